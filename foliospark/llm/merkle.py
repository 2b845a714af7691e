"""A Merkle manifest of a dataset: every row a leaf, a tree for each group, and one tree over the groups' roots.

Leaves of a group are dealt in order to aligned blocks of FANOUT ** LEVELS; a
block hashes the levels inside it alone. Blocks then meet in a butterfly: in
round r, those that differ in digit r of their number only (base FANOUT) swap
the roots of their subtrees, and each of them hashes the parent. So every
block learns its ancestors and their siblings on the way up, and no pass goes
down again. Groups' roots meet in the same way.

A proof is a list of levels from the leaf to the root, each with the hashes
before and after the node in its run; fold() climbs it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.llm.common import SQL_CRC_TABLE, name, packed, reliable, sql_crc32, stored, table, unpacked
from foliospark.llm.mixing import running

FANOUT, LEVELS = 8, 4
LEVEL = "struct<before:string,after:string>"
FIELDS = ("subroot", "root", "proof")
#: The fields of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the values, each `-` if null, else its length in UTF-8 bytes, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, level: F.sha2(F.concat(level["before"], h, level["after"]), 256))


def proof_hash(proof: Column) -> Column:
    """Hex SHA-256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: F.array(level["before"], level["after"]))), ""), 256)


def climb(leaves: list[str], most: int | None, fanout: int = FANOUT) -> list[list[str]]:
    """The levels over leaves, themselves first: `most` more, or as many as leave one node."""
    levels = [leaves]
    while len(levels) <= most if most is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return levels


def placed(rows: DataFrame, size: int) -> DataFrame:
    """(row, tree, by, leaf) -> plus block, at (place in the block) and blocks (of the tree).

    Rows are sorted over all tasks; a tree's places start in each range where
    the ranges before it ended, so no tree has to be in one task.
    """
    order = [F.col("by").asc_nulls_first(), F.col("leaf")]
    ranged = stored(rows.orderBy("tree", *order).withColumn("range", F.spark_partition_id()))
    counts = reliable(ranged.groupBy("range", "tree").agg(F.count("*").alias("n")))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", "tree", before.alias("start"), F.ceil(F.sum("n").over(tree) / size).alias("blocks"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("range", "tree").orderBy(*order)) - 1
    numbered = ranged.join(starts, ["range", "tree"]).withColumn("place", place)
    return numbered.select("row", "tree", "leaf", F.expr(f"place DIV {size}").alias("block"), F.expr(f"CAST(place % {size} AS INT)").alias("at"), "blocks")


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, block, blocks, root) -> (tree, block, root of the tree, uppers: the block's proof).

    Where a tree's last run is short, places up to the next full group take
    part without a root of their own (fewer than there are blocks), so that
    every block finds a partner under each of its siblings.
    """
    most = nodes.agg(F.max("blocks")).collect()[0][0] or 0
    # the width of the topmost group: the largest power of fanout below the number of blocks
    width, powers = F.lit(1).cast("bigint"), 1
    while powers < most:
        width = F.when(F.col("blocks") > powers, F.lit(powers).cast("bigint")).otherwise(width)
        powers *= fanout
    full = F.ceil(F.col("blocks") / width) * width
    last = nodes.where(F.col("block") == F.col("blocks") - 1)
    ghosts = last.where(full > F.col("blocks")).select("tree", F.explode(F.sequence(F.col("blocks"), full - 1)).alias("block"), "blocks", F.lit(None).cast("string").alias("root"))
    state = nodes.select("tree", "block", "blocks", "root").unionByName(ghosts).withColumn("uppers", F.expr(f"CAST(array() AS ARRAY<{LEVEL}>)"))
    step = 1
    while step < most:
        still = F.col("blocks") > step
        digit = F.expr(f"CAST(block DIV {step} % {fanout} AS INT)")
        met = state.where(still).groupBy("tree", "blocks", F.expr(f"block DIV {step * fanout}").alias("group"), F.expr(f"block % {step}").alias("low"))
        met = met.agg(F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "block", "root", "uppers"))).alias("m"))  # fanout at most
        of = lambda rule: F.array_join(F.transform(F.filter("m", rule), lambda x: x["root"]), "")
        has = F.exists("m", lambda x: x["root"].isNotNull())
        met = met.withColumn("parent", F.when(has, F.sha2(of(lambda x: F.lit(True)), 256)))
        got = F.transform("m", lambda own: F.struct(own["block"].alias("block"), F.concat(own["uppers"], F.array(F.struct(of(lambda x: x["digit"] < own["digit"]).alias("before"), of(lambda x: x["digit"] > own["digit"]).alias("after")))).alias("uppers")))
        met = met.select("tree", "blocks", F.col("parent").alias("root"), F.explode(got).alias("own"))
        state = reliable(met.select("tree", "own.block", "blocks", "root", "own.uppers").unionByName(state.where(~still)))
        step *= fanout
    return state.where(F.col("block") < F.col("blocks")).select("tree", "block", "root", "uppers")


def prove(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves plus subroot (of the row's group), root (of all) and proof (array of levels).

    leaf holds hex hashes. Rows of a group ascend by order, nulls first, then
    by leaf; groups ascend by their text in UTF-8 bytes, the null group first.
    Repeated rows are leaves of their own. Columns named like the results give
    way, an empty table gives none, rows without a leaf are an error.
    """
    own = [c for c in leaves.columns if c not in FIELDS]
    whole = packed(leaves.select(*map(name, own)), group, order, leaf)
    tree = F.coalesce(F.concat(F.lit("s"), name(group).cast("string")), F.lit("n"))
    known = F.coalesce(name(leaf), F.raise_error(F.lit("a row has no leaf")).cast("string"))
    rows = stored(placed(whole.select("row", tree.alias("tree"), name(order).alias("by"), known.alias("leaf")), fanout**levels))

    def climbed(part: pa.Table) -> list[list[str]]:
        """A block's levels; only a tree of one block ends where one node is left."""
        return climb(part.column("leaf").to_pylist(), None if part.column("blocks")[0].as_py() == 1 else levels, fanout)

    def top(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        return pa.table({c: part.column(c).slice(0, 1) for c in ("tree", "block", "blocks")} | {"root": pa.array([climbed(part)[-1][0]])})

    blocks = rows.select("tree", "block", "blocks", "at", "leaf").groupBy("tree", "block").applyInArrow(top, "tree string, block bigint, blocks bigint, root string")
    inner = reliable(butterfly(reliable(blocks), fanout))
    groups = inner.where("block = 0").select("tree", F.col("root").alias("subroot"))
    numbered = reliable(running(groups, [F.col("tree")], {"block": F.lit(1).cast("bigint")}))
    numbered = numbered.select(F.lit("").alias("tree"), "block", F.lit(numbered.count()).cast("bigint").alias("blocks"), F.col("subroot").alias("root"), F.col("tree").alias("of"))
    outer = butterfly(numbered, fanout).select("block", F.col("root").alias("top"), F.col("uppers").alias("last"))
    outer = numbered.join(outer, "block").select(F.col("of").alias("tree"), "top", "last")
    uppers = inner.join(outer, "tree").select("tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("uppers", "last").alias("uppers"))

    schema = StructType([rows.schema["row"]]).add("subroot", "string").add("root", "string").add("proof", uppers.schema["uppers"].dataType)

    def spread(part: pa.Table, above: pa.Table) -> pa.Table:
        """Each leaf's levels inside the block, then those that the block learned."""
        part = part.sort_by("at")
        nodes = climbed(part)
        over = above.column("uppers")[0].as_py()
        before: list[str] = []
        after: list[str] = []
        for i in range(part.num_rows):
            for level in nodes[:-1]:
                first = i - i % fanout
                before.append("".join(level[first:i]))
                after.append("".join(level[i + 1 : first + fanout]))
                i //= fanout
            before += [x["before"] for x in over]
            after += [x["after"] for x in over]
        each = len(nodes) - 1 + len(over)
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, each * part.num_rows + 1, each) if each else [0] * (part.num_rows + 1), pa.int32()), pairs)
        one = lambda c: pa.array([above.column(c)[0].as_py()] * part.num_rows, pa.string())
        return pa.table({"row": part.column("row"), "subroot": one("subroot"), "root": one("root"), "proof": proof})

    done = rows.groupBy("tree", "block").cogroup(uppers.groupBy("tree", "block")).applyInArrow(spread, schema)
    return done.select(*unpacked(own), *FIELDS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a leaf of its language's tree, and which of the tampered ones no longer verify.

    A null doc_id is the first of its language and is not tampered with;
    repeated rows are leaves each; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    values = [F.col(c) for c in LEAF]
    folds_from = F.when(tampered, leaf_hash(*values[:-1], lowered)).otherwise(leaf_hash(*values))
    leaves = docs.select("doc_id", "lang", leaf_hash(*values).alias("leaf"), folds_from.alias("now"))
    proven = prove(leaves, "lang", "doc_id").withColumn("folded_root", fold(F.col("now"), F.col("proof")))
    return proven.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_sql(levels: int = 8) -> str:
    """The query in DuckDB SQL, for trees of up to FANOUT ** levels leaves, levels unrolled."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, LEAF[:-1]), field(text)]) + ")"
    parts = [
        SQL_CRC_TABLE,
        f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {sql_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS now FROM documents, crc_table)",
        # a row number of its own, as rows may repeat
        "a0 AS (SELECT *, coalesce('s' || lang, 'n') AS tree, row_number() OVER () AS id FROM leaves)",
        "n0 AS (SELECT id AS leaf_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM a0)",
        "m0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM n0)",
        "p0 AS (SELECT leaf_id, tree, i, CAST([] AS STRUCT(b VARCHAR, a VARCHAR)[]) AS proof FROM n0)",
    ]
    tops = ["SELECT tree, h FROM m0 WHERE n = 1"]

    def level(k: str, last: str, nodes: str, proofs: str) -> list[str]:
        """One level up: nodes above, and proofs with what stands beside each node; nodes alone in their tree stay where they are."""
        runs = f"r{k} AS (SELECT tree, i // {FANOUT} AS i, list(h ORDER BY i) AS hs FROM {nodes} WHERE n > 1 GROUP BY ALL)"
        up = f"m{k} AS (SELECT tree, i, sha256(array_to_string(hs, '')) AS h, count(*) OVER (PARTITION BY tree) AS n FROM r{k})"
        beside = f"{{'b': array_to_string(hs[:p.i % {FANOUT}], ''), 'a': array_to_string(hs[p.i % {FANOUT} + 2:], '')}}"
        proof = f"p{k} AS (SELECT leaf_id, p.tree, p.i // {FANOUT} AS i, CASE WHEN r.hs IS NULL THEN proof ELSE list_append(proof, {beside}) END AS proof FROM {proofs} p LEFT JOIN r{k} r ON r.tree = p.tree AND r.i = p.i // {FANOUT})"
        return [runs, up, proof]

    for k in range(1, levels + 1):
        parts += level(str(k), str(k - 1), f"m{k - 1}", f"p{k - 1}")
        tops.append(f"SELECT tree, h FROM m{k} WHERE n = 1")
    parts += [
        "subroots AS (" + " UNION ALL ".join(tops) + ")",
        "mu0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, h, count(*) OVER () AS n FROM subroots)",
        "pu0 AS (SELECT tree AS leaf_id, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, CAST([] AS STRUCT(b VARCHAR, a VARCHAR)[]) AS proof FROM subroots)",
    ]
    tops = ["SELECT h FROM mu0 WHERE n = 1"]
    for k in range(1, levels + 1):
        parts += level(f"u{k}", f"u{k - 1}", f"mu{k - 1}", f"pu{k - 1}")
        tops.append(f"SELECT h FROM mu{k} WHERE n = 1")
    parts += [
        "whole AS (" + " UNION ALL ".join(tops) + ")",
        f"proven AS (SELECT a0.*, s.h AS subroot, w.h AS root, list_concat(p.proof, u.proof) AS proof FROM a0 JOIN p{levels} p ON p.leaf_id = a0.id JOIN subroots s ON s.tree = a0.tree JOIN pu{levels} u ON u.leaf_id = a0.tree CROSS JOIN whole w)",
        "folded AS (SELECT *, list_reduce(list_prepend({'b': '', 'a': now}, proof), lambda h, l: {'b': '', 'a': sha256(l.b || h.a || l.a)}).a AS folded_root FROM proven)",
    ]
    return "WITH " + ", ".join(parts) + " SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda l: l.b || l.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"
