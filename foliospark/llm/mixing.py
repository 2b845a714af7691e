"""Mixing sources to target weights, with DataFrame and SQL functions only.

Documents fall by hash into BLOCKS blocks for each source. A source's target
in words becomes an exact quota of block takes: every block once for each full
pass over the source, and then blocks in a permuted order until the target is
met, the last of them in part. A multivariate-hypergeometric splitting tree
deals the quotas to the output shards: each node halves its shards and draws
how many takes of each source go left, as a random split of that node's takes
would have it. A shard then owns a run of each source's permuted takes, runs
being disjoint, and orders its own rows by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, name, reliable, table

BLOCKS = 512
WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
SHARDS = 16
#: Sources dealt to shards by one tree, and the bits that part a block's documents into ranges.
FAMILY, RANGES = 1024, 12
SEED = 20240229
#: Rows of the block table up to which it is sent to every task (about 20 MB).
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows plus, by each name in sums, the column's sum over all rows before in the order, which must be a total one.

    Rows are sorted over all tasks; each task runs over its own range, from
    what the ranges before it hold: a row for each task is all that meets.
    """
    ranged = reliable(rows.orderBy(*order).withColumn("range", F.spark_partition_id()))
    whole = ranged.groupBy("range").agg(*(F.sum(c).alias(f"{n}_all") for n, c in sums.items()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = whole.select("range", *(F.coalesce(F.sum(f"{n}_all").over(earlier), F.lit(0)).alias(f"{n}_start") for n in sums))
    mine = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = ranged.join(F.broadcast(start), "range")  # a row for each task
    return made.select(*(name(c) for c in rows.columns), *((F.col(f"{n}_start") + F.coalesce(F.sum(c).over(mine), F.lit(0))).alias(n) for n, c in sums.items()))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) -> plus place (from 0, code point order, null last), weight and target.

    Targets share the total by weight; what lies above most * source_size is
    reshared by weight until none is above. With sources ordered by limit per
    unit of weight, those that stop are the first ones, so one running sum
    finds the level.
    """
    numbered = running(sizes, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1).cast("bigint")})
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    numbered = numbered.withColumn("limit", most * F.col("source_size").cast("double"))
    ranked = reliable(running(numbered, [F.col("limit") / F.col("weight"), F.col("place")], {"limits": F.col("limit"), "weights": F.col("weight")}))
    total = ranked.agg(F.sum("source_size").alias("size_all"), F.sum("weight").alias("weight_all"))  # one row
    level = (F.col("size_all") - F.col("limits")) / (F.col("weight_all") - F.col("weights"))
    ranked = ranked.crossJoin(F.broadcast(total)).withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    # the first source that doesn't stop has the largest level among those that fit
    shared = ranked.agg(F.max(fits).alias("shared"))  # one row
    ranked = ranked.crossJoin(F.broadcast(shared))
    return ranked.select("source", "source_size", "place", "weight", F.least("limit", F.coalesce(F.col("shared") * F.col("weight"), F.lit(0.0))).alias("target"))


def _draw(n: str, k: str, take: str, u: str) -> str:
    """SQL: a hypergeometric draw, k marked among n and `take` taken, by inverting the distribution at u.

    The log-probabilities come from the ratio of neighbours, scaled by their
    largest, in three folds over the support.
    """
    step = f"(ln(CAST(({k} - x + 1) * ({take} - x + 1) AS DOUBLE)) - ln(CAST(x * ({n} - {k} - {take} + x) AS DOUBLE)))"
    low, high = f"greatest(0L, {take} - ({n} - {k}))", f"least({take}, {k})"
    return f"""transform(array(named_struct('lo', {low}, 'hi', {high})), s -> transform(array(CASE WHEN s.hi > s.lo THEN sequence(s.lo + 1, s.hi) ELSE CAST(array() AS ARRAY<BIGINT>) END), xs ->
      transform(array(aggregate(xs, named_struct('p', 0D, 'top', 0D), (a, x) -> named_struct('p', a.p + {step}, 'top', greatest(a.top, a.p + {step})), a -> a.top)), top ->
      transform(array(aggregate(xs, named_struct('p', 0D, 'sum', exp(-top)), (a, x) -> named_struct('p', a.p + {step}, 'sum', a.sum + exp(a.p + {step} - top)), a -> a.sum * {u})), goal ->
      aggregate(xs, named_struct('p', 0D, 'sum', exp(-top), 'pick', s.lo), (a, x) -> named_struct('p', a.p + {step}, 'sum', a.sum + exp(a.p + {step} - top), 'pick', CASE WHEN a.sum < goal THEN x ELSE a.pick END), a -> a.pick)
      )[0])[0])[0])[0]"""


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (id, quotas array<bigint>, sizes array<bigint>, one for each shard) -> (id, shard, quotas), a row for each shard.

    The sums of quotas and of sizes are equal. Each shard of a row gets as many
    takes as its size says, and each quota's shares sum to it.
    """
    nodes = quotas.select("id", F.lit(0).alias("first"), F.lit(shards).alias("width"), "quotas", "sizes")
    while shards > 1:
        u = f"(pmod(xxhash64({seed}, id, first, width, i), 9007199254740992L) / 9007199254740992D)"
        total = "aggregate(quotas, 0L, (a, q) -> a + q)"
        # sources in turn: how many of the remaining left seats this source gets
        left = f"""aggregate(sequence(0, size(quotas) - 1), named_struct('n', {total}, 'take', aggregate(slice(sizes, 1, half), 0L, (a, q) -> a + q), 'out', CAST(array() AS ARRAY<BIGINT>)),
            (acc, i) -> transform(array({_draw("acc.n", "quotas[i]", "acc.take", u)}), got -> named_struct('n', acc.n - quotas[i], 'take', acc.take - got, 'out', concat(acc.out, array(got))))[0], acc -> acc.out)"""
        split = nodes.withColumn("half", F.expr("CAST(width DIV 2 AS INT)"))
        split = split.withColumn("left", F.when(F.col("width") > 1, F.expr(left)).otherwise(F.col("quotas")))
        nodes = split.select(
            "id",
            F.explode(
                F.expr("""CASE WHEN width > 1 THEN array(named_struct('first', first, 'width', half, 'quotas', left, 'sizes', slice(sizes, 1, half)),
                    named_struct('first', first + half, 'width', width - half, 'quotas', zip_with(quotas, left, (q, l) -> q - l), 'sizes', slice(sizes, half + 1, width - half)))
                    ELSE array(named_struct('first', first, 'width', width, 'quotas', quotas, 'sizes', sizes)) END""")
            ).alias("n"),
        ).select("id", "n.first", "n.width", "n.quotas", "n.sizes")
        shards = (shards + 1) // 2
    return nodes.select("id", F.col("first").alias("shard"), "quotas")


def deal_quotas(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(place from 0, quota) -> (place, shard, share): the shards' sizes differ by one take at most.

    One tree deals groups of FAMILY sources, and one for each group deals its
    sources to what the group got: no row holds all sources.
    """
    family = F.floor(F.col("place") / FAMILY).cast("bigint")
    listed = lambda by, what: F.transform(F.sort_array(F.collect_list(F.struct(by, what))), lambda x: x[what])
    groups = counts.groupBy(family.alias("group")).agg(F.sum("quota").alias("quota"), listed("place", "quota").alias("quotas"))
    groups = reliable(groups)
    top = groups.agg(F.sum("quota").alias("total"), listed("group", "quota").alias("quotas"))
    each = F.expr(f"transform(sequence(0, {shards} - 1), k -> total * (k + 1) DIV {shards} - total * k DIV {shards})")
    of_groups = splitting_tree(top.select(F.lit(-1).cast("bigint").alias("id"), "quotas", each.alias("sizes")), shards, seed)
    of_groups = of_groups.select("shard", F.posexplode("quotas").alias("group", "share"))
    sizes = of_groups.groupBy("group").agg(listed("shard", "share").alias("sizes"))
    leaves = splitting_tree(groups.join(sizes, "group").select(F.col("group").alias("id"), "quotas", "sizes"), shards, seed)
    return leaves.select("id", "shard", F.posexplode("quotas").alias("at", "share")).select((F.col("id") * FAMILY + F.col("at")).alias("place"), "shard", "share")


def block_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, block, at, size) of all documents -> what each (source, block) gives to the mix.

    passes: full copies of the block. more: 2 if the whole block is taken once
    more, 1 if only documents before cut_at are, with cut_words of the one at
    cut_at (whose rows have cut_size words), else 0. shards: one for each take.
    """
    blocks = reliable(sized.groupBy("source", "block").agg(F.sum("size").alias("words")))
    plan = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goal = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = reliable(plan.withColumn("passes", passes).withColumn("rest", F.when(F.col("source_size") > 0, goal - F.col("passes") * F.col("source_size")).otherwise(F.lit(0)).cast("bigint")))
    p, b = plan.alias("p"), blocks.alias("b")
    joined = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source"))).select("p.*", "b.block", "b.words")
    permuted = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), "place", "block"), "block")
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = joined.withColumn("before", before)
    joined = joined.withColumn("more", F.when((F.col("words") == 0) | (F.col("before") >= F.col("rest")), 0).when(F.col("before") + F.col("words") <= F.col("rest"), 2).otherwise(1))
    joined = reliable(joined)
    # the one block of a source that is taken in part, by the order of its documents: first by RANGES of them, then in the one range
    parted = joined.where("more = 1").select("source", "block", "place", (F.col("rest") - F.col("before")).alias("room"))
    before = Window.partitionBy("place").rowsBetween(Window.unboundedPreceding, -1)
    span = F.shiftright("at", 64 - RANGES)

    def inside(part: DataFrame, key: Column, order: str) -> DataFrame:
        """The documents of the parted blocks, or of one range in each, summed by a key, and what comes before each key."""
        s, q = sized.withColumn("span", span).alias("s"), part.alias("q")
        on = F.col("s.source").eqNullSafe(F.col("q.source")) & (F.col("s.block") == F.col("q.block"))
        if "span" in part.columns:
            on = on & (F.col("s.span") == F.col("q.span"))
        found = s.join(q, on).groupBy("q.source", "q.block", "q.place", "q.room", key.alias(order)).agg(F.sum("s.size").alias("size"))
        run = F.coalesce(F.sum("size").over(before.orderBy(order)), F.lit(0))
        return found.withColumn("run", run).where("size > 0 and run < room and run + size >= room")

    ranges = reliable(inside(parted, F.col("s.span"), "span").select("source", "block", "place", "span", (F.col("room") - F.col("run")).alias("room")))
    cut = inside(ranges, F.col("s.at"), "at").select("place", "block", F.col("at").alias("cut_at"), (F.col("room") - F.col("run")).alias("cut_words"), F.col("size").alias("cut_size"))
    joined = joined.join(cut, ["place", "block"], "left")
    # takes to shards
    takes = joined.select("place", "block", F.explode(F.expr("CASE WHEN passes + CAST(more > 0 AS INT) > 0 THEN sequence(1L, passes + CAST(more > 0 AS INT)) ELSE CAST(array() AS ARRAY<BIGINT>) END")).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed + 1), "place", "block", "copy"), "block", "copy")) - 1
    takes = takes.withColumn("rank", rank)
    counts = plan.select("place").join(takes.groupBy("place").agg(F.count("*").alias("quota")), "place", "left").select("place", F.coalesce("quota", F.lit(0)).alias("quota"))
    leaves = deal_quotas(counts, shards, seed)
    ends = leaves.withColumn("end", F.sum("share").over(Window.partitionBy("place").orderBy("shard"))).groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    dealt = takes.join(ends, "place").select("place", "block", "copy", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    dealt = dealt.groupBy("place", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    return joined.join(dealt, ["place", "block"], "left").select("source", "source_size", "target", "block", "passes", "more", "cut_at", "cut_words", "cut_size", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, whole: bool = False, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs plus size, source_size, target, taken and copies array<struct<shard,words>>.

    Sources by code point, null last (null is a source of its own), have the
    weights in turn. taken sums the words of the copies; a source's sum meets
    its rounded target, as the one document at the end is taken in part, or,
    with whole, as a whole if that is nearer. Empty and null texts have size 0
    and no words; rows that repeat an id and text are taken alike. Input
    columns with the names returned give way. The result is the same on reruns.
    """
    made = ("size", "source_size", "target", "taken", "copies")
    own = [c for c in docs.columns if c not in made]
    key, at = name(source), F.xxhash64(F.lit(seed), name(doc_id), F.length(name(text)))
    tagged = docs.select(F.struct(*(name(c) for c in own)).alias("row"), key.cast("string").alias("source"), F.pmod(F.xxhash64(F.lit(seed + 2), name(doc_id)), F.lit(BLOCKS)).alias("block"), at.alias("at"), words(name(text)).alias("size"))
    sized = reliable(tagged.select("source", "block", "at", "size"))
    plan = reliable(block_plan(sized, weights, most, shards, seed))
    small = plan.count() <= BROADCAST_ROWS
    t, p = tagged.alias("t"), (F.broadcast(plan) if small else plan).alias("p")
    joined = t.join(p, F.col("t.source").eqNullSafe(F.col("p.source")) & (F.col("t.block") == F.col("p.block")))
    size, part = F.col("t.size"), F.col("p.cut_words")
    last = F.floor(part * size / F.col("p.cut_size")) if not whole else F.when(2 * part >= F.col("p.cut_size"), size).otherwise(F.lit(0))
    extra = F.when(F.col("more") == 2, size).when((F.col("more") == 1) & (F.col("t.at") < F.col("cut_at")), size).when((F.col("more") == 1) & (F.col("t.at") == F.col("cut_at")), last).otherwise(F.lit(0)).cast("bigint")
    amounts = F.transform("shards", lambda shard, i: F.struct(shard.alias("shard"), F.when(i < F.col("passes"), size).otherwise(extra).alias("words")))
    copies = F.filter(amounts, lambda x: x["words"] > 0)
    return joined.select(*(F.col("row").getField(c).alias(c) for c in own), size.alias("size"), F.col("source_size").cast("bigint").alias("source_size"), "target", (F.col("passes") * size + extra).cast("bigint").alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, whole: bool = True, seed: int = SEED, **options) -> DataFrame:
    """The mixed rows: docs' columns plus shard, copy (from 0), copy_words and turn.

    A document stands once for each copy that the mix takes of it. turn is the
    order in a shard; writers sort by (shard, turn).
    """
    made = ("shard", "copy", "copy_words", "turn")
    own = [c for c in docs.columns if c not in made]
    plan = mix_plan(docs.select(*(name(c) for c in own)), doc_id, text, source, whole=whole, seed=seed, **options)
    rows = plan.select(*(name(c) for c in own), F.posexplode("copies").alias("copy", "taken_copy"))
    return rows.select(*(name(c) for c in own), F.col("taken_copy.shard").alias("shard"), "copy", F.col("taken_copy.words").alias("copy_words"), F.xxhash64(F.lit(seed + 3), name(doc_id), "copy").alias("turn"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the mix of all documents, a row for each; nulls, ties, repeats and empty tables as mix_plan says."""
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda x: x["shard"]).alias("shards"))
