"""Near copies by the overlap of word shingles: SimHash candidates, each checked exactly.

Two texts whose shingle sets overlap by 0.8 differ in 15% of SimHash bits, more
than one fingerprint's trie join can bridge. So a text gets PRINTS fingerprints,
and each of their blocks is a chance: texts that agree in a block meet in one
group, where the trie join walks the other bits and drops a pair as soon as it
differs more than similar texts would. What is left is settled by the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, give_back, list_array, name, packed, reliable, unpacked, with_fields
from foliospark.llm.components import connected_components
from foliospark.llm.simhash import trie_pairs

SHINGLE, SIMILAR = 5, 0.8
#: Fingerprints of a text, bits of a block, and blocks of a fingerprint. At 0.8 a block agrees with a chance of 0.037,
#: one of all 120 with 0.99. A bit more halves the groups and costs 15% of that chance.
PRINTS, BLOCK, PER = 40, 20, 3
REST = 64 - BLOCK
SEED = 17
#: Bits that may differ by the depth in the trie: the mean at SIMILAR and two and a half standard deviations, two at least.
_MISS = np.arccos(2 * SIMILAR / (1 + SIMILAR)) / np.pi
_DEPTH = np.arange(REST + 1)
BUDGETS = np.maximum(np.floor(_MISS * _DEPTH + 2.5 * np.sqrt(_MISS * (1 - _MISS) * _DEPTH)), 2).astype(np.int64)
#: Rows of a group that are walked at once, and rows of a part of a larger group; the shingles of a part.
CELL, HELD = 4096, 1_000_000
#: Pairs for each row of a group from which on it is dense: then its texts are compared where they meet, not pair by pair.
DENSE = 1
#: Groups of 15 shingles hashed at once.
ROWS = 1 << 9
_rng = np.random.default_rng(SEED)
FLIPS, FACTORS = (_rng.integers(0, 1 << 64, size=PRINTS, dtype=np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
STEP = np.uint64(_rng.integers(0, 1 << 64, dtype=np.uint64)) | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of all word shingles, ascending; fewer words are one shingle, no words none."""
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    of_words = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = (total ^ of_words[k : k + n]) * STEP
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _added(words: list[np.ndarray]) -> list[np.ndarray]:
    """Bit-wise sums of 15 words: words whose bits weigh 1, 2, 4 and 8, by full adders."""
    out, carried = [], words
    while carried:
        words, carried = carried, []
        while len(words) > 2:
            a, b, c = words[-3:]
            either = a ^ b
            carried.append((a & b) | (either & c))
            words = [*words[:-3], either ^ c]
        out += words
    return out


def prints(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, PRINTS) fingerprints: in each bit the majority of the text's shingles."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ones = np.zeros((len(sets), PRINTS, 64), dtype=np.int32)
    seats = -(-sizes // 15) * 15
    whole, real = np.zeros(int(seats.sum()), dtype=np.uint64), np.zeros(int(seats.sum()), dtype=bool)
    for at, h in zip((np.cumsum(seats) - seats).tolist(), sets, strict=True):
        whole[at : at + len(h)] = h
        real[at : at + len(h)] = True
    owner = np.repeat(np.arange(len(sets)), seats // 15)
    for i in range(0, len(owner), ROWS):
        part, own = slice(15 * i, 15 * (i + ROWS)), owner[i : i + ROWS]
        fresh = np.concatenate(([True], own[1:] != own[:-1]))
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        heads = np.flatnonzero((np.arange(len(own)) - first) % 255 == 0)
        x = (whole[part, None] ^ FLIPS) * FACTORS
        x ^= x >> np.uint64(32)
        x[~real[part]] = 0
        x = x.reshape(-1, 15, PRINTS)
        for k, word in enumerate(_added([x[:, j] for j in range(15)])):
            for s in range(8):
                lanes = np.add.reduceat((word >> np.uint64(s)) & _LANES, heads, axis=0)
                np.add.at(ones, (own[heads], slice(None), slice(s, 64, 8)), lanes.view(np.uint8).reshape(len(heads), PRINTS, 8).astype(np.int32) << k)
    return np.packbits(2 * ones > sizes[:, None, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def _each(kind: str):
    """text -> copy (a hash of the lower-cased words, 0 without any) and its prints or its shingles."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, limits = binary_parts(batch)
            whole, copies, lists, made = data.tobytes(), np.zeros(len(batch), dtype=np.uint64), [], []
            for i, (a, b) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)):
                words = whole[a:b].lower().split()
                copies[i] = xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
                lists.append(shingles(words))
                if kind == "prints" and len(lists) == 64:
                    made.append(prints(lists))
                    lists = []
            if kind == "prints":
                values = np.concatenate([*made, prints(lists)]) if lists or made else np.zeros((0, PRINTS), dtype=np.uint64)
                lists = list(values)
            flat = pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *lists]).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(copies.view(np.int64)), list_array(flat, [len(v) for v in lists])], names=["copy", kind])
            del batch, data, whole, lists, made, flat
        give_back()

    return F.arrow_udf(of, f"struct<copy:bigint,{kind}:array<bigint>>")


def _turned(value, turn: int):
    """value with its bits from `turn` on brought to the top."""
    return F.shiftleft(value, turn).bitwiseOR(F.shiftrightunsigned(value, 64 - turn)) if turn else value


def _groups(slot: np.ndarray, rot: np.ndarray, copy: np.ndarray, hot: bool = False) -> Iterator[pa.RecordBatch]:
    """Whole groups, sorted -> pairs (slot -1, a, b); the members of dense groups too (slot, a copy, b bits)."""

    def out(slot, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.broadcast_to(np.int32(slot), a.shape)), pa.array(a), pa.array(b)], names=["slot", "a", "b"])

    bits = rot.view(np.uint64)
    group = bits >> np.uint64(REST)
    heads = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (slot[1:] != slot[:-1]))))
    sizes = np.diff(np.concatenate((heads, [len(slot)])))
    many = np.repeat(sizes > 1, sizes)
    slot, rot, copy, bits = slot[many], rot[many], copy[many], bits[many]
    sizes = sizes[sizes > 1]
    if not len(sizes):
        return
    number = np.repeat(np.arange(len(sizes)), sizes)
    found = None if hot else trie_pairs(bits & np.uint64((1 << REST) - 1), number, REST, BUDGETS, DENSE * len(bits) + 4)
    if found is not None:
        a, b = copy[found[0]], copy[found[1]]
        yield out(-1, np.minimum(a, b), np.maximum(a, b))
    elif len(sizes) > 1:
        cut = int(np.cumsum(sizes)[(len(sizes) - 1) // 2])
        for part in (slice(0, cut), slice(cut, None)):
            yield from _groups(slot[part], rot[part], copy[part])
    else:
        least = int(np.argmin(copy))
        close = np.bitwise_count(bits ^ bits[least]) <= BUDGETS[-1]
        close[least] = False
        yield out(-1, np.full(int(close.sum()), copy[least]), copy[close])
        yield pa.record_batch([pa.array(slot), pa.array(copy), pa.array(rot)], names=["slot", "a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot and bits, a run of whole groups at a time; a long group passes in parts, as a dense one."""
    held: list[np.ndarray] | None = None
    hot = False
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "rot", "copy")]
        if not len(rows[0]):
            continue
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        key = (rows[1].view(np.uint64) >> np.uint64(REST)) + (rows[0].astype(np.uint64) << np.uint64(BLOCK))
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        first, last = (int(cuts[0]), int(cuts[-1])) if len(cuts) else (len(key), 0)
        if hot and last:  # the rest of a group whose parts have gone
            yield from _groups(*(x[:first] for x in rows), hot=True)
            rows, hot, last = [x[first:] for x in rows], False, last - first
        if last:
            yield from _groups(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
        if len(held[0]) > 2 * CELL:
            yield from _groups(*held, hot=True)
            held, hot = [x[:1] for x in held], True
    if held is not None:
        yield from _groups(*held, hot=hot)
    give_back()


def candidates(distinct: DataFrame) -> DataFrame:
    """(copy, prints) -> (slot, a, b): pairs a, b with slot -1, and the members of dense groups with a copy a and bits b.

    A group is dense if more pairs would come of it than DENSE for each row:
    there, only pairs with its least member come now.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("copy", F.posexplode("prints").alias("no", "f"))
    turns = F.array(*(F.struct((F.col("no") * PER + k).alias("slot"), _turned(F.col("f"), k * BLOCK).alias("rot")) for k in range(PER)))
    dealt = spread.select("copy", F.explode(turns).alias("t")).select("t.slot", "t.rot", "copy")
    dealt = dealt.repartition(parts, "slot", F.shiftrightunsigned("rot", REST)).sortWithinPartitions("slot", "rot", "copy")
    return dealt.mapInArrow(_meet, "slot int, a bigint, b bigint")


def _linked(bits: np.ndarray, label: np.ndarray, flat: np.ndarray, limits: np.ndarray, least: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """Rows of a dense group, their components and their shingles (flat, cut at limits) -> similar rows (i, j), as few as join all that are.

    Rows that came together are not compared again.
    """
    n, sizes = len(bits), np.diff(limits)
    owner = np.repeat(np.arange(n), sizes)
    _, here, times = np.unique(flat, return_inverse=True, return_counts=True)
    here, label = here.reshape(-1), np.unique(label, return_inverse=True)[1].reshape(-1)
    # shingles of many rows are counted by products; of the rarer ones two rows share no more than the one with fewer has
    often = times >= max(2, n / 8)
    held = np.zeros((n, int(often.sum())), dtype=np.float32)
    held[owner[often[here]], (np.cumsum(often) - 1)[here[often[here]]]] = 1
    rare = np.bincount(owner[(times[here] > 1) & ~often[here]], minlength=n)
    mark = np.zeros(len(times), dtype=bool)
    for top in range(0, n - 1, 256):
        both = held[top : top + 256] @ held[top:].T
        for i in range(top, min(top + 256, n - 1)):
            later = slice(i + 1, None)
            enough = both[i - top, i + 1 - top :] + np.minimum(rare[later], rare[i]) >= (least * (sizes[later] + sizes[i]) - 1e-9) / (1 + least)
            enough &= (label[later] != label[i]) & (np.bitwise_count((bits[later] ^ bits[i]).view(np.uint64)) <= BUDGETS[-1])
            other = i + 1 + np.flatnonzero(enough)
            if not len(other):
                continue
            mine = here[limits[i] : limits[i + 1]]
            mark[mine] = True
            for j in other.tolist():
                if label[j] != label[i] and mark[here[limits[j] : limits[j + 1]]].sum() >= (least * (sizes[j] + len(mine)) - 1e-9) / (1 + least):
                    label[label == label[j]] = label[i]
                    yield i, j
            mark[mine] = False


def _between(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar texts (a, b) of dense groups that are in different components; of each two parts of a group as few as join what they join.

    Within a component nothing needs comparing. The rows of a group's largest
    one and the others are dealt into parts of about CELL rows, fewer if texts
    are long; two parts that may hold such a pair meet in a task of their own,
    with their shingles.
    """
    about = sets.select("copy", F.size("shingles").alias("size")).join(roots.withColumnRenamed("node", "copy"), "copy", "left")
    at = members.select("slot", F.shiftrightunsigned("b", REST).alias("value"), F.col("b").alias("rot"), F.col("a").alias("copy")).distinct()
    at = reliable(at.join(about, "copy").withColumn("root", F.coalesce("root", "copy")))
    weight = F.greatest(F.count("*") / CELL, F.sum("size") / HELD)
    sizes = at.groupBy("slot", "value", "root").agg(weight.alias("n"))
    groups = sizes.groupBy("slot", "value").agg(F.max(F.struct("n", "root")).alias("big"), F.sum("n").alias("total"), F.count("*").alias("kinds")).where("kinds > 1")
    count = lambda c: F.greatest(F.ceil(c), F.lit(1)).cast("int")
    groups = groups.select("slot", "value", F.col("big.root").alias("most"), count(F.col("big.n")).alias("inner"), count(F.col("total") - F.col("big.n")).alias("outer"))
    at = at.join(groups, ["slot", "value"]).withColumn("own", F.col("root") == F.col("most"))
    part = F.when(F.col("own"), F.pmod(F.xxhash64("copy"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("copy"), F.col("outer"))).cast("int")
    other = F.explode(F.sequence(F.when(F.col("own"), F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1))
    cells = at.join(sets, "copy").select("slot", "value", "rot", "copy", "root", "shingles", part.alias("part"), other.alias("other"))
    cells = cells.select("slot", "value", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "rot", "copy", "root", "shingles")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        bits, copy, root = (rows.column(c).to_numpy() for c in ("rot", "copy", "root"))
        lists = rows.column("shingles").combine_chunks()
        limits = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
        links = np.array(list(_linked(bits, root, lists.flatten().to_numpy(), limits)), dtype=np.int64).reshape(-1, 2)
        ends = copy[links]
        return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    return cells.groupBy("slot", "value", "x", "y").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets (copy, shingles) have a Jaccard overlap of `least` or more."""
    x = sets.select(F.col("copy").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("copy").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(y, "b").join(x, "a").withColumn("same", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("same") >= F.lit(least) * (F.size("x") + F.size("y") - F.col("same")) - 1e-9).select("a", "b")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy) of all rows, and (copy, no_id, kept_id, kept_copy) of all copies: the first of the copy's component."""
    narrow = docs.select(name(doc_id).alias("doc_id"), name(text).cast("binary").alias("text"))
    prints = reliable(with_fields(narrow, _each("prints")(F.col("text")), ["copy", "prints"]).drop("text"))
    distinct = prints.groupBy("copy").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least"), F.first("prints").alias("prints"))
    found = reliable(candidates(distinct.select("copy", "prints")))
    pairs, members = found.where("slot < 0 and a <> b").select("a", "b"), found.where("slot >= 0")
    # shingles of the texts in any pair or dense group, one for each distinct text
    needed = reliable(found.select(F.col("a").alias("copy")).union(pairs.select("b")).distinct())
    ids = prints.join(needed, "copy", "left_semi").groupBy("copy").agg(F.min("doc_id").alias("wanted")).select("wanted").distinct()
    rows = narrow.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = with_fields(rows.select("text"), _each("shingles")(F.col("text")), ["copy", "shingles"]).drop("text")
    sets = reliable(sets.join(needed, "copy", "left_semi").dropDuplicates(["copy"]))
    # one pair for each text first; of the others only those that are still apart
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    near = reliable(similar(first, sets))
    roots = reliable(connected_components(near))
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    near = reliable(near.union(_between(members, roots, sets)))
    roots = reliable(connected_components(near))
    rest = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
    roots = connected_components(near.union(similar(rest, sets)))
    whole = distinct.select("copy", "least").join(roots.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    best = whole.groupBy("root").agg(F.min(F.struct("least.no_id", "least.doc_id", "copy")).alias("kept"))
    return prints.select("doc_id", "copy"), whole.join(best, "root").select("copy", F.col("kept.doc_id").alias("kept_id"), F.col("kept.copy").alias("kept_copy"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, component_id (the smallest id reachable by similar texts).

    Texts are similar if their sets of five-word shingles (lower-cased, A-Z
    alone) overlap by 0.8 or more (Jaccard). Null and wordless texts are one
    group; equal texts collapse before anything is compared, so repeated rows
    and copies cost nothing. An id of null comes after all others. An empty
    table gives no rows; other columns of docs don't matter.
    """
    rows, kept = _grouped(docs, doc_id, text)
    return rows.join(kept, "copy").select("doc_id", F.col("kept_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold the first document of their group of near copies, all columns as they were.

    The first document has the smallest id, and of several texts under that id
    the one with the least hash; with a null id it is first only where no row
    of the group has an id. Rows that repeat its id and words are the same
    document and stay. Null and wordless texts are one group.
    """
    _, kept = _grouped(docs, doc_id, text)
    first = kept.where("copy = kept_copy").select("kept_id", "kept_copy")
    rows = with_fields(packed(docs, doc_id).withColumn("words", F.col("row").getField(text).cast("binary")), _copies()(F.col("words")), ["copy"])
    return rows.join(first, name(doc_id).eqNullSafe(F.col("kept_id")) & (F.col("copy") == F.col("kept_copy")), "left_semi").select(*unpacked(docs.columns))


def _copies():
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            copies = [xxhash.xxh64_intdigest(b" ".join(w), 42) if (w := (x or b"").lower().split()) else 0 for x in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(np.array(copies, dtype=np.uint64).view(np.int64))], names=["copy"])

    return F.arrow_udf(of, "struct<copy:bigint>")
