"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, name, reliable, table, with_fields
from foliospark.llm.components import connected_components

#: The 64 bits in three blocks (first bit, width): with two differing bits at
#: most, one block at least is equal. A wider budget needs more blocks.
BLOCKS = ((42, 22), (21, 21), (0, 21))
BUDGET = len(BLOCKS) - 1
#: Rows of groups that a worker joins together (a larger group stands alone), and of a task.
AT_ONCE, TASK_ROWS = 1 << 20, 1 << 22


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit-wise majority of the XXH64 (seed 42) of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs plus fingerprint long (the 64 bits, signed). Null and wordless texts get 0."""

    @F.arrow_udf("struct<fingerprint:bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, limits = binary_parts(batch)
            whole = data.tobytes()
            out = np.fromiter((fingerprint(whole[a:b], shingle) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)), dtype=np.uint64, count=len(batch))
            yield pa.StructArray.from_arrays([pa.array(out.view(np.int64))], names=["fingerprint"])

    return with_fields(docs, of(name(text).cast("binary")), ["fingerprint"])


def trie_pairs(keys: np.ndarray, groups: np.ndarray, bits: int, budget: int | np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Index pairs of keys of one group that differ in `budget` bits at most.

    keys: sorted by (group, key), of `bits` low bits. A budget of bits + 1
    numbers says how many of the first 0, 1, ... bits may differ. A trie node
    is an index range. All node pairs of one depth advance together: equal bits
    cost nothing, unequal ones cost one, and a pair past the budget is dropped
    with everything below it. A pair of two single keys is settled by all its
    bits at once. None if more than `most` pairs come of it, or are open at a depth.
    """
    allowed = np.broadcast_to(budget, (bits + 1,))
    edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    lo, hi = edges[:-1], edges[1:]
    wide = hi - lo > 1
    a0, a1 = lo[wide], hi[wide]
    b0, b1, cost = a0, a1, np.zeros(len(a0), dtype=np.int64)
    left, right, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    for bit in range(bits - 1, -2, -1):
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= allowed[-1]
            left.append(x[near])
            right.append(y[near])
            found += len(left[-1])
            a0, a1, b0, b1, cost = (v[~single] for v in (a0, a1, b0, b1, cost))
        if most is not None and found + len(a0) > most:
            return None
        if bit < 0 or not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        made = [(a0, am, b0, bm, cost, a0 == a0), (am, a1, bm, b1, cost, a0 == a0), (a0, am, bm, b1, cost + 1, a0 == a0), (am, a1, b0, bm, cost + 1, ~same)]
        a0, a1, b0, b1, cost, ok = (np.concatenate(v) for v in zip(*made, strict=True))
        ok &= (a1 > a0) & (b1 > b0) & (cost <= allowed[bits - bit]) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, cost = (v[ok] for v in (a0, a1, b0, b1, cost))
    if len(a0):  # ranges of equal keys
        each = (a1 - a0) * (b1 - b0)
        if most is not None and found + each.sum() > most:
            return None
        which = np.repeat(np.arange(len(a0)), each)
        step = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        x, y = a0[which] + step // (b1 - b0)[which], b0[which] + step % (b1 - b0)[which]
        once = (a0 != b0)[which] | (x < y)
        left.append(x[once])
        right.append(y[once])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Distinct fingerprints -> links (a, b) between those at most two bits apart.

    Every fingerprint goes to one group for each of its three blocks; in a
    group the trie join walks the other bits. A fingerprint has 2,080
    neighbours at most, so a dense group can't make its square of links.
    """
    value = name(column)
    spread = distinct.select(value.alias("f"), F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (first, width) in enumerate(BLOCKS)))).alias("at"))
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(BLOCKS) * distinct.count() // TASK_ROWS)
    dealt = spread.select("f", "at.block", "at.value").repartition(parts, "block", "value").sortWithinPartitions("block", "value")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, as many at once as have AT_ONCE rows."""
        held: list[tuple[np.ndarray, ...]] = []
        size, enough = 0, AT_ONCE
        for batch in batches:
            rows = tuple(c.to_numpy() for c in batch.columns)
            held.append(rows)
            size += len(rows[0])
            if size < enough:
                continue
            f, block, value = (np.concatenate(v) for v in zip(*held, strict=True))
            last = int(np.argmax((block == block[-1]) & (value == value[-1])))  # the last group may go on
            if last:
                yield from close(f[:last], block[:last])
            held, size = [(f[last:], block[last:], value[last:])], len(f) - last
            enough = max(AT_ONCE, 2 * size)
        if held:
            yield from close(*(np.concatenate(v) for v in list(zip(*held, strict=True))[:2]))

    def close(f: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        f = f.view(np.uint64)
        for k, (first, width) in enumerate(BLOCKS):
            own = np.unique(f[block == k])
            # turn the block to the top, so that its groups are runs and the rest are the low bits
            turn, bits = np.uint64((64 - first - width) % 64), 64 - width
            turned = np.sort((own << turn) | (own >> (np.uint64(64) - turn)) if turn else own)
            x, y = trie_pairs(turned & np.uint64((1 << bits) - 1), turned >> np.uint64(bits), bits, BUDGET)
            back = (turned >> turn) | (turned << (np.uint64(64) - turn)) if turn else turned
            for i in range(0, len(x), 100_000):
                yield pa.record_batch([pa.array(back[z[i : i + 100_000]].view(np.int64)) for z in (x, y)], names=["a", "b"])

    return dealt.mapInArrow(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (long), component_id.

    Documents with equal fingerprints, or fingerprints two bits apart or less,
    are linked; component_id is the smallest doc_id reachable (null if all are
    null). Null and empty texts share fingerprint 0 and are linked like any
    other. Repeated rows each get their row. Copies collapse to one fingerprint
    before anything is compared, so the size of a group of copies costs nothing.
    """
    narrow = docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"))
    prints = reliable(fingerprints(narrow, "text", shingle).drop("text"))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fingerprint")
    least = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    best = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = least.join(best, "root").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by three-word shingles at two differing bits: near_duplicates, the fingerprint in hexadecimal.

    Null, empty and wordless texts have fingerprint zero and are linked like
    any other; repeated rows each get their row; an empty table gives none.
    """
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
