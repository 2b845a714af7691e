"""Exact substring de-duplication with suffix arrays, over all documents.

Every window of WINDOW bytes is owned by one anchor: the GRAM bytes in it with
the least hash, so equal windows have equal anchors. Whole copies of a text go
at once; only anchors of two different texts, or found twice in one, can own
another repeated window; the bytes around those, the pieces,
are dealt by the anchor's hash into shards, and a shard's suffix array and
permuted common prefixes tell which of its windows are equal. The first of
equal windows is cleared; all other windows of repeated anchors are repeats.
Texts that hold none are read, and nothing of them is moved but their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, give_back, list_array, name, ranges, reliable, table
from foliospark.llm.suffix_array import common_prefixes, suffix_arrays

WINDOW = 100
GRAM = 32
#: An anchor that occurs more often than this, and more than once in HOT_SHARE of all, has its windows dealt one by
#: one, each by its own hash, so that no shard gathers all pieces of a frequent anchor. There are HOT_SHARE at most
#: (some tens of megabytes).
HOT, HOT_SHARE = 5_000, 1_000_000
#: Bytes of text hashed at once, and of pieces in a suffix array. A row longer
#: than the first is hashed in overlapping parts.
BUFFER, SHARD = 1 << 19, 1 << 19
#: Suffix arrays made together, and bytes of pieces in all of them: frequent anchors make long ones.
AT_ONCE, ALL_AT_ONCE = 8, 1 << 21
#: Bytes of documents for each shard, and for each task that works on shards; MOST_TASKS bounds their number.
SHARD_OF, TASK_OF, MOST_TASKS = 1 << 23, 1 << 25, 100_000
#: Bytes of text whose pieces are gathered at once, equal ones merged.
PART = 1 << 23
LAST = (1 << 63) - 1

_SPOT = np.uint64((1 << 24) - 1)


def _scatter(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _scatter(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _owners(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each run of windows with one anchor; data under 16 MB."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return none.view(np.uint64), none, none
    g, span = _BYTES[data], 1
    while span < GRAM:
        g = g[:-span] * np.uint64(0x9E3779B97F4A7C15) + g[span:]
        g ^= g >> np.uint64(29)
        span *= 2
    g = g * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    low = (g & ~_SPOT) | np.arange(len(g), dtype=np.uint64)
    width, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    ends = limits[1:]
    past = np.zeros(n + 1, dtype=np.int32)
    np.add.at(past, np.maximum(limits[:-1], ends - WINDOW + 1), 1)
    np.add.at(past, ends, -1)
    at = np.flatnonzero(np.cumsum(past)[: len(low)] == 0)
    if not len(at):
        return none.view(np.uint64), none, none
    spot = (low[at] & _SPOT).astype(np.int64)
    cut = np.flatnonzero(spot[1:] != spot[:-1])
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
    return g[spot[first]], at[first], at[last]


def owners(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for any length: hash, first and last window start in data, and the row of each anchor."""
    out = []
    for r0, r1 in ranges(np.diff(limits), BUFFER):
        start, stop = int(limits[r0]), int(limits[r1])
        if r1 - r0 == 1 and stop - start > 2 * BUFFER:
            for at in range(start, stop - WINDOW + 1, BUFFER):
                part = data[at : min(stop, at + BUFFER + WINDOW - 1)]
                h, first, last = _owners(part, np.array([0, len(part)]))
                out.append((h, first + at, last + at, np.full(len(h), r0)))
        else:
            h, first, last = _owners(data[start:stop], limits[r0 : r1 + 1] - start)
            out.append((h, first + start, last + start, np.searchsorted(limits, first + start, side="right") - 1))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none
    h, first, last, row = (np.concatenate(v) for v in zip(*out, strict=True))
    return h, first, last, row


def _anchors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, hash of it) -> its anchors, each with that hash, and once more with another one if the text has it twice."""
    for texts, hashes in batches:
        data, limits = binary_parts(texts)
        h, _, _, row = owners(data, limits)
        # a third time in one text tells nothing more
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        third = np.zeros(len(h), dtype=bool)
        third[2:] = again[2:] & again[1:-1]
        h, row, again = h[~third], row[~third], again[~third]
        whose = hashes.to_numpy(zero_copy_only=False)[row] ^ again
        yield list_array(pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(whose)], names=["h", "whose"]), np.bincount(row, minlength=len(texts)))
    give_back()


def _flat(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _cut(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """key, place, text, common, hot -> the pieces of repeated anchors, packed; equal ones of PART bytes of text once, the first of them."""
    for batch in batches:
        keys, places = batch.column("key").to_pylist(), batch.column("place").to_pylist()
        texts, bounds = binary_parts(batch.column("text").cast(pa.binary()))
        for r0, r1 in ranges(np.diff(bounds), PART):
            part = batch.slice(r0, r1 - r0)
            found = _pieces(keys[r0:r1], places[r0:r1], texts[bounds[r0] : bounds[r1]], bounds[r0 : r1 + 1] - bounds[r0], _flat(part.column("common")), _flat(part.column("hot")))
            if found:
                yield from _packed(found, shards)
        give_back()


def _pieces(key: list[int], place: list[int], data: np.ndarray, limits: np.ndarray, common: np.ndarray, hot: np.ndarray) -> dict[tuple[int, bytes], tuple[int, int, int]]:
    h, first, last, row = owners(data, limits)
    often = np.isin(h, hot) if len(hot) else np.zeros(len(h), dtype=bool)
    keep = often | np.isin(h, common)
    h, first, last, row, often = (v[keep] for v in (h, first, last, row, often))
    if often.any():
        size = np.where(often, last - first + 1, 1)
        which = np.repeat(np.arange(len(h)), size)
        step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        first, last = first[which] + step, np.where(often[which], first[which] + step, last[which])
        h, row, often = h[which], row[which], often[which]
    found: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    whole, bases = data.tobytes(), limits.tolist()
    for x, a, z, r, single in zip(h.view(np.int64).tolist(), first.tolist(), last.tolist(), row.tolist(), often.tolist(), strict=True):
        piece = whole[a : z + WINDOW]
        me = (place[r], key[r], a - bases[r])
        at = (xxhash.xxh64_intdigest(piece) - (1 << 63) if single else x, piece)
        if (was := found.get(at)) is None or me < was:
            found[at] = me
    return found


def _packed(found: dict[tuple[int, bytes], tuple[int, int, int]], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, compressed block of pieces), one row for each shard that has any."""
    h = np.array([x for x, _ in found], dtype=np.int64).view(np.uint64)
    pieces = [p for _, p in found]
    where = np.array(list(found.values()), dtype=np.int64)
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    press = zstandard.ZstdCompressor(level=3)
    blocks = []
    for group in np.split(order, cuts):
        parts = [pieces[i] for i in group.tolist()]
        head = np.array([len(parts)], dtype=np.int64).tobytes() + (h[group] // np.uint64(shards)).tobytes() + where[group].T.tobytes()
        blocks.append(press.compress(head + np.array([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(parts)))
    yield pa.record_batch([pa.array(shard[order][np.concatenate(([0], cuts))]), pa.array(blocks, pa.binary())], names=["shard", "block"])


def _unpacked(block: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, int]]]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    h, place, key, start, size = np.frombuffer(data, dtype=np.int64, offset=8, count=5 * n).reshape(5, n).tolist()
    at = 8 + 40 * n
    for x, z, *me in zip(h, size, place, key, start, strict=True):
        yield x, data[at : at + z], tuple(me)
        at += z


def laid_out(pieces: dict[bytes, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces as one text with a mark after each and an end, their sizes and where they start."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    t = np.frombuffer(b"\0".join(pieces) + b"\0\0", dtype=np.uint8).astype(np.uint16) + 2
    bases = np.cumsum(sizes + 1) - sizes - 1
    t[bases + sizes] = 1  # between pieces
    t[-1] = 0
    return t, sizes, bases


def first_windows(pieces: dict[bytes, tuple[int, int, int]], text: tuple[np.ndarray, np.ndarray, np.ndarray], sa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct pieces, each with its first place (place, key, start), their joined text and its suffix array: the windows equal to no earlier one.

    Returns runs of window starts: piece number, first and last offset.
    """
    where = list(pieces.values())
    t, sizes, bases = text
    shared = common_prefixes(t, sa)
    piece_of = np.repeat(np.arange(len(where)), sizes + 1)
    offset = np.arange(len(t) - 1) - bases[piece_of]
    full = np.zeros(len(t), dtype=bool)
    full[:-1] = offset <= sizes[piece_of] - WINDOW
    documents = {w[:2]: i for i, w in enumerate(sorted({w[:2] for w in where}, key=lambda w: w))}
    rank = np.array([documents[w[:2]] for w in where], dtype=np.int64)
    start = np.array([w[2] for w in where], dtype=np.int64)
    alike = np.cumsum(shared[sa] < WINDOW)
    seat = full[sa]
    at, alike = sa[seat], alike[seat]
    value = (rank[piece_of[at]] << np.int64(36)) + start[piece_of[at]] + offset[at]
    heads = np.flatnonzero(np.concatenate(([True], alike[1:] != alike[:-1])))
    least = np.minimum.reduceat(value, heads)
    clear = np.sort(at[value == np.repeat(least, np.diff(np.concatenate((heads, [len(at)]))))])
    brk = np.flatnonzero((clear[1:] != clear[:-1] + 1) | (piece_of[clear[1:]] != piece_of[clear[:-1]]))
    a, z = clear[np.concatenate(([0], brk + 1))], clear[np.concatenate((brk, [len(clear) - 1]))]
    return piece_of[a], offset[a], offset[z]


def _clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by shard -> key, place, first and last start of windows that come first among their equals."""

    def settle(parts: list[dict[bytes, tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
        texts = [laid_out(pieces) for pieces in parts]
        for pieces, text, sa in zip(parts, texts, suffix_arrays([t for t, _, _ in texts]), strict=True):
            piece, lo, hi = first_windows(pieces, text, sa)
            where = list(pieces.values())
            place, key, start = (np.array([w[i] for w in where], dtype=np.int64)[piece] for i in range(3))
            yield pa.record_batch([pa.array(v) for v in (key, place, start + lo, start + hi)], names=["key", "place", "lo", "hi"])

    def settled(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        """One shard, in parts of whole anchors of about SHARD bytes, AT_ONCE of them together.

        An anchor whose pieces are all equal has nothing to sort: no two windows
        of one piece are equal, as its anchor is in another place of each.
        """
        rows = sorted((row for block in blocks for row in _unpacked(block)), key=lambda row: row[0])
        parts: list[dict[bytes, tuple[int, int, int]]] = [{}]
        alone: list[tuple[int, int, int, int]] = []
        size = total = 0
        for _, same in groupby(rows, key=lambda row: row[0]):
            pieces: dict[bytes, tuple[int, int, int]] = {}
            for _, piece, me in same:
                if (was := pieces.get(piece)) is None or me < was:
                    pieces[piece] = me
            if len(pieces) == 1:
                (piece, (place, key, start)), *_ = pieces.items()
                alone.append((key, place, start, start + len(piece) - WINDOW))
                continue
            if size >= SHARD:
                if len(parts) == AT_ONCE or total >= ALL_AT_ONCE:
                    yield from settle(parts)
                    parts, total = [], 0
                parts.append({})
                size = 0
            parts[-1].update(pieces)
            more = sum(map(len, pieces)) + len(pieces)
            size, total = size + more, total + more
        if alone:
            yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*alone, strict=True)], names=["key", "place", "lo", "hi"])
        if parts[-1]:
            yield from settle(parts)

    blocks: list[bytes] = []
    current = None
    for batch in batches:
        for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if shard != current and blocks:
                yield from settled(blocks)
                blocks = []
            current = shard
            blocks.append(block)
    if blocks:
        yield from settled(blocks)
    give_back()


def _strip(data: np.ndarray, limits: np.ndarray, hashes: np.ndarray, clears: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(row, start, end) of the removed runs, from all repeated hashes and the cleared windows (row, lo, hi)."""
    h, first, last, row = owners(data, limits)
    keep = np.isin(h, hashes)
    first, last, row = first[keep], last[keep], row[keep]
    if not len(first):
        return []
    step = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    flag = np.cumsum(step)[:-1] > 0
    if clears:
        r, lo, hi = np.array(clears, dtype=np.int64).T
        step[:] = 0
        np.add.at(step, limits[r] + lo, 1)
        np.add.at(step, limits[r] + hi + 1, -1)
        flag &= np.cumsum(step)[:-1] == 0
    at = np.flatnonzero(flag)
    if not len(at):
        return []
    row = np.searchsorted(limits, at, side="right") - 1
    brk = np.flatnonzero((at[1:] > at[:-1] + WINDOW) | (row[1:] != row[:-1]))
    start, end = at[np.concatenate(([0], brk + 1))], at[np.concatenate((brk, [len(at) - 1]))] + WINDOW
    row = row[np.concatenate(([0], brk + 1))]
    return list(zip(row.tolist(), (start - limits[row]).tolist(), (end - limits[row]).tolist(), strict=True))


def _removed(batches: Iterator[tuple[pa.Array, ...]], as_text: bool) -> Iterator[pa.Array]:
    for batch in batches:
        yield _removed_batch(*batch, as_text)
        del batch
        give_back()


def _removed_batch(place: pa.Array, text: pa.Array, common: pa.Array, hot: pa.Array, clear: pa.Array, as_text: bool) -> pa.Array:
    data, limits = binary_parts(text)
    places, clears = place.to_pylist(), clear.to_pylist()
    spans: list[list[tuple[int, int]]] = [[] for _ in places]
    marked = np.flatnonzero(np.asarray(common.is_valid()))
    counts = np.zeros(len(places), dtype=np.int64)
    counts[marked] = np.diff(limits)[marked]
    for r0, r1 in ranges(counts, BUFFER):
        rows = marked[(marked >= r0) & (marked < r1)]
        if not len(rows):
            continue
        hashes = np.concatenate((_flat(common.slice(r0, r1 - r0)), _flat(hot.slice(r0, r1 - r0))))
        part = np.concatenate([data[limits[r] : limits[r + 1]] for r in rows])
        own = np.concatenate(([0], np.cumsum([limits[r + 1] - limits[r] for r in rows])))
        known = [(i, c["lo"], c["hi"]) for i, r in enumerate(rows.tolist()) for c in clears[r] or () if c["place"] == places[r]]
        for i, a, z in _strip(part, own, hashes, known):
            spans[rows[i]].append((a, z))
    whole, bases = data.tobytes(), limits.tolist()
    kept = []
    for i, gone in enumerate(spans):
        one = whole[bases[i] : bases[i + 1]]
        if gone:
            at, left = 0, []
            for a, z in gone:
                left.append(one[at:a])
                at = z
            one = b"".join([*left, one[at:]])
        kept.append(one)
    left = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    flat = [x for gone in spans for x in gone]
    pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(2)], names=["start", "end"])
    return pa.StructArray.from_arrays([list_array(pairs, [len(x) for x in spans]), left], names=["removed", "kept"])


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, as_text: bool = False) -> DataFrame:
    """docs plus removed array<struct<start,end>> (maximal byte runs) and kept (the other bytes, binary).

    A byte goes if a WINDOW-byte string that covers it also starts earlier: in
    a smaller doc_id, or earlier in the same document. Null ids come last;
    documents of one id (or of none) are ordered by a hash of their text, and
    rows equal in both are one document, each row with the same result. Null
    and short texts lose nothing. Other columns stay; ones named removed or
    kept give way. A cut may part a multi-byte character: kept is bytes, or, with as_text,
    a string without what is left of such characters.
    """
    own = [c for c in docs.columns if c not in ("removed", "kept")]
    base = docs.select(
        F.struct(F.lit(0).alias("-"), *(name(c) for c in own if c != text)).alias("row"),
        F.xxhash64(name(doc_id).cast("bigint"), name(text)).alias("key"),
        F.coalesce(name(doc_id).cast("bigint"), F.lit(LAST)).alias("place"),
        name(text).alias("text"),
    )
    # all of a whole copy goes but for the first one's, whatever else repeats
    long = base.where(F.octet_length("text") >= WINDOW).select(F.md5("text").alias("content"), F.struct("place", "key").alias("at"))
    firsts = long.groupBy("content").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    copies = long.join(firsts, "content").where("at <> first").select("at.key").distinct().withColumn("copy", F.lit(True))
    anchors = base.select("key", F.explode(F.arrow_udf(_anchors, "array<struct<h:bigint,whose:bigint>>")(F.col("text").cast("binary"), F.xxhash64("text"))).alias("a")).select("key", "a.h", "a.whose")
    # an anchor of one text and its copies can't own a repeat between different texts
    counted = anchors.groupBy("h").agg(F.count("*").alias("c"), F.min("whose").alias("least"), F.max("whose").alias("most"))
    counted = reliable(counted.where("least <> most").select("h", "c"))
    total = counted.agg(F.sum("c")).first()[0] or 0
    # HOT_SHARE rows at most, as each is one in HOT_SHARE of the repeated ones: all tasks may have them
    hot = F.broadcast(counted.where(F.col("c") > max(HOT, total // HOT_SHARE)).select("h", F.lit(True).alias("hot")))
    # frequent anchors need no count, so they join nothing, each under a key of its text
    told = anchors.join(hot, "h", "left").withColumn("at", F.when(F.col("hot"), F.xxhash64("h", "key")).otherwise(F.col("h")))
    marked = told.join(counted.select(F.col("h").alias("at"), "c"), "at", "left").where("hot or c is not null")
    marked = marked.groupBy("key").agg(F.collect_list(F.when(F.col("hot").isNull(), F.col("h"))).alias("common"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    joined = base.join(marked, "key", "left").join(copies, "key", "left")
    n_bytes = docs.agg(F.sum(F.octet_length(name(text)))).first()[0] or 0
    parts = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // TASK_OF), MOST_TASKS)
    shards = max(parts, n_bytes // SHARD_OF)
    # row goes along so that both readers of joined share one exchange of the texts
    pieces = joined.where("common is not null and copy is null").select("key", "place", "text", "common", "hot", "row").mapInArrow(lambda batches: _cut(batches, shards), "shard bigint, block binary")
    clear = pieces.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_clear, "key bigint, place bigint, lo bigint, hi bigint")
    clear = clear.groupBy("key").agg(F.collect_list(F.struct("place", "lo", "hi")).alias("clear"))

    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from _removed(batches, as_text)

    removed = F.arrow_udf(of, f"struct<removed:array<struct<start:bigint,end:bigint>>,kept:{'string' if as_text else 'binary'}>")
    other = F.col("copy").isNull()
    done = joined.join(clear, "key", "left").select("row", "text", "copy", removed("place", F.col("text").cast("binary"), F.when(other, F.col("common")), F.when(other, F.col("hot")), "clear").alias("made"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.octet_length("text").cast("bigint").alias("end")))
    nothing = F.lit("") if as_text else F.lit(b"")
    done = done.select("row", "text", F.when(F.col("copy"), whole).otherwise(F.col("made.removed")).alias("removed"), F.when(F.col("copy"), nothing).otherwise(F.col("made.kept")).alias("kept"))
    return done.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own), "removed", "kept")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strip_repeats removes of all documents, and the hash of what is left; null texts are empty, repeats and ties as it says."""
    out = strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
