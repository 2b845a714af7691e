"""Documents scored by masked pseudo-likelihood: each word predicted from the words on both sides.

Every counted word stands in one of CELLS cells, and a word's chance is that of
its cell, from a small bidirectional window network, times the word's share of
its cell, from counts of every word of all documents. The network tells a cell
in two steps, as one of SIDES rows and, given the row, one of SIDES places in
it. The HEAD most frequent words have cells of their own; all others fall by
hash into the rest. The counts stay in a Spark table, which the documents'
words join; only the head, the cells' sizes and the network come to the
driver, and their size doesn't depend on the corpus.

Neither training nor scores depend on how the documents are laid out: texts
are dealt by their hash to shards, whose number follows the corpus, and are
read there in the order of their hashes; parameters are averaged, and chances
added up, as whole numbers; and the products of the scoring pass are whole
numbers small enough to be exact in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, give_back, list_array, name, packed, ranges, stored, table, unpacked

#: Rows of cells and places in a row; cells of one word each, and cells by hash (a power of two).
#: Without the head no word is more than one in HEAD of all, so no join key is hot.
SIDES, HEAD, TAIL = 64, 2048, 2048
CELLS = HEAD + TAIL
#: Words seen on each side, and the network's width.
SIDE, WIDTH = 2, 24
#: Every word of every distinct text is learned from once, in one of ROUNDS rounds, by shards of SHARD words or so.
ROUNDS, SHARD, BATCH, RATE, SEED = 2, 2_000_000, 2048, 0.1, 3
#: The counts of so many words at most, the most frequent ones, go along with the scoring tasks; all others are joined.
COMMON = 1 << 17
#: Parameters travel in chunks, as whole numbers of 1 / SCALE times a weight, so that their sums are exact.
CHUNK, SCALE = 64, 1 << 16
#: Scoring takes hidden units as whole numbers of 1 / UNIT, and weights too, within MOST: sums of WIDTH products stay below 2 ** 24.
UNIT, MOST = 128, 16
#: Log-chances are added up as whole numbers of 1 / LOGS.
LOGS = 1 << 24
BUFFER, REMEMBERED, BLOCK = 1 << 20, 300_000, 4096
FIELDS = ("n_tokens", "log_prob", "perplexity")


def offsets() -> list[int]:
    return [k for k in range(-SIDE, SIDE + 1) if k]


def softmax(logits: np.ndarray, whole: float = 1.0) -> np.ndarray:
    """Of each column, in place; a column sums to 1 / whole."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits *= np.float32(1 / whole) / logits.sum(axis=0)
    return logits


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1])))
    return first, np.diff(first, append=len(values))


def exact(values: np.ndarray) -> np.ndarray:
    """Parameters as whole numbers of 1 / UNIT."""
    return np.rint(np.clip(values, -MOST, MOST) * UNIT).astype(np.float32)


@dataclass(frozen=True)
class Network:
    """Inputs are 0 for the edge of a text, then the cells. row and place: what leads from the hidden units to a row of
    cells and to a place in it; gate: the share that each hidden unit has in the latter, by row."""

    embed: np.ndarray  # (2 * SIDE, 1 + CELLS, WIDTH)
    row: np.ndarray  # (WIDTH, SIDES)
    row_bias: np.ndarray
    gate: np.ndarray  # (SIDES, WIDTH)
    place: np.ndarray  # (WIDTH, SIDES)
    place_bias: np.ndarray  # (SIDES, SIDES)

    def hidden(self, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
        """From the inputs around the places `at`; a place's own input has no part."""
        total = np.zeros((len(at), WIDTH), dtype=np.float32)
        for k, step in enumerate(offsets()):
            total += self.embed[k].take(seen.take(at + step), axis=0)
        return np.tanh(total, out=total)

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts()])

    def like(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([v.size for v in self.parts()])
        return Network(*(p.reshape(v.shape).astype(np.float32) for p, v in zip(np.split(flat[: ends[-1]], ends[:-1]), self.parts(), strict=True)))


@dataclass(frozen=True)
class WindowModel:
    """head: words with a cell of their own. mass: log of the words in each cell, and one more; 0 for the head's.

    common: 0 for the head's words, LOGS times the log of their count for other frequent words.
    """

    head: dict[bytes, int]
    mass: np.ndarray
    net: Network
    counts: DataFrame | None = None  # (word hash h, n) of all words
    common: dict[bytes, int] = field(default_factory=dict)

    def known(self) -> dict[bytes, int]:
        """Of the head's and common's words the cell, from 1, as the inputs have it, and 65,536 times one more than what common says."""
        said = dict.fromkeys(self.head, 0) | self.common
        return {w: (1 + log) << 16 | 1 + (self.head[w] if w in self.head else HEAD + xxhash.xxh64_intdigest(w, 42) % TAIL) for w, log in said.items()}

    def log_probs(self, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log chance of each place's cell, and of a word seen once in it; a place's result depends on its window alone."""
        net, out = self.net, np.empty(len(at))
        # scaled by powers of two, which leaves products and sums exact; places are columns, so that their sums run in one order
        row, gate, place = exact(net.row.T) / np.float32(UNIT * UNIT), exact(net.gate) / np.float32(UNIT), exact(net.place.T) / np.float32(UNIT * UNIT)
        row_bias, place_bias = net.row_bias[:, None], np.ascontiguousarray(net.place_bias.T)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            cell = seen.take(part) - np.uint16(1)
            # places of one row stand together and share its biases; a place alone goes twice, as sums over one column run in another order
            order = np.argsort(cell, kind="stable") if len(cell) > 1 else np.zeros(2, dtype=np.int64)
            part, cell = part[order], cell[order]
            rows, places = np.divmod(cell, np.uint16(SIDES))
            h = net.hidden(seen, part)
            h *= np.float32(UNIT)
            np.rint(h, out=h)
            gated = gate.take(rows, axis=0)
            gated *= h
            np.rint(gated, out=gated)
            np.clip(gated, -UNIT, UNIT, out=gated)
            total = np.zeros(len(part))
            for values, weights, bias, own in ((h, row, row_bias, rows), (gated, place, place_bias.repeat(np.bincount(rows, minlength=SIDES), axis=1), places)):
                logits = weights @ values.T
                logits += bias
                logits -= logits.max(axis=0)
                total += logits[own, np.arange(len(part))]
                np.exp(logits, out=logits)
                total -= np.log(logits.sum(axis=0).astype(np.float64))
            out[i + order] = total - self.mass[cell]
        return out


def split(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words (A-Z alone), those of BUFFER bytes or so at a time."""
    at = 0
    while at < len(text):
        end = at + BUFFER
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n) over all documents. Batches are counted where they are read; their counts meet in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for words in split(value.as_py() or b""):
                    found.update(words)
                if len(found) > REMEMBERED:
                    yield pa.record_batch([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])
                    found = Counter()
        yield pa.record_batch([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    return docs.select(name(text).cast("binary").alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def start(head: list[tuple[bytes, int]], mass: np.ndarray, counts: DataFrame | None = None, seed: int = SEED) -> WindowModel:
    """A model that knows the cells' sizes and no context. mass: words in each tail cell, the head's left out."""
    rng = np.random.default_rng(seed)
    sizes = np.concatenate(([n for _, n in head], np.zeros(HEAD - len(head)), mass)).reshape(SIDES, SIDES)
    small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    net = Network(
        small(2 * SIDE, 1 + CELLS, WIDTH),
        small(WIDTH, SIDES),
        np.log(sizes.sum(axis=1) + 1.0).astype(np.float32),
        (1 + small(SIDES, WIDTH)).astype(np.float32),
        small(WIDTH, SIDES),
        np.log(sizes + 0.1).astype(np.float32),
    )
    return WindowModel({w: i for i, (w, _) in enumerate(head)}, np.concatenate((np.zeros(HEAD), np.log(mass + 1.0))), net, counts)


class Trainer:
    """Mini-batch Adagrad on one shard's share of places."""

    def __init__(self, net: Network) -> None:
        self.net = replace(net, **{f.name: getattr(net, f.name).copy() for f in fields(net)})
        self.pace = replace(net, **{f.name: np.full(getattr(net, f.name).shape, 1e-6, dtype=np.float32) for f in fields(net)})
        self.used = 0

    def _step(self, value: np.ndarray, pace: np.ndarray, grad: np.ndarray) -> None:
        pace += grad**2
        value -= RATE * grad / np.sqrt(pace)

    def _embed(self, inputs: np.ndarray, back: np.ndarray) -> None:
        """Adagrad on the inputs' rows. inputs: (2 * SIDE, places); an input may come more than once."""
        value, pace = (v.embed.reshape(-1, WIDTH) for v in (self.net, self.pace))
        rows = (inputs + np.arange(2 * SIDE, dtype=np.uint16)[:, None] * np.uint16(1 + CELLS)).ravel()
        order = np.argsort(rows, kind="stable")
        rows, order = rows[order], np.tile(np.arange(len(back)), 2 * SIDE)[order]
        first, times = runs(rows)
        often = np.argsort(-times, kind="stable")
        first, times = first[often], times[often]
        grad, rows = back.take(order[first], axis=0), rows[first].astype(np.int64)
        # second, third ... comings are added while many inputs have them, then all others at once
        k, more = 1, np.count_nonzero(times > 1)
        while more > SIDES:
            grad[:more] += back.take(order[first[:more] + k], axis=0)
            k += 1
            more = np.count_nonzero(times[:more] > k)
        if more:
            left = times[:more] - k
            begin = np.cumsum(left) - left
            grad[:more] += np.add.reduceat(back.take(order[np.repeat(first[:more] + k - begin, left) + np.arange(left.sum())], axis=0), begin)
        now = grad * grad
        now += pace.take(rows, axis=0)
        pace[rows] = now
        np.sqrt(now, out=now)
        np.divide(grad, now, out=now)
        now *= -RATE
        now += value.take(rows, axis=0)
        value[rows] = now

    def learn(self, seen: np.ndarray, at: np.ndarray) -> None:
        """From the places `at` of seen, in a fixed random order; places are columns."""
        net, pace = self.net, self.pace
        self.used += len(at)
        at = at[np.random.default_rng(SEED).permutation(len(at))]
        for i in range(0, len(at), BATCH):
            spot = at[i : i + BATCH]
            cell = seen.take(spot) - np.uint16(1)
            order = np.argsort(cell, kind="stable")  # places of one row stand together: its biases and sums come at once
            spot = spot[order]
            rows, places = np.divmod(cell[order], np.uint16(SIDES))
            times = np.bincount(rows, minlength=SIDES)
            mine = np.flatnonzero(times)
            first = (np.cumsum(times) - times)[mine]
            each, share = np.arange(len(spot)), np.float32(1 / len(spot))
            hidden = net.hidden(seen, spot)
            gate = net.gate.take(rows, axis=0)
            gated = hidden * gate
            of_row = net.row.T @ hidden.T
            of_row += net.row_bias[:, None]
            of_place = net.place.T @ gated.T
            of_place += np.ascontiguousarray(net.place_bias.T).repeat(times, axis=1)
            for chances, own in ((softmax(of_row, len(spot)), rows), (softmax(of_place, len(spot)), places)):
                chances[own, each] -= share
            to_gated = of_place.T @ net.place.T
            back = to_gated * gate
            back += of_row.T @ net.row.T
            back *= 1 - hidden**2
            of_bias, of_gate = np.zeros_like(net.place_bias), np.zeros_like(net.gate)
            of_bias[mine] = np.add.reduceat(of_place, first, axis=1).T
            of_gate[mine] = np.add.reduceat(to_gated * hidden, first)
            self._step(net.row, pace.row, (of_row @ hidden).T)
            self._step(net.row_bias, pace.row_bias, of_row.sum(axis=1))
            self._step(net.place, pace.place, (of_place @ gated).T)
            self._step(net.place_bias, pace.place_bias, of_bias)
            self._step(net.gate, pace.gate, of_gate)
            self._embed(np.stack([seen.take(spot + step) for step in offsets()]), back)


def _lined_up(model: WindowModel, texts: Sequence[Iterable[list[bytes]]], known: dict[bytes, int], said: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as runs of words -> inputs with SIDE edges around each text, the words' places in them, and words of each text.

    known: model.known(), filled in here if empty. said takes of each run that
    has words the text's place, the number of words, the sum of what
    model.common says of them, and the hashes of the words of which it says
    nothing. Only a run's words are held, so a very long text costs a number a
    word.
    """
    if not known:
        known.update(model.known())
    got, sizes = [np.zeros(0, dtype=np.uint16)], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for words in filter(None, text):
            numbers = np.fromiter(map(known.get, words, repeat(0)), dtype=np.int64, count=len(words))
            rare = np.flatnonzero(numbers == 0)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(words.__getitem__, rare.tolist()), repeat(42)), dtype=np.uint64, count=len(rare))
            numbers[rare] = 1 + HEAD + (hashes % np.uint64(TAIL)).astype(np.int64)
            if said is not None:
                said.append((i, len(words), int((numbers >> 16).sum()) - len(words) + len(rare), hashes.view(np.int64)))
            got.append((numbers & 0xFFFF).astype(np.uint16))
            sizes[i] += len(words)
    at = np.arange(int(sizes.sum())) + SIDE + np.repeat(2 * SIDE * np.arange(len(sizes)), sizes)
    seen = np.zeros(int(sizes.sum()) + 2 * SIDE * len(sizes) + SIDE, dtype=np.uint16)
    seen[at] = np.concatenate(got)
    return seen, at, sizes


def _counted(hashes: list[np.ndarray]) -> pa.ListArray:
    """Of each list its distinct hashes h, and how often each comes (n)."""
    of, h = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]), np.concatenate([np.zeros(0, dtype=np.int64), *hashes])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), dtype=bool), (h[1:] != h[:-1]) | (of[1:] != of[:-1]))))
    pairs = pa.StructArray.from_arrays([pa.array(h[first]), pa.array(np.diff(first, append=len(h)))], names=["h", "n"])
    return list_array(pairs, np.bincount(of[first], minlength=len(hashes)))


#: A text's identity: 128 bits.
KEY = ("high", "low")


def _key(text: str) -> list:
    return [F.xxhash64(text, F.length(text)).alias("high"), F.xxhash64(F.lit(SEED), text).alias("low")]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """The texts (binary, null ones empty) and their keys."""
    return docs.select(F.coalesce(name(text).cast("binary"), F.lit(b"")).alias("text")).select(*_key("text"), "text")


def lessons(docs: DataFrame, model: WindowModel, text: str = "text") -> DataFrame:
    """(turn, high, low, part, cells, own, rare): the words of each distinct text, in parts, each part with the round that learns from it.

    The text's key (high, low) tells the round. cells: 16-bit inputs, with the
    SIDE inputs before and after the part, from which it learns nothing. own:
    the sum of what model.common says of the part's words; rare: (hash h, n) of
    those of which it says nothing.
    """
    known, bare = model.known(), replace(model, head={}, counts=None, common={})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            data, limits = binary_parts(batch.column("text"))
            whole, ends = data.tobytes(), limits.tolist()
            for a, b in ranges(np.diff(limits), BUFFER):
                said: list[tuple[int, int, int, np.ndarray]] = []
                seen, _, _ = _lined_up(bare, [split(whole[ends[r] : ends[r + 1]]) for r in range(a, b)], known, said)
                made: list[tuple[int, int, int, int, bytes, int]] = []
                now, part, start = -1, 0, 0
                for i, n, own, _ in said:
                    # texts stand 2 * SIDE edges apart, those without words too
                    now, part, start = (i, part + 1, start) if i == now else (i, 0, start + 2 * SIDE * (i - max(now, 0)))
                    high, low = keys[a + i]
                    made.append(((high + part) % ROUNDS, high, low, part, seen[start : start + n + 2 * SIDE].tobytes(), own))
                    start += n
                columns = list(zip(*made, strict=True)) or [()] * 6
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                columns = [*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), _counted([hashes for *_, hashes in said])]
                yield pa.record_batch(columns, names=["turn", "high", "low", "part", "cells", "own", "rare"])
        give_back()

    made = _texts(docs, text).mapInArrow(work, "turn int, high bigint, low bigint, part int, cells binary, own bigint, rare array<struct<h:bigint,n:bigint>>")
    return made.groupBy("turn", "high", "low", "part").agg(*(F.first(c).alias(c) for c in ("cells", "own", "rare")))  # copies have the same


def trained(rows: DataFrame, model: WindowModel, shards: int) -> WindowModel:
    """One round over its texts: each shard goes on from the model, and Spark averages what they end with.

    A shard counts by the words it learned from, in steps of 256.
    """
    net = model.net

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after another; their parameters are added up before they leave the task."""
        total, weights = 0, 0
        trainer, now = Trainer(net), None
        held: list[np.ndarray] = []

        def learn() -> None:
            if held:
                limits = np.cumsum([0, *map(len, held)])
                trainer.learn(np.concatenate(held), np.concatenate([np.arange(a + SIDE, b - SIDE) for a, b in zip(limits[:-1], limits[1:], strict=True)]))
                held.clear()

        def end() -> None:
            nonlocal total, weights
            learn()
            if trainer.used:
                weight = max(trainer.used // 256, 1)
                total = total + np.round(np.clip(trainer.net.flat().astype(np.float64), -64, 64) * SCALE).astype(np.int64) * weight
                weights += weight

        size = 0
        for batch in batches:
            for shard, cells in zip(batch.column("shard").to_pylist(), batch.column("cells"), strict=True):
                if shard != now:
                    end()
                    trainer, now, size = Trainer(net), shard, 0
                held.append(np.frombuffer(cells.as_py(), dtype=np.uint16))
                size += len(held[-1])
                if size > 50_000:
                    learn()
                    size = 0
        end()
        if weights:
            flat = np.concatenate((total, np.zeros(-len(total) % CHUNK, dtype=np.int64)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), CHUNK).cast(pa.list_(pa.int64()))
            n = len(lists)
            yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), lists, pa.array(np.full(n, weights, dtype=np.int64))], names=["chunk", "v", "weight"])
        give_back()

    dealt = rows.withColumn("shard", F.pmod("low", F.lit(shards)).cast("int"))
    parts = min(shards, 10_000)
    ordered = dealt.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "high", "low", "part").select("shard", "cells")
    made = ordered.mapInArrow(work, "chunk int, v array<bigint>, weight bigint")
    sums = made.groupBy("chunk").agg(F.sum("weight").alias("weight"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(CHUNK)))
    got = sums.select("chunk", "weight", F.array(*(f"v{i}" for i in range(CHUNK))).alias("v")).toArrow()
    if not got.num_rows:
        return model
    order = np.argsort(got.column("chunk").to_numpy())
    flat = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, CHUNK)[order] / (got.column("weight").to_numpy()[order, None] * SCALE)
    return replace(model, net=net.like(flat.ravel()))


def _begun(docs: DataFrame, text: str = "text", heads: int = HEAD) -> tuple[WindowModel, DataFrame, int]:
    """A model that knows the counts of every word of all documents, kept in a table in the shared folder, and no context;
    what there is to learn, kept there too; and into how many shards."""
    counts = stored(word_counts(docs, text))
    head = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(heads).collect()]
    mass = np.zeros(TAIL)
    h = F.xxhash64(F.col("word"))
    for r in counts.groupBy(h.bitwiseAND(F.lit(TAIL - 1)).alias("tail")).agg(F.sum("n").alias("n")).collect():
        mass[r["tail"]] = r["n"]
    shards = max(1, int(mass.sum()) // (ROUNDS * SHARD))
    for w, n in head:
        mass[xxhash.xxh64_intdigest(w, 42) % TAIL] -= n
    model = start(head, mass, counts.select(h.alias("h"), "n"))
    model = replace(model, common=common(counts, model.head))
    return model, stored(lessons(docs, model, text)), shards


def _learned(model: WindowModel, rows: DataFrame, shards: int) -> WindowModel:
    for turn in range(ROUNDS):
        model = trained(rows.where(F.col("turn") == turn), model, shards)
    return model


def fit(docs: DataFrame, text: str = "text", heads: int = HEAD) -> WindowModel:
    """Counts of every word of all documents, kept in a table in the shared folder, and a network trained on every word of every distinct text.

    Copies of a text count each, and teach once. The model is the same however
    the documents are laid out.
    """
    return _learned(*_begun(docs, text, heads))


def _log(n):
    return F.round(F.log(n.cast("double")) * LOGS).cast("bigint")


def common(counts: DataFrame, head: dict[bytes, int], most: int | None = None) -> dict[bytes, int]:
    """What WindowModel's common says of the head's words and of `most` (COMMON) others at most, those of the largest counts."""
    size = F.floor(F.log2("n") * 4)
    least, total = None, 0
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        total += r["count"]
        if total > len(head) + (COMMON if most is None else most):
            break
        least = r["size"]
    rows = counts.where(size >= least).select("word", _log(F.col("n")).alias("log")).toArrow() if least is not None else None
    found = dict(zip(rows.column("word").to_pylist(), rows.column("log").to_pylist(), strict=True)) if rows is not None else {}
    return found | dict.fromkeys(head, 0)


def _sums(rows: DataFrame, model: WindowModel) -> DataFrame:
    """lessons' rows -> (high, low, n, sum): the number of words of each text, and its log-chance as a whole number of 1 / LOGS."""
    bare = replace(model, head={}, counts=None, common={})

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, limits = binary_parts(batch)
            seen, limits = np.frombuffer(data.tobytes(), dtype=np.uint16), limits // 2
            sums = [np.zeros(0, dtype=np.int64)]
            for a, b in ranges(np.diff(limits), BUFFER):
                sizes = np.diff(limits[a : b + 1]) - 2 * SIDE
                first = np.cumsum(sizes) - sizes
                at = np.arange(int(sizes.sum())) + np.repeat(limits[a:b] + SIDE - first, sizes)
                sums.append(np.add.reduceat(np.rint(bare.log_probs(seen, at) * LOGS).astype(np.int64), first))
            yield pa.array(np.concatenate(sums))
        give_back()

    made = F.arrow_udf(of, "bigint")(F.col("cells"))
    each = rows.select(*KEY, (F.length("cells") / 2 - 2 * SIDE).cast("bigint").alias("n"), (made + F.col("own")).alias("sum"))
    if model.counts is not None:
        terms = rows.select(*KEY, F.inline("rare")).join(model.counts.withColumnRenamed("n", "all"), "h", "left")
        each = each.unionByName(terms.select(*KEY, F.lit(0).cast("bigint").alias("n"), (F.col("n") * _log(F.coalesce("all", F.lit(1)))).alias("sum")))
    return each.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))


def _scored(docs: DataFrame, rows: DataFrame, model: WindowModel, text: str = "text") -> DataFrame:
    """What score says; rows: docs' lessons."""
    own = [c for c in docs.columns if c not in FIELDS]
    each = packed(docs.select(*(name(c) for c in own)), text).select("row", F.coalesce(name(text).cast("binary"), F.lit(b"")).alias("words"))
    each = each.select("row", *_key("words")).join(_sums(rows, model), list(KEY), "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    total = F.round(F.coalesce("sum", F.lit(0).cast("bigint")) / LOGS, 6)
    perplexity = F.when(n > 0, F.exp(F.least(-total / n, F.lit(700.0))))
    return each.select(*unpacked(own), n.alias("n_tokens"), total.alias("log_prob"), perplexity.alias("perplexity"))


def score(docs: DataFrame, model: WindowModel, text: str = "text") -> DataFrame:
    """docs plus n_tokens, log_prob (natural, summed over all words, to six places) and perplexity.

    Null and wordless texts have 0 tokens, log_prob 0 and a null perplexity.
    Equal texts are scored once and score alike, repeated rows stay, columns
    named like the results give way, an empty table gives none. A word that the
    counts don't have counts as one seen once.
    """
    return _scored(docs, stored(lessons(docs, model, text)), model, text)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by a model of all documents; nulls, ties and empty tables as score says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rows, shards = _begun(docs)
    return _scored(docs, rows, _learned(model, rows, shards)).select("doc_id", *FIELDS)
