"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, give_back, name, ranges, table, with_fields
from foliospark.llm.ngrams import hashed, lower

#: The fitted sample: about this many labelled texts of each class, and so many characters of each at most.
PER_CLASS, EXCERPT = 3000, 20_000
#: Hash bits of an n-gram, n-gram lengths, and how many n-grams the classifier looks at.
BITS, ORDERS, FEATURES = 22, (4, 5, 6), 12_000
SMOOTH, LEAST_TEXTS, PENALTY, STEPS, FOLDS, SEED = 1.0, 3, 1e-4, 300, 5, 11
#: N-grams whose shares of the two classes' texts are so many standard deviations apart, but the best LEAST_FEATURES always.
APART, LEAST_FEATURES = 5.0, 100
#: The share of toxic texts that scores are calibrated to, at every size and whatever share the sample has.
PRIOR = 0.1
BUFFER, PART = 1 << 20, 1 << 21
FIELDS = ("score", "predicted")


@dataclass(frozen=True)
class ToxicityModel:
    """weights: of the kept n-grams (their hashes, ascending), ratios included; a text has an n-gram or not."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float

    def scores(self, data: np.ndarray, limits: np.ndarray, seat: np.ndarray | None = None) -> np.ndarray:
        rows, which = hits(data, limits, seats(self.features) if seat is None else seat)
        total = np.bincount(rows, weights=self.weights[which], minlength=len(limits) - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * (total + self.bias), -500, 500)))


def seats(features: np.ndarray) -> np.ndarray:
    """A table from n-gram hash to feature number, -1 for the others."""
    out = np.full(1 << BITS, -1, dtype=np.int16)
    out[features] = np.arange(len(features))
    return out


def hits(data: np.ndarray, limits: np.ndarray, seat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs of texts end to end, PART bytes at a time."""
    pairs = [np.zeros(0, dtype=np.int64)]
    for i in range(0, max(len(data), 1), PART):
        part = lower(data[i : i + PART + max(ORDERS) - 1])
        found = []
        for n in ORDERS:
            which = seat[hashed(part[: PART + n - 1], n, BITS)]
            at = np.flatnonzero(which >= 0)
            row = np.searchsorted(limits, at + i, side="right") - 1
            ok = at + i + n <= limits[row + 1]
            found.append(row[ok] * (1 << 16) + which[at[ok]])
        pairs.append(np.unique(np.concatenate(found)))
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> 16, pairs & 0xFFFF


def _features(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that tell the classes apart, and their log-count ratios."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for t, c in zip(texts, y.tolist(), strict=True):
        data = lower(np.frombuffer(t, dtype=np.uint8))
        counts[int(c), np.unique(np.concatenate([hashed(data, n, BITS) for n in ORDERS]))] += 1
    sizes = np.array([(~y).sum(), y.sum()])
    seen = np.flatnonzero(counts.sum(axis=0) >= LEAST_TEXTS)
    p, q = counts[1, seen].astype(float), counts[0, seen].astype(float)
    ratio = np.log((p + SMOOTH) / (sizes[1] + 2 * SMOOTH)) - np.log((q + SMOOTH) / (sizes[0] + 2 * SMOOTH))
    # how many standard deviations the two shares are apart: with few texts most n-grams differ by chance
    pooled = (p + q) / sizes.sum()
    apart = np.abs(p / sizes[1] - q / sizes[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / sizes).sum())
    order = np.argsort(-apart, kind="stable")[:FEATURES]
    best = np.sort(order[: max(int((apart[order] >= APART).sum()), LEAST_FEATURES)])
    return seen[best], ratio[best]


def _weights(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights with their ratios, and bias of a logistic regression in which both classes weigh the same."""
    features, ratio = _features(texts, y)
    row, col = _found(texts, features)
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    w, b = np.zeros(len(features)), 0.0
    speed_w, speed_b = np.full(len(features), 1e-8), 1e-8
    for _ in range(STEPS):
        total = np.bincount(row, weights=(w * ratio)[col], minlength=len(y)) + b
        wrong = (1 / (1 + np.exp(-np.clip(total, -500, 500))) - y) * share
        grad = np.bincount(col, weights=wrong[row], minlength=len(features)) * ratio + PENALTY * w
        speed_w += grad**2
        speed_b += wrong.sum() ** 2
        w -= 0.1 * grad / np.sqrt(speed_w)
        b -= 0.1 * wrong.sum() / np.sqrt(speed_b)
    return features, w * ratio, b


def _found(texts: list[bytes], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs."""
    data, limits = _ends(texts)
    seat = seats(features)
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for r0, r1 in ranges(np.diff(limits), BUFFER):
        r, c = hits(data[limits[r0] : limits[r1]], limits[r0 : r1 + 1] - limits[r0], seat)
        rows.append(r + r0)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def train(texts: list[bytes], toxic: list[bool]) -> ToxicityModel:
    """Ratios and weights from all texts; the score's scale and offset from texts that had no part in their own total.

    In each of FOLDS turns a fold of the texts is left out and then scored, so
    that all labelled texts calibrate. The calibration takes one text in 1 / PRIOR
    for toxic at every size of the sample, so a score of 0.5 means the same.
    """
    y = np.array(toxic, dtype=bool)
    if not y.any() or y.all():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -1.0 if not y.any() else 1.0, 1.0)
    fold = np.zeros(len(y), dtype=np.int64)
    for c in (False, True):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    z, known = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(own) or not y[rest].any() or y[rest].all():
            continue
        features, weights, b = _weights([texts[i] for i in rest], y[rest])
        row, col = _found([texts[i] for i in own], features)
        z[own] = np.bincount(row, weights=weights[col], minlength=len(own)) + b
        known[own] = True
    features, weights, b = _weights(texts, y)
    scale, offset = _platt(z[known], y[known])
    return ToxicityModel(features, weights, float(b + offset), float(scale))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset so that scale * (z + offset) is the log-odds, the classes weighing as PRIOR says."""
    scale, offset = 1.0, 0.0
    if not y.any() or y.all():
        return scale, offset
    share = np.where(y, PRIOR / y.sum(), (1 - PRIOR) / (~y).sum())
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(300):
        chance = 1 / (1 + np.exp(-np.clip(scale * (z + offset), -500, 500)))
        gap, curve = (chance - goal) * share, chance * (1 - chance) * share + 1e-3 * share
        offset -= 0.5 * gap.sum() * scale / (curve.sum() * scale**2 + 0.01)
        scale -= 0.5 * ((gap * (z + offset)).sum() + 0.01 * (scale - 1)) / ((curve * (z + offset) ** 2).sum() + 0.01)
        scale = max(scale, 0.1)
    return scale, offset


def _ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """docs (doc_id, text) and labels (doc_id, toxic) -> a model from a bounded sample of the labelled texts.

    About PER_CLASS labels of each class are chosen by a hash of all that tells
    them apart, and of a text longer than EXCERPT characters that many from a
    place that the hash tells, so neither rows nor bytes grow with the tables.
    Null labels teach nothing; rows that repeat count once. Other columns don't
    matter; empty tables give a model that rejects nothing.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("labelled"), (F.col("toxic") != 0).alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda c: int(min(1.0, PER_CLASS / max(counts.get(c, 0), 1)) * (1 << 30))
    spot = F.pmod(F.xxhash64(F.lit(SEED), "labelled"), F.lit(1 << 30))
    # the labels are chosen before any text is touched, and so few that all tasks may have them
    chosen = known.withColumn("spot", spot).where(F.col("spot") < F.when(F.col("toxic"), share(True)).otherwise(share(False)))
    texts = docs.select("doc_id", "text").where("text is not null")
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["labelled"])
    start = F.pmod(F.xxhash64(F.lit(SEED), "text"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("spot", "doc_id", F.substring(F.col("text"), start, F.lit(EXCERPT)).cast("binary").alias("text"), "toxic").distinct()
    got = rows.orderBy("spot", "doc_id", "text", "toxic").limit(4 * PER_CLASS).collect()
    return train([bytes(r["text"]) for r in got], [r["toxic"] for r in got])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone.

    Null texts score as empty ones, equal texts alike, repeated rows stay, an
    empty table gives none; columns named like the results give way. A very
    long text is looked through in parts that overlap.
    """

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seat = seats(model.features)
        for batch in batches:
            data, limits = binary_parts(batch)
            parts = [model.scores(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], seat) for a, b in ranges(np.diff(limits), BUFFER)]
            out = np.concatenate([np.zeros(0), *parts])
            yield pa.StructArray.from_arrays([pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=list(FIELDS))
        give_back()

    return with_fields(docs, F.arrow_udf(of, "struct<score:double,predicted:int>")(name(text).cast("binary")), FIELDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of the labels outside the held-out fifth (a null id is held out); the rest as fit and score say."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0))
    model = fit(docs.where(part != 0), labels.where(part != 0))
    return score(docs, model).select("doc_id", (part == 0).alias("held_out"), "score", "predicted")
