"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, name, ranges, table
from foliospark.llm.ngrams import hashed, lower

#: The fitted sample: about PER_LANG texts of every language, and fewer of each where that would be more than
#: MOST_TEXTS; of a text so many characters at most.
PER_LANG, MOST_TEXTS, EXCERPT = 600, 30_000, 4000
BITS, WIDTH, ORDERS = 16, 16, (2, 3, 4)
EPOCHS, RATE, SNIPPETS, SEED = 4, 0.5, 3, 7
#: Of the calibration texts, the share that accepted predictions may get wrong.
ERROR = 0.01
#: Bytes of a batch looked at together, and of a very long text at a time.
BUFFER, PART = 1 << 20, 1 << 20
FIELDS = ("lang_pred", "score", "rejected")


@dataclass(frozen=True)
class LanguageModel:
    """table: a row of class scores for each hashed n-gram (embedding times output weights)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """One row for each of the texts that lie end to end; each is summed by itself, so its neighbours don't matter."""
        sums, counts = np.zeros((len(limits) - 1, len(self.languages))), np.zeros(len(limits) - 1)
        if len(limits) == 2 and len(data) > PART:
            for i in range(0, len(data), PART):
                self._add(data[i : i + PART + max(ORDERS) - 1], np.array([0, min(PART, len(data) - i)]), sums, counts)
        else:
            self._add(data, limits, sums, counts)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def _add(self, data: np.ndarray, limits: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Add the scores of n-grams to each row; one past the last limit is there for those that reach beyond it."""
        data = lower(data)
        full = np.flatnonzero(np.diff(limits))
        for n in ORDERS if len(full) else ():
            ids = hashed(data, n, BITS)
            whole = np.zeros(limits[-1], dtype=bool)
            whole[: len(ids)] = True
            for k in range(1, n):  # an n-gram must not cross into the next text
                cut = limits[1:-1] - k
                whole[cut[cut >= 0]] = False
            if len(limits) == 2:
                whole[: len(ids)] = True
            marks = whole.astype(np.float64)
            counts[full] += np.add.reduceat(marks, limits[:-1][full])
            seen = np.zeros(limits[-1], dtype=np.int64)
            seen[: min(len(ids), len(seen))] = ids[: len(seen)]
            for c in range(len(self.languages)):
                sums[full, c] += np.add.reduceat(self.table[c][seen] * marks, limits[:-1][full])

    def chances(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, limits) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = lower(np.frombuffer(text, dtype=np.uint8))
    ids, counts = np.unique(np.concatenate([hashed(data, n, BITS) for n in ORDERS]), return_counts=True)
    return ids, counts / max(counts.sum(), 1)


def train(texts: list[bytes], langs: list[str], seed: int = SEED) -> LanguageModel:
    """Fit on four fifths of the texts and on short snippets of them; calibrate on the rest.

    Calibration sets the temperature, and the least score at which accepted
    predictions err in ERROR of the cases at most.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs)) or ["und"]
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in langs])
    held = np.arange(len(texts)) % 5 == 4
    bags, goals = [], []
    for t, c in ((t, c) for t, c, h in zip(texts, y.tolist(), held, strict=True) if not h):
        cuts = [t] + [t[s : s + int(rng.integers(20, 200))] for s in rng.integers(0, max(len(t) - 20, 1), SNIPPETS)]
        for part in cuts:
            ids, share = _bag(part)
            if len(ids):
                bags.append((ids, share))
                goals.append(c)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * max(len(bags), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            ids, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ embed[ids]
            wrong = softmax(mean @ out + bias)
            wrong[goals[i]] -= 1
            back = out @ wrong
            out -= rate * np.outer(mean, wrong)
            bias -= 0.1 * rate * wrong
            # the mean's gradient goes to each n-gram in full, as for a sum of few
            embed[ids] -= rate * np.outer(np.minimum(share * len(ids), 4.0), back)
    model = LanguageModel(languages, np.ascontiguousarray((embed @ out).T.astype(np.float32)), bias, 1.0, 0.0)
    if not held.any():
        return model
    trial = [t for t, h in zip(texts, held, strict=True) if h]
    trial += [t[:80] for t in trial]
    truth = np.concatenate((y[held], y[held]))
    logits = model.logits(np.frombuffer(b"".join(trial), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in trial]))))
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
    chance = softmax(logits / temperature)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == truth
    order = np.argsort(-score)
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= ERROR)
    return LanguageModel(model.languages, model.table, bias, temperature, float(score[order][fine[-1]]) if len(fine) else 1.0)


def sample(docs: DataFrame, doc_id: str, text: str, label: str, per_class: int = PER_LANG, most: int = MOST_TEXTS, seed: int = SEED) -> list[tuple[bytes, str]]:
    """About per_class (text, label) rows of every label, fewer of each where that would be more than `most` in all.

    Rows are chosen by a hash of id and text, so the choice is the same on
    reruns; rows that repeat count once. A text longer than EXCERPT characters
    gives that many from a place that its hash tells.
    """
    rows = docs.where(name(label).isNotNull() & name(text).isNotNull()).select(name(doc_id).alias("id"), name(text).alias("text"), name(label).cast("string").alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    labels = counts.count()
    if not labels:
        return []
    per = max(min(per_class, most // labels), 1)
    spot = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 30))
    limit = (F.least(F.lit(1.0), F.lit(per + 2 * per**0.5) / F.col("n")) * (1 << 30)).cast("bigint")
    # a row for each label: Spark sends them to all tasks if they are few
    chosen = rows.withColumn("spot", spot).join(counts.select("label", limit.alias("limit")), "label").where(F.col("spot") < F.col("limit"))
    start = F.pmod(F.xxhash64(F.lit(seed), "text"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    chosen = chosen.select("label", "spot", F.substring(F.col("text"), start, F.lit(EXCERPT)).alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("spot", "text"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= per).select("label", "spot", "text").collect()
    return [(r["text"].encode(), r["label"]) for r in sorted(chosen, key=lambda r: (r["spot"], r["label"], r["text"]))]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", *, reject: bool = True) -> DataFrame:
    """docs plus lang_pred, score and rejected, from the whole text alone.

    lang_pred is `und` where the text is null or has no letter (score 0), and,
    with reject, where the calibrated score is below the model's limit. Equal
    texts are told alike, repeated rows stay, an empty table gives none; ties go
    to the first language by code point. Columns named like the results give
    way; nothing is shuffled.
    """

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, limits = binary_parts(batch)
            chances = [np.zeros((0, len(model.languages)))]
            for r0, r1 in ranges(np.diff(limits), BUFFER):
                chances.append(model.chances(data[limits[r0] : limits[r1]], limits[r0 : r1 + 1] - limits[r0]))
            chance = np.concatenate(chances)
            best = chance.argmax(axis=1)
            yield pa.StructArray.from_arrays([pa.array([model.languages[i] for i in best.tolist()], pa.string()), pa.array(chance.max(axis=1))], names=["lang", "score"])

    made = F.arrow_udf(of, "struct<lang:string,score:double>")(name(text).cast("binary"))
    letters = F.coalesce(name(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*(name(c) for c in docs.columns)).alias("row"), letters.alias("lettered"), made.alias("made"))
    low = F.col("made.score") < model.reject_below
    known = F.col("lettered") & ~low if reject else F.col("lettered")
    own = [c for c in docs.columns if c not in FIELDS]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in own), F.when(known, F.col("made.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("made.score")).otherwise(0.0).alias("score"), (~F.col("lettered") | low).alias("rejected"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang_pred is the best learned value wherever there is a letter; rejected says where the operator would withhold it.

    Every non-null lang outside the held-out third is learned; a null id is held out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(1))
    known = sample(docs.where(part != 1), "doc_id", "text", "lang")
    model = train([t for t, _ in known], [x for _, x in known])
    return identify(docs.select("doc_id", "text"), model, reject=False).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score", "rejected")
