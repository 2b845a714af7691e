"""Approximate nearest neighbours by cosine: probed lists, scanned a block of dimensions at a time.

Unit vectors are turned by a fixed random rotation, so that a few leading
dimensions tell of all. A query's candidates lose those whose partial distance
is, by a hypothesis test, too large for the k-th best known; the survivors of
the last block are scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import name, reliable, table

#: Lists are the root of the number of vectors, up to MOST_LISTS (a billion vectors); the index is fitted on about
#: SAMPLE vectors, or three for each list. Lists have no size limit: beyond that many vectors they grow.
SAMPLE, MOST_LISTS, ROUNDS, SEED = 12_000, 1 << 15, 12, 5
#: Probes are the fewest that find this share of the sample's own neighbours.
RECALL = 0.97
#: Dimensions of a block, and the test's strictness: a partial distance over d
#: dimensions abandons beyond (1 + STRICT / sqrt(d))^2 of its share of the limit.
BLOCK, STRICT = 16, 2.1
#: Candidates and queries that meet in one group, at most about.
GROUP, QUERIES = 4096, 512
#: Products of vectors and centres held at once.
PRODUCTS = 1 << 23
FOUND = "query_id bigint, vec_id bigint, score double"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, each row times the power of two that brings its largest component to about 1: no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        x = scaled(vectors)
        return (x / np.linalg.norm(x, axis=1, keepdims=True) @ self.rotation).astype(np.float32)

    def lists(self, turned: np.ndarray, probes: int = 1) -> np.ndarray:
        """The nearest lists of each vector; all of them, nearest first, where probes reaches their number."""
        out, step = [np.zeros((0, min(probes, len(self.centres))), dtype=np.int64)], max(PRODUCTS // len(self.centres), 1)
        for i in range(0, len(turned), step):
            near = -(turned[i : i + step] @ self.centres.T)
            whole = probes >= len(self.centres)
            out.append(np.argsort(near, axis=1, kind="stable") if whole else np.argpartition(near, probes - 1, axis=1)[:, :probes])
        return np.concatenate(out)


def fit(sample: np.ndarray, total: int, k: int) -> Index:
    """Rotation, spherical k-means centres, and probes measured on the sample."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    count = int(np.clip(round(total**0.5), 1, min(MOST_LISTS, len(sample))))
    plain = Index(rotation, np.zeros((0, dim), dtype=np.float32), 1)
    x = plain.turned(sample)
    centres = x[rng.choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        own = Index(rotation, centres, 1).lists(x)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-30), centres).astype(np.float32)
    index = Index(rotation, centres, 1)
    own = index.lists(x)[:, 0]
    trial = rng.choice(len(x), min(len(x), 400), replace=False)
    near = x[trial] @ x.T
    near[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-near, axis=1)[:, :k]
    order = index.lists(x[trial], count)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(count)[None, :].repeat(len(trial), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return Index(rotation, centres, int(needed[max(int(np.ceil(RECALL * len(needed))) - 1, 0)]) + 1 if len(needed) else count)


def scan(index: Index, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, cosine) of each query's k best among the vectors, ties to smaller ids; ids differ in a query."""
    q, x = index.turned(queries), index.turned(vectors)
    dim = q.shape[1]
    d = min(BLOCK, dim)
    part = (q[:, :d] ** 2).sum(axis=1)[:, None] + (x[:, :d] ** 2).sum(axis=1)[None, :] - 2 * (q[:, :d] @ x[:, :d].T)
    part[query_ids[:, None] == ids[None, :]] = np.inf
    # a limit for each query: the k-th best of those with the least partial distances; equal ids count once
    first = np.argpartition(part, min(4 * k, len(x)) - 1, axis=1)[:, : min(4 * k, len(x))]
    exact = ((q[:, None, :] - x[first]) ** 2).sum(axis=2)
    exact[np.take_along_axis(part, first, axis=1) == np.inf] = np.nan
    limit = np.full(len(q), np.inf)
    for i in range(len(q)):
        least: dict[int, float] = {}
        for v, e in zip(ids[first[i]].tolist(), exact[i].tolist(), strict=True):
            least[v] = min(e, least.get(v, e))
        finite = sorted(e for e in least.values() if e == e)
        if len(finite) >= k:
            limit[i] = finite[k - 1]
    limit = limit * (1 + 1e-5) + 1e-6  # single precision
    passes = lambda p, d, i: p <= limit[i] * (d / dim) * (1 + STRICT / np.sqrt(d)) ** 2 if d < dim else p <= limit[i]
    qi, xi = np.nonzero(passes(part, d, np.arange(len(q))[:, None]) & (part < np.inf))
    p = part[qi, xi]
    while d < dim:
        to = min(d + BLOCK, dim)
        p = p + ((q[qi, d:to] - x[xi, d:to]) ** 2).sum(axis=1)
        d = to
        ok = passes(p, d, qi)
        qi, xi, p = qi[ok], xi[ok], p[ok]
    # those that set the limits are within them, whatever the tests say
    sure, seat = np.nonzero(exact <= limit[:, None])
    qi, xi = np.concatenate((qi, sure)), np.concatenate((xi, first[sure, seat]))
    a, b = scaled(queries)[qi], scaled(vectors)[xi]
    score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    order = np.lexsort((-score, ids[xi], qi))
    qi, xi, score = qi[order], xi[order], score[order]
    once = np.concatenate(([True], (qi[1:] != qi[:-1]) | (ids[xi[1:]] != ids[xi[:-1]]))) if len(qi) else np.zeros(0, dtype=bool)
    qi, xi, score = qi[once], xi[once], score[once]
    order = np.lexsort((ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    start = np.searchsorted(qi, qi)
    top = np.arange(len(qi)) - start < k
    return query_ids[qi[top]], ids[xi[top]], score[top]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _seek(index: Index, kept: DataFrame, asking: DataFrame, probes: int, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best candidates in the probed lists; kept (list, id, v), asking (id, v)."""
    asking = reliable(asking.select("id", "v", F.explode(_lists(index, probes, dim)("v")).alias("list")))
    # large lists meet many queries in parts: (candidate part) x (query part)
    halls = kept.groupBy("list").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    askers = asking.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    grid = F.broadcast(halls.join(askers, "list"))  # a row for each list, MOST_LISTS at most
    left = kept.join(grid, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"), "id", "v")
    right = asking.join(grid, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("turns")).cast("int").alias("turn"), F.lit(True).alias("asks"), "id", "v")
    met = left.unionByName(right).groupBy("list", "part", "turn").applyInArrow(lambda rows: _meet(index, rows, dim, k), FOUND)
    return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _lists(index: Index, probes: int, dim: int):
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = index.lists(index.turned(_matrix(batch, dim)), probes)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel().astype(np.int32)))

    return F.arrow_udf(of, "array<int>")


def _meet(index: Index, rows: pa.Table, dim: int, k: int) -> pa.Table:
    asks = rows.column("asks").to_numpy()
    ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"), dim)
    found = scan(index, ids[asks], v[asks], ids[~asks], v[~asks], k) if asks.any() and not asks.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))


def _by_index(rows: DataFrame, dim: int, total: int, every: int, k: int) -> DataFrame:
    """Rows (id, v) of one dimension -> their queries' best, each with k at least where there are so many candidates."""
    spot = F.pmod(F.xxhash64(F.lit(SEED), "id", "v"), F.lit(1 << 30))
    most = max(SAMPLE, 3 * min(round(total**0.5), MOST_LISTS))
    picked = rows.select(spot.alias("spot"), "id", "v").where(F.col("spot") <= int(min(1.0, most / total) * (1 << 30))).distinct()
    picked = picked.orderBy("spot", "id", "v").limit(2 * most).toArrow()
    if not picked.num_rows:
        picked = rows.select(spot.alias("spot"), "id", "v").orderBy("spot", "id", "v").limit(1).toArrow()
    index = fit(_matrix(picked.column("v"), dim), total, k)
    kept = reliable(rows.withColumn("list", _lists(index, 1, dim)("v")[0]))
    asking = reliable(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    best, probes = None, index.probes
    while True:
        more = reliable(_seek(index, kept, asking, probes, dim, k))
        best = more if best is None else best.join(asking, best["query_id"] == asking["id"], "left_anti").unionByName(more)
        if probes >= len(index.centres):
            return best
        # queries that found too few, as their lists are small, ask more lists
        fed = more.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        asking = reliable(asking.join(fed, asking["id"] == fed["query_id"], "left_anti"))
        if asking.isEmpty():
            return best
        probes = min(4 * probes, len(index.centres))


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows.

    Rows with a null id or vector, a null, infinite or NaN component, or no
    length take no part. Vectors of other dimensions are not compared: the most
    frequent one, and any of more than GROUP vectors, has an index, and the
    vectors of each other are one list. Rows of one id are one candidate, with
    its best score; of queries of one id the least vector asks. Ties go to
    smaller ids. Fewer candidates give fewer ranks, an empty table none; other
    columns don't matter.
    """
    rows = vectors.select(name(vec_id).cast("bigint").alias("id"), name(vector).alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    sizes = reliable(rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")))
    few = sizes.where(F.col("n") <= GROUP).agg(F.count("*").alias("kinds"), F.max(F.struct("n", "dim")).alias("most")).first()
    large = sorted(((r["n"], r["dim"]) for r in sizes.where(F.col("n") > GROUP).collect()), reverse=True)
    if not large and few["kinds"]:
        large = [tuple(few["most"])]
    parts = [_by_index(rows.where(F.size("v") == dim), dim, n, every, k) for n, dim in large]
    if few["kinds"] > (large == [tuple(few["most"] or ())]):
        rare = rows.where(~F.size("v").isin(*(dim for _, dim in large)))
        asks = rare.where(F.col("id") % every == 0).groupBy("id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
        both = rare.select(F.size("v").alias("dim"), F.lit(False).alias("asks"), "id", "v").unionByName(asks.select("dim", F.lit(True).alias("asks"), "id", "v"))

        def one_list(of: pa.Table) -> pa.Table:
            dim = of.column("dim")[0].as_py()
            return _meet(Index(np.eye(dim), np.zeros((1, dim), dtype=np.float32), 1), of, dim, k)

        parts.append(both.groupBy("dim").applyInArrow(one_list, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    if len(parts) > 1:
        best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of all embeddings, with what nearest says of nulls, ties, repeats and empty tables."""
    return nearest(table(spark, sf_dir, "embeddings"))
