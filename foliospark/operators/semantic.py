"""Semantic retrieval in batches: requests, vector top-k, context, order, grouping, compact results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.sources.shared import stored

LIMIT, MOST, THRESHOLD, CONTEXT, MOST_CONTEXT, LONGEST_QUERY, MOST_CHUNKS = 10, 20, 0.4, 0, 3, 1000, 50
#: Query and chunk vectors that meet in one cell, and of these so many at once.
QUERY_BLOCK, CHUNK_BLOCK, QUERY_ROWS, CHUNK_ROWS = 5000, 20_000, 512, 8192
PIVOTS = 512


def _parameter(url: Column, key: str) -> Column:
    """A decoded query parameter, the first of its name; null if absent."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    there = query.rlike(f"(^|&){key}(=|&|$)")
    raw = F.regexp_extract(query, f"(?:^|&){key}=([^&]*)", 1)
    return F.when(there, F.coalesce(F.try_url_decode(raw), raw))


def parse_search_requests(df: DataFrame, url: str = "url", route_project: str | None = None) -> DataFrame:
    """df plus query, project, mode, grouping, max_results, max_chunks, threshold, context, rerank, and error.

    The first broken rule is the error, and all options are null then.
    """
    link = F.col(url)
    get = lambda key: _parameter(link, key)
    low = lambda key, other: F.coalesce(T.blank_to_null(F.lower(get(key))), F.lit(other))
    query = T.blank_to_null(T.nfkc(F.coalesce(get("q"), get("query"))))
    route = T.blank_to_null(T.nfkc(F.col(route_project))) if route_project else F.lit(None).cast("string")
    own = T.blank_to_null(T.nfkc(get("project")))
    odd = lambda p: F.coalesce((F.length(p) > 128) | p.contains("/") | p.contains("\\"), F.lit(False))

    def number(key: str, least: float, most: float, pattern: str) -> tuple[Column, Column]:
        text = T.blank_to_null(get(key))
        value = text.try_cast("double")
        return value, F.coalesce(text.isNotNull() & (~text.rlike(pattern) | value.isNull() | (value < least) | (value > most)), F.lit(False))

    limit, bad_limit = number("limit", 1, MOST, r"^-?\d+$")
    context, bad_context = number("context", 0, MOST_CONTEXT, r"^-?\d+$")
    threshold, bad_threshold = number("threshold", 0, 1, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    rerank = low("rerank", "false")
    error = (
        F.when(query.isNull(), "missing_query")
        .when(F.length(query) > LONGEST_QUERY, "query_too_long")
        .when(odd(route) | odd(own), "invalid_project")
        .when(F.coalesce(F.lower(route) != F.lower(own), F.lit(False)), "project_conflict")
        .when(~low("group", "files").isin("files", "chunks"), "invalid_group")
        .when(bad_limit, "invalid_limit")
        .when(~low("mode", "auto").isin("auto", "hybrid", "keyword", "vector"), "invalid_mode")
        .when(bad_threshold, "invalid_threshold")
        .when(bad_context, "invalid_context")
        .when(~rerank.isin("1", "true", "yes", "on", "0", "false", "no", "off"), "invalid_rerank")
    )
    n = F.coalesce(limit, F.lit(LIMIT)).cast("int")
    made = {
        "query": query,
        "project": F.coalesce(route, own),
        "mode": low("mode", "auto"),
        "grouping": low("group", "files"),
        "max_results": n,
        "max_chunks": F.when(low("group", "files") == "files", F.least(F.lit(MOST_CHUNKS), n * 3)).otherwise(n),
        "threshold": F.coalesce(threshold, F.lit(THRESHOLD)),
        "context": F.coalesce(context, F.lit(CONTEXT)).cast("int"),
        "rerank": rerank.isin("1", "true", "yes", "on"),
    }
    df = df.withColumn("error", error)
    return df.select(*df.columns, *(F.when(F.col("error").isNull(), v).alias(k) for k, v in made.items()))


def searchable_instances(projects: DataFrame, mapping: DataFrame, access: Sequence[str]) -> DataFrame:
    """(project_id, instance_id): current and replacement index of live, visible projects that are ready."""
    p = projects.where(F.col("deleted_at").isNull() & F.col("visibility").isin(*access)).select(F.col("id").alias("project_id"))
    m = mapping.where("status = 'ready'").join(p, "project_id")
    return m.select("project_id", F.explode(F.array_distinct(F.array_compact(F.array("instance_id", "replacement_instance_id")))).alias("instance_id"))


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, and which of them have a direction."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(size, 1e-300), size[:, 0] > 0


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _grouped(chunks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """chunks plus group, the nearest pivot's number, and angle, how far off it is; vectors without a direction are a group of their own."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.float64())], names=["group", "angle"])
                continue
            x, fine = _unit(batch)
            far = _angles(x, pivots)
            group = np.where(fine, far.argmin(axis=1), len(pivots)).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(group), pa.array(np.where(fine, far.min(axis=1), np.pi))], names=["group", "angle"])

    return chunks.withColumn("at", F.arrow_udf(of, "struct<group:int,angle:double>")("vector")).select("chunk_id", "vector", "at.group", "at.angle")


def _visits(asked: DataFrame, pivots: np.ndarray, groups: dict[int, tuple[float, int]], k: int, threshold: float) -> DataFrame:
    """asked with a row for each group that may hold something at the threshold: most, no chunk of it scores higher, and
    first, whether it is among the most promising ones, which have k chunks between them."""
    numbers = np.array(sorted(groups), dtype=np.int32)
    radius, sizes = (np.array([groups[g][i] for g in numbers.tolist()]) for i in range(2))
    near = np.vstack((pivots, np.zeros((1, pivots.shape[1]))))[numbers]

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists, counts = [], [0]
            if len(batch):
                x, fine = _unit(batch)
                # angles between directions obey the triangle's inequality
                most = np.cos(np.maximum(_angles(x, near) - radius, 0)) + 2e-9  # places are by nine digits
                most[:, numbers == len(pivots)] = 1
                most[~fine] = 1
                order = np.argsort(-most, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                for row, places, held in zip(most, order, before, strict=True):
                    keep = (row[places] >= threshold) | (held < k)
                    lists.append((numbers[places[keep]], row[places[keep]], (held < k)[keep]))
                    counts.append(counts[-1] + int(keep.sum()))
            columns = [np.concatenate(c) for c in zip(*lists, strict=True)] or [np.zeros(0, dtype=t) for t in (np.int32, np.float64, bool)]
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["group", "most", "first"]))

    made = F.arrow_udf(of, "array<struct<group:int,most:double,first:boolean>>")("asked")
    return asked.withColumn("v", F.explode(made)).select("query_id", "asked", "v.group", "v.most", "v.first")


def _met(asked: DataFrame, held: DataFrame, groups: dict[int, tuple[float, int]], k: int, threshold: float) -> DataFrame:
    """asked (query_id, asked, group) and held (chunk_id, vector, group) -> the best k, and what ties with them, of each cell.

    A group's queries and chunks are dealt by hash into blocks, and each pair of
    them is a cell: no cell grows with the data.
    """
    spark = asked.sparkSession
    counts = {r["group"]: r["count"] for r in asked.groupBy("group").count().collect()}  # a row for each group
    grid = [(g, max(-(-n // QUERY_BLOCK), 1), max(-(-groups[g][1] // CHUNK_BLOCK), 1)) for g, n in counts.items()]
    grid = F.broadcast(spark.createDataFrame(grid, "group int, rows int, columns int"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "group").select("group", "query_id", "asked", block("query_id", "rows").alias("row"), each("columns").alias("column"))
    right = held.join(grid, "group").select("group", "chunk_id", "vector", block("chunk_id", "columns").alias("column"), each("rows").alias("row"))

    def best(some: pa.Table, others: pa.Table) -> pa.Table:
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if some.num_rows and others.num_rows:
            ids, chunk = some.column("query_id").to_numpy(), others.column("chunk_id").to_numpy()
            q, x = _unit(some.column("asked"))[0], _unit(others.column("vector"))[0]
            for i in range(0, len(q), QUERY_ROWS):
                for j in range(0, len(x), CHUNK_ROWS):
                    score = q[i : i + QUERY_ROWS] @ x[j : j + CHUNK_ROWS].T
                    # all that tie with the k-th stay, so that ties are settled once all have met
                    few = min(k, score.shape[1])
                    kth = np.partition(score, -few, axis=1)[:, -few]
                    a, b = np.nonzero((score >= np.maximum(kth, threshold)[:, None] - 1e-12) & (score >= threshold))
                    found.append((ids[i + a], chunk[j + b], score[a, b]))
        return pa.table(dict(zip(("query_id", "chunk_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    key = ("group", "row", "column")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, "query_id bigint, chunk_id bigint, score double")


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, threshold: float = THRESHOLD, access: Sequence[str] | None = None) -> DataFrame:
    """(query_id, place, chunk_id, score): the k best chunks by cosine at the threshold or above, ties to smaller ids.

    Hidden chunks are left out first. Chunks are grouped by the nearest of up to
    PIVOTS pivots, chunks themselves; a group's radius bounds what a query can
    find in it. Each query first meets the most promising groups that have k
    chunks between them, and then those alone whose bound is not below its k-th
    score so far: the result is exact, and pivots decide the work only.
    """
    if access is not None:
        chunks = chunks.where(F.col("visibility").isin(*access))
    spark = queries.sparkSession
    given = chunks.select("chunk_id", "vector")
    n = max(2, min(PIVOTS, 4 * int(given.count() ** 0.5)))
    drawn = given.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n).select("vector").toArrow().column("vector")
    if not len(drawn):
        return spark.createDataFrame([], "query_id bigint, place int, chunk_id bigint, score double")
    pivots = _unit(drawn)[0]
    held = stored(_grouped(given, pivots))
    groups = {r["group"]: (r["radius"], r["n"]) for r in held.groupBy("group").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # PIVOTS + 1 rows
    visits = stored(_visits(queries.select("query_id", F.col("vector").alias("asked")), pivots, groups, k, threshold))
    first = stored(_met(visits.where("first"), held, groups, k, threshold))
    scores = F.sort_array(F.collect_list("score"), asc=False)
    kth = first.groupBy("query_id").agg(F.try_element_at(scores, F.lit(k)).alias("kth"))
    more = visits.where("not first").join(kth, "query_id", "left").where(F.col("most") >= F.greatest(F.coalesce("kth", F.lit(threshold)), F.lit(threshold)))
    met = first.union(_met(more.select("query_id", "asked", "group"), held, groups, k, threshold))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "chunk_id", "score")


def expand_context(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """hits (query_id, item_id, ordinal) plus text of the k chunks before and after in the item, in order, joined by blank lines.

    Ordinals count an item's chunks one by one. Hits ask for their neighbours
    by place, each place once: only those chunks move, whatever the item's
    length, and no task gathers an item.
    """
    places = hits.select("item_id", "ordinal").distinct()
    steps = F.array(*map(F.lit, range(-k, k + 1)))
    asked = places.select("item_id", F.col("ordinal").alias("hit"), F.explode(steps).alias("step")).withColumn("ordinal", F.col("hit") + F.col("step"))
    wanted = chunks.join(asked.select("item_id", "ordinal").distinct(), ["item_id", "ordinal"], "left_semi").select("item_id", "ordinal", "text")
    met = asked.join(wanted, ["item_id", "ordinal"]).groupBy("item_id", F.col("hit").alias("ordinal"))
    wide = met.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.max(F.col("step") == 0).alias("there"))
    return hits.join(wide.where("there").drop("there"), ["item_id", "ordinal"])


def order_chunks(chunks: DataFrame, rerank: bool, merged: bool) -> DataFrame:
    """chunks (query_id, position, score, rerank_score) plus place: a single reranked response keeps its order, merged ones go by rerank score (else score), others by score."""
    fine = ~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf"))
    score = F.coalesce(F.when(fine, F.col("rerank_score")), F.col("score")) if rerank else F.col("score")
    order = [F.col("position")] if rerank and not merged else [F.desc(score), F.col("position")]
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def hydrate(chunks: DataFrame, docs: DataFrame, projects: Sequence[str] | None, access: Sequence[str]) -> DataFrame:
    """chunks joined with their visible documents, of the given projects; unknown ones go."""
    seen = docs.where(F.col("visibility").isin(*access))
    if projects is not None:
        seen = seen.where(F.col("project_id").isin(*projects))
    return chunks.join(seen.select("file_id", "project_slug", "path", "title"), "file_id")


def group_results(df: DataFrame, grouping: str, limit: int) -> DataFrame:
    """The best chunk of each file by place, or all chunks; the first `limit` for each query, placed anew."""
    if grouping == "files":
        df = df.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy("place"))).where("n = 1").drop("n")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return df.withColumn("place", again).where(F.col("place") <= limit)


def compact_results(df: DataFrame) -> DataFrame:
    """Results (score, text, result_title, source_title, metadata map, project, path, raw_path, source_url, source_key) in the compact shape."""
    meta = lambda k: F.when(T.strip(F.element_at("metadata", F.lit(k))) != "", F.element_at("metadata", F.lit(k)))
    some = lambda c: F.when(T.strip(c) != "", F.col(c))
    title = F.coalesce(some("result_title"), some("source_title"), meta("title"), meta("display_title"), meta("name"), T.title_case_stem(some("path")), F.lit("Untitled"))
    base, raw = F.coalesce(some("source_url"), some("source_key")), some("raw_path")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    url = F.when(raw.startswith("/") & (origin != ""), F.concat(origin, raw)).otherwise(F.coalesce(raw, base))
    uri = F.when(some("project").isNotNull() & (T.encode_path(some("path")) != ""), F.concat(F.lit("prompt://"), T.encode_component("project"), F.lit("/"), T.encode_path("path")))
    return df.select("query_id", "place", F.coalesce("score", F.lit(0.0)).alias("score"), title.alias("title"), F.coalesce(some("text"), F.lit("")).alias("text"), some("project").alias("project"), some("path").alias("path"), uri.alias("uri"), url.alias("url"))


def to_safe_json(df: DataFrame, made: str = "json") -> DataFrame:
    """df's rows as JSON with < > & and the two line separators escaped."""
    out = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return df.withColumn(made, out)
