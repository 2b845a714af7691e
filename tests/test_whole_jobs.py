"""Queries and operators on more than the given tables hold."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import outbox, semantic
from foliospark.plans import queries as library
from foliospark.plans.library import Library, now
from foliospark.sources import trees

SF = "/root/testdata/sf0.001"


def test_too_long_contents_are_reported(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = F.when(F.col("doc_id") == 1, F.repeat(F.lit("a"), 500_001)).when(F.col("doc_id") == 2, F.repeat(F.lit("a"), 500_000)).otherwise(F.col("text"))
    folder = str(tmp_path)
    docs.withColumn("text", text).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    got = library.queries()["v2_fields"](spark, folder).where("rule = 'content_too_long'").collect()
    assert [r["entity_id"] for r in got] == ["doc-1"]


def test_remote_status_reaches_all_waiting_items(spark, monkeypatch):
    lib = Library(spark, SF)
    report = lib.items.select("file_id", F.lit("completed").alias("remote_status"), F.lit(3).alias("chunks_count"))
    after, again = outbox.apply_remote_status(lib.items, report, now())
    assert after.where("status in ('queued', 'processing')").count() == 0 and again.count() == 0
    waiting = lib.items.where("status in ('queued', 'processing')").count()
    assert waiting > 3 and outbox.apply_remote_status(lib.items, report, now(), 3)[0].where("status in ('queued', 'processing')").count() == waiting - 3
    asked, whole = [], outbox.apply_remote_status
    monkeypatch.setattr(outbox, "apply_remote_status", lambda items, report, now, limit=None: asked.append(limit) or whole(items, report, now, limit))
    library.queries()["o13_remote"](spark, SF)
    assert asked == [None]


def test_vector_topk_takes_any_number_of_queries(spark):
    n = 20_003
    q = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).alias("vector"))
    angles = np.arange(40) * 0.157
    chunks = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "chunk_id bigint, vector array<double>")
    got = {(r["query_id"], r["place"]): r["chunk_id"] for r in semantic.vector_topk(chunks, q, 2, 0.2).collect()}
    order = np.argsort(-np.cos(np.arange(n)[:, None] - angles[None, :]), axis=1)
    assert got == {(i, p + 1): int(order[i, p]) for i in range(n) for p in range(2)}


def test_a_manifest_that_was_changed_is_refused(spark, tmp_path):
    lib, folder = Library(spark, SF), str(tmp_path / "m")
    trees.write_manifest(lib.manifest, folder)
    assert trees.read_manifest(spark, folder)["files"].count() == lib.manifest_files.count()
    lib.manifest_files.limit(5).write.mode("overwrite").parquet(f"{folder}/files")
    with pytest.raises(ValueError, match="hash"):
        trees.read_manifest(spark, folder)


def test_what_was_stored_can_be_cleared(spark):
    kept = trees.stored(spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert Path(path).exists() and trees.clear_stored(spark) >= 1 and not Path(path).exists()


def test_context_moves_neighbours_alone(spark):
    """An item of 200,000 chunks with three hits, and short items: at the ends, beside each other, and of two queries."""
    chunks = spark.range(200_000).select(F.lit("long").alias("item_id"), F.col("id").alias("ordinal"), F.concat(F.lit("t"), "id").alias("text"))
    chunks = chunks.union(spark.createDataFrame([("short", i, f"s{i}") for i in range(3)], "item_id string, ordinal bigint, text string"))
    hits = spark.createDataFrame([(1, "long", 0), (1, "long", 77_777), (2, "long", 77_778), (2, "long", 199_999), (3, "short", 1), (4, "short", 1), (5, "short", 9), (6, "none", 0)], "query_id int, item_id string, ordinal bigint")
    got = {(r["query_id"], r["item_id"], r["ordinal"]): r["context"] for r in semantic.expand_context(hits, chunks, 2).collect()}
    t = lambda a, z: "\n\n".join(f"t{i}" for i in range(a, z + 1))
    assert got == {(1, "long", 0): t(0, 2), (1, "long", 77_777): t(77_775, 77_779), (2, "long", 77_778): t(77_776, 77_780), (2, "long", 199_999): t(199_997, 199_999), (3, "short", 1): "s0\n\ns1\n\ns2", (4, "short", 1): "s0\n\ns1\n\ns2"}
    plan = semantic.expand_context(hits, chunks, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_large_project_is_dealt_to_many_tasks(spark):
    """One project has nine files of ten; without broadcasts and without help at run time no task has more than its share."""
    n = 20_000
    project = F.when(F.col("id") % 10 == 0, F.concat(F.lit("p"), F.col("id") % 70)).otherwise("big")
    files = spark.range(n).select(F.concat(F.lit("f"), "id").alias("entity_id"), project.alias("project_id"))
    ledger = files.select("entity_id", "project_id", F.lit("file").alias("entity_type"), F.lit("h").alias("content_hash"))
    nodes = files.select(F.col("entity_id").alias("id"), F.lit("file").alias("node_type"), F.lit(None).cast("timestamp").alias("deleted_at"))
    changed = spark.createDataFrame([("big", "c"), ("p10", "c"), ("none", "c")], "project_id string, content_hash string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "32"), strict=True):
            spark.conf.set(k, v)
        rows = outbox.fan_out_project_changes(changed, ledger, nodes).select("file_id", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {f"f{i}" for i in range(n) if i % 10 or i % 70 == 10}
    assert len(rows) == len(want) and {r["file_id"] for r in rows} == want
    tasks = [r["task"] for r in rows]
    assert max(map(tasks.count, set(tasks))) < n / 6


@pytest.mark.parametrize("kind", ["clusters", "spread"])
def test_vector_topk_leaves_out_groups_by_their_bounds(spark, monkeypatch, kind):
    """Exact against all pairs; of clustered chunks a query meets a small part. Ties, vectors without a direction, hidden chunks, few chunks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 16)) * (0.05 if kind == "clusters" else 3)
    x[7] = x[8] = x[9]
    x[10] = 0
    q = np.vstack((x[::40] + rng.normal(size=(75, 16)) * 0.01, np.zeros((1, 16))))
    hidden = rng.integers(0, 5, 3000) == 0
    chunks = spark.createDataFrame([(i, v.tolist(), "private" if h else "public") for i, (v, h) in enumerate(zip(x, hidden, strict=True))], "chunk_id bigint, vector array<double>, visibility string").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = unit(q) @ unit(x).T
    met, whole = [], semantic._met
    monkeypatch.setattr(semantic, "_met", lambda asked, held, groups, *a: met.append(sum(groups[r["group"]][1] for r in asked.collect())) or whole(asked, held, groups, *a))
    for k, threshold in ((7, 0.3), (3, -1.0)):
        met.clear()
        got = {}
        for r in semantic.vector_topk(chunks, queries, k, threshold, ("public",)).collect():
            got.setdefault(r["query_id"], {})[r["place"]] = r["chunk_id"]
        for i in range(len(q)):
            best = sorted((-round(scores[i, c], 9), c) for c in np.flatnonzero(~hidden) if scores[i, c] >= threshold)[:k]
            assert got.get(i, {}) == {p + 1: c for p, (_, c) in enumerate(best)}, i
        if kind == "clusters":
            assert sum(met) < 0.2 * len(q) * (~hidden).sum()
    few = semantic.vector_topk(chunks.limit(2), queries.limit(3), 5, -1.0).collect()
    assert len(few) == 6 and semantic.vector_topk(chunks.limit(0), queries, 5).count() == 0 and semantic.vector_topk(chunks, queries.limit(0), 5).count() == 0
