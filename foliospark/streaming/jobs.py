"""Streams: ledger changes to jobs, and periodic maintenance of the job table in a versioned store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import outbox as O
from foliospark.sources.versions import Conflict, Snapshot, VersionedStore


#: State of many keys stays on disk beside the executor's memory, with its changes in the checkpoint.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_jobs(changes: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """changes, a stream (changed_at, change insert | update | delete, entity_type, entity_id, project_id, content_hash), -> jobs.

    tables has nodes, ledger and items as they are. Each key comes once as long
    as the stream's checkpoint lives, however late or often its changes come:
    there is no watermark, so nothing is too late, and the keys seen are kept
    as state (in RocksDB, unless the session has chosen a provider).
    """
    live = tables["nodes"].where("node_type = 'file' and deleted_at is null").select(F.col("id").alias("entity_id"))
    configs = tables["ledger"].where("entity_type = 'project'").select(F.col("entity_id").alias("project_id"), F.col("content_hash").alias("config_hash"))
    files = tables["ledger"].where("entity_type = 'file'").select("project_id", F.col("entity_id").alias("file_id"), F.col("content_hash").alias("file_hash")).join(live.withColumnRenamed("entity_id", "file_id"), "file_id", "left_semi")
    at = F.col("changed_at")
    put = changes.where("change <> 'delete'")
    projects = put.where("entity_type = 'project'")
    ensure = projects.select(at, *O.ensure_job(F.col("project_id"), F.col("content_hash")))
    fan = projects.select("changed_at", "project_id", F.col("content_hash").alias("config_hash")).join(files, "project_id").select(at, *O.upsert_job(F.col("project_id"), F.col("file_id"), F.col("file_hash"), F.col("config_hash"), False))
    own = put.where("entity_type = 'file'").join(live, "entity_id", "left_semi").join(configs, "project_id").select(at, *O.upsert_job(F.col("project_id"), F.col("entity_id"), F.col("content_hash"), F.col("config_hash"), False))
    gone = changes.where("change = 'delete' and entity_type = 'file'").select("changed_at", F.col("entity_id").alias("file_id")).join(tables["items"].select("file_id", "item_id", F.col("project_id")), "file_id")
    delete = gone.select(at, F.concat(F.lit("delete:"), "file_id", F.lit(":"), "item_id").alias("dedupe_key"), F.lit("delete_file").alias("operation"), "project_id", "file_id", F.col("item_id").alias("expected_hash"))
    jobs = ensure.union(fan).union(own).union(delete)
    conf = changes.sparkSession.conf
    if conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        conf.set(PROVIDER, ROCKSDB)
    return jobs.dropDuplicates(["dedupe_key"]).select(*O.JOB)


def maintain(store: VersionedStore, incoming: DataFrame, now: Column, *, stream: str = "jobs", batch: int | None = None, limit: int | None = None, act: Callable[[DataFrame], DataFrame] | None = None) -> Snapshot:
    """One round of upkeep: reconcile, merge, claim, decide and apply, committed as one version of the store.

    The store holds projects, docs, files, ledger, mapping, items and jobs.
    Jobs that are due (`limit` of them, or all) are claimed; those that need
    nothing done are settled at once, too large ones fail, and for the rest
    `act` (job and decision -> dedupe_key, result, message, permanent) does the
    work and tells how it went; without it they stay claimed until their lease
    ends. The stream's batch number is part of the version: a batch that was
    committed before changes nothing, one that wasn't leaves nothing behind. If
    another commit comes first, the round starts anew on what that one left.
    """
    for _ in range(10):
        base = store.snapshot()
        batches = dict(base.facts.get("batches", {}))
        if batch is not None and batch <= batches.get(stream, -1):
            incoming.write.format("noop").mode("overwrite").save()  # the stream's own state has to go on
            return base
        t = base.all()
        found = (O.reconcile_projects(t["projects"], t["ledger"], t["mapping"]), O.reconcile_files(t["docs"], t["ledger"], t["items"]), O.obsolete_items(t["items"], t["docs"]))
        due = reduce(DataFrame.unionByName, (d.select(*O.JOB) for d in found), incoming.select(*O.JOB))
        merged = O.merge_jobs(t["jobs"], due, now).persist()
        try:
            claimed = O.claim_jobs(merged, O.ready_jobs(merged, now, limit), now).persist()
            mine = claimed.join(merged.select("dedupe_key", F.col("attempts").alias("before")), "dedupe_key").where("status = 'processing' and attempts > before").drop("before")
            upserts = O.decide_upserts(mine, t["docs"], t["files"], t["ledger"], t["items"]).select("dedupe_key", "decision")
            deletes = O.decide_deletes(mine, t["docs"], t["items"]).select("dedupe_key", "decision")
            ensures = mine.where("operation = 'ensure_instance'").select("dedupe_key", F.lit("ensure").alias("decision"))
            decided = upserts.union(deletes).union(ensures)
            outcomes = _settled(decided)
            if act is not None:
                todo = mine.join(decided.where(F.col("decision").isin("upload", "delete", "ensure")), "dedupe_key")
                outcomes = outcomes.unionByName(act(todo).select("dedupe_key", "result", "message", "permanent")).persist()
            after = {"jobs": O.apply_outcomes(claimed, outcomes, now), "items": O.fail_items(t["items"], claimed, outcomes, now)}
            facts = {"batches": batches | ({} if batch is None else {stream: batch})}
            return store.commit(base, put=after, facts=facts)
        except Conflict:
            continue
        finally:
            merged.unpersist()
    raise Conflict("other commits came first ten times")


def _settled(decided: DataFrame) -> DataFrame:
    """Outcomes of the decisions that need no work outside."""
    skipped, large = F.col("decision").isin("missing", "stale", "current", "live", "no_item", "other_item"), F.col("decision") == "too_large"
    message = F.when(large, F.lit(f"document is larger than {O.MOST_BYTES} bytes"))
    return decided.where(skipped | large).select("dedupe_key", F.when(large, "error").otherwise("skipped").alias("result"), message.alias("message"), large.alias("permanent"))


def stream_maintenance(jobs: DataFrame, store: VersionedStore, now: Callable[[], Column], checkpoint: str, *, stream: str = "jobs", limit: int | None = None, act: Callable[[DataFrame], DataFrame] | None = None, once: bool = False) -> StreamingQuery:
    """maintain for each micro-batch of a stream of jobs: a minute apart, or all that is there with once."""

    def merge(batch: DataFrame, number: int) -> None:
        maintain(VersionedStore(batch.sparkSession, store.folder), batch, now(), stream=stream, batch=number, limit=limit, act=act)

    writer = jobs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
