"""The index outbox: job keys, jobs from ledger changes, reconciliation, draining, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T

LAYOUT = "readable-v1"
MOST_NAME, MOST_BYTES, MOST_ERROR = 64, 4 * 1024 * 1024, 4000
ATTEMPTS, FIRST_DELAY, MOST_DELAY, LEASE = 5, 30, 3600, 120
ACTIVE = ("pending", "processing", "retry")
JOB = ("dedupe_key", "operation", "project_id", "file_id", "expected_hash")


def instance_id(slug: Column | str) -> Column:
    """Index name of a project slug; null where it is empty, too long or not a name."""
    name = F.regexp_replace(F.regexp_replace(F.lower(T.nfkc(slug)), "[^a-z0-9_]+", "-"), "^-+|-+$", "")
    return F.when((F.length(name) <= MOST_NAME) & name.rlike("^[a-z0-9_]+(?:-[a-z0-9_]+)*$"), name)


def item_key(path: Column | str) -> Column:
    """Project-relative path of an item; null where nothing is left or a part is .. ."""
    parts = F.filter(F.split(F.replace(T.nfc(path), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when((F.size(parts) > 0) & ~F.exists(parts, lambda p: p == ".."), F.array_join(parts, "/"))


def index_hash(file_hash: Column | str, project_hash: Column | str) -> Column:
    return F.concat(T.col(file_hash), F.lit("|"), T.col(project_hash))


def retry_delay(attempts: Column | str) -> Column:
    """30, 60, 120 ... seconds, an hour at most."""
    return F.least(F.lit(MOST_DELAY), F.lit(FIRST_DELAY) * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(T.col(attempts), F.lit(30)) - 1))).cast("int")


def ensure_job(project_id, config_hash, name=None) -> list[Column]:
    """With an index name the reconciler's key, without one the change log's."""
    key = F.concat(F.lit("ensure:"), project_id, F.lit(":"), config_hash) if name is None else F.concat(F.lit("ensure:"), project_id, F.lit(":"), F.when(config_hash != "", config_hash).otherwise("current"), F.lit(f":{LAYOUT}:"), name)
    return [key.alias("dedupe_key"), F.lit("ensure_instance").alias("operation"), project_id.alias("project_id"), F.lit(None).cast("string").alias("file_id"), config_hash.alias("expected_hash")]


def upsert_job(project_id, file_id, file_hash, config_hash, reconcile: bool) -> list[Column]:
    tail = [F.lit(f":{LAYOUT}")] if reconcile else []
    key = F.concat(F.lit("upsert:"), file_id, F.lit(":"), file_hash, F.lit(":"), config_hash, *tail)
    return [key.alias("dedupe_key"), F.lit("upsert_file").alias("operation"), project_id.alias("project_id"), file_id.alias("file_id"), index_hash(file_hash, config_hash).alias("expected_hash")]


def delete_jobs(items: DataFrame) -> DataFrame:
    key = F.concat(F.lit("delete:"), "file_id", F.lit(":"), "item_id")
    return items.select(key.alias("dedupe_key"), F.lit("delete_file").alias("operation"), "project_id", "file_id", F.col("item_id").alias("expected_hash"))


def _live_files(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'file' and deleted_at is null").select(F.col("id").alias("entity_id"))


#: A project with more than one in SPREAD of all files is dealt to so many parts.
SPREAD = 64


def fan_out_project_changes(changed: DataFrame, ledger: DataFrame, nodes: DataFrame) -> DataFrame:
    """changed (project_id, content_hash) -> an upsert for each live file of the projects.

    Files of large projects, by their count, meet their project in SPREAD parts,
    so that no task has a large project's files alone.
    """
    listed = ledger.where("entity_type = 'file'").select("entity_id", "project_id", F.col("content_hash").alias("file_hash"))
    counts = listed.groupBy("project_id").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"))  # one row
    large = F.broadcast(counts.crossJoin(F.broadcast(whole)).where(F.col("n") * SPREAD > F.col("total")).select("project_id", F.lit(True).alias("large")))  # fewer than SPREAD rows
    part = F.when(F.col("large"), F.pmod(F.xxhash64("entity_id"), F.lit(SPREAD))).otherwise(F.lit(0).cast("bigint"))
    files = listed.join(_live_files(nodes), "entity_id", "left_semi").join(large, "project_id", "left").withColumn("part", part).drop("large")
    parts = F.when(F.col("large"), F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    asked = changed.select("project_id", F.col("content_hash").alias("config_hash")).join(large, "project_id", "left").select("project_id", "config_hash", F.explode(parts).alias("part"))
    rows = files.join(asked, ["project_id", "part"])
    return rows.select(*upsert_job(F.col("project_id"), F.col("entity_id"), F.col("file_hash"), F.col("config_hash"), False))


def ledger_changes_to_jobs(before: DataFrame, after: DataFrame, nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Jobs for what differs between two ledgers, in the change log's form, each key once."""
    keys = ["sync_key", "entity_type", "entity_id", "project_id"]
    b = before.select(*keys, F.col("content_hash").alias("old_hash"))
    a = after.select(*keys, "content_hash")
    changed = a.join(b.select("sync_key", "old_hash"), "sync_key", "left").where(~F.col("content_hash").eqNullSafe(F.col("old_hash")))
    projects = changed.where("entity_type = 'project'")
    ensure = projects.select(*ensure_job(F.col("project_id"), F.col("content_hash")))
    current = after.where("entity_type = 'project'").select(F.col("entity_id").alias("project_id"), F.col("content_hash").alias("config_hash"))
    files = changed.where("entity_type = 'file'").join(_live_files(nodes), "entity_id", "left_semi").join(current, "project_id")
    upsert = files.select(*upsert_job(F.col("project_id"), F.col("entity_id"), F.col("content_hash"), F.col("config_hash"), False))
    gone = b.where("entity_type = 'file'").join(a, "sync_key", "left_anti").select(F.col("entity_id").alias("file_id"))
    delete = delete_jobs(items.join(gone, "file_id", "left_semi"))
    return ensure.union(fan_out_project_changes(projects, after, nodes)).union(upsert).union(delete).dropDuplicates(["dedupe_key"])


def reconcile_projects(projects: DataFrame, ledger: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ensure jobs for live projects whose index is missing, misnamed or not ready; slugs without a valid name are left out."""
    p = projects.where("deleted_at is null").select(F.col("id").alias("project_id"), instance_id("slug").alias("wanted"))
    sync = ledger.where("entity_type = 'project'").select(F.col("entity_id").alias("project_id"), "content_hash")
    m = mapping.select("project_id", "instance_id", "replacement_instance_id", "status")
    rows = p.join(sync, "project_id", "left").join(m, "project_id", "left")
    there = F.coalesce(F.col("instance_id") == F.col("wanted"), F.lit(False)) | F.coalesce(F.col("replacement_instance_id") == F.col("wanted"), F.lit(False))
    rows = rows.where(F.col("wanted").isNotNull() & (~there | ~F.col("status").eqNullSafe(F.lit("ready"))))
    return rows.select(*ensure_job(F.col("project_id"), F.coalesce("content_hash", F.lit("")), F.col("wanted")))


def _indexable(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    files = ledger.where("entity_type = 'file'").select(F.col("entity_id").alias("file_id"), F.col("content_hash").alias("file_hash"))
    projects = ledger.where("entity_type = 'project'").select(F.col("entity_id").alias("project_id"), F.col("content_hash").alias("config_hash"))
    return docs.join(files, "file_id").join(projects, "project_id")


def reconcile_files(docs: DataFrame, ledger: DataFrame, items: DataFrame) -> DataFrame:
    """Upserts for documents whose item is missing, failed, elsewhere, otherwise keyed or stale."""
    rows = _indexable(docs.select("file_id", "project_id", "project_slug", "path"), ledger)
    it = items.select("file_id", "item_id", "instance_id", F.col("item_key").alias("own_key"), F.col("index_hash").alias("own_hash"), "status")
    rows = rows.join(it, "file_id", "left").withColumn("wanted", instance_id("project_slug")).withColumn("wanted_key", item_key("path"))
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    stale = F.col("item_id").isNull() | (F.col("status") == "error") | differs("instance_id", F.col("wanted")) | differs("own_key", F.col("wanted_key")) | differs("own_hash", index_hash("file_hash", "config_hash"))
    return rows.where(stale).select(*upsert_job(F.col("project_id"), F.col("file_id"), F.col("file_hash"), F.col("config_hash"), True))


def obsolete_items(items: DataFrame, docs: DataFrame) -> DataFrame:
    return delete_jobs(items.join(docs.select("file_id"), "file_id", "left_anti"))


def merge_jobs(jobs: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """incoming into jobs by dedupe_key: new ones start, completed ones start anew, active and failed ones stay as they are."""
    fresh = incoming.dropDuplicates(["dedupe_key"]).select(*(F.col(c).alias(f"in_{c}") for c in JOB))
    both = jobs.join(fresh, F.col("dedupe_key") == F.col("in_dedupe_key"), "full")
    new, again = F.col("dedupe_key").isNull(), (F.col("status") == "completed") & F.col("in_dedupe_key").isNotNull()
    start = new | F.coalesce(again, F.lit(False))
    null = F.lit(None)
    made = {
        "status": F.lit("pending"),
        "attempts": F.lit(0),
        "next_attempt_at": now,
        "lease_expires_at": null,
        "last_error": null,
        "updated_at": now,
        "completed_at": null,
    }
    kinds = dict(jobs.dtypes)
    out = []
    for c in jobs.columns:
        if c in made:
            out.append(F.when(start, made[c].cast(kinds[c])).otherwise(F.col(c)).alias(c))
        elif c in JOB:
            out.append(F.coalesce(F.col(c), F.col(f"in_{c}")).alias(c))
        elif c == "created_at":
            out.append(F.coalesce(F.col(c), now.cast(kinds[c])).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def _reopened(jobs: DataFrame, chosen: Column, now: Column) -> DataFrame:
    made = {"status": F.lit("retry"), "attempts": F.lit(0), "next_attempt_at": now, "lease_expires_at": F.lit(None), "last_error": F.lit(None), "updated_at": now, "completed_at": F.lit(None)}
    kinds = dict(jobs.dtypes)
    return jobs.select(*(F.when(chosen, made[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in jobs.columns))


def recover_failed(jobs: DataFrame, patterns: Sequence[str], now: Column, operation: str = "upsert_file") -> DataFrame:
    """Failed jobs whose message holds one of the (lower-case) patterns go to retry."""
    message = F.lower(F.coalesce("last_error", F.lit("")))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | message.contains(p)
    return _reopened(jobs, (F.col("status") == "failed") & (F.col("operation") == operation) & hit, now)


def retry_failed(jobs: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The `limit` (1 to 100) longest untouched failed jobs go to retry."""
    oldest = jobs.where("status = 'failed'").orderBy("updated_at", "dedupe_key").limit(max(1, min(100, limit))).select("dedupe_key", F.lit(True).alias("chosen"))
    rows = jobs.join(oldest, "dedupe_key", "left")
    return _reopened(rows, F.coalesce("chosen", F.lit(False)), now).select(*jobs.columns)


def ready_jobs(jobs: DataFrame, now: Column, limit: int | None = 3) -> DataFrame:
    """Jobs that may run, ensure before delete before upsert, oldest first; 1 to 10 of them, or with no limit all, in no order."""
    ready = jobs.where(F.col("status").isin(*ACTIVE) & (F.col("next_attempt_at") <= now) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)))
    if limit is None:
        return ready
    kind = F.when(F.col("operation") == "ensure_instance", 0).when(F.col("operation") == "delete_file", 1).otherwise(2)
    return ready.orderBy(kind, "created_at", "dedupe_key").limit(max(1, min(10, limit)))


def claim_jobs(jobs: DataFrame, ready: DataFrame, now: Column) -> DataFrame:
    mine = ready.select("dedupe_key", F.lit(True).alias("claimed"))
    rows = jobs.join(mine, "dedupe_key", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    made = {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "lease_expires_at": now + F.expr(f"interval {LEASE} seconds"), "updated_at": now}
    return rows.select(*(F.when(F.col("claimed"), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in jobs.columns))


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """outcomes (dedupe_key, result completed | skipped | error, message, permanent) into claimed jobs.

    An error means retry after the delay of the attempts so far, or failed
    after ATTEMPTS of them or if it is permanent; messages are cut.
    """
    o = outcomes.select("dedupe_key", "result", "message", F.coalesce("permanent", F.lit(False)).alias("permanent"))
    rows = jobs.join(o, "dedupe_key", "left")
    known, error = F.col("result").isNotNull(), F.col("result") == "error"
    over = (F.col("attempts") >= ATTEMPTS) | F.col("permanent")
    made = {
        "status": F.when(error & over, "failed").when(error, "retry").otherwise("completed"),
        "next_attempt_at": F.when(error, F.timestamp_seconds(F.unix_timestamp(now) + retry_delay("attempts"))).otherwise(F.col("next_attempt_at")),
        "lease_expires_at": F.lit(None).cast("timestamp"),
        "last_error": F.when(error, F.substring("message", 1, MOST_ERROR)),
        "updated_at": now,
        "completed_at": F.when(~error, now).otherwise(F.col("completed_at")),
    }
    return rows.select(*(F.when(known, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in jobs.columns))


def outcome_summary(claimed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of completed, skipped, retried and failed among claimed jobs (attempts already raised)."""
    rows = claimed.join(outcomes, "dedupe_key")
    over = (F.col("attempts") >= ATTEMPTS) | F.coalesce("permanent", F.lit(False))
    error = F.col("result") == "error"
    return rows.agg(F.count("*").alias("claimed"), F.count_if(F.col("result") == "completed").alias("completed"), F.count_if(F.col("result") == "skipped").alias("skipped"), F.count_if(error & ~over).alias("retried"), F.count_if(error & over).alias("failed"))


def fail_items(items: DataFrame, jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Items whose upsert failed or is to be retried carry its message."""
    bad = jobs.where("operation = 'upsert_file'").join(outcomes.where("result = 'error'"), "dedupe_key").groupBy("file_id").agg(F.max(F.substring("message", 1, MOST_ERROR)).alias("message"))
    rows = items.join(bad.withColumn("hit", F.lit(True)), "file_id", "left")
    made = {"status": F.lit("error"), "last_error": F.col("message"), "updated_at": now}
    return rows.select(*(F.when(F.col("hit"), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in items.columns))


def decide_upserts(jobs: DataFrame, docs: DataFrame, files: DataFrame, ledger: DataFrame, items: DataFrame) -> DataFrame:
    """upsert jobs -> decision (missing, stale, current, too_large, upload), with the predecessor an upload must keep."""
    facts = _indexable(docs.select("file_id", "project_id", "project_slug", "path", F.octet_length("content").alias("n_bytes")), ledger).drop("project_id")
    facts = facts.join(files.select(F.col("node_id").alias("file_id"), "content_hash"), "file_id").withColumn("found", F.lit(True))
    own = items.select("file_id", *(F.col(c).alias(f"item_{c}") for c in ("instance_id", "item_id", "item_key", "index_hash", "content_hash", "status", "previous_instance_id", "previous_item_id")))
    rows = jobs.where("operation = 'upsert_file'").select("dedupe_key", "file_id", "expected_hash").join(facts, "file_id", "left").join(own, "file_id", "left")
    want = index_hash("file_hash", "config_hash")
    same = (F.col("item_status") == "indexed") & (F.col("item_index_hash") == want) & (F.col("item_content_hash") == F.col("content_hash")) & (F.col("item_instance_id") == instance_id("project_slug")) & (F.col("item_item_key") == item_key("path"))
    decision = F.when(F.col("found").isNull(), "missing").when((F.coalesce("expected_hash", F.lit("")) != "") & (F.col("expected_hash") != want), "stale").when(same, "current").when(F.col("n_bytes") > MOST_BYTES, "too_large").otherwise("upload")
    rows = rows.withColumn("decision", decision)
    keep = F.col("item_status") == "indexed"
    upload = F.col("decision") == "upload"
    return rows.select("dedupe_key", "file_id", "decision", F.when(upload, F.when(keep, F.col("item_instance_id")).otherwise(F.col("item_previous_instance_id"))).alias("keep_instance_id"), F.when(upload, F.when(keep, F.col("item_item_id")).otherwise(F.col("item_previous_item_id"))).alias("keep_item_id"))


def decide_deletes(jobs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """delete jobs -> decision (live, no_item, other_item, delete) and the items to remove."""
    live = docs.select("file_id", F.lit(True).alias("live"))
    own = items.select("file_id", "instance_id", "item_id", "previous_instance_id", "previous_item_id")
    rows = jobs.where("operation = 'delete_file'").select("dedupe_key", "file_id", "expected_hash").join(live, "file_id", "left").join(own, "file_id", "left")
    decision = F.when(F.col("live"), "live").when(F.col("item_id").isNull(), "no_item").when((F.coalesce("expected_hash", F.lit("")) != "") & (F.col("expected_hash") != F.col("item_id")), "other_item").otherwise("delete")
    before = F.col("previous_item_id").isNotNull() & F.col("previous_instance_id").isNotNull() & ~((F.col("previous_item_id") == F.col("item_id")) & (F.col("previous_instance_id") == F.col("instance_id")))
    gone = F.col("decision") == "delete"
    return rows.withColumn("decision", decision).select("dedupe_key", "file_id", "decision", F.when(gone, F.col("item_id")).alias("delete_item_id"), F.when(gone & before, F.col("previous_item_id")).alias("delete_previous_item_id"))


def apply_remote_status(items: DataFrame, report: DataFrame, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """report (file_id, remote_status, chunks_count) into all waiting items, or the `limit` oldest-checked ones -> items, and file ids to queue anew."""
    waiting = items.where("status in ('queued', 'processing')")
    if limit is not None:
        waiting = waiting.orderBy(F.coalesce("checked_at", "created_at"), "file_id").limit(limit)
    r = report.join(waiting.select("file_id"), "file_id", "left_semi").select("file_id", "remote_status", F.col("chunks_count").alias("remote_chunks"), F.lit(True).alias("seen"))
    rows = items.join(r, "file_id", "left")
    remote = F.col("remote_status")
    done, bad = remote == "completed", remote.isin("error", "skipped", "outdated")
    status = F.when(done, "indexed").when(bad, "error").when(remote == "queued", "queued").otherwise("processing")
    made = {
        "status": status,
        "chunks_count": F.col("remote_chunks"),
        "last_error": F.when(bad, F.concat(F.lit("index item ended with remote status: "), remote)).when(done, F.lit(None)).otherwise(F.col("last_error")),
        "indexed_at": F.when(done, now).otherwise(F.col("indexed_at")),
        "checked_at": now,
        "previous_instance_id": F.when(done, F.lit(None)).otherwise(F.col("previous_instance_id")),
        "previous_item_id": F.when(done, F.lit(None)).otherwise(F.col("previous_item_id")),
        "updated_at": now,
    }
    after = rows.select(*(F.when(F.col("seen"), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in items.columns))
    return after, r.where(bad).select("file_id")


def ready_swaps(mapping: DataFrame, docs: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects whose replacement index is complete: every document indexed there and no active job."""
    m = mapping.where("replacement_instance_id is not null and replacement_instance_id <> instance_id").select("project_id", "instance_id", "replacement_instance_id")
    own = items.select("file_id", F.col("instance_id").alias("at"), "status")
    lacking = docs.select("file_id", "project_id").join(m, "project_id").join(own, "file_id", "left").where("at is null or at <> replacement_instance_id or status <> 'indexed'")
    busy = jobs.where(F.col("status").isin(*ACTIVE))
    return m.join(lacking.select("project_id").distinct(), "project_id", "left_anti").join(busy.select("project_id").distinct(), "project_id", "left_anti")


def status_counts(mapping: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    parts = [t.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "status", "n") for k, t in (("projects", mapping), ("items", items), ("jobs", jobs))]
    return parts[0].union(parts[1]).union(parts[2])


def coverage(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = docs.select("file_id").join(items.select("file_id", "status"), "file_id", "left")
    return rows.agg(F.count("*").alias("expected"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status").isin("queued", "processing")).alias("waiting"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(F.col("status").isNull()).alias("missing"))


def recent_errors(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.where("last_error is not null").orderBy(F.desc("updated_at"), "dedupe_key").limit(n).select("dedupe_key", "operation", "status", "attempts", "last_error", "updated_at")


def health(projects: DataFrame, runs: DataFrame, kv: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: live projects, the last run, whether a bootstrap pointer exists, and coverage."""
    live = projects.where("deleted_at is null").agg(F.count("*").alias("projects"))
    last = runs.agg(F.max_by("status", F.struct("started_at", "id")).alias("last_run"))
    boot = kv.agg((F.count_if(F.col("key").startswith("manifest:bootstrap:")) > 0).alias("bootstrap"))
    return live.crossJoin(last).crossJoin(boot).crossJoin(coverage(docs, items))
