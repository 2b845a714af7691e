"""Streams: late and repeated changes, whole rounds of upkeep, leases and retries by a moved clock."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from foliospark.operators import outbox
from foliospark.plans.library import Library, now
from foliospark.sources.versions import VersionedStore
from foliospark.streaming import jobs as streams
from foliospark.streaming import leases

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, SF)


def change_rows(lib):
    """The ledger's changes, times spread over four days in no order, and each of them once more."""
    rows = lib.full_ledger.where("entity_type <> 'folder'").select("entity_type", "entity_id", "project_id", "content_hash").collect()
    out = []
    for i, r in enumerate(rows):
        for k in range(2):
            out.append((START + dt.timedelta(minutes=(i * 7919 + k * 2999) % 5760), "update", *r))
    return out


CHANGES = "changed_at timestamp, change string, entity_type string, entity_id string, project_id string, content_hash string"


def one_by_one(spark, folder, parts, schema):
    """A stream that reads each part in a micro-batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:04d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_and_repeated_changes_equal_the_batch(spark, lib, tmp_path):
    rows = change_rows(lib)
    parts = [rows[0::3], rows[1::3], rows[2::3], rows[:5]]
    tables = {"nodes": lib.nodes, "ledger": lib.full_ledger, "items": lib.items}
    source = one_by_one(spark, str(tmp_path / "log"), parts, CHANGES)
    q = streams.stream_jobs(source, tables).writeStream.format("parquet").option("path", str(tmp_path / "jobs")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == len(parts)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "jobs")).select(*outbox.JOB).collect()]
    want = {tuple(r) for r in outbox.ledger_changes_to_jobs(lib.ledger.limit(0), lib.full_ledger, lib.nodes, lib.items).select(*outbox.JOB).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_change_older_than_all_before_gives_its_job(spark, lib, tmp_path):
    """Hours after the newest change, in a later batch and after a restart."""
    row = change_rows(lib)
    files = [r for r in row if r[2] == "file"]
    tables = {"nodes": lib.nodes, "ledger": lib.full_ledger, "items": lib.items}
    seen = []
    for hours, change in ((12, files[0]), (13, files[2]), (3, files[4]), (14, files[0])):
        one_by_one(spark, f"{tmp_path}/log/{len(seen)}", [[(START + dt.timedelta(hours=hours), *change[1:])]], CHANGES)
        source = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
        streams.stream_jobs(source, tables).writeStream.format("parquet").option("path", str(tmp_path / "jobs")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "jobs")).count())
    assert seen == [1, 2, 3, 3]


def upkeep_store(spark, lib, folder):
    store = VersionedStore(spark, str(folder))
    store.commit(store.snapshot(), put={"projects": lib.projects, "docs": lib.docs, "files": lib.files, "ledger": lib.full_ledger, "mapping": lib.mapping, "items": lib.items, "jobs": lib.jobs.limit(0)})
    return store


def table_of(snapshot, name):
    return sorted(map(str, snapshot.table(name).collect()))


def test_a_batch_takes_effect_once(spark, lib, tmp_path, monkeypatch):
    """Killed before its commit, and after it but before the stream knows: in the end the tables are those of one undisturbed run."""
    rows = change_rows(lib)
    tables = {"nodes": lib.nodes, "ledger": lib.full_ledger, "items": lib.items}
    undisturbed = upkeep_store(spark, lib, tmp_path / "one")
    store = upkeep_store(spark, lib, tmp_path / "two")

    def act(todo):
        result = F.when(F.col("decision") == "upload", "error").otherwise("completed")
        return todo.select("dedupe_key", result.alias("result"), F.lit("no way").alias("message"), F.lit(False).alias("permanent"))

    one_by_one(spark, str(tmp_path / "log"), [rows[::2], rows[1::2]], CHANGES)

    def run(into, state):
        source = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        streams.stream_maintenance(streams.stream_jobs(source, tables), into, now, str(tmp_path / state), act=act, once=True).awaitTermination()

    run(undisturbed, "state-one")
    want = undisturbed.snapshot()
    assert want.version == 3 and want.facts["batches"] == {"jobs": 1}
    whole, calls = VersionedStore.commit, itertools.count()

    def killed(self, *a, **k):
        n = next(calls)
        if n == 0:
            raise RuntimeError("killed before")
        done = whole(self, *a, **k)
        if n == 1:
            raise RuntimeError("killed after")
        return done

    monkeypatch.setattr(VersionedStore, "commit", killed)
    for versions in (1, 2):
        with pytest.raises(Exception, match="killed"):
            run(store, "state-two")
        assert store.snapshot().version == versions
    run(store, "state-two")
    got = store.snapshot()
    assert got.version == 3 and got.facts == want.facts
    assert table_of(got, "jobs") == table_of(want, "jobs") and table_of(got, "items") == table_of(want, "items")
    kinds = {(r["operation"], r["status"], r["attempts"]) for r in got.table("jobs").collect()}
    assert {("ensure_instance", "completed", 1), ("delete_file", "completed", 1), ("upsert_file", "retry", 1), ("upsert_file", "completed", 1)} <= kinds


def test_upkeep_starts_anew_when_another_commit_came_first(spark, lib, tmp_path, monkeypatch):
    store = upkeep_store(spark, lib, tmp_path / "s")
    whole, once = VersionedStore.commit, []

    def late(self, base, **k):
        if not once:
            once.append(whole(self, base, put={"other": spark.range(3)}))
        return whole(self, base, **k)

    monkeypatch.setattr(VersionedStore, "commit", late)
    done = streams.maintain(store, lib.jobs.limit(0), now(), batch=0)
    assert done.version == 3 and "other" in done and done.table("jobs").where("status = 'processing'").count() > 0


EVENTS = "at timestamp, kind string, dedupe_key string, result string, message string, permanent boolean"


def by_batches(spark, events, until):
    """The same life by claim_jobs and apply_outcomes, run at every second at which something may happen."""
    schema = "dedupe_key string, operation string, project_id string, file_id string, expected_hash string, status string, attempts int, next_attempt_at timestamp, lease_expires_at timestamp, last_error string, created_at timestamp, updated_at timestamp, completed_at timestamp"
    table, log, times = spark.createDataFrame([], schema), [], sorted({e[0] for e in events})
    while times:
        at = times.pop(0)
        if at > until:
            break
        moment, before = F.lit(at), {r["dedupe_key"]: r for r in table.collect()}
        mine = [e for e in events if e[0] == at]
        coming = [(e[2], "upsert_file", "p", e[2], "") for e in mine if e[1] == "job"]
        steps = []
        if any(e[1] == "outcome" for e in mine):
            outcomes = spark.createDataFrame([(e[2], e[3], e[4], e[5]) for e in mine if e[1] == "outcome"], "dedupe_key string, result string, message string, permanent boolean")
            steps.append(outbox.apply_outcomes(table, outcomes, moment))
        if coming:
            steps.append(outbox.merge_jobs(steps[-1] if steps else table, spark.createDataFrame(coming, "dedupe_key string, operation string, project_id string, file_id string, expected_hash string"), moment))
        last = steps[-1] if steps else table
        steps.append(outbox.claim_jobs(last, outbox.ready_jobs(last, moment, None), moment))
        for step in steps:
            rows = step.collect()
            for r in rows:
                was = before.get(r["dedupe_key"])
                if r["status"] != "pending" and (was is None or (r["status"], r["attempts"], r["lease_expires_at"]) != (was["status"], was["attempts"], was["lease_expires_at"])):
                    log.append((r["dedupe_key"], at, r["status"], r["attempts"], r["lease_expires_at"]))
                    due = r["lease_expires_at"] if r["status"] == "processing" else r["next_attempt_at"] if r["status"] == "retry" else None
                    if due is not None and due not in times:
                        times = sorted([*times, due])
                before[r["dedupe_key"]] = r
            table = spark.createDataFrame([tuple(r) for r in rows], schema)
    return sorted(log)


def test_leases_and_retries_by_a_moved_clock(spark, tmp_path):
    s = lambda n: START + dt.timedelta(seconds=n)
    job = lambda n, k: (s(n), "job", k, None, None, None)
    done = lambda n, k, result="completed", permanent=False: (s(n), "outcome", k, result, "broken", permanent)
    tick = lambda n: (s(n), "tick", None, None, None, None)
    events = [job(0, "fine"), job(0, "lost"), job(1, "bad"), job(1, "worst"), job(2, "slow")]
    events += [done(10, "fine"), done(11, "worst", "error", True), done(12, "bad", "error"), done(13, "slow", "error"), job(14, "bad"), job(15, "worst")]
    # bad fails five times: claimed at 42, 150, 330, 630
    events += [done(50, "bad", "error"), done(160, "bad", "error"), done(340, "bad", "error"), job(400, "fine"), done(405, "fine", "skipped")]
    events += [tick(n) for n in range(20, 1300, 20)]
    events = sorted(events, key=lambda e: e[0])
    parts = [list(g) for _, g in itertools.groupby(events, key=lambda e: e[0])]
    parts = [sum(parts[i : i + 4], []) for i in range(0, len(parts), 4)]
    source = one_by_one(spark, str(tmp_path / "log"), parts, EVENTS)
    leases.stream_leases(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((r["dedupe_key"], r["at"], r["status"], r["attempts"], r["lease_expires_at"]) for r in rows if r["at"] <= s(1000))
    want = by_batches(spark, [e for e in events if e[1] != "tick"], s(1000))
    assert got == want
    last = {r["dedupe_key"]: r for r in sorted(rows, key=lambda r: r["step"])}
    assert last["fine"]["status"] == "completed" and last["worst"]["status"] == "failed" and last["worst"]["last_error"] == "broken" and last["lost"]["attempts"] >= 8
    assert all(len({r["step"] for r in rows if r["dedupe_key"] == k}) == sum(r["dedupe_key"] == k for r in rows) for k in last)


def test_leases_of_many_keys_share_few_states(spark, tmp_path):
    """Calls and states are those of buckets, whatever the number of keys; each key has its own life."""
    n, s = 3000, lambda t: START + dt.timedelta(seconds=t)
    jobs = [(s(i % 7), "job", f"k{i}", None, None, None) for i in range(n)]
    outcomes = [(s(20 + i % 7), "outcome", f"k{i}", ("completed", "error", "error")[i % 3], None, i % 3 == 1) for i in range(n) if i % 4]
    source = one_by_one(spark, str(tmp_path / "log"), [jobs, outcomes, [(s(100), "tick", None, None, None, None)], [(s(101), "tick", None, None, None, None)]], EVENTS)
    run = leases.stream_leases(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= leases.BUCKETS < n
    changes = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["step"]):
        changes.setdefault(r["dedupe_key"], []).append((r["step"], r["at"], r["status"], r["attempts"]))
    for i in range(n):
        want = [(1, s(i % 7), "processing", 1)]
        if i % 4:
            want.append((2, s(20 + i % 7), ("completed", "failed", "retry")[i % 3], 1))
            want += [(3, s(50 + i % 7), "processing", 2)] if i % 3 == 2 else []
        assert changes[f"k{i}"] == want
