"""Jobs run off a stream: a state for each key, with timers for leases that end and retries that fall due."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.outbox import ATTEMPTS, FIRST_DELAY, LEASE, MOST_DELAY, MOST_ERROR
from foliospark.streaming.jobs import PROVIDER, ROCKSDB

#: What the stream of events has to have: kind job, outcome, or tick, which tells the time alone.
EVENT = ("at", "kind", "dedupe_key", "result", "message", "permanent")
#: Keys are dealt to so many buckets by their hash. A call and a state for each key would cost milliseconds a key and batch.
BUCKETS = 512
#: What is known of a bucket's jobs: a JSON object of key -> [status, attempts, due, last_error, step].
STATE = "jobs string"
#: step: the transitions of a key in order.
CHANGE = "dedupe_key string, step int, at timestamp, status string, attempts int, next_attempt_at timestamp, lease_expires_at timestamp, last_error string"


def delay_ms(attempts: int) -> int:
    """30, 60, 120 ... seconds, an hour at most."""
    return 1000 * min(MOST_DELAY, FIRST_DELAY * 2 ** (min(attempts, 30) - 1))


class Leases:
    """The lives of a bucket's jobs: claimed as they come, claimed again when a lease or a delay is over, until completed or failed."""

    def __init__(self, jobs: dict[str, list]) -> None:
        self.jobs, self.changes = jobs, []

    def _write(self, key: str, at: int, status: str, attempts: int, due: int | None, error: str | None) -> None:
        """The job's new state, and the row that tells of it. due: when the lease ends, or the next attempt."""
        step = self.jobs[key][4] + 1 if key in self.jobs else 1
        self.jobs[key] = [status, attempts, due, error, step]
        self.changes.append((key, step, at, status, attempts, due if status == "retry" else at, due if status == "processing" else None, error))

    def _claim(self, key: str, at: int, attempts: int, error: str | None) -> None:
        self._write(key, at, "processing", attempts + 1, at + 1000 * LEASE, error)

    def _catch_up(self, key: str, now: int) -> None:
        """Claim as often as leases and delays ended up to now: timers wait for the watermark, events may be ahead of it."""
        while key in self.jobs:
            _, attempts, due, error, _ = self.jobs[key]
            if due is None or due > now:
                return
            self._claim(key, due, attempts, error)

    def take(self, at: int, kind: str, key: str, result: str, message: str, permanent: bool) -> None:
        """One event; a key's come in the order of their times."""
        self._catch_up(key, at)
        status, attempts, *_ = self.jobs.get(key, (None, 0))
        if kind == "job" and status in (None, "completed"):
            self._claim(key, at, 0, None)
        elif kind == "outcome" and status == "processing":
            if result != "error":
                self._write(key, at, "completed", attempts, None, None)
            elif permanent or attempts >= ATTEMPTS:
                self._write(key, at, "failed", attempts, None, message[:MOST_ERROR])
            else:
                self._write(key, at, "retry", attempts, at + delay_ms(attempts), message[:MOST_ERROR])

    def next_due(self, now: int) -> int | None:
        """Once all have caught up with now: when the next lease or delay ends."""
        for key in [k for k, job in self.jobs.items() if job[2] is not None and job[2] <= now]:
            self._catch_up(key, now)
        return min((job[2] for job in self.jobs.values() if job[2] is not None), default=None)

    def frame(self) -> pd.DataFrame:
        frame = pd.DataFrame(self.changes, columns=[c.split()[0] for c in CHANGE.split(", ")])
        for c in ("at", "next_attempt_at", "lease_expires_at"):
            frame[c] = pd.to_datetime(frame[c], unit="ms")
        return frame


def _run(bucket: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A bucket's events, or its timer, which is that of the job that is due first."""
    if bucket[0] < 0:
        return
    leases = Leases(json.loads(state.get[0]) if state.exists else {})
    if not state.hasTimedOut:
        events = pd.concat([f[["at_ms", "kind", "dedupe_key", "result", "message", "permanent"]] for f in frames]).sort_values("at_ms", kind="stable")
        for e in zip(*(events[c].tolist() for c in events.columns), strict=True):
            leases.take(*e)
    due = leases.next_due(state.getCurrentWatermarkMs())
    if leases.changes:
        state.update((json.dumps(leases.jobs, ensure_ascii=False, separators=(",", ":")),))
        yield leases.frame()
    if due is not None:
        state.setTimeoutTimestamp(due)


def stream_leases(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """events, a stream of EVENT, -> every change of every job (CHANGE), for whoever runs them and for the job table.

    at is the time an event was taken in, which only grows; its watermark is
    the clock by which leases and delays end, so ticks keep it going. A job
    that comes is claimed at once, for LEASE seconds. An outcome is that of the
    claim under way, others are passed over: completed or skipped ends the job,
    an error brings it back after 30 * 2^(attempts - 1) seconds, or fails it
    after ATTEMPTS of them or if it is permanent. A lease that ends without an
    outcome is claimed again. A job that comes again is new if it was completed,
    and nothing else. Null keys are ticks. Keys are dealt to `buckets`, each of
    which is read and written whole when one of its jobs changes, so many
    millions of them call for more; the number stays as long as the checkpoint.
    """
    conf = events.sparkSession.conf
    if conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        conf.set(PROVIDER, ROCKSDB)
    timed = events.withWatermark("at", "0 seconds")
    # ticks are a bucket of their own, without a state
    bucket = F.coalesce(F.when(F.col("dedupe_key").isNotNull(), F.pmod(F.xxhash64("dedupe_key"), F.lit(buckets))), F.lit(-1))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    dealt = timed.select("at", bucket.cast("int").alias("bucket"), text("kind"), text("dedupe_key"), text("result"), text("message"), F.coalesce("permanent", F.lit(False)).alias("permanent"), F.unix_millis("at").alias("at_ms"))
    return dealt.groupBy("bucket").applyInPandasWithState(_run, CHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
