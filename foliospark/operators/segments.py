"""A full-text index that is kept up to date in segments of a versioned store.

An update writes the postings of new and changed documents as one more
segment, and the ids that it takes out of earlier ones. What is live is what no
later segment has taken out, so searches and statistics are those of an index
built anew. Merging puts segments of about one size together and forgets what
was dead in them, so that their number grows with the logarithm of the updates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.fulltext import FIELDS, build_index
from foliospark.sources.versions import Snapshot, VersionedStore

#: Segments of one size, within a factor of TIER, that are left side by side.
TIER = 4
TABLES = ("postings", "documents", "removed")


def segments(snapshot: Snapshot) -> list[int]:
    return sorted(int(name.split("-")[1]) for name in snapshot.tables if name.startswith("documents-"))


def _live(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows (segment, file_id and more) that no later segment has taken out."""
    last = removed.groupBy("file_id").agg(F.max("segment").alias("gone_at"))
    return rows.join(last, "file_id", "left").where("gone_at is null or segment >= gone_at").drop("gone_at")


def live(snapshot: Snapshot) -> tuple[DataFrame, DataFrame]:
    """The index as build_index gives it: postings (term, file_id, field, positions) and doc_stats (file_id, length)."""
    removed = snapshot.under("removed-")
    postings, documents = (_live(snapshot.under(f"{t}-"), removed) for t in ("postings", "documents"))
    return postings.select("term", "file_id", "field", "positions"), documents.select("file_id", "length")


def update(store: VersionedStore, docs: DataFrame) -> Snapshot:
    """Bring the index to docs: only documents whose fields differ from the index's are read for terms and written.

    docs has file_id, unique, and FIELDS. Nothing is written if nothing differs.
    """
    base = store.snapshot()
    known = segments(base)
    number = max(known, default=-1) + 1
    told = docs.select("file_id", F.sha2(F.to_json(F.struct(*FIELDS)), 256).alias("digest"))
    if known:
        before = _live(base.under("documents-"), base.under("removed-")).select("file_id", F.col("digest").alias("old"))
        differs = before.join(told, "file_id", "full").where(~F.col("digest").eqNullSafe(F.col("old"))).persist()
    else:
        differs = told.withColumn("old", F.lit(None).cast("string"))
    try:
        if known and differs.isEmpty():
            return base
        fresh = docs.join(differs.select("file_id"), "file_id", "left_semi") if known else docs
        postings, stats = build_index(fresh)
        segment = F.lit(number).alias("segment")
        new = {
            "postings": postings.select(segment, "term", "file_id", "field", "positions"),
            "documents": stats.join(told, "file_id").select(segment, "file_id", "length", "digest"),
            "removed": differs.where("old is not null").select(segment, "file_id"),
        }
        return store.commit(base, put={f"{t}-{number}": new[t] for t in TABLES})
    finally:
        differs.unpersist()


def _chosen(sizes: dict[int, int], most: int) -> list[int]:
    """Segments to merge: all those of the fullest size, if there are more than `most` of it."""
    tiers: dict[int, list[int]] = {}
    for segment, n in sizes.items():
        tiers.setdefault(int(math.log(max(n, 1), TIER)), []).append(segment)
    fullest = max(tiers.values(), key=len, default=[])
    if most == 1:
        return sorted(sizes)
    return sorted(fullest) if len(fullest) > most else []


def merge(store: VersionedStore, most: int = TIER) -> Snapshot:
    """Put segments of one size together where there are more than `most` of them (with 1: all segments).

    The merged segment takes the number of the latest. Of what was taken out,
    only ids that still stand dead in other segments are kept.
    """
    base = store.snapshot()
    known = segments(base)
    if len(known) < 2:
        return base
    removed, documents = base.under("removed-"), base.under("documents-")
    alive = _live(documents, removed)
    sizes = dict.fromkeys(known, 0) | {r["segment"]: r["count"] for r in alive.groupBy("segment").count().collect()}  # a row for each segment
    chosen = _chosen(sizes, most)
    if len(chosen) < 2:
        return base
    number = max(chosen)
    mine = F.col("segment").isin(chosen)
    move = lambda rows: _live(rows.where(mine), removed).withColumn("segment", F.lit(number))
    others = documents.where(~mine).select("file_id", F.col("segment").alias("at"))
    still = removed.where(mine).join(others, "file_id").where("at < segment").select("segment", "file_id").distinct()
    put = {"postings": move(base.under("postings-")).select("segment", "term", "file_id", "field", "positions"), "documents": move(documents).select("segment", "file_id", "length", "digest"), "removed": still}
    return store.commit(base, put={f"{t}-{number}": put[t] for t in TABLES}, drop=[f"{t}-{n}" for t in TABLES for n in chosen if n != number])
