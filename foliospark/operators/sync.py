"""Sync planning and merging: classify a manifest against the ledger, plan removals, merge every table.

A manifest is three DataFrames: projects, folders, files. `now` is always passed in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.normalize import manifest_fingerprint
from foliospark.sources.versions import Snapshot, VersionedStore

ENTITY = ("sync_key", "entity_type", "entity_id", "project_id", "source_path", "content_hash")
CHANGE_NOTES = ("Initial content sync", "Updated by content sync")
AUTHOR = "content-sync"


def entities(manifest: dict[str, DataFrame]) -> DataFrame:
    """All entities of a manifest in the ledger's shape; bodies stay out."""
    kinds = (("project", "projects", "id", "config_hash"), ("folder", "folders", "project_id", "config_hash"), ("file", "files", "project_id", "sync_hash"))
    out = None
    for kind, table, project, digest in kinds:
        rows = manifest[table].select(F.concat(F.lit(f"{kind}:"), "id").alias("sync_key"), F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.col(project).alias("project_id"), "source_path", F.col(digest).alias("content_hash"))
        out = rows if out is None else out.unionByName(rows)
    return out


def classify_entities(manifest: dict[str, DataFrame], ledger: DataFrame) -> DataFrame:
    """Each entity with created, moved, updated, unchanged; moved and updated may both hold."""
    old = ledger.select("sync_key", F.col("source_path").alias("old_path"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    rows = entities(manifest).join(old, "sync_key", "left")
    known = F.col("known").isNotNull()
    moved, updated = known & ~F.col("source_path").eqNullSafe(F.col("old_path")), known & ~F.col("content_hash").eqNullSafe(F.col("old_hash"))
    return rows.select(*ENTITY, (~known).alias("created"), moved.alias("moved"), updated.alias("updated"), (known & ~moved & ~updated).alias("unchanged"))


def plan_deletions(manifest: dict[str, DataFrame], ledger: DataFrame, prune: bool) -> DataFrame:
    """Ledger rows to remove: not projects, of projects that prune, absent from the manifest; none unless prune is asked for."""
    pruning = manifest["projects"].where("prune").select(F.col("id").alias("project_id"))
    gone = ledger.where("entity_type <> 'project'").join(pruning, "project_id", "left_semi").join(entities(manifest).select("sync_key"), "sync_key", "left_anti")
    return (gone if prune else gone.where("false")).select("sync_key", "entity_type", "entity_id", "project_id")


def plan_stats(classified: DataFrame, deletions: DataFrame) -> DataFrame:
    counted = classified.groupBy("entity_type").agg(*(F.count_if(c).alias(c) for c in ("created", "updated", "moved", "unchanged")))
    gone = deletions.groupBy("entity_type").agg(F.count("*").alias("deleted"))
    return counted.join(gone, "entity_type", "full").select("entity_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("created", "updated", "moved", "unchanged", "deleted")))


def changed_entities(classified: DataFrame) -> DataFrame:
    """Entities whose rows must be written: new ones and those with another hash. A moved source touches the ledger alone."""
    return classified.where("created or updated")


def has_mutations(classified: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row, one boolean: whether a sync would do anything."""
    return classified.select((~F.col("unchanged")).alias("m")).union(deletions.select(F.lit(True))).agg(F.coalesce(F.max("m"), F.lit(False)).alias("mutations"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], now: Column, *, created: Sequence[str] = ("created_at",)) -> DataFrame:
    """A merge by key that writes a row only where one of columns differs or it was deleted; merged rows live again."""
    inc = incoming.select(F.col(key).alias("in_key"), *(F.col(c).alias(f"in_{c}") for c in columns))
    both = current.join(inc, F.col(key) == F.col("in_key"), "full")
    new, hit = F.col(key).isNull(), F.col("in_key").isNotNull()
    differs = F.col("deleted_at").isNotNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"in_{c}"))
    write = hit & (new | differs)
    out = []
    for c, kind in current.dtypes:
        if c == key:
            value = F.coalesce(key, "in_key")
        elif c in columns:
            value = F.when(hit, F.col(f"in_{c}")).otherwise(F.col(c))
        elif c == "updated_at":
            value = F.when(write, now).otherwise(F.col(c))
        elif c == "deleted_at":
            value = F.when(hit, F.lit(None)).otherwise(F.col(c))
        elif c in created:
            value = F.when(new, now).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.cast(kind).alias(c))
    return both.select(*out)


def merge_projects(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    return upsert(current, incoming, "id", ("slug", "name", "description", "visibility", "default_language", "metadata_json"), now)


def manifest_nodes(folders: DataFrame, files: DataFrame) -> DataFrame:
    cols = ("id", "project_id", "parent_id", "name", "path", "depth", "sort_order", "visibility")
    return folders.select(*cols, F.lit("folder").alias("node_type")).unionByName(files.select(*cols, F.lit("file").alias("node_type")))


def merge_nodes(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    return upsert(current, incoming, "id", ("project_id", "parent_id", "node_type", "name", "path", "depth", "sort_order", "visibility"), now)


BODY = ("title", "description", "content", "language", "format", "role", "variables_json", "metadata_json", "tags_text")


def merge_files(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """New files start at version 1. Another content hash raises the version and updated_at; other differences are written without either."""
    inc = incoming.select(F.col("id").alias("in_key"), *(F.col(c).alias(f"in_{c}") for c in (*BODY, "content_hash")))
    both = current.join(inc, F.col("node_id") == F.col("in_key"), "full")
    new, hit = F.col("node_id").isNull(), F.col("in_key").isNotNull()
    bumped = hit & ~new & (F.col("content_hash") != F.col("in_content_hash"))
    out = []
    for c, kind in current.dtypes:
        if c == "node_id":
            value = F.coalesce("node_id", "in_key")
        elif c in (*BODY, "content_hash"):
            value = F.when(hit, F.col(f"in_{c}")).otherwise(F.col(c))
        elif c == "current_version":
            value = F.when(new, 1).when(bumped, F.col(c) + 1).otherwise(F.col(c))
        elif c == "updated_at":
            value = F.when(new | bumped, now).otherwise(F.col(c))
        elif c == "created_at":
            value = F.when(new, now).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.cast(kind).alias(c))
    return both.select(*out)


def append_versions(versions: DataFrame, current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """versions plus 1 for files that have none yet, and current + 1 where the content hash differs; existing (file, version) pairs stay."""
    old = current.select(F.col("node_id").alias("id"), F.col("current_version").alias("was"), F.col("content_hash").alias("old_hash"))
    rows = incoming.select("id", "content", "variables_json", "metadata_json", F.col("content_hash").alias("new_hash")).join(old, "id", "left")
    make = lambda part, version, note: part.select(F.col("id").alias("file_id"), version.cast("int").alias("version_number"), "content", "variables_json", "metadata_json", F.lit(note).alias("change_note"), F.lit(AUTHOR).alias("created_by"), now.alias("created_at"))
    fresh = make(rows, F.lit(1), CHANGE_NOTES[0])
    more = make(rows.where("was is not null and old_hash <> new_hash"), F.col("was") + 1, CHANGE_NOTES[1])
    add = fresh.unionByName(more).join(versions.select("file_id", "version_number"), ["file_id", "version_number"], "left_anti")
    return versions.unionByName(add.select(*versions.columns))


def file_tags(files: DataFrame) -> DataFrame:
    """(file_id, normalized_name, name, place): tags by compatibility form, trimmed, lower-cased; the last spelling shows, the first place counts."""
    rows = files.select(F.col("id").alias("file_id"), F.posexplode("tags").alias("at", "raw"))
    rows = rows.withColumn("normalized_name", F.lower(T.strip(T.nfkc("raw")))).where("normalized_name <> ''")
    return rows.groupBy("file_id", "normalized_name").agg(F.max_by(T.strip("raw"), "at").alias("name"), F.min("at").alias("place"))


def merge_tags(tags: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tags (normalized_name, name) and links (file_id, normalized_name) after files: their links anew, unused tags gone."""
    fresh = file_tags(files)
    kept = links.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    links = kept.select("file_id", "normalized_name").unionByName(fresh.select("file_id", "normalized_name"))
    named = fresh.groupBy("normalized_name").agg(F.max_by("name", F.struct("file_id", "place")).alias("new_name"))
    merged = tags.join(named, "normalized_name", "full").select("normalized_name", F.coalesce("new_name", "name").alias("name"))
    return merged.join(links.select("normalized_name").distinct(), "normalized_name", "left_semi"), links


def apply_deletions(nodes: DataFrame, ledger: DataFrame, deletions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes softly deleted, ledger rows removed."""
    gone = deletions.select(F.col("entity_id").alias("id"), F.lit(True).alias("gone")).distinct()
    rows = nodes.join(gone, "id", "left")
    hit = F.col("gone") & F.col("deleted_at").isNull()
    nodes = rows.select(*(F.when(hit, now).otherwise(F.col(c)).alias(c) if c in ("deleted_at", "updated_at") else F.col(c) for c in nodes.columns))
    return nodes, ledger.join(deletions.select("sync_key"), "sync_key", "left_anti")


def merge_ledger(ledger: DataFrame, manifest: dict[str, DataFrame], run_id: str, now: Column) -> DataFrame:
    """Rows touched only where something differs."""
    values = ENTITY[1:]
    inc = entities(manifest).select(F.col("sync_key").alias("in_key"), *(F.col(c).alias(f"in_{c}") for c in values))
    both = ledger.join(inc, F.col("sync_key") == F.col("in_key"), "full")
    hit = F.col("in_key").isNotNull()
    differs = F.col("sync_key").isNull()
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"in_{c}"))
    write = hit & differs
    made = {"sync_key": F.coalesce("sync_key", "in_key"), "last_seen_run_id": F.when(write, F.lit(run_id)).otherwise(F.col("last_seen_run_id")), "updated_at": F.when(write, now).otherwise(F.col("updated_at"))}
    made |= {c: F.when(hit, F.col(f"in_{c}")).otherwise(F.col(c)) for c in values}
    return both.select(*(made[c].alias(c) for c in ledger.columns))


def run_log(run_id: str, fingerprint: DataFrame, status: str, prune: bool, stats: DataFrame, now: Column) -> DataFrame:
    """One row of the run log; stats as JSON in order of entity type."""
    packed = stats.agg(F.to_json(F.sort_array(F.collect_list(F.struct("entity_type", "created", "updated", "moved", "unchanged", "deleted")))).alias("stats_json"))
    return packed.crossJoin(fingerprint.select("manifest_hash")).select(F.lit(run_id).alias("id"), "manifest_hash", F.lit(status).alias("status"), F.lit(prune).alias("prune_requested"), "stats_json", now.alias("started_at"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def ledger_snapshot(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("project_id", "entity_type", "source_path", "sync_key")


def sync(tables: dict[str, DataFrame], manifest: dict[str, DataFrame], *, prune: bool, run_id: str, now: Column, dry_run: bool = False) -> dict[str, DataFrame]:
    """The tables after a sync, removals first so that a new id may take a pruned path.

    Entities whose hash is the ledger's own get the ledger row alone, even
    where a table has drifted. A dry run returns the tables as they were. The
    result adds stats and run, the row for the run log; writers put it beside
    the old version and swap.
    """
    classified = classify_entities(manifest, tables["ledger"])
    gone = plan_deletions(manifest, tables["ledger"], prune)
    stats = plan_stats(classified, gone)
    run = run_log(run_id, manifest_fingerprint(manifest), "dry_run" if dry_run else "applied", prune, stats, now)
    if dry_run:
        return tables | {"stats": stats, "run": run}
    todo = changed_entities(classified).select(F.col("entity_type"), F.col("entity_id").alias("id"))
    part = {k: manifest[k].join(todo.where(F.col("entity_type") == kind).select("id"), "id", "left_semi") for k, kind in (("projects", "project"), ("folders", "folder"), ("files", "file"))}
    nodes, ledger = apply_deletions(tables["nodes"], tables["ledger"], gone, now)
    tags, links = merge_tags(tables["tags"], tables["file_tags"], part["files"])
    out = {
        "projects": merge_projects(tables["projects"], part["projects"], now),
        "nodes": merge_nodes(nodes, manifest_nodes(part["folders"], part["files"]), now),
        "versions": append_versions(tables["versions"], tables["files"], part["files"], now),
        "files": merge_files(tables["files"], part["files"], now),
        "tags": tags,
        "file_tags": links,
        "ledger": merge_ledger(ledger, manifest, run_id, now),
        "stats": stats,
        "run": run,
    }
    return tables | out


def sync_store(store: VersionedStore, manifest: dict[str, DataFrame], *, prune: bool, run_id: str, now: Column) -> Snapshot:
    """A sync of the store's latest version, committed as the next one: all its tables, or none.

    The run log gets its row in the same version; stats is that of the last
    sync. Of two syncs at once, one raises Conflict and has to start anew.
    """
    base = store.snapshot()
    tables = base.all()
    out = sync({k: t for k, t in tables.items() if k not in ("stats", "runs")}, manifest, prune=prune, run_id=run_id, now=now)
    run = out.pop("run")
    return store.commit(base, put={k: t for k, t in out.items() if t is not tables.get(k)}, add={"runs": run})


def migrate_flat(items: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """Flat rows (id, slug, title, description, content, category, visibility, deleted_at, created_at, updated_at) and their versions as nodes and files.

    A folder for each live category, named by its hex; system rows become
    private with that role; files for live rows only, versions where a file is.
    """
    folder = lambda c: F.concat(F.lit("legacy-folder-"), F.lower(F.hex(c)))
    live = items.where("deleted_at is null")
    folders = live.select("category").distinct().select(folder("category").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("folder").alias("node_type"), F.col("category").alias("name"), F.concat(F.lit("/"), "category").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("timestamp").alias("deleted_at"))
    name = F.concat(F.when(F.instr("slug", "/") > 0, F.expr("substring(slug, instr(slug, '/') + 1)")).otherwise(F.col("slug")), F.lit(".md"))
    own = items.select("id", folder("category").alias("parent_id"), F.lit("file").alias("node_type"), name.alias("name"), F.concat(F.lit("/"), "slug", F.lit(".md")).alias("path"), (F.length("slug") - F.length(F.replace("slug", F.lit("/"), F.lit(""))) + 1).alias("depth"), F.when(F.col("visibility") == "public", "public").otherwise("private").alias("visibility"), "deleted_at")
    latest = versions.groupBy(F.col("item_id").alias("id")).agg(F.max("version_number").alias("latest"))
    files = live.join(latest, "id", "left").select(F.col("id").alias("node_id"), "title", "description", "content", F.when(F.col("visibility") == "system", "system").otherwise("template").alias("role"), F.lit("").alias("content_hash"), F.coalesce("latest", F.lit(1)).alias("current_version"))
    kept = versions.join(live.select(F.col("id").alias("item_id")), "item_id", "left_semi").select(F.col("item_id").alias("file_id"), "version_number", "content")
    return {"nodes": folders.unionByName(own), "files": files, "versions": kept}


def latest_by_key(versions: DataFrame) -> DataFrame:
    """The newest version of each file."""
    best = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("version_number")))
    return versions.withColumn("n", best).where("n = 1").drop("n")
