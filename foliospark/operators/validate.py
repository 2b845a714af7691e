"""Checks of a manifest in bulk: path parts, field contracts, duplicates, references, limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's limits, patterns and allowed words.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
IDENTIFIER, SLUG = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$", r"^[a-z0-9][a-z0-9_-]*$"
VISIBILITIES, FORMATS = ("public", "private"), ("markdown", "text", "json")
ROLES = ("system", "developer", "user", "template", "reference")
LENGTHS = {
    "project": {"id": 160, "slug": 100, "name": 200, "description": 2000, "default_language": 50, "source_path": 1000, "config_hash": 100},
    "folder": {"id": 160, "project_id": 160, "parent_id": 160, "name": 255, "path": 1000, "source_path": 1000, "config_hash": 100},
    "file": {"id": 160, "project_id": 160, "parent_id": 160, "name": 255, "path": 1000, "title": 500, "description": 4000, "content": 500_000, "language": 50, "source_path": 1000, "content_hash": 100, "sync_hash": 100},
}
REQUIRED = {
    "project": ("id", "slug", "name", "default_language", "source_path", "config_hash"),
    "folder": ("id", "project_id", "name", "path", "source_path", "config_hash"),
    "file": ("id", "project_id", "name", "path", "title", "language", "source_path", "content_hash", "sync_hash"),
}
LIMITS = {"projects": 50, "folders": 5000, "files": 2000}
MOST_TAGS, MOST_VARIABLES, MOST_NAME = 20, 100, 100
MOST_DEPTH, MOST_SORT = 100, 1_000_000


def path_violations(df: DataFrame, path: str = "path") -> DataFrame:
    """df's rows with the part and rule for each broken part of the path (a leading / is no part)."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    rows = df.select("*", F.explode(parts).alias("part"))
    stem = F.lower(F.substring_index("part", ".", 1))
    rules = (("empty", F.col("part") == ""), ("dots", F.col("part").isin(".", "..")), ("trailing", F.col("part").rlike(r"[ .]$") & ~F.col("part").isin(".", "..")), ("character", F.col("part").rlike(r'[<>:"|?*\\]')), ("reserved", stem.isin(*RESERVED)))
    return rows.withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))))


def _rules(kind: str) -> list[tuple[str, Column]]:
    c = F.col
    rules = [(f"{f}_too_long", F.length(f) > n) for f, n in LENGTHS[kind].items()]
    rules += [(f"{f}_missing", F.trim(F.coalesce(f, F.lit(""))) == "") for f in REQUIRED[kind]]
    rules += [("id_pattern", ~c("id").rlike(IDENTIFIER))]
    if kind == "project":
        rules += [("slug_pattern", ~c("slug").rlike(SLUG)), ("visibility_value", ~c("visibility").isin(*VISIBILITIES))]
    else:
        bad = ~c("path").startswith("/") | c("path").contains("\\") | c("path").contains("//") | F.exists(F.split("path", "/"), lambda p: p.isin(".", ".."))
        rules += [("path_pattern", bad), ("visibility_value", c("visibility").isNotNull() & ~c("visibility").isin(*VISIBILITIES)), ("depth_range", ~c("depth").between(0, MOST_DEPTH)), ("sort_range", ~c("sort_order").between(-MOST_SORT, MOST_SORT))]
    if kind == "file":
        rules += [("format_value", ~c("format").isin(*FORMATS)), ("role_value", ~c("role").isin(*ROLES)), ("tags_many", F.size("tags") > MOST_TAGS), ("tag_comma", F.exists("tags", lambda t: t.contains(","))), ("tag_too_long", F.exists("tags", lambda t: F.length(t) > MOST_NAME)), ("variables_many", F.size("variables") > MOST_VARIABLES), ("variable_too_long", F.exists("variables", lambda v: F.length(v) > MOST_NAME))]
    return rules


def field_violations(manifest: Mapping[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_id, rule) for every broken field rule; one pass over each table."""
    out = None
    for table, kind in (("projects", "project"), ("folders", "folder"), ("files", "file")):
        broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in _rules(kind))))
        rows = manifest[table].select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.explode(broken).alias("rule"))
        out = rows if out is None else out.unionByName(rows)
    return out


def duplicate_violations(manifest: Mapping[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_id, rule): keys that occur more than once; entity_id is the repeated value."""
    p, d, f = manifest["projects"], manifest["folders"], manifest["files"]
    keys = [
        p.select(F.lit("project").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("duplicate_id").alias("rule")),
        p.select(F.lit("project"), "slug", F.lit("duplicate_slug")),
        d.select(F.lit("folder"), "id", F.lit("duplicate_id")),
        f.select(F.lit("file"), "id", F.lit("duplicate_id")),
        d.select("id").distinct().union(f.select("id").distinct()).select(F.lit("node"), "id", F.lit("duplicate_node_id")),
        d.select("project_id", "path").union(f.select("project_id", "path")).select(F.lit("node"), F.concat("project_id", F.lit(":"), F.lower("path")), F.lit("duplicate_path")),
    ]
    rows = keys[0]
    for k in keys[1:]:
        rows = rows.union(k)
    return rows.groupBy("entity_type", "entity_id", "rule").agg(F.count("*").alias("n")).where("n > 1").drop("n")


def reference_violations(manifest: Mapping[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_id, rule): projects and parents that don't exist or disagree with the path."""
    projects = manifest["projects"].select(F.col("id").alias("project_id"), F.lit(True).alias("project_known")).distinct()
    folders = manifest["folders"].select("project_id", F.col("id").alias("parent_id"), F.col("path").alias("parent_path"), F.lit(True).alias("parent_known"))
    cols = ("id", "project_id", "parent_id", "path", "name", "depth")
    nodes = manifest["folders"].select(F.lit("folder").alias("kind"), *cols).unionByName(manifest["files"].select(F.lit("file").alias("kind"), *cols))
    rows = nodes.join(projects, "project_id", "left").join(folders, ["project_id", "parent_id"], "left")
    above = F.regexp_replace("path", "/[^/]*$", "")
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) - 1
    rules = (
        ("unknown_project", F.col("project_known").isNull()),
        ("unknown_parent", F.col("parent_id").isNotNull() & F.col("parent_known").isNull()),
        ("parent_path", F.col("parent_known").isNotNull() & (F.col("parent_path") != above)),
        ("missing_parent", F.col("parent_id").isNull() & (above != "")),
        ("depth", F.col("depth") != slashes),
        ("name", F.col("name") != F.substring_index("path", "/", -1)),
    )
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules)))
    return rows.select(F.col("kind").alias("entity_type"), F.col("id").alias("entity_id"), F.explode(broken).alias("rule"))


def limit_violations(manifest: Mapping[str, DataFrame], limits: Mapping[str, int] = LIMITS) -> DataFrame:
    """(entity_type, n, most) of the tables that hold more rows than allowed."""
    out = None
    for table, most in limits.items():
        row = manifest[table].agg(F.count("*").alias("n")).select(F.lit(table).alias("entity_type"), "n", F.lit(most).cast("bigint").alias("most"))
        out = row if out is None else out.union(row)
    return out.where("n > most")


def validation_report(manifest: Mapping[str, DataFrame]) -> DataFrame:
    """(entity_type, rule, n) over all checks of fields, duplicates and references; no row means the manifest passes."""
    rows = field_violations(manifest).unionByName(duplicate_violations(manifest)).unionByName(reference_violations(manifest))
    return rows.groupBy("entity_type", "rule").agg(F.count("*").alias("n"))
