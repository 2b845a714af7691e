"""Library tables derived from the driver's tables by expression, in Spark and in SQL.

Everything is computed from whole tables; numbers such as doc_id % 10 only
decide what state a row is in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-06-01 00:00:00"
START = "2024-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@dataclass(frozen=True, eq=False)
class Library:
    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_docs(self) -> int:
        return self.raw("documents").count()

    @cached_property
    def docs0(self) -> DataFrame:
        labels = self.raw("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
        d = self.raw("documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
        tags = F.when(F.col("quality").isNull(), F.array("lang")).otherwise(F.array(F.col("lang"), F.when(F.col("quality") == 1, "good").otherwise("poor")))
        s = F.col("doc_id").cast("string")
        d = d.withColumn("id", F.concat(F.lit("doc-"), s)).withColumn("project_id", F.concat(F.lit("project-"), "source")).withColumn("parent_id", F.concat(F.lit("folder-"), "source", F.lit("-"), "lang"))
        d = d.withColumn("name", F.concat(s, F.lit(".md"))).withColumn("path", F.concat(F.lit("/"), "lang", F.lit("/"), "name")).withColumn("tags", tags).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("text", 256)))
        return d.withColumn("sync_hash", F.concat(F.lit("sha256:"), F.sha2(F.concat("id", "path", "content_hash"), 256))).withColumn("visibility", F.when(F.col("toxic") == 1, "private")).withColumn("k", F.col("doc_id") % 10)

    @cached_property
    def projects(self) -> DataFrame:
        n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
        p = self.raw("documents").select("source").distinct()
        return p.select(
            F.concat(F.lit("project-"), "source").alias("id"), F.col("source").alias("slug"), F.concat(F.upper(F.substring("source", 1, 1)), F.substring("source", 2, 1000)).alias("name"),
            F.concat(F.lit("Documents of "), "source").alias("description"), F.when(n % 5 == 4, "private").otherwise("public").alias("visibility"), F.lit("en").alias("default_language"), F.lit("{}").alias("metadata_json"), (n % 2 == 0).alias("prune"),
            F.concat("source", F.lit("/_project.yaml")).alias("source_path"), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("project:"), "source"), 256)).alias("config_hash"), F.lit(START).cast("timestamp").alias("created_at"), F.lit(START).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        d = self.raw("documents").select("source", "lang").distinct()
        return d.select(
            F.concat(F.lit("folder-"), "source", F.lit("-"), "lang").alias("id"), F.concat(F.lit("project-"), "source").alias("project_id"), F.lit(None).cast("string").alias("parent_id"), F.col("lang").alias("name"), F.concat(F.lit("/"), "lang").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("sort_order"), F.lit(None).cast("string").alias("visibility"),
            F.concat("source", F.lit("/"), "lang", F.lit("/_folder.yaml")).alias("source_path"), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("folder:"), "source", F.lit("/"), "lang"), 256)).alias("config_hash"),
        )

    @cached_property
    def manifest_files(self) -> DataFrame:
        d = self.docs0
        return d.select(
            "doc_id", "k", "id", "project_id", "parent_id", "name", "path", F.lit(1).alias("depth"), (F.col("doc_id") % 7).cast("int").alias("sort_order"), "visibility",
            F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.substring("text", 81, 100).alias("description"), F.col("text").alias("content"), F.col("lang").alias("language"), F.lit("markdown").alias("format"), F.lit("reference").alias("role"), "tags", F.array().cast("array<string>").alias("variables"), F.lit("[]").alias("variables_json"), F.lit("{}").alias("metadata_json"), F.array_join("tags", ",").alias("tags_text"),
            F.concat("source", "path").alias("source_path"), "content_hash", "sync_hash",
        )

    @cached_property
    def manifest(self) -> dict[str, DataFrame]:
        return {"projects": self.projects, "folders": self.folders, "files": self.manifest_files}

    @cached_property
    def nodes(self) -> DataFrame:
        cols = ("id", "project_id", "parent_id", "name", "path", "depth", "sort_order", "visibility")
        rows = self.folders.select(*cols, F.lit("folder").alias("node_type")).unionByName(self.manifest_files.select(*cols, F.lit("file").alias("node_type")))
        return rows.select("*", F.lit(START).cast("timestamp").alias("created_at"), F.lit(START).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))

    @cached_property
    def files(self) -> DataFrame:
        at = F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + (F.col("doc_id") % 500) * 3600)
        return self.manifest_files.select(F.col("id").alias("node_id"), "title", "description", "content", "language", "format", "role", "variables_json", "metadata_json", "tags_text", "content_hash", F.lit(1).alias("current_version"), F.lit(START).cast("timestamp").alias("created_at"), at.alias("updated_at"))

    @cached_property
    def docs(self) -> DataFrame:
        from foliospark.operators.catalog import build_search_documents

        return build_search_documents(self.nodes, self.projects, self.files)

    @cached_property
    def search_table(self) -> DataFrame:
        """docs, stored in the shared folder for a query that reads them several times."""
        from foliospark.sources.trees import stored

        return stored(self.docs)

    @cached_property
    def index(self) -> tuple[DataFrame, DataFrame]:
        """The full-text index, stored in the shared folder for a query that reads it several times."""
        from foliospark.operators.fulltext import build_index
        from foliospark.sources.trees import stored

        postings, stats = build_index(self.search_table)
        return stored(postings), stored(stats)

    # the previous snapshot

    @cached_property
    def old_nodes(self) -> DataFrame:
        ghost = F.concat(F.lit("ghost-"), "doc_id")  # no live id looks so, however many there are
        f = self.manifest_files
        g = f.where("k = 4").select(F.concat(F.lit("doc-"), ghost).alias("id"), "project_id", "parent_id", F.concat(ghost, F.lit(".md")).alias("name"), F.concat(F.lit("/"), "language", F.lit("/"), ghost, F.lit(".md")).alias("path"), "depth", "sort_order", "visibility", F.lit("file").alias("node_type"))
        cols = g.columns
        live = self.folders.select(*cols[:-1], F.lit("folder").alias("node_type")).unionByName(f.where("k <> 0").select("id", "project_id", "parent_id", F.when(F.col("k") == 3, F.concat(F.lit("old-"), "name")).otherwise(F.col("name")).alias("name"), "path", "depth", "sort_order", "visibility", F.lit("file").alias("node_type")))
        return live.unionByName(g).select("*", F.lit(START).cast("timestamp").alias("created_at"), F.lit(START).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))

    @cached_property
    def old_files(self) -> DataFrame:
        f = self.files.join(self.manifest_files.select(F.col("id").alias("node_id"), "k"), "node_id").where("k <> 0")
        changed = F.col("k").isin(1, 3)
        return f.withColumn("content_hash", F.when(changed, "sha256:old").otherwise(F.col("content_hash"))).withColumn("title", F.when(changed, "old title").otherwise(F.col("title"))).drop("k")

    @cached_property
    def versions(self) -> DataFrame:
        return self.old_files.select(F.col("node_id").alias("file_id"), F.lit(1).alias("version_number"), "content", "variables_json", "metadata_json", F.lit("Initial content sync").alias("change_note"), F.lit("content-sync").alias("created_by"), F.lit(START).cast("timestamp").alias("created_at"))

    @cached_property
    def ledger(self) -> DataFrame:
        """The ledger before: k 0 new, 1 other hash, 2 other source, 3 both, 4 with a ghost beside it."""
        f = self.manifest_files
        k = F.col("k")
        file = f.where(k != 0).select(F.concat(F.lit("file:"), "id").alias("sync_key"), F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), "project_id", F.when(k.isin(2, 3), F.concat(F.lit("old/"), "source_path")).otherwise(F.col("source_path")).alias("source_path"), F.when(k.isin(1, 3), "sha256:old").otherwise(F.col("sync_hash")).alias("content_hash"))
        gid = F.concat(F.lit("doc-ghost-"), "doc_id")
        ghost = f.where(k == 4).select(F.concat(F.lit("file:"), gid), F.lit("file"), gid, "project_id", F.concat(F.lit("ghost/"), gid), F.lit("sha256:ghost"))
        p = self.projects.select(F.concat(F.lit("project:"), "id"), F.lit("project"), "id", "id", "source_path", "config_hash")
        d = self.folders.select(F.concat(F.lit("folder:"), "id"), F.lit("folder"), "id", "project_id", "source_path", "config_hash")
        return file.union(ghost).union(p).union(d).withColumn("last_seen_run_id", F.lit("run-1")).withColumn("updated_at", F.lit(START).cast("timestamp"))

    @cached_property
    def full_ledger(self) -> DataFrame:
        """The ledger after a sync."""
        from foliospark.operators.sync import entities

        return entities(self.manifest)

    # the index

    @cached_property
    def items(self) -> DataFrame:
        d = self.manifest_files.withColumn("config_hash", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("project:"), F.substring("project_id", 9, 1000)), 256))).where("doc_id % 7 <> 0")
        status = F.element_at(F.array(*map(F.lit, ("indexed", "queued", "processing", "error"))), (F.col("doc_id") % 4 + 1).cast("int"))
        stamp = lambda n: F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + n)
        live = d.select(F.col("id").alias("file_id"), "project_id", F.substring("project_id", 9, 1000).alias("instance_id"), F.concat(F.lit("item-"), "doc_id").alias("item_id"), F.substring("path", 2, 1000).alias("item_key"), F.when(F.col("doc_id") % 11 == 0, "stale").otherwise(F.concat("sync_hash", F.lit("|"), "config_hash")).alias("index_hash"), "content_hash", status.alias("status"), F.when(status == "indexed", (F.col("doc_id") % 9).cast("int")).alias("chunks_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("indexed_at"), F.when(F.col("doc_id") % 3 == 0, stamp(F.col("doc_id") * 60)).alias("checked_at"), F.when(F.col("doc_id") % 5 == 0, "older").alias("previous_instance_id"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("before-"), "doc_id")).alias("previous_item_id"), stamp(F.col("doc_id")).alias("created_at"), stamp(F.lit(0)).alias("updated_at"))
        orphan = live.where(F.substring("item_id", 6, 20).cast("long") % 13 == 0).withColumn("file_id", F.concat(F.lit("doc-ghost-"), F.substring("item_id", 6, 20))).withColumn("item_id", F.concat(F.lit("orphan-"), "item_id"))
        return live.unionByName(orphan)

    @cached_property
    def mapping(self) -> DataFrame:
        n = F.regexp_extract("slug", "([0-9]+)", 1).cast("int")
        return self.projects.where(n % 6 != 5).select(F.col("id").alias("project_id"), F.when(n % 6 == 4, F.concat(F.lit("legacy-"), "slug")).otherwise(F.col("slug")).alias("instance_id"), F.when(n % 3 == 1, F.col("slug")).alias("replacement_instance_id"), F.when(n % 4 == 3, "pending").otherwise("ready").alias("status"))

    @cached_property
    def jobs(self) -> DataFrame:
        """One job for each (user, event type) of events: the latest event tells its state."""
        e = self.raw("events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max("ts").alias("created_at"))
        i = F.col("event_id")
        operation = F.element_at(F.array(*map(F.lit, ("ensure_instance", "upsert_file", "delete_file"))), (i % 3 + 1).cast("int"))
        status = F.element_at(F.array(*map(F.lit, ("pending", "retry", "processing", "failed", "completed"))), (i % 5 + 1).cast("int"))
        start = F.unix_timestamp(F.lit(NOW))
        return e.select(F.concat(F.lit("job:"), "user_id", F.lit(":"), "event_type").alias("dedupe_key"), operation.alias("operation"), F.concat(F.lit("project-src"), i % 20).alias("project_id"), F.when(operation != "ensure_instance", F.concat(F.lit("doc-"), i % self.n_docs)).alias("file_id"), F.concat(F.lit("hash-"), i % 17).alias("expected_hash"), status.alias("status"), (i % 7).cast("int").alias("attempts"), F.timestamp_seconds(start + (i % 100 - 70) * 60).alias("next_attempt_at"), F.when(i % 4 == 0, F.timestamp_seconds(start + (i % 9 - 4) * 60)).alias("lease_expires_at"), F.when(status.isin("failed", "retry"), F.when(i % 2 == 0, F.lit("Request Timeout after 30 s")).otherwise("bad input")).alias("last_error"), F.date_trunc("second", "created_at").alias("created_at"), F.timestamp_seconds(start - (i % 1000) * 60).alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"))

    @cached_property
    def queries(self) -> DataFrame:
        """Two words of each benchmark item, and odd ones, whose ids no item has: wildcards, case, accents, nothing."""
        b = self.raw("benchmark")
        two = b.select(F.col("item_id").cast("bigint").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("query"))
        odd = [(-1, "%"), (-2, "_"), (-3, "---"), (-4, "THE Of"), (-5, "éle"), (-6, "  "), (-7, "中文"), (-8, "th"), (-9, "10.md")]
        return two.union(self.spark.createDataFrame(odd, "query_id bigint, query string"))

    @cached_property
    def kv(self) -> DataFrame:
        """Key/value records of conversations: a bundle for each, pointers for the even ones, common entries for the rest."""
        c = self.raw("conversations").where("turn = 0").select("conv_id", "text")
        s = F.col("conv_id").cast("string")
        js = lambda **f: F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
        bundles = c.select(F.concat(F.lit("bundle:"), s).alias("key"), js(content=F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("text"))).alias("value"))
        pointers = c.where("conv_id % 2 = 0").select(F.concat(F.lit("manifest:bootstrap:client"), s, F.lit(":default")), js(bundleKey=F.concat(F.lit("bundle:"), F.when(F.col("conv_id") % 3 == 0, "gone-").otherwise(""), s)))
        common = c.where("conv_id % 2 = 1").select(F.concat(F.lit("common:"), s), js(key=F.concat(F.lit("common:"), s), title=F.substring("text", 1, 20)))
        return bundles.union(pointers).union(common)


#: The same tables for DuckDB.
SQL = """
docs0 AS (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic, 'doc-' || d.doc_id AS id, 'project-' || d.source AS project_id, 'folder-' || d.source || '-' || d.lang AS parent_id,
    d.doc_id || '.md' AS name, '/' || d.lang || '/' || d.doc_id || '.md' AS path, CASE WHEN l.quality IS NULL THEN d.lang WHEN l.quality = 1 THEN d.lang || ',good' ELSE d.lang || ',poor' END AS tags_text,
    'sha256:' || sha256(d.text) AS content_hash, CASE WHEN l.toxic = 1 THEN 'private' END AS visibility, d.doc_id % 10 AS k
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
mfiles AS (SELECT *, 'sha256:' || sha256(id || path || content_hash) AS sync_hash, 1 AS depth, CAST(doc_id % 7 AS INTEGER) AS sort_order, substr(split_part(text, chr(10), 1), 1, 80) AS title, substr(text, 81, 100) AS description, source || path AS source_path FROM docs0),
projects AS (SELECT 'project-' || source AS id, source AS slug, upper(substr(source, 1, 1)) || substr(source, 2) AS name, 'Documents of ' || source AS description, CASE WHEN n % 5 = 4 THEN 'private' ELSE 'public' END AS visibility, n, n % 2 = 0 AS prune,
    source || '/_project.yaml' AS source_path, 'sha256:' || sha256('project:' || source) AS config_hash FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS n FROM documents)),
folders AS (SELECT DISTINCT 'folder-' || source || '-' || lang AS id, 'project-' || source AS project_id, CAST(NULL AS VARCHAR) AS parent_id, lang AS name, '/' || lang AS path, 0 AS depth, 0 AS sort_order, CAST(NULL AS VARCHAR) AS visibility, source || '/' || lang || '/_folder.yaml' AS source_path, 'sha256:' || sha256('folder:' || source || '/' || lang) AS config_hash FROM documents),
nodes AS (SELECT id, project_id, parent_id, name, path, depth, sort_order, visibility, 'folder' AS node_type FROM folders UNION ALL SELECT id, project_id, parent_id, name, path, depth, sort_order, visibility, 'file' FROM mfiles),
sdocs AS (SELECT f.id AS file_id, f.project_id, p.slug AS project_slug, p.name AS project_name, f.path, '/' || f.lang AS parent_path, f.name AS file_name, f.title, f.description, f.text AS content, f.lang AS language, coalesce(f.visibility, p.visibility) AS visibility, f.tags_text, TIMESTAMP '2024-01-01 00:00:00' + (f.doc_id % 500) * INTERVAL 1 HOUR AS updated_at, f.doc_id
  FROM mfiles f JOIN projects p ON p.id = f.project_id),
entities AS (SELECT 'project:' || id AS sync_key, 'project' AS entity_type, id AS entity_id, id AS project_id, source_path, config_hash AS content_hash FROM projects
  UNION ALL SELECT 'folder:' || id, 'folder', id, project_id, source_path, config_hash FROM folders UNION ALL SELECT 'file:' || id, 'file', id, project_id, source_path, sync_hash FROM mfiles),
ledger AS (SELECT 'file:' || id AS sync_key, 'file' AS entity_type, id AS entity_id, project_id, CASE WHEN k IN (2, 3) THEN 'old/' || source_path ELSE source_path END AS source_path, CASE WHEN k IN (1, 3) THEN 'sha256:old' ELSE sync_hash END AS content_hash FROM mfiles WHERE k <> 0
  UNION ALL SELECT 'file:doc-ghost-' || doc_id, 'file', 'doc-ghost-' || doc_id, project_id, 'ghost/doc-ghost-' || doc_id, 'sha256:ghost' FROM mfiles WHERE k = 4
  UNION ALL SELECT * FROM entities WHERE entity_type <> 'file'),
items0 AS (SELECT f.id AS file_id, f.project_id, f.source AS instance_id, 'item-' || doc_id AS item_id, substr(f.path, 2) AS item_key, CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE f.sync_hash || '|' || p.config_hash END AS index_hash, f.content_hash, CASE doc_id % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' ELSE 'error' END AS status, doc_id,
    CASE WHEN doc_id % 5 = 0 THEN 'older' END AS previous_instance_id, CASE WHEN doc_id % 5 = 0 THEN 'before-' || doc_id END AS previous_item_id, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE END AS checked_at, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 SECOND AS created_at
  FROM mfiles f JOIN projects p ON p.id = f.project_id WHERE doc_id % 7 <> 0),
items AS (SELECT * FROM items0 UNION ALL SELECT 'doc-ghost-' || doc_id, project_id, instance_id, 'orphan-' || item_id, item_key, index_hash, content_hash, status, doc_id, previous_instance_id, previous_item_id, checked_at, created_at FROM items0 WHERE doc_id % 13 = 0),
mapping AS (SELECT id AS project_id, CASE WHEN n % 6 = 4 THEN 'legacy-' || slug ELSE slug END AS instance_id, CASE WHEN n % 3 = 1 THEN slug END AS replacement_instance_id, CASE WHEN n % 4 = 3 THEN 'pending' ELSE 'ready' END AS status FROM projects WHERE n % 6 <> 5),
jobs AS (SELECT 'job:' || user_id || ':' || event_type AS dedupe_key, operation, 'project-src' || (i % 20) AS project_id, CASE WHEN operation <> 'ensure_instance' THEN 'doc-' || (i % (SELECT count(*) FROM documents)) END AS file_id, 'hash-' || (i % 17) AS expected_hash, status, CAST(i % 7 AS INTEGER) AS attempts, TIMESTAMP '2024-06-01 00:00:00' + (i % 100 - 70) * INTERVAL 1 MINUTE AS next_attempt_at, CASE WHEN i % 4 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' + (i % 9 - 4) * INTERVAL 1 MINUTE END AS lease_expires_at, CASE WHEN status IN ('failed', 'retry') THEN CASE WHEN i % 2 = 0 THEN 'Request Timeout after 30 s' ELSE 'bad input' END END AS last_error, date_trunc('second', ts) AS created_at, TIMESTAMP '2024-06-01 00:00:00' - (i % 1000) * INTERVAL 1 MINUTE AS updated_at
  FROM (SELECT user_id, event_type, max(event_id) AS i, max(ts) AS ts, CASE max(event_id) % 3 WHEN 0 THEN 'ensure_instance' WHEN 1 THEN 'upsert_file' ELSE 'delete_file' END AS operation, CASE max(event_id) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id, event_type)),
queries AS (SELECT CAST(item_id AS BIGINT) AS query_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS query FROM benchmark UNION ALL SELECT * FROM (VALUES (-1, '%'), (-2, '_'), (-3, '---'), (-4, 'THE Of'), (-5, 'éle'), (-6, '  '), (-7, '中文'), (-8, 'th'), (-9, '10.md')) v(query_id, query)),
kv AS (SELECT 'bundle:' || conv_id AS key, CAST(NULL AS VARCHAR) AS bundle_key, CASE WHEN conv_id % 5 = 0 THEN '' ELSE text END AS content, conv_id, text FROM conversations WHERE turn = 0
  UNION ALL SELECT 'manifest:bootstrap:client' || conv_id || ':default', 'bundle:' || CASE WHEN conv_id % 3 = 0 THEN 'gone-' ELSE '' END || conv_id, NULL, conv_id, text FROM conversations WHERE turn = 0 AND conv_id % 2 = 0
  UNION ALL SELECT 'common:' || conv_id, NULL, NULL, conv_id, text FROM conversations WHERE turn = 0 AND conv_id % 2 = 1)
"""
