"""The read model and catalogue queries: search documents, listings, lookups, records, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T

ANONYMOUS, SIGNED_IN = ("public",), ("public", "private")
MOST_FETCHED = 10
DOCUMENT = ("file_id", "project_id", "project_slug", "project_name", "path", "parent_path", "file_name", "title", "description", "content", "language", "format", "role", "visibility", "tags_text", "variables_json", "metadata_json", "current_version", "created_at", "updated_at")


def build_search_documents(nodes: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each live file of a live project. A file's own visibility counts before its project's; folders' doesn't."""
    n = nodes.where("node_type = 'file' and deleted_at is null").alias("n")
    p = projects.where("deleted_at is null").alias("p")
    parent = nodes.select("id", "path").alias("u")
    joined = n.join(p, F.col("n.project_id") == F.col("p.id")).join(files.alias("f"), F.col("f.node_id") == F.col("n.id")).join(parent, F.col("n.parent_id") == F.col("u.id"), "left")
    own = {"file_id": "n.id", "project_id": "p.id", "project_slug": "p.slug", "project_name": "p.name", "path": "n.path", "file_name": "n.name", "created_at": "f.created_at", "updated_at": "f.updated_at"}
    made = {"parent_path": F.coalesce("u.path", F.lit("/")), "visibility": F.coalesce("n.visibility", "p.visibility")}
    return joined.select(*((made[c] if c in made else F.col(own.get(c, f"f.{c}"))).alias(c) for c in DOCUMENT))


def _changed(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose columns differ, or that one side lacks."""
    b, a = before.select(key, F.struct(*columns).alias("was")), after.select(key, F.struct(*columns).alias("now"))
    return b.join(a, key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(key)


def refresh_search_documents(docs: DataFrame, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """docs brought up to date: only files touched by a changed file, node, parent or project are built anew."""
    files = _changed(before["files"], after["files"], "node_id", ("title", "description", "content", "language", "format", "role", "tags_text", "variables_json", "metadata_json", "current_version", "updated_at")).select(F.col("node_id").alias("file_id"))
    nodes = _changed(before["nodes"], after["nodes"], "id", ("project_id", "parent_id", "node_type", "path", "name", "visibility", "deleted_at"))
    projects = _changed(before["projects"], after["projects"], "id", ("slug", "name", "visibility", "deleted_at")).select(F.col("id").alias("project_id"))
    every = after["nodes"].select("id", "parent_id", "project_id").unionByName(before["nodes"].select("id", "parent_id", "project_id"))
    below = every.join(nodes.select(F.col("id").alias("parent_id")), "parent_id").select(F.col("id").alias("file_id"))
    members = every.join(projects, "project_id").select(F.col("id").alias("file_id"))
    touched = files.union(nodes.select(F.col("id").alias("file_id"))).union(below).union(members).distinct()
    fresh_nodes = after["nodes"].join(touched.select(F.col("file_id").alias("id")), "id", "left_semi")
    parents = after["nodes"].where("node_type = 'folder'")
    fresh = build_search_documents(fresh_nodes.where("node_type = 'file'").unionByName(parents), after["projects"], after["files"])
    return docs.join(touched, "file_id", "left_anti").unionByName(fresh)


def visible(df: DataFrame, access: Sequence[str], requested: str | None = None) -> DataFrame:
    """Rows whose visibility the caller may see; asking for another one gives no rows."""
    allowed = [v for v in access if requested is None or v == requested]
    return df.where(F.col("visibility").isin(allowed)) if allowed else df.where("false")


def list_projects(projects: DataFrame, access: Sequence[str]) -> DataFrame:
    rows = visible(projects.where("deleted_at is null"), access)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(T.ascii_lower("name"), "id"))).select("place", "id", "slug", "name", "visibility")


def list_directory(nodes: DataFrame, projects: DataFrame, files: DataFrame, requests: DataFrame, access: Sequence[str]) -> DataFrame:
    """requests (request_id, project, path) -> direct children in order: folders first, sort order, name. A missing or hidden folder lists nothing."""
    p = visible(projects.where("deleted_at is null"), access).select(F.col("id").alias("project_id"), F.col("slug"), F.col("visibility").alias("project_visibility"))
    wanted = requests.select("request_id", T.ascii_lower(T.strip(T.nfkc("project"))).alias("wanted"), T.normalize_path("path").alias("folder_path"))
    asked = wanted.join(p.select("project_id", "project_visibility", F.explode(F.array_distinct(F.array(T.ascii_lower("project_id"), T.ascii_lower("slug")))).alias("wanted")), "wanted")
    asked = asked.groupBy("request_id", "folder_path").agg(F.min(F.struct("project_id", "project_visibility")).alias("p")).select("request_id", "folder_path", "p.*")
    live = nodes.where("deleted_at is null").join(p.drop("slug"), "project_id").withColumn("seen_as", F.coalesce("visibility", "project_visibility")).where(F.col("seen_as").isin(*access))
    folders = live.where("node_type = 'folder'").select("project_id", F.col("path").alias("folder_path"), F.col("id").alias("folder_id"))
    found = asked.join(folders, ["project_id", "folder_path"], "left").where("folder_path = '/' or folder_id is not null")
    # the asked folders' children first; only they meet the files
    c, f = live.alias("c"), found.alias("f")
    rows = c.join(f, (F.col("c.project_id") == F.col("f.project_id")) & F.col("c.parent_id").eqNullSafe(F.col("f.folder_id")))
    rows = rows.select("f.request_id", "c.id", "c.node_type", "c.name", "c.path", "c.sort_order").join(files.select(F.col("node_id").alias("id"), "title", "language", "role"), "id", "left")
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("node_type") == "folder", 0).otherwise(1), "sort_order", T.ascii_lower("name"), "id")
    return rows.select("request_id", "id", "node_type", "name", "path", "sort_order", "title", "language", "role").withColumn("place", F.row_number().over(order))


def identifiers(requests: DataFrame) -> DataFrame:
    """requests (request_id, identifier) plus key (trimmed), project and lookup path; project is null for bare ids and paths."""
    trimmed = requests.withColumn("key", T.blank_to_null(T.nfkc("identifier"))).where("key is not null")
    uri = T.parse_file_uri("key")
    pair = F.when(F.col("key").rlike(r"^[^:]+:/"), F.struct(T.strip(F.regexp_extract("key", r"(?s)^([^:]+):(/.*)$", 1)).alias("project"), T.plain_path(F.regexp_extract("key", r"(?s)^([^:]+):(/.*)$", 2)).alias("path")))
    bare = T.plain_path(F.when(F.col("key").endswith(".md"), F.col("key")).otherwise(F.concat("key", F.lit(".md"))))
    named = trimmed.withColumn("named", F.coalesce(uri, pair))
    return named.withColumn("project", F.col("named.project")).withColumn("lookup", F.coalesce(F.col("named.path"), bare)).drop("named")


def resolve_files(docs: DataFrame, requests: DataFrame, access: Sequence[str]) -> DataFrame:
    """requests -> (request_id, file_id): an exact id first, else a path, compared without regard to ASCII case.

    A bare path found in several projects gives the first by project slug and id.
    """
    asked = identifiers(requests).select("request_id", "key", F.lower("project").alias("project"), T.ascii_lower("lookup").alias("lookup"))
    seen = visible(docs, access).select("file_id", "project_id", "project_slug", T.ascii_lower("path").alias("lookup"))
    by_id = asked.where("project is null").join(seen.select("file_id", "project_slug"), asked["key"] == seen["file_id"]).select("request_id", F.lit(0).alias("rank"), "project_slug", "file_id")
    own = (F.col("project") == T.ascii_lower("project_id")) | (F.col("project") == T.ascii_lower("project_slug"))
    by_path = asked.join(seen, "lookup").where(F.col("project").isNull() | own)
    by_path = by_path.select("request_id", F.lit(1).alias("rank"), "project_slug", "file_id")
    return by_id.union(by_path).groupBy("request_id").agg(F.min(F.struct("rank", "project_slug", "file_id")).alias("m")).select("request_id", F.col("m.file_id").alias("file_id"))


def fetch_files(docs: DataFrame, requests: DataFrame, access: Sequence[str], most: int = MOST_FETCHED) -> DataFrame:
    """requests (request_id, identifiers array) -> (request_id, place, identifier, file_id); the first `most` distinct ones, misses with a null id."""
    asked = requests.select("request_id", F.posexplode(F.slice(T.clean_list("identifiers"), 1, most)).alias("place", "identifier"))
    numbered = asked.select(F.struct("request_id", "place").alias("request_id"), "identifier")
    found = resolve_files(docs, numbered, access).select(F.col("request_id.request_id").alias("request_id"), F.col("request_id.place").alias("place"), "file_id")
    return asked.join(found, ["request_id", "place"], "left")


def resolve_resource(docs: DataFrame, nodes: DataFrame, projects: DataFrame, requests: DataFrame, access: Sequence[str]) -> DataFrame:
    """requests (request_id, project, path) -> kind file, directory or none, and id: the file of that path, else the folder."""
    asked = requests.select("request_id", T.ascii_lower("project").alias("wanted"), T.normalize_path("path").alias("lookup"))
    seen = visible(docs, access)
    f = seen.select(F.explode(F.array_distinct(F.array(T.ascii_lower("project_id"), T.ascii_lower("project_slug")))).alias("wanted"), F.col("path").alias("lookup"), F.col("file_id"))
    p = visible(projects.where("deleted_at is null"), access).select(F.col("id").alias("project_id"), F.explode(F.array_distinct(F.array(T.ascii_lower("id"), T.ascii_lower("slug")))).alias("wanted"), F.col("visibility").alias("inherited"))
    folders = nodes.where("node_type = 'folder' and deleted_at is null").join(p, "project_id").where(F.coalesce("visibility", "inherited").isin(*access)).select("wanted", F.col("path").alias("lookup"), F.col("id").alias("folder_id"))
    folders = folders.union(p.select("wanted", F.lit("/"), F.col("project_id")))
    files = asked.join(f, [T.ascii_lower(asked["lookup"]) == T.ascii_lower(f["lookup"]), asked["wanted"] == f["wanted"]]).groupBy("request_id").agg(F.min("file_id").alias("file_id"))
    dirs = asked.join(folders, ["wanted", "lookup"]).groupBy("request_id").agg(F.min("folder_id").alias("folder_id"))
    out = asked.select("request_id").join(files, "request_id", "left").join(dirs, "request_id", "left")
    return out.select("request_id", F.when(F.col("file_id").isNotNull(), "file").when(F.col("folder_id").isNotNull(), "directory").otherwise("none").alias("kind"), F.coalesce("file_id", "folder_id").alias("id"))


def file_records(docs: DataFrame) -> DataFrame:
    """Public records: tags as a list, variables and metadata parsed (empty if they don't), and the URI."""
    tags = F.filter(F.transform(F.split("tags_text", ","), T.strip), lambda t: t != "")
    return docs.withColumn("tags", tags).withColumn("variables", F.coalesce(F.from_json("variables_json", "array<string>"), F.array().cast("array<string>"))).withColumn("metadata", F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))).withColumn("uri", T.file_uri("project_slug", "path")).drop("tags_text", "variables_json", "metadata_json")


def compact_records(records: DataFrame) -> DataFrame:
    return records.select("file_id", "uri", "title", "description", "language", "role", "tags", "updated_at")


VIEWER, RAW = "/p/", "/raw/"


def _viewer_path(project: Column, path: Column) -> Column:
    return F.concat(F.lit(VIEWER), T.encode_component(project), F.lit("/"), T.encode_path(path))


def normalize_links(df: DataFrame, link: str = "link", made: str = "viewer_path") -> DataFrame:
    """Any viewer, raw or interface link, URI or identifier as a viewer path; null and blank give null."""
    value = F.col("link_text")
    rows = df.withColumn("link_text", T.blank_to_null(T.nfkc(link)))
    named = lambda pattern: F.when(value.rlike(pattern), _viewer_path(F.coalesce(T.decode_component(F.regexp_extract(value, pattern, 1)), F.regexp_extract(value, pattern, 1)), F.regexp_replace(F.regexp_extract(value, pattern, 2), "^/+", "")))
    uri = named(r"(?is)^prompt://([^/]+)/(.+)$")
    pair = named(r"(?s)^([^:/?#]+):(/(?!/).*)$")
    absolute = F.regexp_replace(value, r"(?i)^https?://[^/?#]*", "")
    pathname = F.regexp_extract(absolute, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(absolute, r"(?s)\?([^#]*)", 1)
    asked = T.blank_to_null(T.decode_component(F.replace(F.regexp_extract(query, r"(?:^|&)identifier=([^&]*)", 1), F.lit("+"), F.lit(" "))))
    parts = F.filter(F.split(pathname, "/"), lambda p: p != "")
    decoded = F.transform(parts, lambda p: F.coalesce(T.decode_component(p), p))
    of_parts = lambda start: _viewer_path(F.element_at(decoded, start), F.array_join(F.slice(decoded, start + 1, F.greatest(F.size(decoded) - start, F.lit(0))), "/"))
    routed = F.when((pathname.startswith(VIEWER) | pathname.startswith(RAW)) & (F.size(parts) >= 3), of_parts(2))
    by_query = F.when(asked.isNotNull(), F.coalesce(*(F.when(asked.rlike(p), _viewer_path(F.regexp_extract(asked, p, 1), F.regexp_replace(F.regexp_extract(asked, p, 2), "^/+", ""))) for p in (r"(?is)^prompt://([^/]+)/(.+)$", r"(?s)^([^:/?#]+):(/(?!/).*)$")), F.concat(F.lit("/p?identifier="), T.encode_component(asked))))
    bare = F.when(~value.rlike("(?i)^[a-z][a-z0-9+.-]*://") & (F.size(parts) >= 2), of_parts(1))
    return rows.withColumn(made, F.coalesce(uri, pair, by_query, routed, bare, F.concat(F.lit("/p?identifier="), T.encode_component(value)))).drop("link_text")
