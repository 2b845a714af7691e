"""Registered queries over the library's operators, each beside the SQL that DuckDB runs for it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import catalog as R
from foliospark.operators import collect as C
from foliospark.operators import fulltext as Q
from foliospark.operators import normalize as N
from foliospark.operators import outbox as O
from foliospark.operators import ranked
from foliospark.operators import segments as S
from foliospark.operators import semantic as M
from foliospark.operators import sync as Y
from foliospark.operators import templates as P
from foliospark.operators import validate as V
from foliospark.plans.library import SQL, Library, now
from foliospark.sources.trees import shared_folder
from foliospark.sources.versions import VersionedStore

REGISTRY: dict[str, tuple[Callable[[Library], DataFrame], str | None]] = {}
TS = "TIMESTAMP '2024-06-01 00:00:00'"
URL = "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '/+$', '')"
EVERYONE, MEMBERS = R.ANONYMOUS, R.SIGNED_IN


def query(name: str, sql: str | None = None):
    def keep(make: Callable[[Library], DataFrame]):
        REGISTRY[name] = (make, sql)
        return make

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, folder, make=make: make(Library(spark, folder))) for k, (make, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f"WITH {SQL} {sql}" if "WITH " not in sql[:6] else f"WITH {SQL}, {sql[5:]}" for k, (_, sql) in REGISTRY.items() if sql}


# Full text


@query("q1_filter", "SELECT file_id, path FROM sdocs WHERE lower(language) = 'en' AND path LIKE '/en/%' AND (',' || lower(tags_text) || ',') LIKE '%,good,%' AND project_slug = 'src1'")
def _(lib):
    return Q.filter_documents(lib.docs, project=" SRC1 ", directory="/EN/", language="En", tags=["Good", " "]).select("file_id", "path")


#: Tokens of every document by field and place.
TOKENS = """parted AS (SELECT file_id, unnest([0, 1, 2, 3, 4, 5]) AS field, unnest([title, file_name, path, description, content, tags_text]) AS value FROM sdocs),
    listed AS (SELECT file_id, field, list_filter(regexp_split_to_array(lower(strip_accents(value)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM parted),
    tok AS (SELECT file_id, field, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM listed)"""


@query("q3_index_terms", f"WITH {TOKENS} SELECT term, count(DISTINCT file_id) AS n_docs, count(*) AS n_hits FROM tok GROUP BY term")
def _(lib):
    postings, _ = Q.build_index(lib.docs)
    return postings.groupBy("term").agg(F.count_distinct("file_id").alias("n_docs"), F.sum(F.size("positions")).alias("n_hits"))


@query("q3_segments", f"WITH {TOKENS} SELECT term, count(DISTINCT file_id) AS n_docs, count(*) AS n_hits FROM tok GROUP BY term")
def _(lib):
    """The index of an older state, brought up to date twice and merged, has the terms of a new one."""
    store = VersionedStore(lib.spark, f"{shared_folder(lib.spark)}/kept-{uuid.uuid4().hex}")
    now_, k = lib.search_table, F.crc32(F.col("file_id").cast("binary")) % 10
    S.update(store, now_.where(k < 8).withColumn("title", F.when(k < 2, "older").otherwise(F.col("title"))).withColumn("file_id", F.when(k == 3, F.concat(F.lit("gone-"), "file_id")).otherwise(F.col("file_id"))))
    S.update(store, now_.where(k < 9))
    S.update(store, now_)
    postings, _ = S.live(S.merge(store, most=1))
    return postings.groupBy("term").agg(F.count_distinct("file_id").alias("n_docs"), F.sum(F.size("positions")).alias("n_hits"))


@query("q3_index_lengths", f"WITH {TOKENS} SELECT file_id, count(*) AS length FROM tok GROUP BY file_id")
def _(lib):
    return Q.build_index(lib.docs)[1]


@query("q4_parse", "SELECT query_id, CAST(no - 1 AS INTEGER) AS phrase_no, CAST(len(words) AS INTEGER) AS n_phrases, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(words[no])), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS no FROM (SELECT query_id, list_filter(list_transform(regexp_split_to_array(trim(query), '\\s+'), lambda w: regexp_replace(w, '[\"*:^(){}\\[\\]]', '', 'g')), lambda w: w <> '') AS words FROM queries))")
def _(lib):
    return Q.parse_queries(lib.queries).withColumn("tokens", F.array_join("tokens", " "))


PHRASES = TOKENS + """, words AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(trim(query), '\\s+'), lambda w: regexp_replace(w, '["*:^(){}\\[\\]]', '', 'g')), lambda w: w <> '') AS ws FROM queries),
    phr AS (SELECT query_id, len(ws) AS n_phrases, no - 1 AS phrase_no, list_filter(regexp_split_to_array(lower(strip_accents(ws[no])), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS toks FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS no FROM words)),
    wanted AS (SELECT query_id, phrase_no, n_phrases, len(toks) AS n, unnest(toks) AS token, unnest(range(len(toks))) AS no FROM phr),
    starts AS (SELECT query_id, phrase_no, n_phrases, file_id, field, pos - no AS start FROM wanted JOIN tok ON term = token OR (no = n - 1 AND starts_with(term, token)) GROUP BY query_id, phrase_no, n_phrases, n, file_id, field, pos - no HAVING count(*) = n),
    hits AS (SELECT query_id, phrase_no, n_phrases, file_id, count(*) AS freq FROM starts GROUP BY ALL),
    stats AS (SELECT file_id, CAST(sum(len(terms)) AS BIGINT) AS length FROM listed GROUP BY file_id)"""


@query("q5_match", f"WITH {PHRASES} SELECT query_id, phrase_no, n_phrases, file_id, freq FROM hits")
def _(lib):
    postings, _ = lib.index
    return Q.match(postings, Q.parse_queries(lib.queries)).withColumn("phrase_no", F.col("phrase_no").cast("bigint")).withColumn("n_phrases", F.col("n_phrases").cast("bigint"))


@query("q6_bm25", f"WITH {PHRASES}, per AS (SELECT query_id, phrase_no, count(*) AS n FROM hits GROUP BY ALL), corpus AS (SELECT count(*) AS docs, avg(length) AS mean FROM stats), parts AS (SELECT h.query_id, h.file_id, h.n_phrases, (CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM hits h JOIN per USING (query_id, phrase_no) JOIN stats s ON s.file_id = h.file_id CROSS JOIN corpus) SELECT query_id, file_id, round(-sum(part), 6) AS rank FROM parts GROUP BY query_id, file_id, n_phrases HAVING count(*) = n_phrases")
def _(lib):
    postings, stats = lib.index
    return Q.rank(postings, Q.parse_queries(lib.queries), stats).withColumn("rank", F.round("rank", 6))


def _low(c):
    return f"translate({c}, '{T.UPPER}', '{T.LOWER}')"


ANY = " OR ".join(f"{_low(c)} LIKE '%' || lower(query) || '%'" for c in ("title", "file_name", "path", "description", "content", "tags_text"))


@query("q7_substring", f"SELECT query_id, file_id, {_low('title')} LIKE '%' || lower(query) || '%' AS in_title FROM sdocs JOIN queries ON {ANY}")
def _(lib):
    return Q.substring_match(lib.search_table, lib.index[0], lib.queries)


BM25 = PHRASES + """, per AS (SELECT query_id, phrase_no, count(*) AS n FROM hits GROUP BY ALL), corpus AS (SELECT count(*) AS docs, avg(length) AS mean FROM stats),
    parts AS (SELECT h.query_id, h.file_id, h.n_phrases, (CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM hits h JOIN per USING (query_id, phrase_no) JOIN stats s ON s.file_id = h.file_id CROSS JOIN corpus),
    ranks AS (SELECT query_id, file_id, -sum(part) AS rank FROM parts GROUP BY query_id, file_id, n_phrases HAVING count(*) = n_phrases)"""


@query("q8_search", f"""WITH {BM25}, likes AS (SELECT query_id, file_id FROM sdocs JOIN queries ON {ANY} WHERE trim(query) <> ''),
    found AS (SELECT query_id, file_id FROM likes UNION SELECT query_id, file_id FROM ranks),
    tiered AS (SELECT f.query_id, f.file_id, r.rank, d.updated_at, CASE WHEN {_low('title')} = {_low('query')} THEN 0 WHEN {_low('file_name')} = {_low('query')} THEN 1 WHEN {_low('path')} = '/' || {_low('query')} THEN 2 WHEN {_low('title')} LIKE '%' || lower(query) || '%' THEN 3 WHEN r.rank IS NOT NULL THEN 4 ELSE 5 END AS tier
      FROM found f JOIN sdocs d ON d.file_id = f.file_id AND d.visibility = 'public' JOIN queries q ON q.query_id = f.query_id LEFT JOIN ranks r ON r.query_id = f.query_id AND r.file_id = f.file_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(coalesce(rank, 999999), 9), updated_at DESC, file_id) AS place FROM tiered)
    SELECT query_id, CAST(place AS INTEGER) AS place, file_id, tier, round(rank, 6) AS score FROM placed WHERE place <= 10""")
def _(lib):
    postings, stats = lib.index
    return Q.search(lib.search_table, postings, stats, lib.queries, EVERYONE, 10).withColumn("score", F.round("score", 6))


@query("q6_best", f"WITH {BM25} SELECT query_id, CAST(place AS INTEGER) AS place, file_id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), file_id) AS place FROM ranks) WHERE place <= 10")
def _(lib):
    """Ten best by blocks: what no bound reaches is not scored."""
    postings, stats = lib.index
    found, _ = ranked.best(ranked.build_blocks(postings, stats), Q.parse_queries(lib.queries), Q.dictionary(postings), 10)
    return found.withColumn("rank", F.round("rank", 6))


@query("q9_browse", "SELECT file_id, title, updated_at FROM sdocs WHERE visibility = 'public' ORDER BY updated_at DESC, file_id LIMIT 20")
def _(lib):
    return Q.browse(lib.docs, EVERYONE, 20)


# Catalogue


@query("r1_search_documents", "SELECT file_id, project_slug, project_name, path, parent_path, title, description, sha256(content) AS content_sha, visibility, tags_text, updated_at FROM sdocs")
def _(lib):
    return lib.docs.select("file_id", "project_slug", "project_name", "path", "parent_path", "title", "description", F.sha2("content", 256).alias("content_sha"), "visibility", "tags_text", "updated_at")


@query("r2_refresh", "SELECT file_id, s.path, CASE WHEN k IN (1, 3) THEN 'fresh title' ELSE s.title END AS title, s.visibility FROM sdocs s JOIN mfiles f ON f.id = s.file_id WHERE k <> 0")
def _(lib):
    files = lib.files.join(lib.old_files.select("node_id"), "node_id", "left_semi")
    k = lib.manifest_files.select(F.col("id").alias("node_id"), "k")
    newer = files.join(k, "node_id").withColumn("title", F.when(F.col("k").isin(1, 3), "fresh title").otherwise(F.col("title"))).drop("k")
    before = {"nodes": lib.nodes, "projects": lib.projects, "files": files}
    docs = R.build_search_documents(**before)
    return R.refresh_search_documents(docs, before, before | {"files": newer}).select("file_id", "path", "title", "visibility")


@query("r3_visible", "SELECT file_id FROM sdocs WHERE visibility = 'private'")
def _(lib):
    return R.visible(lib.docs, MEMBERS, "private").select("file_id")


@query("r4_projects", "SELECT CAST(row_number() OVER (ORDER BY lower(name), id) AS INTEGER) AS place, id, slug, name, visibility FROM projects WHERE visibility = 'public'")
def _(lib):
    return R.list_projects(lib.projects, EVERYONE)


@query("r5_directory", "SELECT p.slug || path AS request_id, id, node_type, name, CAST(row_number() OVER (PARTITION BY p.slug || path ORDER BY rank, sort_order, lower(name), id) AS INTEGER) AS place FROM (SELECT DISTINCT source AS slug, '/' || lang AS path FROM documents) p JOIN (SELECT f.id, 'file' AS node_type, f.name, f.sort_order, 1 AS rank, f.source, '/' || f.lang AS folder FROM mfiles f JOIN projects q ON q.id = f.project_id WHERE q.visibility = 'public' AND coalesce(f.visibility, 'public') = 'public') n ON n.source = p.slug AND n.folder = p.path")
def _(lib):
    asked = lib.folders.select(F.concat(F.substring("project_id", 9, 100), "path").alias("request_id"), F.upper("project_id").alias("project"), F.concat("path", F.lit("/")).alias("path"))
    return R.list_directory(lib.nodes, lib.projects, lib.files, asked, EVERYONE).select("request_id", "id", "node_type", "name", "place")


ASKED = "CASE doc_id % 4 WHEN 0 THEN file_id WHEN 1 THEN 'prompt://' || project_slug || path WHEN 2 THEN upper(project_slug) || ':' || path ELSE 'none/' || doc_id END"


@query("r6_resolve", "SELECT doc_id AS request_id, file_id FROM sdocs WHERE visibility = 'public' AND doc_id % 4 <> 3")
def _(lib):
    d = lib.docs.withColumn("doc_id", F.substring("file_id", 5, 20).cast("bigint"))
    asked = d.select(F.col("doc_id").alias("request_id"), F.expr(ASKED).alias("identifier"))
    return R.resolve_files(lib.docs, asked, EVERYONE)


@query("r7_fetch", "SELECT CAST(doc_id AS BIGINT) AS request_id, CAST(no AS INTEGER) AS place, CASE no WHEN 0 THEN file_id ELSE 'missing' END AS identifier, CASE WHEN no = 0 AND visibility = 'public' THEN file_id END AS file_id FROM sdocs, (VALUES (0), (1)) v(no)")
def _(lib):
    asked = lib.docs.select(F.substring("file_id", 5, 20).cast("bigint").alias("request_id"), F.array(F.concat(F.lit(" "), "file_id"), F.lit("missing"), "file_id", F.lit("")).alias("identifiers"))
    return R.fetch_files(lib.docs, asked, EVERYONE)


@query("r8_resource", "SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 2 THEN 'none' WHEN doc_id % 3 = 1 THEN CASE WHEN p.visibility = 'public' THEN 'directory' ELSE 'none' END WHEN s.visibility = 'public' THEN 'file' ELSE 'none' END AS kind FROM sdocs s JOIN projects p ON p.id = s.project_id")
def _(lib):
    d = lib.docs.withColumn("doc_id", F.substring("file_id", 5, 20).cast("bigint"))
    asked = d.select(F.col("doc_id").alias("request_id"), F.col("project_slug").alias("project"), F.when(F.col("doc_id") % 3 == 0, F.col("path")).when(F.col("doc_id") % 3 == 1, F.col("parent_path")).otherwise("/nowhere").alias("path"))
    return R.resolve_resource(lib.docs, lib.nodes, lib.projects, asked, EVERYONE).select("request_id", "kind")


@query("r9_records", "SELECT file_id, 'prompt://' || project_slug || path AS uri, replace(tags_text, ',', '|') AS tags, 0 AS n_variables FROM sdocs")
def _(lib):
    r = R.file_records(lib.docs)
    return r.select("file_id", "uri", F.array_join("tags", "|").alias("tags"), F.size("variables").alias("n_variables"))


@query("r10_uri", "SELECT file_id, project_slug AS project, '/a b/' || language || '&x/' || file_name AS path, true AS same FROM sdocs")
def _(lib):
    path = F.concat(F.lit("/a b/"), "language", F.lit("&x/"), "file_name")
    back = T.parse_file_uri(T.file_uri("project_slug", path))
    return lib.docs.select("file_id", back["project"].alias("project"), back["path"].alias("path"), (back["path"] == path).alias("same"))


@query("r11_links", "SELECT file_id, '/p/' || project_slug || path AS viewer_path FROM sdocs")
def _(lib):
    kinds = [F.concat(F.lit("prompt://"), "project_slug", "path"), F.concat("project_slug", F.lit(":"), "path"), F.concat(F.lit("https://x.example/p/"), "project_slug", "path"), F.concat(F.lit("/raw/"), "project_slug", "path"), F.concat("project_slug", "path"), F.concat(F.lit("https://x.example/raw?identifier="), T.encode_component(F.concat("project_slug", F.lit(":"), "path")))]
    k = F.substring("file_id", 5, 20).cast("bigint") % len(kinds)
    link = kinds[0]
    for i, x in enumerate(kinds):
        link = F.when(k == i, x).otherwise(link)
    return R.normalize_links(lib.docs.select("file_id", link.alias("link"))).select("file_id", "viewer_path")


# Sync


CLASSIFIED = "SELECT e.*, l.sync_key IS NULL AS created, l.sync_key IS NOT NULL AND e.source_path IS DISTINCT FROM l.source_path AS moved, l.sync_key IS NOT NULL AND e.content_hash IS DISTINCT FROM l.content_hash AS updated FROM entities e LEFT JOIN ledger l ON l.sync_key = e.sync_key"
GONE = "SELECT l.sync_key, l.entity_type, l.entity_id, l.project_id FROM ledger l JOIN projects p ON p.id = l.project_id AND p.prune WHERE l.entity_type <> 'project' AND l.sync_key NOT IN (SELECT sync_key FROM entities)"


@query("y1_classify", f"WITH c AS ({CLASSIFIED}) SELECT sync_key, created, moved, updated, NOT created AND NOT moved AND NOT updated AS unchanged FROM c")
def _(lib):
    return Y.classify_entities(lib.manifest, lib.ledger).select("sync_key", "created", "moved", "updated", "unchanged")


@query("y2_stats", f"WITH c AS ({CLASSIFIED}), g AS (SELECT entity_type, count(*) AS deleted FROM ({GONE}) GROUP BY 1) SELECT entity_type, count(*) FILTER (created) AS created, count(*) FILTER (updated) AS updated, count(*) FILTER (moved) AS moved, count(*) FILTER (NOT created AND NOT moved AND NOT updated) AS unchanged, coalesce(max(deleted), 0) AS deleted FROM c LEFT JOIN g USING (entity_type) GROUP BY entity_type")
def _(lib):
    return Y.plan_stats(Y.classify_entities(lib.manifest, lib.ledger), Y.plan_deletions(lib.manifest, lib.ledger, True)).withColumn("deleted", F.col("deleted").cast("bigint"))


@query("y3_deletions", GONE)
def _(lib):
    return Y.plan_deletions(lib.manifest, lib.ledger, True)


@query("y4_changed", f"WITH c AS ({CLASSIFIED}) SELECT sync_key FROM c WHERE created OR updated")
def _(lib):
    return Y.changed_entities(Y.classify_entities(lib.manifest, lib.ledger)).select("sync_key")


@query("y4_mutations", "SELECT count(*) > 0 AS mutations FROM mfiles WHERE k IN (0, 1, 2, 3, 4)")
def _(lib):
    return Y.has_mutations(Y.classify_entities(lib.manifest, lib.ledger), Y.plan_deletions(lib.manifest, lib.ledger, True))


@query("y5_merge_projects", f"SELECT id, CASE WHEN n % 3 = 0 THEN 'renamed' ELSE name END AS name, visibility, CASE WHEN n % 3 = 0 THEN {TS} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM projects")
def _(lib):
    n = F.regexp_extract("slug", "([0-9]+)", 1).cast("int")
    return Y.merge_projects(lib.projects, lib.projects.withColumn("name", F.when(n % 3 == 0, "renamed").otherwise(F.col("name"))), now()).select("id", "name", "visibility", "updated_at")


@query("y6_merge_nodes", f"SELECT id, name, path, node_type, CASE WHEN k IN (0, 3) THEN {TS} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM (SELECT n.*, f.k FROM nodes n LEFT JOIN mfiles f ON f.id = n.id) UNION ALL SELECT 'doc-ghost-' || doc_id, 'ghost-' || doc_id || '.md', '/' || lang || '/' || 'ghost-' || doc_id || '.md', 'file', TIMESTAMP '2024-01-01 00:00:00' FROM mfiles WHERE k = 4")
def _(lib):
    return Y.merge_nodes(lib.old_nodes, Y.manifest_nodes(lib.folders, lib.manifest_files), now()).select("id", "name", "path", "node_type", "updated_at")


@query("y7_merge_files", f"SELECT id AS node_id, title, content_hash, CASE WHEN k IN (1, 3) THEN 2 ELSE 1 END AS current_version, CASE WHEN k IN (0, 1, 3) THEN {TS} ELSE TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 500) * INTERVAL 1 HOUR END AS updated_at FROM mfiles")
def _(lib):
    return Y.merge_files(lib.old_files, lib.manifest_files, now()).select("node_id", "title", "content_hash", "current_version", "updated_at")


@query("y8_versions", "SELECT id AS file_id, v AS version_number, CASE v WHEN 1 THEN 'Initial content sync' ELSE 'Updated by content sync' END AS change_note FROM mfiles, (VALUES (1), (2)) t(v) WHERE v = 1 OR k IN (1, 3)")
def _(lib):
    return Y.append_versions(lib.versions, lib.old_files, lib.manifest_files, now()).select("file_id", "version_number", "change_note")


@query("y9_tags", "SELECT tag AS normalized_name, count(*) AS n_files FROM (SELECT unnest(string_split(tags_text, ',')) AS tag FROM mfiles) GROUP BY tag")
def _(lib):
    old = lib.spark.createDataFrame([("en", "EN"), ("unused", "Unused")], "normalized_name string, name string")
    links = lib.manifest_files.where("k = 1").select(F.col("id").alias("file_id"), F.lit("unused").alias("normalized_name"))
    tags, links = Y.merge_tags(old, links, lib.manifest_files)
    return links.join(tags.select("normalized_name"), "normalized_name", "left_semi").groupBy("normalized_name").agg(F.count("*").alias("n_files"))


@query("y10_deletions", f"WITH g AS ({GONE}), o AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM mfiles WHERE k = 0) UNION ALL SELECT 'doc-ghost-' || doc_id FROM mfiles WHERE k = 4) SELECT id, CASE WHEN id IN (SELECT entity_id FROM g) THEN {TS} END AS deleted_at FROM o")
def _(lib):
    nodes, _ = Y.apply_deletions(lib.old_nodes, lib.ledger, Y.plan_deletions(lib.manifest, lib.ledger, True), now())
    return nodes.select("id", "deleted_at")


@query("y11_ledger", f"SELECT coalesce(e.sync_key, l.sync_key) AS sync_key, coalesce(e.source_path, l.source_path) AS source_path, coalesce(e.content_hash, l.content_hash) AS content_hash, CASE WHEN e.sync_key IS NOT NULL AND (l.sync_key IS NULL OR e.source_path <> l.source_path OR e.content_hash <> l.content_hash) THEN 'run-2' ELSE 'run-1' END AS last_seen_run_id FROM entities e FULL JOIN ledger l ON l.sync_key = e.sync_key")
def _(lib):
    return Y.merge_ledger(lib.ledger, lib.manifest, "run-2", now()).select("sync_key", "source_path", "content_hash", "last_seen_run_id")


@query("y12_latest_run", "SELECT 'run-' || event_id AS id, ts AS started_at FROM events ORDER BY ts DESC, 'run-' || event_id DESC LIMIT 1")
def _(lib):
    return Y.latest_run(lib.raw("events").select(F.concat(F.lit("run-"), "event_id").alias("id"), F.col("ts").alias("started_at")))


@query("y13_snapshot", "SELECT sync_key, project_id, source_path FROM ledger")
def _(lib):
    return Y.ledger_snapshot(lib.ledger).select("sync_key", "project_id", "source_path")


def _tables(lib):
    tags = lib.spark.createDataFrame([("en", "EN")], "normalized_name string, name string")
    links = lib.manifest_files.where("k <> 0").select(F.col("id").alias("file_id"), F.explode("tags").alias("normalized_name"))
    return {"projects": lib.projects, "nodes": lib.old_nodes, "files": lib.old_files, "versions": lib.versions, "tags": tags, "file_tags": links, "ledger": lib.ledger}


@query("y14_sync", f"WITH g AS ({GONE}), o AS (SELECT n.id, n.name, f.k FROM nodes n LEFT JOIN mfiles f ON f.id = n.id UNION ALL SELECT 'doc-ghost-' || doc_id, 'ghost-' || doc_id || '.md', 4 FROM mfiles WHERE k = 4) SELECT id, name, CASE WHEN id IN (SELECT entity_id FROM g) THEN {TS} END AS deleted_at FROM o")
def _(lib):
    """The tables committed as one version, synced into the next, and read from there."""
    store = VersionedStore(lib.spark, f"{shared_folder(lib.spark)}/kept-{uuid.uuid4().hex}")
    store.commit(store.snapshot(), put=_tables(lib))
    Y.sync_store(store, lib.manifest, prune=True, run_id="run-2", now=now())
    return store.snapshot().table("nodes").select("id", "name", "deleted_at")


@query("y14_sync_files", f"SELECT id AS node_id, CASE WHEN k IN (1, 3) THEN 2 ELSE 1 END AS current_version, title, CASE WHEN k IN (0, 1, 3) THEN {TS} ELSE TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 500) * INTERVAL 1 HOUR END AS updated_at FROM mfiles")
def _(lib):
    return Y.sync(_tables(lib), lib.manifest, prune=True, run_id="run-2", now=now())["files"].select("node_id", "current_version", "title", "updated_at")


@query("y15_migrate", "SELECT 'legacy-folder-' || lower(hex(lang)) AS id, '/' || lang AS path, 'folder' AS node_type, 0 AS depth FROM (SELECT DISTINCT lang FROM documents WHERE doc_id % 9 <> 0) UNION ALL SELECT CAST(doc_id AS VARCHAR), '/' || source || '/' || doc_id || '.md', 'file', 2 FROM documents")
def _(lib):
    d = lib.raw("documents")
    s = F.col("doc_id").cast("string")
    items = d.select(s.alias("id"), F.concat("source", F.lit("/"), s).alias("slug"), F.lit("t").alias("title"), F.lit("").alias("description"), F.col("text").alias("content"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 5 == 0, "system").otherwise("public").alias("visibility"), F.when(F.col("doc_id") % 9 == 0, now()).alias("deleted_at"))
    versions = d.select(s.alias("item_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("version_number"), F.col("text").alias("content"))
    return Y.migrate_flat(items, versions)["nodes"].select("id", "path", "node_type", "depth")


# Validation


def _odd(lib):
    """The manifest with faults here and there."""
    f, i = lib.manifest_files, F.col("doc_id")
    f = f.withColumn("id", F.when(i % 23 == 0, "doc-0").otherwise(F.col("id"))).withColumn("title", F.when(i % 7 == 0, " ").otherwise(F.substring("title", 1, 500))).withColumn("depth", F.when(i % 13 == 0, 5).otherwise(F.col("depth")))
    f = f.withColumn("visibility", F.when(i % 17 == 0, "secret").otherwise(F.col("visibility"))).withColumn("parent_id", F.when(i % 19 == 0, "nowhere").otherwise(F.col("parent_id")))
    return lib.manifest | {"files": f}


ODD = "o AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'doc-0' ELSE id END AS oid, CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 1 END AS odepth FROM mfiles)"
FIELDS = "SELECT 'file' AS entity_type, oid AS entity_id, 'title_missing' AS rule FROM o WHERE doc_id % 7 = 0 OR trim(title) = '' UNION ALL SELECT 'file', oid, 'visibility_value' FROM o WHERE doc_id % 17 = 0"
REFS = "SELECT 'file' AS entity_type, oid AS entity_id, 'unknown_parent' AS rule FROM o WHERE doc_id % 19 = 0 UNION ALL SELECT 'file', oid, 'depth' FROM o WHERE odepth <> 1"
DUPES = "SELECT 'file' AS entity_type, oid AS entity_id, 'duplicate_id' AS rule FROM o GROUP BY oid HAVING count(*) > 1"


@query("v1_paths", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reserved' WHEN 1 THEN 'trailing' WHEN 2 THEN 'character' ELSE 'empty' END AS rule FROM documents")
def _(lib):
    part = F.element_at(F.array(*map(F.lit, ("con.md", "x.", "a?b", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return V.path_violations(lib.raw("documents").select("doc_id", F.concat(F.lit("/"), "lang", F.lit("/"), part).alias("path"))).select("doc_id", "rule")


@query("v2_fields", f"WITH {ODD} {FIELDS}")
def _(lib):
    return V.field_violations(_odd(lib))


@query("v3_duplicates", f"WITH {ODD} {DUPES}")
def _(lib):
    return V.duplicate_violations(_odd(lib))


@query("v4_references", f"WITH {ODD} {REFS}")
def _(lib):
    return V.reference_violations(_odd(lib))


@query("v5_limits", "SELECT * FROM (SELECT 'projects' AS entity_type, count(*) AS n, CAST(10 AS BIGINT) AS most FROM projects UNION ALL SELECT 'folders', count(*), 10 FROM folders UNION ALL SELECT 'files', count(*), 2000 FROM mfiles) WHERE n > most")
def _(lib):
    return V.limit_violations(lib.manifest, {"projects": 10, "folders": 10, "files": 2000})


@query("v6_report", f"WITH {ODD} SELECT entity_type, rule, count(*) AS n FROM ({FIELDS} UNION ALL {REFS} UNION ALL {DUPES}) GROUP BY ALL")
def _(lib):
    return V.validation_report(_odd(lib))


# Normalisation


@query("n1_front_matter", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'title: ' || lang END AS header, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '---' || chr(10) || 'open' || chr(10) || text ELSE text END) AS body_sha, CASE doc_id % 3 WHEN 1 THEN 'unclosed front matter' END AS error FROM documents")
def _(lib):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\r\ntitle: "), "lang", F.lit("\n---\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("---\nopen\n"), "text")).otherwise(F.col("text"))
    return N.split_front_matter(lib.raw("documents").select("doc_id", raw.alias("raw"))).select("doc_id", "header", F.sha2("body", 256).alias("body_sha"), "error")


@query("n2_header")
def _(lib):
    h = F.concat(F.lit("title: "), "lang", F.lit("\nsort: "), "doc_id", F.lit("\ntags: [a, ' b ', a]\nextra: {z: 1, a: "), "source", F.lit("}\n"), F.when(F.col("doc_id") % 2 == 0, "published: 2024-01-01\n").otherwise(""))
    return N.parse_front_matter(lib.raw("documents").select("doc_id", h.alias("header"))).select("doc_id", "fields.*")


@query("n3_title", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Heading ' || doc_id ELSE 'stem' END AS title FROM documents")
def _(lib):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n#  Heading "), "doc_id", F.lit(" \n# Second"))).otherwise(F.concat(F.lit("## no\n"), "text"))
    return lib.raw("documents").select("doc_id", N.default_title(body, F.lit("stem")).alias("title"))


LINES = "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '---')), chr(10)) AS kept FROM documents"


@query("n4_description", f"SELECT doc_id, trim(substr(replace(string_split(ltrim(kept, chr(10)), chr(10) || chr(10))[1], chr(10), ' '), 1, 300)) AS description FROM ({LINES})")
def _(lib):
    return lib.raw("documents").select("doc_id", N.default_description(F.concat(F.lit("# Title\n\n"), "text")).alias("description"))


@query("n5_variables", "SELECT doc_id, 'topic,' || lang || CASE WHEN lang = 'name' THEN '' ELSE ',name' END || ',x.' || doc_id AS variables FROM documents")
def _(lib):
    body = F.concat("text", F.lit(" {{ name }} {{topic}} {{name}} {{x."), "doc_id", F.lit(" }} {{ }}"))
    return lib.raw("documents").select("doc_id", F.array_join(N.extract_variables(F.array(F.lit("topic"), F.col("lang")), body), ",").alias("variables"))


@query("n6_clean_list", "SELECT doc_id, 'a|' || lang || '|' || source AS items FROM documents")
def _(lib):
    return lib.raw("documents").select("doc_id", F.array_join(T.clean_list(F.array(F.lit(" a "), F.col("lang"), F.lit(""), F.concat("lang", F.lit("\t")), F.col("source"), F.lit("a"))), "|").alias("items"))


@query("n7_metadata", "SELECT doc_id, source AS extra, 'kept' AS own, lang AS both FROM documents")
def _(lib):
    m = F.create_map(F.lit("own"), F.lit("kept"), F.lit("both"), F.lit("old"))
    h = F.create_map(F.lit("extra"), F.col("source"), F.lit("title"), F.lit("t"), F.lit("both"), F.col("lang"))
    return lib.raw("documents").select("doc_id", N.effective_metadata(m, h).alias("m")).select("doc_id", F.col("m")["extra"].alias("extra"), F.col("m")["own"].alias("own"), F.col("m")["both"].alias("both"))


@query("n8_path_fields", "SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.md' AS path, doc_id || '.md' AS name, '/' || source || '/' || lang AS parent_path, 2 AS depth FROM documents")
def _(lib):
    d = lib.raw("documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("rel_path"))
    return N.path_fields(d).drop("rel_path")


@query("n9_normalize_path", "SELECT doc_id, '/' || source || '/' || lang AS path FROM documents")
def _(lib):
    return lib.raw("documents").select("doc_id", T.normalize_path(F.concat(F.lit(" \\"), "source", F.lit("\\\\//"), "lang", F.lit("/ "))).alias("path"))


@query("n10_stable_id", "SELECT id AS entity, 'file-' || substr(sha256('{\"path\":\"' || path || '\",\"projectId\":\"' || project_id || '\"}'), 1, 24) AS id FROM mfiles")
def _(lib):
    return lib.manifest_files.select(F.col("id").alias("entity"), T.stable_id("file-", "project_id", "path").alias("id"))


@query("n11_hashes", "SELECT id, 'sha256:' || sha256('{\"content\":' || CAST(to_json(text) AS VARCHAR) || ',\"description\":' || CAST(to_json(description) AS VARCHAR) || ',\"format\":\"markdown\",\"language\":\"' || lang || '\",\"metadata\":{},\"promptRole\":\"reference\",\"tags\":[\"' || replace(tags_text, ',', '\",\"') || '\"],\"title\":' || CAST(to_json(title) AS VARCHAR) || ',\"variables\":[]}') AS content_hash FROM mfiles")
def _(lib):
    return N.add_hashes(lib.manifest_files).select("id", "content_hash")


@query("n11_config_hash", "SELECT id, 'sha256:' || sha256('{\"defaultLanguage\":\"en\",\"description\":\"' || description || '\",\"id\":\"' || id || '\",\"metadata\":{},\"name\":\"' || name || '\",\"prune\":' || CASE WHEN prune THEN 'true' ELSE 'false' END || ',\"slug\":\"' || slug || '\",\"visibility\":\"' || visibility || '\"}') AS config_hash FROM projects")
def _(lib):
    return N.add_config_hash(lib.projects, "project").select("id", "config_hash")


@query("n12_format", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'json' END AS format, CASE doc_id % 4 WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'invalid json' END WHEN 3 THEN 'unknown extension' END AS format_error FROM documents")
def _(lib):
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("md", "TXT", "json", "bin"))), (i % 4 + 1).cast("int"))
    d = lib.raw("documents").select("doc_id", F.concat("doc_id", F.lit("."), ext).alias("name"), F.when(i % 8 == 2, F.concat(F.lit("{"), "text")).otherwise(F.concat(F.lit('{"a":'), "doc_id", F.lit("}"))).alias("body"))
    return N.detect_format(d).select("doc_id", "format", "format_error")


@query("n13_body", "SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_replace(text, '\\s+$', '') || chr(10) END) AS body_sha FROM documents")
def _(lib):
    return lib.raw("documents").select("doc_id", F.sha2(N.normalize_body(F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat("text", F.lit(" \t\n\n")))), 256).alias("body_sha"))


@query("n15_fingerprint", "WITH e AS (SELECT id AS project_id, sha256('projects|' || id || '|' || source_path || '|' || config_hash) AS h FROM projects UNION ALL SELECT project_id, sha256('folders|' || id || '|' || source_path || '|' || config_hash) FROM folders UNION ALL SELECT project_id, sha256('files|' || id || '|' || source_path || '|' || sync_hash) FROM mfiles), parts AS (SELECT project_id, substr(h, 1, 2) AS part, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM e GROUP BY ALL), each AS (SELECT project_id, sha256(string_agg(h, ',' ORDER BY part)) AS h FROM parts GROUP BY project_id) SELECT 'sha256:' || sha256(string_agg(h, ',' ORDER BY project_id)) AS manifest_hash FROM each")
def _(lib):
    return N.manifest_fingerprint(lib.manifest)


# Collecting


@query("c1_nav_links")
def _(lib):
    return C.extract_nav_links(lib.raw("pages"))


@query("c2_canonical_url", f"SELECT page_id, {URL} AS url, {URL} || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS with_query FROM pages")
def _(lib):
    return lib.raw("pages").select("page_id", C.canonical_url("url", "url").alias("url"), C.canonical_url("url", "url", "/", True).alias("with_query"))


@query("c3_slug", "SELECT id, regexp_replace(regexp_replace(replace(replace(lower(title), '&', ' and '), '@', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM mfiles")
def _(lib):
    return lib.manifest_files.select("id", T.slug("title", True).alias("slug"))


@query("c4_doc_path", f"SELECT page_id, 'core-and-utils/' || regexp_replace(regexp_replace({URL}, '^[a-z]+://[^/]*/', ''), '[^a-z0-9/]+', '-', 'g') || '.md' AS path FROM pages")
def _(lib):
    return lib.raw("pages").select("page_id", C.doc_path(F.lit("Core & Utils"), C.canonical_url("url", "url")).alias("path"))


def _links(lib):
    url = C.canonical_url("url", "url")
    return lib.raw("pages").select(url.alias("url"), F.regexp_extract(url, "^[a-z]+://[^/]*/([a-z]+)", 1).alias("grp"), F.lit("t").alias("title"), F.ascii(F.regexp_extract(url, "^[a-z]+://[^/]*/([a-z]+)", 1)).alias("group_sort"), F.col("page_id").alias("document_sort"))


@query("c5_select", f"SELECT url, min(page_id) AS document_sort FROM (SELECT {URL} AS url, page_id FROM pages) WHERE regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) IN ('en', 'fr') GROUP BY url")
def _(lib):
    return C.select_nav_documents(_links(lib), ["EN", "Fr"]).select("url", "document_sort")


@query("c6_markdown")
def _(lib):
    return C.pages_to_markdown(lib.raw("pages"), "plain").select("page_id", "title", "markdown", "error")


@query("c7_markdown_space", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '[ \\t]+' || chr(10), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_sha FROM documents")
def _(lib):
    return lib.raw("documents").select("doc_id", F.sha2(C.normalize_markdown(F.replace("text", F.lit("\n"), F.lit(" \r\n\t\n\r"))), 256).alias("text_sha"))


@query("c8_errors")
def _(lib):
    pages = lib.raw("pages").withColumn("html", F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 5 == 1, "<h1>a</h1>").otherwise(F.col("html")))
    return C.collection_errors(C.pages_to_markdown(pages, "plain"))


@query("c9_discover", f"SELECT 'docs/' || regexp_replace({URL}, '^[a-z]+://', '') || '.md' AS path FROM pages")
def _(lib):
    at = F.concat(F.lit("docs/"), F.regexp_replace(C.canonical_url("url", "url"), "^[a-z]+://", ""))
    entry = lambda p, kind: F.concat(F.lit('{"path":"'), p, F.lit(f'","type":"{kind}"}}'))
    listing = F.concat(F.lit('{"tree":['), F.concat_ws(",", entry(F.concat(at, F.lit(".md")), "blob"), entry(at, "tree"), entry(F.concat(at, F.lit(".png")), "blob"), entry(F.concat(F.lit("src/"), at, F.lit(".md")), "blob")), F.lit("]}"))
    return C.discover_documents(lib.raw("pages").select(listing.alias("listing")), "docs/", [".md", ".mdx"])


@query("c10_clashes", f"SELECT lower({URL}) || '.md' AS folded, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def _(lib):
    u = C.canonical_url("url", "url")
    d = lib.raw("pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, u).otherwise(u), F.when(F.col("page_id") % 2 == 0, ".mdx").otherwise(".md")).alias("path"))
    return C.map_output_paths(d)[1]


def _placed(lib):
    return lib.raw("documents").select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), (F.col("doc_id") % 20).alias("group_sort"), (F.col("doc_id") % 50).alias("document_sort"))


PLACED = "f AS (SELECT '/' || source AS path, 0 AS depth, doc_id % 20 AS g, doc_id % 50 AS d FROM documents UNION ALL SELECT '/' || source || '/' || lang, 1, doc_id % 20, doc_id % 50 FROM documents), m AS (SELECT path, depth, min(g * 1000 + d) AS sort FROM f GROUP BY path, depth)"


@query("c11_folders", f"WITH {PLACED} SELECT path, depth, sort FROM m")
def _(lib):
    return C.derive_folders(_placed(lib))


@query("c11_folders_ranked", f"WITH {PLACED} SELECT path, depth, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY sort, path) * 10 AS sort FROM m")
def _(lib):
    return C.derive_folders(_placed(lib), "ranked").withColumn("sort", F.col("sort").cast("bigint"))


@query("c12_bodies", f"SELECT url, min(page_id) AS page_id FROM (SELECT {URL} AS url, page_id FROM pages) GROUP BY url")
def _(lib):
    pages = lib.raw("pages").withColumn("url", C.canonical_url("url", "url"))
    return C.attach_bodies(_links(lib).select("url").distinct(), pages).select("url", "page_id")


@query("c13_inventory", "SELECT 'file' AS kind, source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents WHERE lang = 'es' OR doc_id % 9 = 0 UNION ALL SELECT DISTINCT 'folder', source || '/' || lang FROM documents d WHERE lang = 'es' OR NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.lang = d.lang AND e.doc_id % 9 <> 0) UNION ALL SELECT DISTINCT 'folder', source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.lang <> 'es' AND e.doc_id % 9 <> 0)")
def _(lib):
    d = lib.raw("documents").select("doc_id", "lang", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    stale, empty = C.inventory_diff(d, d.where("lang <> 'es' and doc_id % 9 <> 0"))
    return stale.select(F.lit("file").alias("kind"), "path").union(empty.select(F.lit("folder"), "folder"))


# Semantic retrieval


@query("m1_requests", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'missing_query' WHEN 1 THEN 'invalid_limit' WHEN 2 THEN 'invalid_mode' WHEN 3 THEN 'invalid_threshold' END AS error, CASE WHEN doc_id % 6 > 3 THEN lang || ' ' || doc_id END AS query, CAST(CASE WHEN doc_id % 6 > 3 THEN 1 + doc_id % 20 END AS INTEGER) AS max_results, CAST(CASE WHEN doc_id % 6 = 4 THEN least(50, 3 * (1 + doc_id % 20)) WHEN doc_id % 6 = 5 THEN 1 + doc_id % 20 END AS INTEGER) AS max_chunks FROM documents")
def _(lib):
    i = F.col("doc_id")
    rest = F.element_at(F.array(*map(F.lit, ("", "&limit=21", "&mode=best", "&threshold=1.5", "&rerank=YES", "&group=chunks&context=2"))), (i % 6 + 1).cast("int"))
    url = F.concat(F.lit("https://x.example/search?q="), F.when(i % 6 == 0, "%20").otherwise(F.concat("lang", F.lit("+"), i)), rest, F.when(i % 6 == 1, "").otherwise(F.concat(F.lit("&limit="), 1 + i % 20)))
    return M.parse_search_requests(lib.raw("documents").select("doc_id", url.alias("url"))).select("doc_id", "error", "query", "max_results", "max_chunks")


@query("m2_instances", "SELECT project_id, instance_id FROM (SELECT project_id, instance_id, status FROM mapping UNION SELECT project_id, replacement_instance_id, status FROM mapping) m JOIN projects p ON p.id = m.project_id WHERE m.status = 'ready' AND instance_id IS NOT NULL AND visibility = 'public'")
def _(lib):
    return M.searchable_instances(lib.projects, lib.mapping, EVERYONE)


@query("m3_vector_topk", "SELECT query_id, CAST(place AS INTEGER) AS place, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE score >= 0.2) WHERE place <= 5")
def _(lib):
    e = lib.raw("embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return M.vector_topk(chunks, asked, 5, 0.2).withColumn("score", F.round("score", 6))


@query("m4_context", "SELECT conv_id AS item_id, turn AS ordinal, sha256(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10) || chr(10))) AS context_sha FROM conversations")
def _(lib):
    c = lib.raw("conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ordinal"), "text")
    return M.expand_context(c.select("item_id", "ordinal"), c, 1).select("item_id", "ordinal", F.sha2("context", 256).alias("context_sha"))


def _chunks(lib):
    """Events as scored chunks: a user is a query."""
    i = F.col("event_id")
    return lib.raw("events").select(F.col("user_id").alias("query_id"), i.alias("position"), F.col("value").alias("score"), F.when(i % 4 == 0, F.lit(float("nan"))).when(i % 4 == 1, (i % 1000) / 100.0).alias("rerank_score"), F.concat(F.lit("doc-"), i % lib.n_docs).alias("file_id"))


EVENTS = "chunks AS (SELECT user_id AS query_id, event_id AS position, value AS score, CASE WHEN event_id % 4 = 1 THEN (event_id % 1000) / 100.0 END AS rerank, 'doc-' || (event_id % (SELECT count(*) FROM documents)) AS file_id FROM events), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank, score) DESC, position) AS place FROM chunks)"


@query("m5_order", f"WITH {EVENTS} SELECT query_id, position, CAST(place AS INTEGER) AS place FROM placed")
def _(lib):
    return M.order_chunks(_chunks(lib), True, True).select("query_id", "position", "place")


@query("m6_hydrate", f"WITH {EVENTS} SELECT position, c.file_id, project_slug, path FROM chunks c JOIN sdocs d ON d.file_id = c.file_id WHERE d.visibility = 'public'")
def _(lib):
    return M.hydrate(_chunks(lib), lib.docs, None, EVERYONE).select("position", "file_id", "project_slug", "path")


@query("m7_group", f"WITH {EVENTS}, best AS (SELECT query_id, file_id, min(place) AS place FROM placed GROUP BY ALL) SELECT query_id, file_id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM best) WHERE n <= 10")
def _(lib):
    return M.group_results(M.order_chunks(_chunks(lib), True, True), "files", 10).select("query_id", "file_id", "place")


def _results(lib):
    i = F.substring("file_id", 5, 20).cast("bigint")
    own = F.create_map(F.when(i % 3 == 0, "name").otherwise("other"), F.when(i % 3 == 0, F.concat(F.lit("Name "), i)).otherwise("x"))
    return lib.docs.select(i.alias("query_id"), F.lit(1).alias("place"), F.lit(0.5).alias("score"), "title", F.lit("a<b & c").alias("text"), F.when(i % 3 == 1, F.concat(F.lit("Title "), i)).alias("result_title"), F.lit(" ").alias("source_title"), own.alias("metadata"), F.col("project_slug").alias("project"), F.concat(F.lit("/"), "language", F.lit("/my-page_"), i, F.lit(".md")).alias("path"), F.concat(F.lit("/raw/"), i).alias("raw_path"), F.lit("https://x.example/a/b").alias("source_url"), F.lit(None).cast("string").alias("source_key"))


COMPACT = "SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 1 THEN 'Title ' || doc_id WHEN 0 THEN 'Name ' || doc_id ELSE 'My Page ' || doc_id END AS title, 'prompt://' || project_slug || '/' || language || '/my-page_' || doc_id || '.md' AS uri, 'https://x.example/raw/' || doc_id AS url FROM sdocs"


@query("m8_compact", COMPACT)
def _(lib):
    return M.compact_results(_results(lib)).select("query_id", "title", "uri", "url")


@query("m9_json", f"SELECT query_id, '{{\"query_id\":' || query_id || ',\"text\":\"a\\u003cb \\u0026 c\",\"title\":\"' || title || '\"}}' AS json FROM ({COMPACT})")
def _(lib):
    return M.to_safe_json(M.compact_results(_results(lib)).select("query_id", "text", "title")).select("query_id", "json")


# Outbox


@query("o1_keys", "SELECT file_id, 'a-' || project_slug || '-b' AS instance_id, substr(path, 2) AS item_key, CAST(least(3600, 30 * power(2, greatest(0, doc_id % 12 - 1))) AS INTEGER) AS delay FROM sdocs")
def _(lib):
    i = F.substring("file_id", 5, 20).cast("bigint")
    return lib.docs.select("file_id", O.instance_id(F.concat(F.lit("!A "), "project_slug", F.lit("  b?"))).alias("instance_id"), O.item_key(F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("\\")))).alias("item_key"), O.retry_delay(i % 12).alias("delay"))


FAN = "SELECT 'upsert:' || f.id || ':' || f.sync_hash || ':' || p.config_hash AS dedupe_key, 'upsert_file' AS operation, f.project_id, f.id AS file_id FROM mfiles f JOIN projects p ON p.id = f.project_id"


@query("o2_changes", f"{FAN} WHERE k IN (0, 1, 3) UNION ALL SELECT DISTINCT 'delete:' || i.file_id || ':' || i.item_id, 'delete_file', i.project_id, i.file_id FROM items i JOIN mfiles f ON 'doc-ghost-' || f.doc_id = i.file_id WHERE f.k = 4")
def _(lib):
    after = lib.full_ledger
    return O.ledger_changes_to_jobs(lib.ledger, after, lib.nodes, lib.items).select("dedupe_key", "operation", "project_id", "file_id")


@query("o3_fan_out", f"{FAN} WHERE p.prune")
def _(lib):
    changed = lib.projects.where("prune").select(F.col("id").alias("project_id"), F.col("config_hash").alias("content_hash"))
    return O.fan_out_project_changes(changed, lib.full_ledger, lib.nodes).select("dedupe_key", "operation", "project_id", "file_id")


@query("o4_reconcile_projects", "SELECT 'ensure:' || p.id || ':' || p.config_hash || ':readable-v1:' || p.slug AS dedupe_key, p.id AS project_id FROM projects p LEFT JOIN mapping m ON m.project_id = p.id WHERE m.project_id IS NULL OR m.status <> 'ready' OR (m.instance_id <> p.slug AND m.replacement_instance_id IS DISTINCT FROM p.slug)")
def _(lib):
    return O.reconcile_projects(lib.projects, lib.full_ledger, lib.mapping).select("dedupe_key", "project_id")


@query("o5_reconcile_files", "SELECT 'upsert:' || f.id || ':' || f.sync_hash || ':' || p.config_hash || ':readable-v1' AS dedupe_key, f.id AS file_id FROM mfiles f JOIN projects p ON p.id = f.project_id WHERE doc_id % 7 = 0 OR doc_id % 4 = 3 OR doc_id % 11 = 0")
def _(lib):
    return O.reconcile_files(lib.docs, lib.full_ledger, lib.items).select("dedupe_key", "file_id")


@query("o6_obsolete", "SELECT 'delete:' || file_id || ':' || item_id AS dedupe_key, file_id FROM items WHERE file_id NOT IN (SELECT file_id FROM sdocs)")
def _(lib):
    return O.obsolete_items(lib.items, lib.docs).select("dedupe_key", "file_id")


@query("o7_merge", f"SELECT dedupe_key, CASE WHEN status = 'completed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'completed' THEN 0 ELSE attempts END AS attempts, CASE WHEN status = 'completed' THEN {TS} ELSE updated_at END AS updated_at FROM jobs UNION ALL SELECT 'new:' || dedupe_key, 'pending', 0, {TS} FROM jobs")
def _(lib):
    own = lib.jobs.select(*O.JOB)
    incoming = own.union(own).union(own.withColumn("dedupe_key", F.concat(F.lit("new:"), "dedupe_key")))
    return O.merge_jobs(lib.jobs, incoming, now()).select("dedupe_key", "status", "attempts", "updated_at")


@query("o8_recover", "SELECT dedupe_key, CASE WHEN status = 'failed' AND operation = 'upsert_file' AND lower(last_error) LIKE '%timeout%' THEN 'retry' ELSE status END AS status FROM jobs")
def _(lib):
    return O.recover_failed(lib.jobs, ["timeout"], now()).select("dedupe_key", "status")


@query("o8_retry", "SELECT dedupe_key, CASE WHEN status = 'failed' AND n <= 20 THEN 'retry' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY updated_at, dedupe_key) AS n FROM jobs)")
def _(lib):
    return O.retry_failed(lib.jobs, now(), 20).select("dedupe_key", "status")


READY = f"SELECT * FROM jobs WHERE status IN ('pending', 'retry', 'processing') AND next_attempt_at <= {TS} AND (lease_expires_at IS NULL OR lease_expires_at <= {TS}) ORDER BY CASE operation WHEN 'ensure_instance' THEN 0 WHEN 'delete_file' THEN 1 ELSE 2 END, created_at, dedupe_key LIMIT 10"


@query("o9_ready", f"SELECT dedupe_key, operation FROM ({READY})")
def _(lib):
    return O.ready_jobs(lib.jobs, now(), 10).select("dedupe_key", "operation")


def _outcomes(lib):
    h = F.col("attempts") % 4
    return lib.jobs.where("status = 'processing'").select("dedupe_key", F.when(h == 0, "completed").when(h == 1, "skipped").otherwise("error").alias("result"), F.lit("broken").alias("message"), (h == 3).alias("permanent"))


BROKEN, OVER = "(status = 'processing' AND attempts % 4 >= 2)", "(attempts >= 5 OR attempts % 4 = 3)"


@query("o10_outcomes", f"SELECT dedupe_key, CASE WHEN status <> 'processing' THEN status WHEN attempts % 4 < 2 THEN 'completed' WHEN {OVER} THEN 'failed' ELSE 'retry' END AS status, CASE WHEN {BROKEN} THEN {TS} + CAST(least(3600, 30 * power(2, greatest(0, attempts - 1))) AS INTEGER) * INTERVAL 1 SECOND ELSE next_attempt_at END AS next_attempt_at, CASE WHEN {BROKEN} THEN 'broken' WHEN status <> 'processing' THEN last_error END AS last_error, CASE WHEN status = 'processing' AND attempts % 4 < 2 THEN {TS} END AS completed_at FROM jobs")
def _(lib):
    return O.apply_outcomes(lib.jobs, _outcomes(lib), now()).select("dedupe_key", "status", "next_attempt_at", "last_error", "completed_at")


@query("o10_summary", f"SELECT count(*) AS claimed, count(*) FILTER (attempts % 4 = 0) AS completed, count(*) FILTER (attempts % 4 = 1) AS skipped, count(*) FILTER (attempts % 4 >= 2 AND NOT {OVER}) AS retried, count(*) FILTER (attempts % 4 >= 2 AND {OVER}) AS failed FROM jobs WHERE status = 'processing'")
def _(lib):
    return O.outcome_summary(lib.jobs, _outcomes(lib))


@query("o11_upserts", "WITH j AS (SELECT f.id AS file_id, 'up:' || f.doc_id AS dedupe_key, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE f.sync_hash || '|' || p.config_hash END AS expected FROM mfiles f JOIN projects p ON p.id = f.project_id) SELECT j.dedupe_key, CASE WHEN f.doc_id % 3 = 0 THEN 'stale' WHEN i.status = 'indexed' AND i.index_hash = f.sync_hash || '|' || p.config_hash THEN 'current' ELSE 'upload' END AS decision FROM j JOIN mfiles f ON f.id = j.file_id JOIN projects p ON p.id = f.project_id LEFT JOIN items i ON i.file_id = f.id")
def _(lib):
    hashes = lib.full_ledger.where("entity_type = 'project'").select(F.col("entity_id").alias("project_id"), F.col("content_hash").alias("config_hash"))
    f = lib.manifest_files.join(hashes, "project_id")
    jobs = f.select(F.concat(F.lit("up:"), "doc_id").alias("dedupe_key"), F.lit("upsert_file").alias("operation"), F.col("id").alias("file_id"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.concat("sync_hash", F.lit("|"), "config_hash")).alias("expected_hash"))
    return O.decide_upserts(jobs, lib.docs, lib.files, lib.full_ledger, lib.items).select("dedupe_key", "decision")


@query("o12_deletes", "SELECT 'del:' || file_id AS dedupe_key, CASE WHEN file_id IN (SELECT file_id FROM sdocs) THEN 'live' WHEN doc_id % 2 = 0 THEN 'other_item' ELSE 'delete' END AS decision FROM items")
def _(lib):
    n = F.regexp_extract("item_id", "([0-9]+)$", 1).cast("bigint")
    jobs = lib.items.select(F.concat(F.lit("del:"), "file_id").alias("dedupe_key"), F.lit("delete_file").alias("operation"), "file_id", F.when(n % 2 == 0, "other").otherwise(F.col("item_id")).alias("expected_hash"))
    return O.decide_deletes(jobs, lib.docs, lib.items).select("dedupe_key", "decision")


@query("o13_remote", "SELECT file_id, CASE WHEN status NOT IN ('queued', 'processing') THEN status WHEN doc_id % 3 = 0 THEN 'indexed' WHEN doc_id % 3 = 1 THEN 'error' ELSE 'processing' END AS status FROM items")
def _(lib):
    n = F.regexp_extract("item_id", "([0-9]+)$", 1).cast("bigint")
    report = lib.items.select("file_id", F.when(n % 3 == 0, "completed").when(n % 3 == 1, "outdated").otherwise("running").alias("remote_status"), F.lit(3).alias("chunks_count"))
    return O.apply_remote_status(lib.items, report, now())[0].select("file_id", "status")


@query("o14_swaps", "SELECT project_id, m.instance_id, replacement_instance_id FROM mapping m WHERE replacement_instance_id <> m.instance_id AND NOT EXISTS (SELECT 1 FROM sdocs d LEFT JOIN items i ON i.file_id = d.file_id WHERE d.project_id = m.project_id AND (i.file_id IS NULL OR i.instance_id <> m.replacement_instance_id OR i.status = 'error'))")
def _(lib):
    done = lib.items.withColumn("status", F.when(F.col("status") != "error", "indexed").otherwise(F.col("status")))
    return O.ready_swaps(lib.mapping, lib.docs, done, lib.jobs.where("status = 'completed'"))


@query("o15_status", "SELECT 'projects' AS kind, status, count(*) AS n FROM mapping GROUP BY status UNION ALL SELECT 'items', status, count(*) FROM items GROUP BY status UNION ALL SELECT 'jobs', status, count(*) FROM jobs GROUP BY status")
def _(lib):
    return O.status_counts(lib.mapping, lib.items, lib.jobs)


COVER = "SELECT count(*) AS expected, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status IN ('queued', 'processing')) AS waiting, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status IS NULL) AS missing FROM sdocs d LEFT JOIN items i ON i.file_id = d.file_id"


@query("o16_coverage", COVER)
def _(lib):
    return O.coverage(lib.docs, lib.items)


@query("o17_errors", "SELECT dedupe_key, status, last_error, updated_at FROM jobs WHERE last_error IS NOT NULL ORDER BY updated_at DESC, dedupe_key LIMIT 20")
def _(lib):
    return O.recent_errors(lib.jobs, 20).select("dedupe_key", "status", "last_error", "updated_at")


@query("o18_health", f"WITH c AS ({COVER}) SELECT (SELECT count(*) FROM projects) AS projects, (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_run, true AS bootstrap, c.* FROM c")
def _(lib):
    runs = lib.raw("events").select(F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.col("event_id").alias("id"))
    return O.health(lib.projects, runs, lib.kv, lib.docs, lib.items)


# Templates and key/value records


@query("p1_render", "SELECT conv_id, turn, 'Hi ' || role || ', about ' || substr(text, 1, 30) || ' and {{missing}}' AS rendered, 'missing' AS missing, 'name,topic' AS used FROM conversations")
def _(lib):
    values = F.create_map(F.lit("name"), F.col("role"), F.lit("topic"), F.substring("text", 1, 30))
    d = lib.raw("conversations").select("conv_id", "turn", F.lit("Hi {{ name }}, about {{topic}} and {{ missing }}").alias("template"), values.alias("values"))
    return P.render(d).select("conv_id", "turn", "rendered", F.array_join("missing", ",").alias("missing"), F.array_join("used", ",").alias("used"))


@query("k1_bootstrap", "SELECT conv_id AS request_id, bundle_key AS source_key, sha256(text) AS content_sha FROM kv WHERE key LIKE 'manifest:%' AND conv_id % 3 <> 0 AND conv_id % 5 <> 0")
def _(lib):
    c = lib.raw("conversations").where("turn = 0")
    asked = c.select(F.col("conv_id").alias("request_id"), F.concat(F.lit(" Client"), "conv_id").alias("client"), F.lit("DEFAULT").alias("profile"))
    return P.bootstrap_context(lib.kv, asked).select("request_id", "source_key", F.sha2("content", 256).alias("content_sha"))


@query("k2_common", "SELECT conv_id AS request_id, key FROM kv WHERE key LIKE 'common:%'")
def _(lib):
    asked = lib.raw("conversations").where("turn = 0").select(F.col("conv_id").alias("request_id"), F.concat(F.lit(" common:"), "conv_id").alias("key"))
    return P.common_item(lib.kv, asked).select("request_id", "key")


from foliospark.plans import round_trips  # noqa: E402, F401 (it registers its queries)
