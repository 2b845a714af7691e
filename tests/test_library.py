"""Golden values and properties of the library's operators."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import catalog, collect, fulltext, markdown, normalize, outbox, semantic, sync, templates, validate
from foliospark.plans.library import Library, now
from foliospark.sources import trees

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, SF)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_index_names_keys_and_delays(spark):
    names = [("My UI Docs", "my-ui-docs"), ("doc_library", "doc_library"), ("a" * 65, None), ("!!", None)]
    for r in spark.createDataFrame(names, "slug string, want string").withColumn("got", outbox.instance_id("slug")).collect():
        assert r["got"] == r["want"]
    keys = [("guides\\content-sync.md", "guides/content-sync.md"), ("/components/./button.md", "components/button.md"), ("../secret.md", None), ("/", None)]
    for r in spark.createDataFrame(keys, "path string, want string").withColumn("got", outbox.item_key("path")).collect():
        assert r["got"] == r["want"]
    assert one(spark, *(outbox.retry_delay(F.lit(n)).alias(str(n)) for n in (1, 2, 3, 4, 10))) == (30, 60, 120, 240, 3600)


def test_uris_round_trip_and_refuse_bad_ones(spark):
    rows = spark.createDataFrame([("my docs", "/a b/ü&x.md", "prompt://my%20docs/a%20b/%C3%BC%26x.md"), ("p", "/(x)!~*'.md", "prompt://p/(x)!~*'.md")], "s string, p string, want string")
    for r in rows.withColumn("uri", T.file_uri("s", "p")).withColumn("back", T.parse_file_uri("uri")).collect():
        assert r["uri"] == r["want"] and r["back"]["project"] == r["s"] and r["back"]["path"] == r["p"]
    bad = spark.createDataFrame([("http://x/y",), ("prompt:///y",), ("prompt://p/%zz",), ("PROMPT://p/q",)], "u string").select(T.parse_file_uri("u").alias("x")).collect()
    assert [r["x"] is None for r in bad] == [True, True, True, False]


def test_links_of_all_kinds(spark):
    want = "/p/doc-library/guides/content-sync.md"
    links = ["prompt://doc-library/guides/content-sync.md", "doc-library:/guides/content-sync.md", "https://x.example/p/doc-library/guides/content-sync.md", "/p/doc-library/guides/content-sync.md", "https://x.example/raw/doc-library/guides/content-sync.md", "https://x.example/raw?identifier=doc-library%3A%2Fguides%2Fcontent-sync.md", "https://x.example/api/files/fetch?identifier=prompt%3A%2F%2Fdoc-library%2Fguides%2Fcontent-sync.md", "doc-library/guides/content-sync.md"]
    out = catalog.normalize_links(spark.createDataFrame([(x,) for x in links], "link string")).collect()
    assert [r["viewer_path"] for r in out] == [want] * len(links)
    bare = catalog.normalize_links(spark.createDataFrame([("doc-1",), (None,), (" ",)], "link string")).collect()
    assert [r["viewer_path"] for r in bare] == ["/p?identifier=doc-1", None, None]


def test_paths_and_slugs(spark):
    rows = [(None, "/"), ("", "/"), ("a\\b//c/", "/a/b/c"), ("／ｘ", "/x"), (" /a/ ", "/a")]
    for r in spark.createDataFrame(rows, "p string, want string").withColumn("got", T.normalize_path("p")).collect():
        assert r["got"] == r["want"]
    assert one(spark, T.slug(F.lit("Core & Utils @v4")), T.slug(F.lit("Core & Utils"), True)) == ("core-utils-v4", "core-and-utils")


def test_front_matter(spark):
    rows = [(0, "---\ntitle: A\n---\nbody"), (1, "---\nopen"), (2, "no header"), (3, None), (4, "---\r\nx: 1\r\n---\r\nb\r\n")]
    out = {r["i"]: r for r in normalize.split_front_matter(spark.createDataFrame(rows, "i int, raw string")).collect()}
    assert (out[0]["header"], out[0]["body"]) == ("title: A", "body") and out[1]["error"] and out[2]["header"] is None and out[3]["body"] == "" and out[4]["body"] == "b\n"
    read = normalize.read_header("title: ' T '\nsort: true\ntags: [a, ' b', a]\nextra: {b: 1, a: 2}\nmetadata: {k: v}")
    assert read["title"] == "T" and read["tags"] == ["a", "b"] and read["errors"] == ["sort: integer expected"] and read["metadata_json"] == '{"extra":{"a":2,"b":1},"k":"v"}'
    assert normalize.read_header("seen: 2025-01-31")["errors"] == ["metadata: not JSON"] and normalize.read_header("[1]")["errors"] and normalize.read_header(": :\n -")["errors"]
    assert one(spark, normalize.default_description(F.lit("# T\n\n```\ncode\n```\nfirst\n---\nline\n\nsecond")))[0] == "first line"


def test_variables_keep_their_order(spark):
    got = one(spark, normalize.extract_variables(F.array(F.lit("subject")), F.lit("{{ reader }} {{größe}} {{subject}}")).alias("v"))["v"]
    assert got == ["subject", "reader", "größe"]


def test_canonical_json_escapes_like_json(spark):
    import json

    text = 'a"\\\x0b\x1f\x01\\u001F / é  '
    assert one(spark, T.canonical_json(F.struct(F.lit(text).alias("a"), F.lit(None).cast("string").alias("b"))).alias("j"))["j"] == json.dumps({"a": text, "b": None}, ensure_ascii=False, separators=(",", ":"))


HTML = """<html><body><div data-section="true">Core</div><h1 data-title="true">Flex</h1><p data-description="true">How to grow.</p>
<div data-content="true"><h2>Use <code>grow</code></h2><p class="sr-only">secret</p><p>See <a href="/docs/x">x</a> and <b>bold</b>.</p><button>copy</button>
<pre><code class="language-html">&lt;div&gt;
  hi</code></pre><figure><svg>no</svg><figcaption>Shown</figcaption><div>preview</div><pre>code</pre></figure><ul><li>one<ul><li>two</li></ul></li></ul>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table><img alt="Chart"><script>x()</script></div></body></html>"""


def test_pages_become_markdown(spark):
    rows = [(1, "https://a.example/d/f", HTML), (2, "u", "<p>x"), (3, "u", None), (4, "u", HTML.replace("Flex", " "))]
    out = {r["page_id"]: r for r in collect.pages_to_markdown(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    text = out[1]["markdown"]
    for part in ("# Flex\n\nHow to grow.\n\n", "## Use `grow`", "[x](https://a.example/docs/x)", "**bold**", "```html\n<div>\n  hi\n```", "Shown", "```\ncode\n```", "- one\n", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |", "Image: Chart"):
        assert part in text, part
    for part in ("secret", "copy", "preview", "x()", "no</svg>"):
        assert part not in text
    assert out[1]["section"] == "Core" and [out[i]["error"] for i in (2, 3, 4)] == ["missing markers", "empty response", "empty title or description"]
    reasons = collect.collection_errors(collect.pages_to_markdown(spark.createDataFrame(rows, "page_id int, url string, html string"))).collect()
    assert sorted(r["reason"] for r in reasons) == ["empty response", "empty title or description", "missing markers"]


def test_navigation_of_three_kinds(spark):
    auto = '<nav><div data-autoscroll><div><h3>Core</h3><ul><li><a href="/docs/a">A</a><li><a href="/docs/b">B</a></ul></div><div><h3>CORE</h3><a href="/docs/a">A</a></div></div></nav>'
    side = '<div data-docs-sidebar-content><div data-sidebar="group"><div data-sidebar="group-label">Get Started</div><a data-sidebar="menu-button" href="/docs">Intro</a><a href="/x">no</a></div></div>'
    assert markdown.nav_groups(markdown.parse(auto), "autoscroll") == [("Core", [("A", "/docs/a"), ("B", "/docs/b")]), ("CORE", [("A", "/docs/a")])]
    assert markdown.nav_groups(markdown.parse(side), "sidebar") == [("Get Started", [("Intro", "/docs")])]
    rows = collect.extract_nav_links(spark.createDataFrame([(1, auto)], "page_id int, html string"), "autoscroll").collect()
    assert [(r["group_sort"], r["document_sort"]) for r in rows] == [(1, 1), (1, 2), (1, 3)]


def test_canonical_urls(spark):
    base = "https://a.example/docs/start"
    rows = [("/docs/x/#top", "https://a.example/docs/x"), ("y", "https://a.example/docs/y"), ("https://b.example/docs/x", None), ("mailto:x", None), ("/blog", None), ("/docs?q=1", "https://a.example/docs")]
    for r in spark.createDataFrame(rows, "href string, want string").withColumn("got", collect.canonical_url("href", F.lit(base), "/docs")).collect():
        assert r["got"] == r["want"], r


def test_templates(spark):
    df = spark.createDataFrame([("Hi {{ a }}{{b}} {{ c }} {{a}}", {"a": "{{b}}", "b": "$1\\"})], "template string, values map<string,string>")
    r = templates.render(df).first()
    assert r["rendered"] == "Hi {{b}}$1\\ {{c}} {{b}}" and r["missing"] == ["c"] and r["used"] == ["a", "b"]
    same = templates.render(spark.createDataFrame([("no variables",)], "template string").withColumn("values", F.create_map().cast("map<string,string>"))).first()
    assert same["rendered"] == "no variables" and same["missing"] == []


def test_common_index(spark):
    kv = spark.createDataFrame([("index:common", '[{"key":"common:a","title":"A"},{"title":"no key"},7]')], "key string, value string")
    assert [r["key"] for r in templates.list_common(kv).collect()] == ["common:a"]


def test_bm25_is_sqlites(spark, lib):
    docs = lib.docs
    rows = docs.select("file_id", *fulltext.FIELDS).collect()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, title, file_name, path, description, content, tags_text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?,?,?,?,?,?,?)", [tuple(r) for r in rows])
    postings, stats = fulltext.build_index(docs)
    asked = [(1, "the"), (2, "of the"), (3, "ele"), (4, "10.md"), (5, "en th")]
    got = fulltext.bm25(fulltext.match(postings, fulltext.parse_queries(spark.createDataFrame(asked, "query_id int, query string"))), stats)
    ours = {(r["query_id"], r["file_id"]): r["rank"] for r in got.collect()}
    theirs = {}
    for q, text in asked:
        for i, rank in db.execute("select id, bm25(t) from t where t match ?", (" AND ".join(f'"{w}"*' for w in text.split()),)):
            theirs[q, i] = rank
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k], rel=1e-6) for k in ours)


def test_sync_twice_changes_nothing(lib):
    from foliospark.plans.queries import _tables

    first = sync.sync(_tables(lib), lib.manifest, prune=True, run_id="r2", now=now())
    again = sync.classify_entities(lib.manifest, first["ledger"])
    gone = sync.plan_deletions(lib.manifest, first["ledger"], True)
    assert sync.has_mutations(again, gone).first()["mutations"] is False
    dry = sync.sync(_tables(lib), lib.manifest, prune=True, run_id="r2", now=now(), dry_run=True)
    assert dry["nodes"].count() == lib.old_nodes.count()
    assert first["versions"].groupBy("file_id", "version_number").count().where("count > 1").count() == 0


def test_refresh_equals_rebuild(lib):
    before = {"nodes": lib.nodes, "projects": lib.projects, "files": lib.files}
    projects = lib.projects.withColumn("name", F.when(F.col("slug") == "src1", "New").otherwise(F.col("name")))
    nodes = lib.nodes.withColumn("deleted_at", F.when(F.col("sort_order") == 3, now()))
    after = {"nodes": nodes, "projects": projects, "files": lib.files}
    docs = catalog.build_search_documents(**before)
    a, b = catalog.refresh_search_documents(docs, before, after), catalog.build_search_documents(**after)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_failed_jobs_stay_failed(spark):
    kind = "dedupe_key string, operation string, project_id string, file_id string, expected_hash string, status string, attempts int, next_attempt_at timestamp, lease_expires_at timestamp, last_error string, created_at timestamp, updated_at timestamp, completed_at timestamp"
    jobs = spark.createDataFrame([(s, "upsert_file", "p", "f", "h", s, 2) + (None,) * 6 for s in ("failed", "completed", "pending", "retry")], kind)
    incoming = jobs.select(*outbox.JOB).union(spark.createDataFrame([("new", "ensure_instance", "p", None, "h")], ",".join(kind.split(", ")[:5])))
    out = {r["dedupe_key"]: r for r in outbox.merge_jobs(jobs, incoming, now()).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"failed": "failed", "completed": "pending", "pending": "pending", "retry": "retry", "new": "pending"}
    assert out["completed"]["attempts"] == 0 and out["pending"]["attempts"] == 2
    claimed = outbox.claim_jobs(jobs, jobs.where("status = 'pending'"), now())
    done = outbox.apply_outcomes(claimed, spark.createDataFrame([("pending", "error", "m" * 5000, None)], "dedupe_key string, result string, message string, permanent boolean"), now())
    r = done.where("dedupe_key = 'pending'").first()
    assert r["status"] == "retry" and r["attempts"] == 3 and len(r["last_error"]) == 4000


def test_orderings(spark):
    rows = [(1, 0, 0.9, None), (1, 1, 0.5, 0.95), (1, 2, 0.6, float("nan"))]
    df = spark.createDataFrame(rows, "query_id int, position int, score double, rerank_score double")
    order = lambda **k: [r["position"] for r in semantic.order_chunks(df, **k).orderBy("place").collect()]
    assert order(rerank=True, merged=True) == [1, 0, 2] and order(rerank=True, merged=False) == [0, 1, 2] and order(rerank=False, merged=True) == [0, 2, 1]


def test_search_requests(spark):
    rows = [("https://x/s?q=a+b&limit=5&group=chunks", None), ("https://x/s", "missing_query"), ("https://x/s?q=" + "a" * 1001, "query_too_long"), ("https://x/s?q=a&limit=x", "invalid_limit"), ("https://x/s?q=a&project=a/b", "invalid_project"), ("https://x/s?q=a&context=4", "invalid_context"), ("https://x/s?q=a&rerank=maybe", "invalid_rerank"), ("https://x/s?q=a&group=x", "invalid_group")]
    out = semantic.parse_search_requests(spark.createDataFrame(rows, "url string, want string")).collect()
    assert [r["error"] for r in out] == [w for _, w in rows]
    assert (out[0]["query"], out[0]["max_results"], out[0]["max_chunks"], out[0]["threshold"], out[0]["rerank"]) == ("a b", 5, 5, 0.4, False)


def test_bad_manifests(spark, lib):
    f = lib.manifest_files.limit(2)
    clash = lib.manifest | {"files": f.withColumn("path", F.when(F.col("doc_id") == f.first()["doc_id"], "/A.md").otherwise("/a.md")).withColumn("project_id", F.lit("project-src0")).withColumn("tags", F.array(F.lit("invalid,tag")))}
    rules = {r["rule"] for r in validate.validation_report(clash).collect()}
    assert {"duplicate_path", "tag_comma"} <= rules


def test_trees_and_manifests(spark, tmp_path):
    root = tmp_path / "content"
    (root / "one/guides").mkdir(parents=True)
    (root / "one/_project.yaml").write_text("id: p1\nslug: one\nname: One\nsync: {prune: true}\n")
    (root / "one/guides/_folder.yaml").write_text("sort: 3\n")
    (root / "one/guides/example.md").write_text("---\ntitle: Example\ntags: [a]\nvariables: [subject]\n---\n# H\n\nHello {{ reader }} {{subject}}\n\n")
    (root / "one/guides/.hidden.md").write_text("x")
    (root / "one/data.json").write_text("{bad")
    raw = trees.read_content_tree(spark, str(root))
    projects, folders = trees.read_configs(spark, str(root))
    m = normalize.build_manifest(raw, projects, folders)
    rows = {r["path"]: r for r in m["files"].collect()}
    e = rows["/guides/example.md"]
    assert e["title"] == "Example" and e["variables"] == ["subject", "reader"] and e["language"] == "zh-CN" and e["content"].endswith("{{subject}}\n") and e["parent_id"] == m["folders"].first()["id"]
    assert rows["/data.json"]["errors"] == ["invalid json"] and set(rows) == {"/guides/example.md", "/data.json"}
    trees.write_manifest(m, str(tmp_path / "m"))
    back = trees.read_manifest(spark, str(tmp_path / "m"))
    assert normalize.manifest_fingerprint(back).first() == normalize.manifest_fingerprint(m).first()
    doc = trees.render_documents(spark.createDataFrame([("T: x", "d", "body\n\n")], "title string, description string, body string")).first()["document"]
    assert doc == "---\ntitle: 'T: x'\ndescription: d\n---\n\nbody\n"
    (tmp_path / "kv.json").write_text('[{"key": "a", "value": "{}"}]')
    assert trees.read_kv(spark, str(tmp_path / "kv.json")).first()["key"] == "a"
