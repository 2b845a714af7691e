"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import re

import duckdb
import pytest

from foliospark.plans import queries as library

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def _links(got):
    """Every link of the pages' navigation, found by a pattern of its own."""
    pages = got.sparkSession.read.parquet(f"{SF}/pages.parquet").collect()
    want = sum(len(re.findall(r"<a\s[^>]*href=\"[^\"]+\"[^>]*>\s*[^<\s]", nav)) for p in pages for nav in re.findall(r"(?s)<nav.*?</nav>", p["html"] or ""))
    assert got.count() == want


def _headers(got):
    rows = {r["doc_id"]: r for r in got.collect()}
    for d in got.sparkSession.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source").collect():
        r = rows.pop(d["doc_id"])
        assert r["title"] == d["lang"] and r["sort"] == d["doc_id"] and r["tags"] == ["a", "b"]
        if d["doc_id"] % 2:
            assert r["errors"] == [] and r["metadata_json"] == f'{{"extra":{{"a":"{d["source"]}","z":1}}}}'
        else:
            assert r["errors"] == ["metadata: not JSON"]  # dates
    assert not rows


def _markdown(got):
    """Pages with an article, a heading and a paragraph give Markdown that starts with the title; others give a reason."""
    pages = {p["page_id"]: p["html"] or "" for p in got.sparkSession.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = got.collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        whole = all(f"<{t}" in pages[r["page_id"]] for t in ("article", "h1", "p"))
        if r["error"] is None:
            assert whole and r["markdown"].startswith(f"# {r['title']}\n\n") and "<script" not in r["markdown"]
        else:
            assert r["markdown"] is None and (not whole or r["error"] != "missing markers")


def _errors(got):
    pages = got.sparkSession.read.parquet(f"{SF}/pages.parquet").count()
    assert 0 < got.count() and got.count() >= 2 * pages // 5  # two of five pages are broken


EXPECTED = {"c1_nav_links": _links, "n2_header": _headers, "c6_markdown": _markdown, "c8_errors": _errors}


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, db, name):
    got = library.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if (sql := library.oracle_sql().get(name)) is None:
        EXPECTED[name](got)
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
