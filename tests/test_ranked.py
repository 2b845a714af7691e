"""The best by blocks are those of the whole ranking, and blocks are passed over."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.operators import fulltext, ranked

FIELDS = "file_id string, " + ", ".join(f"{f} string" for f in fulltext.FIELDS)


def library(n):
    """Texts of some frequent and many rare words; the few short ones that repeat a word score best for it."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        size = 4 if i % 40 == 0 else rng.randrange(20, 200)
        text = " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=size))
        rows.append((f"f{i:04d}", "same title" if i % 3 else f"rare{i}", f"n{i}.md", f"/n{i}.md", None, text + (" alpha beta" if i % 7 == 0 else ""), ""))
    return rows


def whole(postings, stats, queries, terms, k):
    ranks = fulltext.bm25(fulltext.match(postings, fulltext.parse_queries(queries), terms), stats)
    order = Window.partitionBy("query_id").orderBy(F.round("rank", 9), "file_id")
    rows = ranks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return sorted((r["query_id"], r["place"], r["file_id"], round(r["rank"], 8)) for r in rows.collect())


@pytest.mark.parametrize("k", [3, 50])
def test_best_equal_the_whole_ranking(spark, k):
    docs = spark.createDataFrame(library(600), FIELDS)
    postings, stats = (d.persist() for d in fulltext.build_index(docs))
    asked = ["w40", "w4", "w1 w2", "alpha-beta", "w", "rare0", "same-ti", "w59 alpha", "beta-alpha", "%", "", None, "nothing", "w3 nothing", "md w5"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    terms = fulltext.dictionary(postings)
    blocks = ranked.build_blocks(postings, stats, block_docs=8)
    found, scored = ranked.best(blocks, fulltext.parse_queries(queries), terms, k)
    got = sorted((r["query_id"], r["place"], r["file_id"], round(r["rank"], 8)) for r in found.collect())
    assert got == whole(postings, stats, queries, terms, k)
    rows = scored.collect()
    assert len({(r["query_id"], r["block"]) for r in rows}) == len(rows)  # none twice
    every = blocks.posted.select("block").distinct().count()
    by_query = {q: sum(r["query_id"] == q for r in rows) for q in range(len(asked))}
    assert every >= 75 and not any(by_query[q] for q in (9, 10, 11, 12, 13))
    if k == 3:
        for q, term in ((0, "w40"), (3, "beta"), (7, "alpha")):
            having = blocks.bounds.where(f"term = '{term}'").count()
            assert having > 45 and 0 < by_query[q] < 0.5 * having


def test_nothing_and_ties(spark):
    empty = spark.createDataFrame([], FIELDS)
    queries = spark.createDataFrame([(1, "same")], "query_id bigint, query string")
    postings, stats = fulltext.build_index(empty)
    found, scored = ranked.best(ranked.build_blocks(postings, stats), fulltext.parse_queries(queries), fulltext.dictionary(postings), 3)
    assert found.count() == 0 and scored.count() == 0
    docs = spark.createDataFrame([(f"f{i:02d}", "same", f"{i % 2}", "/p", None, "", "") for i in range(40)], FIELDS)
    postings, stats = fulltext.build_index(docs)
    found, _ = ranked.best(ranked.build_blocks(postings, stats, block_docs=4), fulltext.parse_queries(queries), fulltext.dictionary(postings), 3)
    assert [(r["place"], r["file_id"]) for r in found.orderBy("place").collect()] == [(1, "f00"), (2, "f01"), (3, "f02")]
    with pytest.raises(ValueError):
        ranked.best(ranked.build_blocks(postings, stats), fulltext.parse_queries(queries), fulltext.dictionary(postings), 0)
