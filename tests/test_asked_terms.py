"""What is asked decides what moves: other postings are dropped where they are read, and a phrase is looked for once."""

from pyspark.sql import functions as F

from foliospark.operators import fulltext

FIELDS = "file_id string, " + ", ".join(f"{f} string" for f in fulltext.FIELDS)


def index(spark):
    docs = [(f"f{i}", f"title {i}", f"n{i}.md", f"/n{i}.md", None, " ".join(f"w{i * j % 997}" for j in range(200)) + " alpha beta", "") for i in range(40)]
    return [d.persist() for d in fulltext.build_index(spark.createDataFrame(docs, FIELDS))]


def test_postings_of_terms_that_nobody_asks_are_dropped_before_they_move(spark):
    postings, _ = index(spark)
    asked = spark.createDataFrame([("alpha",), ("w12",), ("absent",)], "term string")
    left = fulltext.of_terms(postings, asked)
    want = postings.join(asked, "term")
    assert left.columns == postings.columns
    assert sorted(map(str, left.join(asked, "term").select(*want.columns).collect())) == sorted(map(str, want.collect())) != []
    assert left.count() <= want.count() + 0.01 * postings.count()  # terms that share a hash with an asked one
    assert left.rdd.getNumPartitions() == postings.rdd.getNumPartitions()  # read where they stand


def test_ranks_of_phrases_that_many_queries_share(spark):
    postings, stats = index(spark)
    asked = ["alpha", "alpha", "alpha w1", "w1 alpha", "alpha-beta w", "beta-alpha", "alpha alpha", "%", "", None, "title"]
    phrases = fulltext.parse_queries(spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string"))
    terms = fulltext.dictionary(postings)
    rows = lambda df: sorted((r["query_id"], r["file_id"], round(r["rank"], 9)) for r in df.collect())
    got, want = rows(fulltext.rank(postings, phrases, stats, terms)), rows(fulltext.bm25(fulltext.match(postings, phrases, terms), stats))
    assert got == want and {q for q, *_ in got} == {0, 1, 2, 3, 4, 6, 10}
    found = fulltext.match(postings, phrases, terms).where(F.col("query_id").isin(0, 6)).groupBy("query_id", "phrase_no").count().collect()
    assert sorted(map(tuple, found)) == [(0, 0, 40), (6, 0, 40), (6, 1, 40)]
