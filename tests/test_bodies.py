"""Bodies without a text: what stays of them, and the queries over them against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.operators import normalize
from foliospark.plans import queries as library

TEXTS = ["", " ", " \n\t\n", "a", "a\n\n", "\n\n b \n", None]


def test_a_blank_body_is_a_newline_and_an_empty_one_empty(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "body string").select(normalize.normalize_body("body").alias("made")).collect()
    assert [r["made"] for r in rows] == ["", "\n", "\n", "a\n", "a\n", "\n\n b\n", None]


def against_sql(spark, folder, name, texts):
    """The query and its SQL over documents with these texts, each under an id that 5 divides and one that it doesn't."""
    docs = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(t for t in texts for _ in range(6))]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = library.queries()[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = db.execute(library.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want


def test_n13_of_blank_texts(spark, tmp_path):
    against_sql(spark, tmp_path, "n13_body", TEXTS)


def test_n14_of_blank_texts(spark, tmp_path):
    against_sql(spark, tmp_path, "n14_build_manifest", [t for t in TEXTS if t is not None])
