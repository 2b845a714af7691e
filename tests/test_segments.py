"""The index in segments equals one built anew, writes only what changed, and forgets the dead when merged."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import catalog, fulltext, segments
from foliospark.plans.library import Library
from foliospark.sources.versions import VersionedStore

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(str(tuple(r)) for r in df.collect())


def equal_to_new(snapshot, docs):
    postings, stats = segments.live(snapshot)
    new, lengths = fulltext.build_index(docs)
    return plain(postings) == plain(new) and plain(stats) == plain(lengths)


@pytest.fixture(scope="module")
def docs(spark):
    lib = Library(spark, SF)
    return lib.docs.withColumn("content", F.substring("content", 1, 400)).persist()


def test_updates_write_what_changed_and_equal_a_new_index(spark, docs, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    n = F.regexp_extract("file_id", "([0-9]+)", 1).cast("int")
    first = docs.where(n % 9 != 0)
    assert equal_to_new(segments.update(store, first), first)
    assert segments.update(store, first).version == 1  # nothing differs
    states = [docs.withColumn("title", F.when(n % 10 == 3, "another title").otherwise(F.col("title"))).where(n % 10 != 4), docs.where(n % 10 != 5), docs.withColumn("tags_text", F.when(n == 7, F.lit(None)).otherwise(F.col("tags_text"))).where(n % 10 != 3)]
    before = first
    for state in states:
        got = segments.update(store, state)
        number = segments.segments(got)[-1]
        old, new = ({r["file_id"]: tuple(r[f] for f in fulltext.FIELDS) for r in d.collect()} for d in (before, state))
        changed = {i for i in new if new[i] != old.get(i)}
        assert {r["file_id"] for r in got.table(f"postings-{number}").collect()} == changed
        assert {r["file_id"] for r in got.table(f"removed-{number}").collect()} == {i for i in old if new.get(i) != old[i]}
        assert equal_to_new(got, state)
        before = state
    queries = spark.createDataFrame([(1, "another title"), (2, "th"), (3, "e"), (4, "%")], "query_id bigint, query string")
    want = plain(fulltext.search(state, *fulltext.build_index(state), queries, catalog.SIGNED_IN, 20))
    assert plain(fulltext.search(state, *segments.live(got), queries, catalog.SIGNED_IN, 20)) == want
    # of four segments one is large: the small ones are put together, then all
    part = segments.merge(store, most=2)
    assert len(segments.segments(part)) < 4 and equal_to_new(part, state)
    assert equal_to_new(segments.update(store, docs), docs)
    whole = segments.merge(store, most=1)
    assert len(segments.segments(whole)) == 1 and equal_to_new(whole, docs)
    assert whole.under("removed-").count() == 0 and whole.under("documents-").count() == docs.count()
    assert segments.merge(store).version == whole.version


def test_an_index_of_nothing(spark, docs, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert equal_to_new(segments.update(store, docs.limit(0)), docs.limit(0))
    assert equal_to_new(segments.update(store, docs), docs)
    assert equal_to_new(segments.update(store, docs.limit(0)), docs.limit(0))


def test_terms_and_their_prefixes_by_brute_force(spark, tmp_path):
    words = ["a", "ab", "abc", "abd", "b", "ba", "z", "zz", "é", "éa", "中", "中文", "0", "9z", "ab\U0001f600"]
    postings = spark.createDataFrame([(w, "f") for w in words], "term string, file_id string").repartition(5)
    asked = [(i, t, last) for i, (t, last) in enumerate((t, last) for t in [*words, "q", "abz", ""] for last in (True, False))]
    wanted = spark.createDataFrame(asked, "id int, token string, last boolean")
    got = sorted((r["id"], r["term"]) for r in fulltext.widen(fulltext.dictionary(postings), wanted).collect())
    assert got == sorted((i, w) for i, t, last in asked for w in words if w == t or last and w.startswith(t))
