"""The pipeline's stages against brute force on the smallest tables."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_operators import MODEL, WORDS, brute_repeats, brute_targets, odd_rows

import corpus_pipeline
from foliospark.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage leaves, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "sentencepiece"]
    assert all(df.columns == kept[0].columns for df in kept[:5])


def test_toxic_documents_go(spark, kept):
    before, after = rows(kept[0]), rows(kept[1])
    model = toxicity.fit(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    for i, r in before.items():
        data = np.frombuffer(r["text"].encode(), dtype=np.uint8)
        assert (i in after) == (model.scores(data, np.array([0, len(data)]))[0] < 0.5)


def test_one_of_each_group_stays(kept):
    before, after = rows(kept[1]), rows(kept[2])
    label = brute_groups({i: r["text"] for i, r in before.items()})
    assert set(after) == {i for i in label if label[i] == i}


def test_repeats_are_cut(kept):
    before, after = rows(kept[2]), rows(kept[3])
    for i, (left, runs) in brute_repeats([(i, r["text"]) for i, r in before.items()]).items():
        text = left.decode("utf-8", "ignore")
        if runs and not text:
            assert i not in after
        else:
            assert after[i]["text"] == text and after[i]["n_chars"] == (len(text) if runs else before[i]["n_chars"])


def test_the_mix_meets_targets_with_whole_documents(kept):
    before, after = rows(kept[3]), kept[4].collect()
    size = {i: len(WORDS.findall(r["text"])) for i, r in before.items()}
    sizes, taken, biggest, times = {}, {}, {}, {}
    for i, r in before.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), size[i])
    for r in after:
        assert r["text"] == before[r["doc_id"]]["text"]
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    for s, want in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= biggest[s]


def test_pieces_are_the_librarys(kept):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for r in kept[5].collect():
        assert r["pieces"] == lib.encode(r["text"]) and r["round_trip"]


def test_run_chains_the_stages(spark, kept):
    count = lambda df: sorted((r["doc_id"], len(r["pieces"])) for r in df.select("doc_id", "pieces").collect())
    assert count(corpus_pipeline.run(spark, SF)) == count(kept[5])


CLASHES = ("a.b", "row", "made", "made_", "score", "predicted", "toxic", "spot", "labelled", "kept_id", "kept_copy", "copy", "prints", "words", "removed", "kept", "key", "place", "shard", "turn", "size", "taken", "source_size", "decoded")


@pytest.mark.parametrize("number", range(5))
def test_stages_keep_columns_of_any_name(spark, number):
    """Odd rows with clashing columns: the stage's rows are those without such columns, and each column keeps its values."""
    plain = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    wide = plain
    for c in CLASHES:
        wide = wide.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, wide, SF)
    assert [c for c in out.columns if c not in ("pieces", "round_trip")] == wide.columns
    got = out.collect()
    assert all(r[c] == f"{c}:{'?' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASHES)
    less = stage(spark, plain, SF).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["source"]), str(r["n_chars"]))
    assert sorted(map(key, got)) == sorted(map(key, less)) and got
    bare = stage(spark, plain.drop("n_chars", "lang"), SF)
    assert bare.count() == len(less) and "n_chars" not in bare.columns


@pytest.mark.parametrize("number", range(5))
def test_stages_on_empty_and_null_tables(spark, number):
    stage, schema = corpus_pipeline.STAGES[number][1], "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    nulls = stage(spark, spark.createDataFrame([(None, None, None, None, None)] * 2, schema), SF)
    assert nulls.count() == (0 if number == 3 else 2)
