"""The corpus pipeline over documents.

Each stage takes what its predecessor kept, whole, and takes part columns by
name only where it needs them: all others, whatever their names, go along in
one struct. SQL can't express the stages: tests hold them against brute force.

What holds for every stage: an empty table gives an empty one; rows that repeat
are decided alike and each stays or goes; a null text counts as empty, and a
null id or source is a value of its own; texts of any length are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import mixing, near_copies, sentencepiece_codec, suffix_dedup, toxicity
from foliospark.llm.common import packed, small_batches, stored, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, does not reject; columns as they were.

    Labels of ids that docs has not teach nothing; without labels of both
    kinds nothing is rejected, unless all are toxic.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(packed(docs, "text"), model).where("predicted = 0").select(*unpacked(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles overlap by 0.8 or more; columns as they were.

    The one with the smallest id stays, and of different texts under that id
    one. Rows that repeat it stay with it. Wordless texts are one group.
    """
    small_batches(spark)
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; documents of which nothing is left go.

    Of equal passages the one in the smallest id stays. n_chars, where docs has
    it, is counted anew for texts that lost something; other columns stay. Null
    and short texts lose nothing and stay.
    """
    small_batches(spark)
    left = suffix_dedup.strip_repeats(packed(docs, "doc_id", "text"), as_text=True)
    lost = F.size("removed") > 0
    made = {"text": F.when(lost, F.col("kept")).otherwise(F.col("text"))}
    made["n_chars"] = F.when(lost, F.length("kept").cast("bigint")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None
    rows = left.where(~lost | (F.col("kept") != ""))
    return rows.select(*(made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, whole documents only; columns as they were.

    A null source is a source of its own. Empty texts have no words to take and go.
    """
    return mixing.mix(packed(docs, "doc_id", "text", "source")).select(*unpacked(docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with pieces (their SentencePiece ids) and round_trip: whether decoding them gives the text back.

    Columns of these two names give way; all others stay. A null text has no pieces.
    """
    small_batches(spark)
    done = sentencepiece_codec.encode_and_decode(packed(docs, "text"), sentencepiece_codec.default_model())
    same = F.col("decoded") == F.coalesce(F.replace("text", F.lit(sentencepiece_codec.SPACE), F.lit(" ")), F.lit(""))
    own = [c for c in docs.columns if c not in ("pieces", "round_trip")]
    return done.select(*unpacked(own), "pieces", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each leaves is stored in the shared folder, as its successors read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
