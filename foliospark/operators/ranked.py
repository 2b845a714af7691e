"""The best k documents by BM25 without scoring every match.

Documents of about one length stand in a block. The bounds of a term in a block
are how often a document of the block has it at most, and how short such a
document is at least; the corpus's statistics are not part of them, so they hold
however those change. They bound the score of every document of a block. A
query's most promising blocks are scored first, and each round passes over the
blocks whose bound does not reach the k-th best score so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.fulltext import asked_terms, bm25, corpus_of, occurrences, of_terms, part_of_score
from foliospark.sources.shared import stored

#: Documents of a block, and how many blocks of a query are scored in each round before all others that may matter.
BLOCK_DOCS, ROUNDS = 128, (2, 16)
PHRASE = ("query_id", "phrase_no", "n_phrases")
#: Scores are compared to nine places, so a bound must be lower by more than two units of the last to count as lower.
SLACK = 2e-9


@dataclass(frozen=True)
class Blocks:
    """posted: the postings with block and length. bounds (term, block, docs, most, least). stats (file_id, length)."""

    posted: DataFrame
    bounds: DataFrame
    stats: DataFrame


def build_blocks(postings: DataFrame, doc_stats: DataFrame, block_docs: int = BLOCK_DOCS) -> Blocks:
    """Blocks of an index as fulltext.build_index gives it, in the shared folder. Postings move once, to their document's block."""
    parts = stored(doc_stats.repartitionByRange("length", "file_id").select("file_id", "length", F.spark_partition_id().alias("part")))
    at = F.row_number().over(Window.partitionBy("part").orderBy("length", "file_id")) - 1
    block = F.col("part").cast("bigint") * (1 << 32) + F.floor(at / block_docs)
    placed = parts.select("file_id", "length", block.alias("block"))
    posted = stored(postings.join(placed, "file_id"))
    # a document's postings stand together in a file, so they are added up where they are read
    each = posted.groupBy("term", "block", "file_id").agg(F.sum(F.size("positions")).alias("freq"), F.first("length").alias("length"))
    bounds = each.groupBy("term", "block").agg(F.count("*").alias("docs"), F.max("freq").alias("most"), F.min("length").alias("least"))
    return Blocks(posted, stored(bounds), doc_stats)


def _spread(blocks: Blocks, asked: DataFrame) -> DataFrame:
    """(query_id, phrase_no, n): how many documents have each phrase.

    The bounds tell it of a lone term; prefixes of several terms count ids, and
    only phrases of several tokens look at places.
    """
    by = ["query_id", "phrase_no"]
    asked = stored(asked.join(asked.groupBy(by).agg(F.count("*").alias("terms")), by))
    lone = blocks.bounds.join(asked.where("n = 1 and terms = 1"), "term").groupBy(by).agg(F.sum("docs").alias("n"))
    several = asked.where("n = 1 and terms > 1")
    wide = of_terms(blocks.posted.select("term", "file_id"), several).join(several, "term").groupBy(by).agg(F.count_distinct("file_id").alias("n"))
    runs = occurrences(blocks.posted, asked.where("n > 1").drop("terms"), PHRASE).groupBy(by).agg(F.count("*").alias("n"))
    return lone.unionByName(wide).unionByName(runs)


def _bounded(blocks: Blocks, places: DataFrame, spread: DataFrame) -> DataFrame:
    """(query_id, block, bound): blocks that may hold a document with every phrase, and a score that none of it exceeds."""
    token = places.groupBy("query_id", "phrase_no", "n_phrases", "n", "no", "block").agg(F.sum("most").alias("most"), F.min("least").alias("least"))
    phrase = token.groupBy("query_id", "phrase_no", "n_phrases", F.col("n").alias("tokens"), "block").agg(F.count("*").alias("found"), F.min("most").alias("most"), F.max("least").alias("least"))
    rows = phrase.where("found = tokens").join(spread, ["query_id", "phrase_no"]).crossJoin(F.broadcast(corpus_of(blocks.stats)))  # one row
    whole = rows.groupBy("query_id", "n_phrases", "block").agg(F.count("*").alias("found"), F.sum(part_of_score("most", "least")).alias("bound"))
    return whole.where("found = n_phrases").select("query_id", "block", "bound")


def best(blocks: Blocks, phrases: DataFrame, terms: DataFrame, k: int, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The k best (query_id, place, file_id, rank) of each query, and (query_id, block, round) of the blocks scored.

    Ranks are those of fulltext.bm25, compared to nine places, then by file id:
    nothing that belongs to the best is lost. phrases are as parse_queries gives
    them, terms is the index's dictionary. Queries without a match give no row.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = stored(asked_terms(phrases, terms))
    spread = stored(_spread(blocks, asked))
    places = stored(of_terms(blocks.bounds, asked).join(asked, "term"))
    left = stored(_bounded(blocks, places, spread))
    order = Window.partitionBy("query_id").orderBy(F.round("rank", 9), "file_id")
    first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    found, scored = None, None
    for number, size in enumerate([*rounds, None]):
        if found is not None:
            worst = found.groupBy("query_id").agg(F.count("*").alias("held"), F.max("rank").alias("worst")).where(F.col("held") >= k)
            left = left.join(scored, ["query_id", "block"], "left_anti").join(worst, "query_id", "left")
            left = left.where(F.col("worst").isNull() | (F.col("bound") >= -F.col("worst") - SLACK)).select("query_id", "block", "bound")
        now = left if size is None else left.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= size)
        chosen = stored(now.select("query_id", "block", F.lit(number).alias("round")))
        here = stored(places.join(chosen, ["query_id", "block"], "left_semi").drop("docs", "most", "least"))
        ranks = bm25(occurrences(blocks.posted, here, PHRASE, ("term", "block")), blocks.stats, spread)
        ranks = ranks if found is None else found.select("query_id", "file_id", "rank").unionByName(ranks)
        found = stored(ranks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
        scored = chosen if scored is None else scored.unionByName(chosen)
    return found.select("query_id", "place", "file_id", "rank"), scored
