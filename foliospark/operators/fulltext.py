"""Full-text search in batches: structured filters, index, prefix phrases, BM25, tiers."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.catalog import visible
from foliospark.sources.trees import stored

FIELDS = ("title", "file_name", "path", "description", "content", "tags_text")
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
NO_RANK = 999999.0
DEFAULT_LIMIT, MOST_RESULTS = 10, 50


def filter_documents(docs: DataFrame, *, project: str | None = None, directory: str | None = None, recursive: bool = True, language: str | None = None, role: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """The structured filters; unset ones let all pass. A recursive directory is a path prefix with live wildcards."""
    low = lambda s: s.translate(str.maketrans(T.UPPER, T.LOWER))
    if project and project.strip():
        docs = docs.where((T.ascii_lower("project_id") == low(project.strip())) | (T.ascii_lower("project_slug") == low(project.strip())))
    folder = "/" + directory.strip().replace("\\", "/").strip("/") if directory else "/"
    if folder != "/":
        direct = F.col("parent_path") == folder
        docs = docs.where(direct | T.ascii_lower("path").like(low(folder).replace("\\", "\\\\") + "/%") if recursive else direct)
    if language and language.strip():
        docs = docs.where(T.ascii_lower("language") == low(language.strip()))
    if role:
        docs = docs.where(F.col("role") == role)
    for tag in (t.strip() for t in tags):
        if tag:
            docs = docs.where(F.concat(F.lit(","), T.ascii_lower("tags_text"), F.lit(",")).contains(f",{low(tag)},"))
    return docs


TOKEN_EDGE = r"[^\p{L}\p{N}\p{Co}]+"


def tokens(c: Column | str) -> Column:
    """Runs of letters and numbers, lower-cased, without diacritics; none for null."""
    return F.filter(F.split(T.folded(F.coalesce(T.col(c), F.lit(""))), TOKEN_EDGE), lambda t: t != "")


_WORDS, _ASCII_WORDS = regex.compile(r"[\p{L}\p{N}\p{Co}]+"), re.compile("[a-z0-9]+")


def _terms(text: str | None) -> list[str]:
    """tokens() of one text."""
    low = T.fold(text or "")
    return (_ASCII_WORDS if low.isascii() else _WORDS).findall(low)


def _posted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The fields of each document -> its distinct terms by field with their places, grouped where the document is read."""
    for batch in batches:
        terms: list[str] = []
        fields: list[int] = []
        counts, places, sizes = [0], [0], array("i")
        for document in zip(*(c.to_pylist() for c in batch), strict=True):
            for f, text in enumerate(document):
                found: dict[str, list[int]] = {}
                for at, term in enumerate(_terms(text)):
                    found.setdefault(term, []).append(at)
                terms += found
                fields += [f] * len(found)
                for at in found.values():
                    sizes.extend(at)
                    places.append(len(sizes))
            counts.append(len(terms))
        positions = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.frombuffer(sizes, dtype=np.int32) if sizes else [], pa.int32()))
        posted = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(fields, pa.int32()), positions], names=["term", "field", "positions"])
        yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), posted)


def _lengths(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([sum(len(_terms(text)) for text in document) for document in zip(*(c.to_pylist() for c in batch), strict=True)], pa.int64())


def build_index(docs: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Postings (term, file_id, field, positions) and doc_stats (file_id, length).

    A document's fields are folded, split and grouped in one step where it is
    read: one row for each distinct term, field and document is all that moves.
    """
    fields = [F.col(f) for f in FIELDS]
    posted = F.arrow_udf(_posted, "array<struct<term:string,field:int,positions:array<int>>>")(*fields)
    postings = docs.select(F.col(key).alias("file_id"), posted.alias("posted")).select("file_id", F.explode("posted").alias("t")).select("t.term", "file_id", "t.field", "t.positions")
    return postings, docs.select(F.col(key).alias("file_id"), F.arrow_udf(_lengths, "bigint")(*fields).alias("length"))


def dictionary(postings: DataFrame) -> DataFrame:
    """(range, term): the distinct terms in ranges of their order, in the shared folder; a range is one task's share."""
    ordered = postings.select("term").distinct().repartitionByRange("term").withColumn("range", F.spark_partition_id())
    return stored(ordered.select("range", "term"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) -> (query_id, phrase_no, n_phrases, tokens): every word is a phrase whose last token is a prefix."""
    words = F.split(T.strip(T.nfkc(F.coalesce("query", F.lit("")))), r"(?U)\s+")
    cleaned = F.filter(F.transform(words, lambda w: T.strip(F.regexp_replace(w, r'["*:^(){}\[\]]', ""))), lambda w: w != "")
    rows = queries.select("query_id", cleaned.alias("words")).select("query_id", F.size("words").alias("n_phrases"), F.posexplode("words").alias("phrase_no", "word"))
    return rows.select("query_id", "phrase_no", "n_phrases", tokens("word").alias("tokens"))


def widen(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (token, last and more) -> with term, a row for each term that is the token or, where last, begins with it.

    terms is a dictionary: what begins with a token is one interval of it, so
    a token meets only the ranges that its interval touches.
    """
    ends = terms.groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high"))  # a row for each range
    high = F.when(F.col("last"), F.concat("token", F.lit("\U0010ffff"))).otherwise(F.col("token"))
    sent = wanted.join(F.broadcast(ends), (F.col("token") <= F.col("high")) & (high >= F.col("low"))).drop("low", "high")
    fits = (F.col("term") == F.col("token")) | (F.col("last") & F.col("term").startswith(F.col("token")))
    return terms.join(sent, "range").where(fits).drop("range")


#: So many hashes of asked terms, at most, go to the tasks that read postings.
SKETCH = 1 << 18


def of_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings whose terms have the hash of an asked one: all that a join on the term finds, and few that it drops.

    The others are dropped where they are read, so that what moves follows what is asked, not the corpus.
    """
    hashed = F.pmod(F.xxhash64("term"), F.lit(SKETCH)).alias("hash")
    return postings.select("*", hashed).join(F.broadcast(asked.select(hashed).distinct()), "hash", "left_semi").drop("hash")  # SKETCH rows at most


def _named(phrases: DataFrame) -> DataFrame:
    """phrases, stored, with phrase: the tokens as one text."""
    return stored(phrases.withColumn("phrase", F.array_join("tokens", " ")))


def _found(postings: DataFrame, named: DataFrame, terms: DataFrame | None) -> DataFrame:
    """(phrase, file_id, freq): what many queries ask is looked for once."""
    asked = stored(asked_terms(named.select("phrase", "tokens").distinct(), dictionary(postings) if terms is None else terms))
    return occurrences(postings, asked, ["phrase"])


def match(postings: DataFrame, phrases: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, phrase_no, n_phrases, file_id, freq): occurrences of each phrase in each document.

    Prefixes are widened on the dictionary (terms, or one made of the postings)
    and only then meet the postings. A phrase without a token has no
    occurrence, so its query matches nothing.
    """
    named = _named(phrases)
    return _found(postings, named, terms).join(named.drop("tokens"), "phrase").select("query_id", "phrase_no", "n_phrases", "file_id", "freq")


def asked_terms(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """Columns of phrases but tokens, and (n, no, term): the terms that may stand for token `no` of a phrase's n tokens."""
    own = [c for c in phrases.columns if c != "tokens"]
    wanted = phrases.select(*own, F.size("tokens").alias("n"), F.posexplode("tokens").alias("no", "token"))
    return widen(terms, wanted.withColumn("last", F.col("no") == F.col("n") - 1)).drop("token", "last")


def occurrences(postings: DataFrame, asked: DataFrame, by: Sequence[str], on: Sequence[str] = ("term",)) -> DataFrame:
    """Postings, and as which places of phrases (by) their terms may stand -> (*by, file_id, freq). asked is read more than once."""
    one, more = asked.where("n = 1"), asked.where("n > 1")
    single = of_terms(postings.select(*on, "file_id", F.size("positions").alias("freq")), one).join(one, list(on)).groupBy(*by, "file_id").agg(F.sum("freq").alias("freq"))
    runs = of_terms(postings.select(*on, "file_id", "field", "positions"), more).join(more, list(on)).select(*by, "n", "file_id", "field", "no", F.explode("positions").alias("at"))
    runs = runs.groupBy(*by, "n", "file_id", "field", (F.col("at") - F.col("no")).alias("start")).agg(F.count_distinct("no").alias("found")).where("found = n")
    return single.unionByName(runs.groupBy(*by, "file_id").agg(F.count("*").alias("freq")))


def corpus_of(doc_stats: DataFrame) -> DataFrame:
    """One row (docs, mean)."""
    return doc_stats.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))


def part_of_score(freq: str, length: str) -> Column:
    """What a phrase that n documents have adds to the score; more the more frequent it is and the shorter the document."""
    raw = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    return idf * F.col(freq) * (K1 + 1) / (F.col(freq) + K1 * (1 - B + B * F.col(length) / F.col("mean")))


def bm25(matches: DataFrame, doc_stats: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """(query_id, file_id, rank) of documents with every phrase; lower is better. Statistics are those of the whole corpus.

    spread (query_id, phrase_no, n), how many documents have each phrase, is
    needed where matches are not all there are.
    """
    corpus = corpus_of(doc_stats)
    spread = matches.groupBy("query_id", "phrase_no").agg(F.count("*").alias("n")) if spread is None else spread
    rows = matches.join(spread, ["query_id", "phrase_no"]).join(doc_stats, "file_id").crossJoin(F.broadcast(corpus))  # one row
    whole = rows.withColumn("part", part_of_score("freq", "length")).groupBy("query_id", "file_id", "n_phrases").agg(F.count("*").alias("found"), F.sum("part").alias("score"))
    return whole.where("found = n_phrases").select("query_id", "file_id", (-F.col("score")).alias("rank"))


def rank(postings: DataFrame, phrases: DataFrame, doc_stats: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """bm25 of match: (query_id, file_id, rank).

    A phrase's part of a document's score is made once, whatever the number of
    queries that ask it, and moves by document only.
    """
    named = _named(phrases)
    found = stored(_found(postings, named, terms))
    spread = found.groupBy("phrase").agg(F.count("*").alias("n"))
    asked = stored(named.select("query_id", "n_phrases", "phrase").join(spread, "phrase"))
    rows = found.join(doc_stats, "file_id").join(asked, "phrase").crossJoin(F.broadcast(corpus_of(doc_stats)))  # one row
    whole = rows.withColumn("part", part_of_score("freq", "length")).groupBy("query_id", "file_id", "n_phrases").agg(F.count("*").alias("found"), F.sum("part").alias("score"))
    return whole.where("found = n_phrases").select("query_id", "file_id", (-F.col("score")).alias("rank"))


def _asked(queries: DataFrame) -> DataFrame:
    """query_id, and the query as it is looked for in folded fields: with a live % or _ as a pattern, else as it is."""
    low = F.lower(F.col("query"))
    pattern = F.concat(F.lit("%"), F.replace(low, F.lit("\\"), F.lit("\\\\")), F.lit("%"))  # the engine's escape character is doubled
    return queries.select("query_id", low.alias("low"), pattern.alias("pattern"), F.col("query").rlike("[%_]").alias("wild"))


def _folded(docs: DataFrame, *others: str) -> DataFrame:
    """file_id and the fields as substrings are looked for in them: each document is folded once, whatever the queries."""
    return docs.select("file_id", *others, *(F.coalesce(T.ascii_lower(f), F.lit("")).alias(f"low_{f}") for f in FIELDS))


def _holds(field: str) -> Column:
    return F.when(F.col("wild"), F.like(F.col(f"low_{field}"), F.col("pattern"))).otherwise(F.col(f"low_{field}").contains(F.col("low")))


def _grams(term: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - size + 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(size)))


def substring_candidates(postings: DataFrame, docs: DataFrame, queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, file_id), all pairs that may hold the query as a substring, and more.

    A document that holds a query has a term that holds the query's longest
    token, so the distinct terms tell, found by the token's first letters (three
    at most). Only a query without letters and numbers asks every document.
    """
    all_tokens = tokens("query")
    longest = F.array_max(F.transform(all_tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("token"))))["token"]
    asked = queries.where("query is not null").select("query_id", longest.alias("token"))
    keyed = asked.where("token is not null").withColumn("gram", F.substring("token", 1, 3))
    kinds = F.array_distinct(F.concat(*(_grams(F.col("term"), n) for n in (1, 2, 3))))
    known = postings.select("term").distinct() if terms is None else terms
    terms = known.select("term", F.explode(kinds).alias("gram"))
    held = stored(terms.join(keyed.select("token", "gram").distinct(), "gram").where(F.col("term").contains(F.col("token"))).select("token", "term").distinct())
    by_token = of_terms(postings.select("term", "file_id"), held).join(held, "term").select("token", "file_id").distinct()
    by_term = by_token.join(asked.where("token is not null"), "token").select("query_id", "file_id")
    return by_term.unionByName(asked.where("token is null").select("query_id").crossJoin(docs.select("file_id")))


def substring_match(docs: DataFrame, postings: DataFrame, queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, file_id, in_title) of documents with the query in a field; postings are those of docs, or of more."""
    pairs = substring_candidates(postings, docs, queries, terms)
    rows = pairs.join(_folded(docs), "file_id").join(_asked(queries), "query_id")
    return rows.where(_any_field()).select("query_id", "file_id", _holds("title").alias("in_title"))


def _any_field() -> Column:
    """Short fields first."""
    found = _holds("title")
    for f in ("file_name", "path", "description", "tags_text", "content"):
        found = found | _holds(f)
    return found


def search(docs: DataFrame, postings: DataFrame, doc_stats: DataFrame, queries: DataFrame, access: Sequence[str], limit: int | None = None, requested: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """queries (query_id, query) -> (query_id, place, file_id, tier, score): the best `limit` for each.

    Tiers: exact title, exact name, exact path, title contains, text match,
    substring alone; then rank (to nine places), newest, file id. Filter docs beforehand; the
    index stays that of the corpus; terms is its dictionary. score is null where only a substring hit.
    """
    limit = max(1, min(MOST_RESULTS, DEFAULT_LIMIT if limit is None else int(limit)))
    asked = stored(queries.select("query_id", T.blank_to_null(T.nfkc("query")).alias("query")).where("query is not null"))  # read many times
    terms = dictionary(postings) if terms is None else terms
    seen = visible(docs, access, requested)
    ranked = rank(postings, parse_queries(asked), doc_stats, terms)
    both = substring_candidates(postings, seen, asked, terms).join(ranked, ["query_id", "file_id"], "full")
    facts = _folded(seen, "updated_at")
    exact = _asked(asked).join(asked.select("query_id", T.ascii_lower("query").alias("exact"), T.ascii_lower(T.plain_path("query")).alias("as_path")), "query_id")
    rows = both.join(facts, "file_id").join(exact, "query_id").where(F.col("rank").isNotNull() | _any_field())
    tier = F.when(F.col("low_title") == F.col("exact"), 0).when(F.col("low_file_name") == F.col("exact"), 1).when(F.col("low_path") == F.col("as_path"), 2).when(_holds("title"), 3).when(F.col("rank").isNotNull(), 4).otherwise(5)
    order = Window.partitionBy("query_id").orderBy("tier", F.round(F.coalesce("rank", F.lit(NO_RANK)), 9), F.desc("updated_at"), "file_id")
    rows = rows.select("query_id", "file_id", "rank", "updated_at", tier.alias("tier"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "file_id", "tier", F.col("rank").alias("score"))


def browse(docs: DataFrame, access: Sequence[str], limit: int | None = None, requested: str | None = None) -> DataFrame:
    """Without a query: the newest documents."""
    limit = max(1, min(MOST_RESULTS, DEFAULT_LIMIT if limit is None else int(limit)))
    return visible(docs, access, requested).orderBy(F.desc("updated_at"), "file_id").limit(limit).select("file_id", "title", "updated_at")
