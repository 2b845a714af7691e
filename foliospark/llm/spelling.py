"""Spelling variants of words, by permuterm rotations.

A word with a terminator has a rotation for each of its places. A rotation
that ends in the character to be edited shares all before it with the same
rotation of every word that has another character there (a replacement), and
that part alone is a whole rotation of the word without it (a deletion, and
seen from there an insertion). So rotations are sorted over all tasks by the
part before the edited character, equal parts stand together, and one scan
finds every neighbour. A group holds a word for each character at most, and
each member is given the number of its neighbours there and the best of them,
never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import SQL_CRC_TABLE, give_back, name, reliable, sql_crc32, stored, table

RUN = re.compile("[a-zÀ-ÿ]+")  # lower-cased already
TERMINATOR = "\x00"
LEAST_LENGTH, LEAST_TIMES, RATIO = 6, 5, 5
#: One run in so many of a document loses a character.
MISPELT = 199
REMEMBERED, SLICE = 300_000, 1 << 20
FOUND = "word string, k bigint, form_n bigint, form string"


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that cut no run."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and RUN.match(text, end):
            end = RUN.match(text, end).end()
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", mispelt: int = MISPELT, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): how often each word of at least `least` characters stands in all texts.

    Words are runs of letters up to U+00FF, A-Z lower-cased. Where the crc32 of
    `<key>:<run>` is divisible by mispelt (0: nowhere), the run loses the
    character at that crc32 modulo its length. A null key is an empty one, null
    texts have no words, repeated rows count each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for k, value in zip(batch.column("k"), batch.column("text"), strict=True):
                start = zlib.crc32((k.as_py() + ":").encode())
                for part in _slices((value.as_py() or b"").lower().decode("utf-8", "replace")):
                    for run, n in Counter(RUN.findall(part)).items():
                        if mispelt and len(run) >= least:
                            h = zlib.crc32(run.encode(), start)
                            if h % mispelt == 0:
                                h %= len(run)
                                run = run[:h] + run[h + 1 :]
                        if len(run) >= least:
                            found[run] += n
                    if len(found) > REMEMBERED:
                        yield out(found)
                        found = Counter()
        yield out(found)
        give_back()

    def out(found: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.coalesce(name(key).cast("string"), F.lit("")).alias("k"), name(text).cast("binary").alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(word, n) -> (part, edited, first, word, n), word and n in full.

    edited: the rotation is part and then a character of the word; first: that
    character differs from the one before it in the word, so that of a run of
    equal characters one stands for all when it is left out. Otherwise part is
    the whole rotation.
    """
    turned = F.concat("word", F.lit(TERMINATOR), "word", F.lit(TERMINATOR))
    size = F.length("word")
    turns = words.select("word", "n", size.alias("size"), turned.alias("turned"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    part = lambda less: F.substring("turned", F.col("i") + 1, F.col("size") + 1 - less)
    char = lambda at: F.substring("word", at, F.lit(1))
    alone = (F.col("i") < 2) | (char(F.col("i")) != char(F.col("i") - 1))
    kinds = F.array(F.struct(part(0).alias("part"), F.lit(False).alias("edited"), F.lit(True).alias("first")), F.struct(part(1).alias("part"), F.lit(True).alias("edited"), alone.alias("first")))
    # no character is edited where the rotation ends in the terminator
    kinds = F.when(F.col("i") > 0, kinds).otherwise(F.slice(kinds, 1, 1))
    return turns.select("word", "n", F.explode(kinds).alias("k")).select("k.part", "k.edited", "k.first", "word", "n")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations -> what each word finds among those that share its part."""
    held: list[pa.RecordBatch] = []

    def groups(rows: pa.Table) -> pa.RecordBatch:
        part = rows.column("part").combine_chunks()
        new = np.concatenate(([True], pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        many = np.repeat(sizes > 1, sizes)  # most parts are a word's own
        kept = rows.filter(pa.array(many))
        sizes = sizes[sizes > 1]
        words, n, edited, first = (kept.column(c).to_pylist() for c in ("word", "n", "edited", "first"))
        made: list[tuple[str, int, int, str]] = []
        a = 0
        for size in sizes.tolist():
            inside = range(a, a + size)
            a += size
            alike = sorted((-n[i], words[i], first[i]) for i in inside if edited[i])
            for i in inside:
                if edited[i]:
                    near = alike[1] if alike[0][1] == words[i] and len(alike) > 1 else alike[0]
                    if near[1] != words[i]:
                        made.append((words[i], len(alike) - 1, -near[0], near[1]))
                else:  # one at most: the word without the character
                    longer = [x for x in alike if x[2]]
                    if longer:
                        made.append((words[i], len(longer), -longer[0][0], longer[0][1]))
                    made += [(x[1], 1, n[i], words[i]) for x in longer]
        columns = list(zip(*made, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "k", "form_n", "form"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("part")[batch.num_rows - 1]
        if held and held[0].column("part")[0] != last or not held and batch.column("part")[0] != last:
            # the last part may go on in the next batch
            cut = batch.num_rows - 1
            while cut and batch.column("part")[cut - 1] == last:
                cut -= 1
            yield groups(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield groups(pa.Table.from_batches(held))


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> a row for each distinct word: word, n, n_near, form, form_n, root.

    Words are near if one replaced, inserted or deleted character parts them.
    form: the near word of largest n (the smallest of several), if that n is at
    least ratio times the word's. root: where following forms ends. n of
    repeated words is added up, null words are left out, other columns are not
    returned, and an empty table gives none.
    """
    words = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    ranged = rotations(words).repartitionByRange("part").sortWithinPartitions("part")
    found = ranged.mapInArrow(_scan, FOUND).groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    known = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    known = stored(known)
    # each turn doubles how far a pointer reaches; n grows along it, so it ends
    reach = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = reliable(reach.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    roots = known.join(reach, "word", "left")
    return roots.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that are frequent enough, with their forms; odd rows as word_counts says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = word_counts(docs).where(F.col("n") >= LEAST_TIMES)
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_sql() -> str:
    """The query in DuckDB SQL: neighbours by patterns with one place left open."""
    cut = "left({0}, i) || substr({0}, i + 2)"
    return f"""WITH RECURSIVE {SQL_CRC_TABLE},
      runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
      hashed AS (SELECT run, n, {sql_crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs, crc_table WHERE length(run) >= {LEAST_LENGTH}),
      words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {MISPELT} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_TIMES}),
      places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
      opened AS (SELECT word, {cut.format("word")} AS rest, left(word, i) || '*' || substr(word, i + 2) AS pattern FROM places),
      shorter AS (SELECT DISTINCT o.word AS longer, w.word AS shorter FROM opened o JOIN words w ON w.word = o.rest),
      near AS (SELECT a.word, b.word AS other FROM opened a JOIN opened b USING (pattern) WHERE a.word <> b.word UNION SELECT longer, shorter FROM shorter UNION SELECT shorter, longer FROM shorter),
      best AS (SELECT near.word, count(*) AS n_near, min({{'n': -o.n, 'w': near.other}}) AS top FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
      formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.top.n >= {RATIO} * w.n THEN b.top.w END AS form, CASE WHEN -b.top.n >= {RATIO} * w.n THEN -b.top.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
      chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
      ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
      SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN ends e ON e.word = f.word"""
