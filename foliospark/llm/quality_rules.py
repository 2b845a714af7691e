"""Quality rules: counted base rules, and zstandard compression bands by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, name, table, with_fields

#: (bytes from, lowest, highest compressed share of the whole text). Below the
#: lowest a text repeats itself, above the highest it is no prose. A
#: compressor's window fills with length, so both fall; a very short text is
#: mostly frame and has no upper limit.
BANDS = ((0, 0.35, 9.0), (256, 0.30, 0.85), (1024, 0.25, 0.75), (4096, 0.22, 0.70), (16384, 0.18, 0.65))
#: The same for chunks of CHUNK bytes, the last one counting from CHUNK / 2 on;
#: more than a quarter outside rejects the text.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.18, 0.75), 0.25
LEVEL = 3

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "bad_chunks", "kept")


def _per_row(marks: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[limits])


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    often = np.zeros(n - 2, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def compression(text: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Compressed share of the whole, chunks outside their band, chunks, and the verdict."""
    ratio = len(press.compress(text)) / len(text)
    _, low, high = next(b for b in reversed(BANDS) if len(text) >= b[0])
    chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK) if i == 0 or len(text) - i >= CHUNK // 2] if len(text) >= CHUNK // 2 else []
    bad = sum(not CHUNK_BAND[0] <= len(press.compress(c)) / len(c) <= CHUNK_BAND[1] for c in chunks) if len(chunks) > 1 else 0
    return ratio, bad, len(chunks), low <= ratio <= high and bad <= CHUNK_SHARE * len(chunks)


def _judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        data, limits = binary_parts(batch)
        blank = _SPACE[data]
        starts = np.zeros(len(data) + 1, dtype=bool)
        starts[limits[:-1]] = True
        first = ~blank
        first[1:] &= blank[:-1] | starts[1:-1]
        n_words = _per_row(first, limits)
        word_chars = _per_row(~blank & ((data & 0xC0) != 0x80), limits)
        n_symbols = _per_row(_SYMBOL[data], limits)
        whole, at = data.tobytes(), limits.tolist()
        lines, repeats, ratios, bad, fine = [], [], [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            text = whole[a:b]
            full = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines.append(len(full) - len(set(full)))
            repeats.append(repeated_words(text.split()))
            ratio, outside, _, ok = compression(text, press) if text else (None, 0, 0, False)
            ratios.append(ratio)
            bad.append(outside)
            fine.append(ok)
        again = np.array(repeats, dtype=np.int64)
        failed = (n_words < 50) | (100 * again > 50 * n_words)
        made = [n_words, word_chars, n_symbols, np.array(lines, dtype=np.int64), again, failed]
        yield pa.StructArray.from_arrays([*map(pa.array, made), pa.array(ratios, pa.float64()), pa.array(bad, pa.int64()), pa.array(np.array(fine, dtype=bool) & ~failed)], names=list(FIELDS))


def judge_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the FIELDS; kept is false if base_failed or a compression band is missed.

    Null and empty texts have no words, a null ratio, and are not kept. Lines
    are parted by \\n alone, and one without a word is no line. Columns named
    like the fields give way. Rows are judged alone, so repeated rows are judged
    alike and stay, an empty table gives none, and nothing is shuffled.
    """
    kind = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,ratio:double,bad_chunks:bigint,kept:boolean>"
    return with_fields(docs, F.arrow_udf(_judge, kind)(name(text).cast("binary")), FIELDS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document; nulls, repeated rows and empty tables as judge_quality says."""
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
