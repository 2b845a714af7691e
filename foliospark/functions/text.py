"""Column functions on text: folding, Unicode forms, paths, URIs, slugs, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z only, as the catalogue compares; other letters keep their case."""
    return F.translate(col(c), UPPER, LOWER)


def _mapped(c: Column | str, change: Callable[[str], str]) -> Column:
    """A string function in Arrow batches; its input stands in the plan once, so that calls can nest. Null stays null."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else change(s) for s in batch.to_pylist()], pa.string())

    return F.arrow_udf(of, "string")(col(c))


def nfkc(c: Column | str) -> Column:
    return _mapped(c, lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s))


def nfc(c: Column | str) -> Column:
    return _mapped(c, lambda s: s if s.isascii() else unicodedata.normalize("NFC", s))


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    if text.isascii():
        return text
    # no mark stands before U+0300
    return "".join([ch for ch in unicodedata.normalize("NFD", text) if ch < "\u0300" or unicodedata.category(ch) != "Mn"])


def folded(c: Column | str) -> Column:
    return _mapped(c, fold)


def strip(c: Column | str) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def blank_to_null(c: Column | str) -> Column:
    c = strip(c)
    return F.when(c != "", c)


def plain_path(c: Column | str) -> Column:
    """A path with forward slashes, one at the start, none doubled or at the end; / for nothing."""
    path = F.regexp_replace(F.replace(strip(F.coalesce(col(c), F.lit("/"))), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)


def normalize_path(c: Column | str) -> Column:
    """plain_path after compatibility composition."""
    return plain_path(nfkc(c))


def encode_component(c: Column | str) -> Column:
    """Percent-encoding of one URI component; - _ . ! ~ * ' ( ) stay."""
    out = F.url_encode(col(c))
    for code, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def decode_component(c: Column | str) -> Column:
    """The inverse; null where the encoding is malformed."""
    c = col(c)
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(~out.contains("�") | c.contains("�"), out)


def encode_path(c: Column | str) -> Column:
    return F.array_join(F.transform(F.filter(F.split(col(c), "/"), lambda p: p != ""), encode_component), "/")


def file_uri(slug: Column | str, path: Column | str) -> Column:
    """prompt://<slug>/<path>, encoded part by part."""
    return F.concat(F.lit("prompt://"), encode_component(slug), F.lit("/"), encode_path(path))


def parse_file_uri(c: Column | str) -> Column:
    """struct(project, path), or null where c is no such URI or is badly encoded."""
    c = col(c)
    rest = F.substring(c, 10, 1 << 30)
    project = decode_component(F.regexp_extract(rest, r"(?s)^([^/]+)/", 1))
    parts = F.transform(F.split(F.regexp_extract(rest, r"(?s)^[^/]+/(.*)$", 1), "/"), decode_component)
    fine = ascii_lower(c).startswith("prompt://") & rest.rlike(r"(?s)^[^/]+/") & project.isNotNull() & ~F.exists(parts, lambda p: p.isNull())
    return F.when(fine, F.struct(project.alias("project"), plain_path(F.array_join(parts, "/")).alias("path")))


def slug(c: Column | str, ampersand: bool = False) -> Column:
    out = F.lower(strip(c))
    out = F.replace(out, F.lit("&"), F.lit(" and ")) if ampersand else out
    return F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("@"), F.lit("")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_list(c: Column | str) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(col(c), strip), lambda x: x.isNotNull() & (x != "")))


def canonical_json(value: Column) -> Column:
    """JSON with nulls written; give struct fields in key order. Control characters are escaped in lower case."""
    out = F.to_json(value, {"ignoreNullFields": "false"})
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return out


def sha256_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def stable_id(prefix: str, project_id: Column | str, path: Column | str) -> Column:
    """prefix and 24 hex digits of the hash of {path, projectId}."""
    body = canonical_json(F.struct(col(path).alias("path"), col(project_id).alias("projectId")))
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 24))


def title_case_stem(path: Column | str) -> Column:
    """guides/content-sync.md -> Content Sync; null for no name."""
    file = F.element_at(F.filter(F.split(col(path), "/"), lambda p: p != ""), -1)
    stem = F.trim(F.regexp_replace(F.regexp_replace(file, r"\.[^.]+$", ""), "[-_]+", " "))
    words = F.transform(F.split(stem, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(stem != "", F.array_join(words, " "))
