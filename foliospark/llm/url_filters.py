"""URL filters: host and path rules, and pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import name, table, with_fields

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class Pattern:
    """A regular expression on the lower-cased url, and tokens that any match has in the url as a whole."""

    regex: str
    tokens: tuple[str, ...]


_TOKEN = "[a-z0-9]+"
_EDGE = "(?:^|[^a-z0-9]|$)"


def parse_rule(rule: str) -> Pattern:
    """A rule in the common form of filter lists: plain text, * for anything, ^ for what parts tokens or an end of the url, | for its start or end.

    Letters and digits between two characters that part tokens, literal ones or
    ^, or at a marked end, are tokens of every url that the rule matches.
    """
    text = rule.strip().lower()
    start, end = text.startswith("|"), text.endswith("|") and len(text) > 1
    body = text[start : len(text) - end]
    parts = re.findall(rf"{_TOKEN}|\*+|\^|[^a-z0-9*^]", body)
    regex = "".join(_EDGE if p == "^" else ".*" if p[0] == "*" else re.escape(p) for p in parts)
    parting = lambda i, marked: marked if not 0 <= i < len(parts) else parts[i][0] != "*"
    tokens = tuple(dict.fromkeys(p for i, p in enumerate(parts) if re.fullmatch(_TOKEN, p) and parting(i - 1, start) and parting(i + 1, end)))
    return Pattern(("^" if start else "") + regex + ("$" if end else ""), tokens)


def parse_rules(lines: Iterable[str]) -> tuple[Pattern, ...]:
    """The patterns of a rule list; blank lines and those that start with ! are none."""
    return tuple(parse_rule(line) for line in lines if line.strip() and not line.strip().startswith("!"))


#: What blocks a url that no host rule judges.
RULES = """
! adverts and trackers
://ads.
^adserver^
^doubleclick.
^banner^ad^
?utm_source=*&utm_medium=
&utm_source=*&utm_medium=
! sessions, accounts and shops
?sessionid=
&sessionid=
;jsessionid=
?phpsessid=
/wp-admin/
/wp-login.php
/login|
/login?
/login/
/signin^
/cart^
/checkout^
! lists of lists
/tag/*/page/
/search?
^calendar^*?month=
! what is no prose
^casino^
^poker^
^viagra^
^pills.
^xxx^
^porn^
^torrent^
^free-download^
""".splitlines()
PATTERNS = parse_rules(RULES)


def lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return lower(parts[0]), parts[1]


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. Few rules: one expression, longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def token_counts(urls: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens. As many rows as the rules have tokens come back."""
    if not tokens:
        return {}
    known = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(lower(name(url)), F.lit(f"({_TOKEN})")))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).join(known, "token").collect()}


def index_patterns(patterns: Sequence[Pattern], counts: dict[str, int]) -> dict[str, list[str]]:
    """Rarest token (by the urls' counts, then by name) -> the regular expressions it fetches; those of no token under an empty one."""
    index: dict[str, list[str]] = {}
    for p in patterns:
        index.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(p.regex)
    return index


def judge_urls(pages: DataFrame, url: str = "url", patterns: Sequence[Pattern] = PATTERNS, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> DataFrame:
    """pages plus host, path, rule and verdict (allow or block).

    Equal urls are judged alike, and repeated rows stay; an empty table gives none.

    Without a host rule the patterns decide: a url's tokens fetch candidate
    patterns, only those run, and one match blocks. A null url, or one without
    ://, has an empty host and path; a null one is allowed. Columns named like
    the results give way; rows are judged alone.
    """
    index = index_patterns(patterns, token_counts(pages, url, sorted({t for p in patterns for t in p.tokens})))

    def blocked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = {t: [re.compile(x) for x in xs] for t, xs in index.items()}
        tokens = re.compile(_TOKEN)
        for batch in batches:
            out = []
            for u in batch.to_pylist():
                u = u or ""
                out.append(any(x.search(u) for t in (set(tokens.findall(u)) | {""}) & compiled.keys() for x in compiled[t]))
            yield pa.array(out, pa.bool_())

    host, path = host_and_path(name(url))
    rule, verdict = host_rule(F.col("made.host"), F.col("made.path"), rules)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(F.struct(*(name(c) for c in own)).alias("row"), F.struct(host.alias("host"), path.alias("path")).alias("made"), lower(name(url)).alias("low"))
    split = split.withColumn("blocked", F.arrow_udf(blocked, "boolean")("low"))
    return split.select(*(F.col("row").getField(c).alias(c) for c in own), "made.host", "made.path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls by the host rules and RULES; nulls, repeats and empty tables as judge_urls says."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_sql() -> str:
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])))
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in HOST_RULES)
    any_pattern = " OR ".join(f"regexp_matches(low, '{p.regex}')" for p in PATTERNS)
    return f"""WITH parts AS (
      SELECT page_id, {low} AS low,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages), ruled AS (SELECT *, CASE {fits} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE {verdicts} WHEN {any_pattern} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
