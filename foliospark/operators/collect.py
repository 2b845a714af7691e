"""Collecting stored pages into documents: links, canonical urls, paths, Markdown, folders, inventory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import markdown as M

LINK = "array<struct<grp:string,title:string,href:string,group_sort:int,document_sort:int>>"


def extract_nav_links(pages: DataFrame, profile: str = "nav", page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, grp, title, href, group_sort, document_sort); equal labels, without regard to case, are one group."""
    kind = pa.list_(pa.struct([("grp", pa.string()), ("title", pa.string()), ("href", pa.string()), ("group_sort", pa.int32()), ("document_sort", pa.int32())]))

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                places: dict[str, int] = {}
                links, counts = [], {}
                for group, found in M.nav_groups(M.parse(text or ""), profile):
                    g = places.setdefault(group.casefold(), len(places) + 1)
                    for title, href in found:
                        counts[g] = counts.get(g, 0) + 1
                        links.append({"grp": group, "title": title, "href": href, "group_sort": g, "document_sort": counts[g]})
                out.append(links)
            yield pa.array(out, kind)

    return pages.select(page_id, F.explode(F.arrow_udf(of, LINK)(F.col(html))).alias("l")).select(page_id, "l.*")


def canonical_url(href: Column | str, base: Column | str, prefix: str = "/", keep_query: bool = False) -> Column:
    """href made absolute against base, without fragment and end slash (and query); null for another scheme, host or path."""
    href, base = T.strip(href), T.col(base)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == origin, path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    joined = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?"), F.concat(path, href)).when(href.startswith("#") | (href == ""), path).otherwise(F.concat(folder, F.lit("/"), href))
    bare = F.regexp_replace(joined, r"#.*$", "")
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/+$", "")
    where = F.regexp_replace(plain, r"^[A-Za-z]+://[^/]*", "")
    fine = plain.rlike(r"^https?://") & (F.lower(F.regexp_extract(plain, r"^[a-z]+://([^/]*)", 1)) == F.lower(F.regexp_extract(base, r"^[a-z]+://([^/?#]*)", 1))) & (where.startswith(prefix) | (F.concat(where, F.lit("/")) == prefix))
    return F.when(fine, F.concat(plain, query) if keep_query else plain)


def doc_path(group: Column | str, url: Column | str, prefix: str = "/") -> Column:
    """<group slug>/<rest of the url's path>.md, with index for no rest."""
    where = F.regexp_replace(F.regexp_replace(T.col(url), r"^[A-Za-z]+://[^/]*", ""), r"\?.*$", "")
    rest = F.regexp_replace(F.regexp_replace(where, f"^{prefix}", ""), "^/+|/+$", "")
    parts = F.filter(F.transform(F.split(rest, "/"), lambda p: T.slug(p)), lambda p: p != "")
    return F.concat(T.slug(group, True), F.lit("/"), F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("index"), F.lit(".md"))


def select_nav_documents(links: DataFrame, groups: Sequence[str] | None = None, max_documents: int | None = None) -> DataFrame:
    """links (url, grp, group_sort, document_sort, ...) of the chosen groups, each url once (the first), in order, the first max_documents."""
    if groups is not None:
        links = links.where(F.lower("grp").isin([g.lower() for g in groups]))
    first = F.row_number().over(Window.partitionBy("url").orderBy("group_sort", "document_sort"))
    kept = links.where("url is not null").withColumn("n", first).where("n = 1").drop("n").orderBy("group_sort", "document_sort", "url")
    return kept.limit(max_documents) if max_documents is not None else kept


def pages_to_markdown(pages: DataFrame, profile: str = "marked", html: str = "html", url: str = "url") -> DataFrame:
    """pages plus section, title, description, body, markdown and error; a bad page has its reason and no text."""
    names = ("section", "title", "description", "body", "markdown", "error")
    kind = pa.struct([(n, pa.string()) for n in names])

    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, urls in batches:
            yield pa.array([M.page(t, u or "", profile) for t, u in zip(texts.to_pylist(), urls.to_pylist(), strict=True)], kind)

    made = pages.withColumn("made", F.arrow_udf(of, "struct<" + ",".join(f"{n}:string" for n in names) + ">")(F.col(html), F.col(url)))
    return made.select(*(F.col(c) for c in pages.columns if c not in names), "made.*")


def normalize_markdown(c: Column | str) -> Column:
    text = F.regexp_replace(F.regexp_replace(T.col(c), "\r\n?", "\n"), "[ \t]+\n", "\n")
    return T.strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def collection_errors(pages: DataFrame) -> DataFrame:
    """(url, reason) of rejected pages of pages_to_markdown, and of bodies that are HTML, sorted."""
    reason = F.coalesce("error", F.when(F.col("body").rlike(r"(?is)^\s*<(!doctype|html)\b"), "html body"))
    return pages.select("url", reason.alias("reason")).where("reason is not null").orderBy("url", "reason")


def discover_documents(tree: DataFrame, prefix: str, extensions: Sequence[str], listing: str = "listing") -> DataFrame:
    """A repository listing (JSON {tree: [{path, type}]}) -> its files under prefix with an extension, in order without regard to case."""
    rows = tree.select(F.explode(F.from_json(F.col(listing), "struct<tree:array<struct<path:string,type:string>>>")["tree"]).alias("e")).select("e.path", "e.type")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.where((F.col("type") == "blob") & F.col("path").startswith(prefix) & ext.isin([e.lower() for e in extensions])).select("path").orderBy(F.lower("path"), "path")


def map_output_paths(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """df plus output_path (.mdx as .md), and the output paths that clash without regard to case."""
    out = df.withColumn("output_path", F.regexp_replace(path, r"(?i)\.mdx$", ".md"))
    return out, out.groupBy(F.lower("output_path").alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


def derive_folders(docs: DataFrame, mode: str = "nested", path: str = "path") -> DataFrame:
    """docs (path, group_sort, document_sort) -> (path, depth, sort) of every folder above one.

    nested: a folder's order is its smallest (group, document) as group * 1000
    + document. ranked: its rank among the folders beside it, times ten.
    """
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("path"), (n - 1).alias("depth")))
    rows = docs.where(F.size(parts) > 1).select("group_sort", "document_sort", F.explode(up).alias("f"))
    least = rows.groupBy("f").agg(F.min(F.struct("group_sort", "document_sort")).alias("m")).select("f.path", "f.depth", "m.*")
    if mode == "nested":
        return least.select("path", "depth", (F.col("group_sort") * 1000 + F.col("document_sort")).alias("sort"))
    beside = Window.partitionBy(F.regexp_replace("path", "/[^/]*$", "")).orderBy("group_sort", "document_sort", "path")
    return least.select("path", "depth", (F.row_number().over(beside) * 10).alias("sort"))


def attach_bodies(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links joined with pages by url, each url's first page (the smallest page_id) taken."""
    one = pages.groupBy("url").agg(F.min_by(F.struct(*(c for c in pages.columns if c != "url")), "page_id").alias("p"))
    return links.join(one, "url").select(*links.columns, "p.*")


def inventory_diff(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths once owned and no longer written, and folders left empty by their going. Files never owned aren't named."""
    stale = previous.select("path").distinct().join(current.select("path"), "path", "left_anti")

    def above(df: DataFrame) -> DataFrame:
        parts = F.split(F.regexp_replace("path", "^/", ""), "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return df.where(F.size(parts) > 1).select(F.explode(up).alias("folder")).distinct()

    return stale, above(stale).join(above(current), "folder", "left_anti")
