"""Rendering templates, and lookups in key/value records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

#: Placeholders as they are rendered: ASCII names only.
PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"


def render(df: DataFrame, template: str = "template", values: str = "values", declared: str | None = None) -> DataFrame:
    """df plus rendered, missing (distinct, in order) and used (declared names that have a value).

    One pass: a value is never expanded again. A name without a value stays as {{name}}.
    """
    names = F.regexp_extract_all(F.col(template), F.lit(PLACEHOLDER), 1)
    pieces = F.split(F.col(template), PLACEHOLDER, -1)
    has = lambda n: F.coalesce(F.map_contains_key(F.col(values), n), F.lit(False))
    filled = F.transform(names, lambda n: F.when(has(n), F.coalesce(F.element_at(F.col(values), n), F.lit("null"))).otherwise(F.concat(F.lit("{{"), n, F.lit("}}"))))
    df = df.withColumn("rendered", F.array_join(F.flatten(F.zip_with(pieces, F.concat(filled, F.array(F.lit(""))), lambda p, v: F.array(p, v))), ""))
    df = df.withColumn("missing", F.array_distinct(F.filter(names, lambda n: ~has(n))))
    return df.withColumn("used", F.filter(F.array_distinct(F.col(declared) if declared else names), has))


def bootstrap_context(kv: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, client, profile) -> client, profile, source_key and content of the bundle that the manifest names.

    Client and profile are lower-cased and may hold a-z, 0-9, _ and - only. No
    pointer, a dangling one or an empty bundle give no row.
    """
    r = requests.select("request_id", F.lower(T.strip("client")).alias("client"), F.lower(T.strip("profile")).alias("profile")).where("client rlike '^[a-z0-9_-]+$' and profile rlike '^[a-z0-9_-]+$'")
    r = r.withColumn("key", F.concat(F.lit("manifest:bootstrap:"), "client", F.lit(":"), "profile"))
    pointers = kv.where(F.col("key").startswith("manifest:bootstrap:")).select("key", F.get_json_object("value", "$.bundleKey").alias("source_key"))
    bundles = kv.select(F.col("key").alias("source_key"), F.get_json_object("value", "$.content").alias("content")).where("content <> ''")
    return r.join(pointers, "key").where("source_key <> ''").join(bundles, "source_key").select("request_id", "client", "profile", "source_key", "content")


def common_item(kv: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, key) -> the record of an exact common: key."""
    r = requests.select("request_id", T.strip(T.nfkc("key")).alias("key")).where(F.col("key").startswith("common:"))
    return r.join(kv, "key").select("request_id", "key", "value")


def list_common(kv: DataFrame) -> DataFrame:
    """Entries of index:common that have a key and a title."""
    parts = kv.where("key = 'index:common'").select(F.explode(F.from_json("value", "array<string>")).alias("part"))
    entries = parts.select(F.from_json("part", "struct<key:string,title:string,description:string>").alias("e"))
    return entries.select("e.*").where("key is not null and title is not null")
