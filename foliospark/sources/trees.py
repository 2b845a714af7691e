"""Reading and writing: content trees, configs, manifests, documents, key/value seeds, table stores."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import normalize as N
from foliospark.sources.shared import clear_stored, shared_folder, stored  # noqa: F401

#: Config files of a project and a folder, and the defaults of what they leave out. Fixed values.
PROJECT_FILE, FOLDER_FILE = "_project.yaml", "_folder.yaml"
MOST_CONFIGS, MOST_LEVELS = 10_000, 16
DEFAULT_VISIBILITY, DEFAULT_LANGUAGE = "private", "zh-CN"


#: What a task hands on at once, in bytes, of the files that it reads.
MOST_READ = 1 << 24


def _below(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame | None:
    """(source_path, content) of files under root, listed and read by tasks; null where only Spark's readers get at root.

    Spark's readers would list every file on the driver. As with them, hidden
    names (a leading _ or .) and empty files are passed over.
    """
    try:
        system, at = files.FileSystem.from_uri(root.rstrip("/"))
        if system.get_file_info(at).type != files.FileType.Directory:
            return None
        first = [i.base_name for i in system.get_file_info(files.FileSelector(at))]  # projects
    except (pa.ArrowException, OSError, ValueError):
        return None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files.FileSystem.from_uri(root.rstrip("/"))
        for batch in batches:
            left = [info for name in batch.column(0).to_pylist() for info in system.get_file_info([f"{at}/{name}"])]
            while left:
                info = left.pop()
                if info.base_name.startswith(".") or (info.base_name.startswith("_") and "=" not in info.base_name) or info.base_name.endswith("._COPYING_"):
                    continue
                if info.type == files.FileType.Directory:
                    inner = system.get_file_info(files.FileSelector(info.path))
                    left += [i for i in inner if i.type == files.FileType.Directory]
                    found = [i for i in inner if i.type == files.FileType.File and not i.base_name.startswith((".", "_"))]
                else:
                    found = [info]
                paths = [i.path[len(at) + 1 :] for i in found if i.size and i.base_name.endswith(tuple(suffixes)) and not i.base_name.endswith("._COPYING_")]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["source_path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files.FileSystem.from_uri(root.rstrip("/"))
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["source_path", "content"])
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{at}/{path}") as stream:
                    rows.append((path, stream.read()))
                size += len(rows[-1][1])
                if size >= MOST_READ:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    tops = spark.createDataFrame([(f,) for f in first], "name string").repartition(max(1, min(len(first), 1000)))
    return tops.mapInArrow(walk, "source_path string").repartition(n).mapInArrow(read, "source_path string, content binary")


def _tree(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """Files under root as (project_dir, rel_path, source_path, content); the first folder is the project's."""
    found = _below(spark, root, suffixes)
    if found is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(suffixes)}}}").load(root)
        top = root.rstrip("/").rsplit("/", 1)[-1]
        source = F.regexp_extract(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"(?s)/{top}/(.*)$", 1)
        found = found.withColumn("source_path", source)
    return found.select(F.substring_index("source_path", "/", 1).alias("project_dir"), F.regexp_replace("source_path", "^[^/]*/", "").alias("rel_path"), "source_path", "content")


def read_content_tree(spark: SparkSession, root: str) -> DataFrame:
    """(project_dir, rel_path, source_path, raw, utf8) of .md, .txt and .json files; names with a leading _ and hidden parts are passed over. raw is null where it isn't UTF-8."""
    rows = _tree(spark, root, (".md", ".txt", ".json", ".MD", ".TXT", ".JSON"))
    parts = F.split("rel_path", "/")
    rows = rows.where(~F.exists(parts, lambda p: p.startswith(".")) & ~F.substring_index("rel_path", "/", -1).startswith("_"))
    fine = F.expr("is_valid_utf8(cast(content as string))")
    return rows.select("project_dir", "rel_path", "source_path", F.when(fine, F.col("content").cast("string")).alias("raw"), fine.alias("utf8"))


def _config_files(spark: SparkSession, root: str) -> DataFrame:
    """The config files of a tree like _tree's rows. Spark's readers pass over names with a leading _, so
    the driver lists and reads them: one small file for each project and folder. More than MOST_CONFIGS, or deeper ones than MOST_LEVELS, are an error."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/")
    rows = []
    for depth in range(1, MOST_LEVELS + 2):
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top + "/*" * depth + f"/{{{PROJECT_FILE},{FOLDER_FILE}}}")) or ():
            if depth > MOST_LEVELS:
                raise ValueError(f"config files more than {MOST_LEVELS} levels below {root}")
            source = found.getPath().toString()[len(top) + 1 :]
            stream = fs.open(found.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            project, _, rest = source.partition("/")
            rows.append((project, rest, source, bytearray(text.encode())))
            if len(rows) > MOST_CONFIGS:
                raise ValueError(f"more than {MOST_CONFIGS} config files under {root}")
    return spark.createDataFrame(rows, "project_dir string, rel_path string, source_path string, content binary")


def read_configs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Projects and folders of a tree, with defaults; a config that can't be read has its reason in error."""
    kind = "project_dir string, rel_path string, source_path string, id string, slug string, name string, description string, visibility string, default_language string, prune boolean, enabled boolean, sort_order int, metadata_json string, error string"

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                project = r.source_path.endswith(PROJECT_FILE)
                row = {"project_dir": r.project_dir, "rel_path": r.rel_path.rsplit("/", 1)[0] if "/" in r.rel_path else "", "source_path": r.source_path, "error": None}
                try:
                    data = yaml.safe_load(bytes(r.content).decode()) or {}
                    link = data.get("sync") or {}
                    row |= {k: data.get(k) for k in ("id", "slug", "name")}
                    row |= {"description": data.get("description") or "", "visibility": data.get("visibility") or (DEFAULT_VISIBILITY if project else None), "default_language": data.get("default_language") or DEFAULT_LANGUAGE}
                    row |= {"prune": bool(link.get("prune", False)), "enabled": bool(link.get("enabled", True)), "sort_order": int(data.get("sort") or 0), "metadata_json": json.dumps(data.get("metadata") or {}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))}
                except (yaml.YAMLError, UnicodeDecodeError, AttributeError, TypeError, ValueError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    configs = _config_files(spark, root).mapInPandas(of, kind)
    name = F.substring_index("source_path", "/", -1)
    projects = configs.where(name == PROJECT_FILE).drop("rel_path", "sort_order")
    return projects, configs.where(name == FOLDER_FILE).drop("slug", "name", "default_language", "prune", "enabled")


def write_manifest(manifest: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in manifest.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    N.manifest_fingerprint(dict(manifest)).write.mode("overwrite").json(f"{folder}/fingerprint")


def read_manifest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What write_manifest wrote; an error if its fingerprint isn't that of the tables, as where a writer broke off."""
    manifest = {name: spark.read.parquet(f"{folder}/{name}") for name in ("projects", "folders", "files")}
    made = N.manifest_fingerprint(manifest)
    if spark.read.schema(made.schema).json(f"{folder}/fingerprint").collect() != made.collect():
        raise ValueError(f"the manifest in {folder} doesn't have the hash that was written beside it")
    return manifest


def render_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("document", N.emit(df))


def write_documents(df: DataFrame, folder: str, partition: str = "project_id") -> None:
    """Rendered documents, one JSON line each with its path, by project."""
    render_documents(df).select(partition, "path", "document").write.mode("overwrite").partitionBy(partition).json(folder)


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """A seed file, a JSON list of {key, value}, as (key, value)."""
    return spark.read.option("multiLine", "true").schema("key string, value string").json(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str, partitions: Mapping[str, Sequence[str]] | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        by = (partitions or {}).get(name)
        (writer.partitionBy(*by) if by else writer).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
