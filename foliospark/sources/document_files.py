"""A tree of document files written by Spark tasks: one file for each row, stale ones taken away.

Tasks write into a folder of their attempt under a hidden one of the job, by a
Python data source; only attempts that Spark commits are told of, and a job
that fails takes its folder away. Then tasks move the files of committed
attempts to their places, each by one rename, and take away files that the rows
don't have. What broke off there can be finished by `publish`.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, DONE = "document_files", "committed"


@dataclass
class Attempt(WriterCommitMessage):
    name: str


def staging(root: str, job: str) -> str:
    return f"{root.rstrip('/')}/.new-{job}"


def checked(path: str) -> str:
    """A path below the root; others are an error."""
    plain = posixpath.normpath(path.lstrip("/"))
    if plain in ("", ".") or plain.startswith("../") or plain == ".." or plain.split("/")[0].startswith(".new-"):
        raise ValueError(f"not a path for a document: {path!r}")
    return plain


class DocumentWriter(DataSourceWriter):
    def __init__(self, root: str, job: str) -> None:
        self.root, self.job = root, job

    def write(self, iterator: Iterator) -> Attempt:
        """(path, document) rows as files of this attempt."""
        system, at = files.FileSystem.from_uri(staging(self.root, self.job))
        name, made = uuid.uuid4().hex, set()
        for path, document in iterator:
            target = f"{at}/{name}/{checked(path)}"
            folder = posixpath.dirname(target)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(target) as out:
                out.write((document or "").encode())
        return Attempt(name if made else "")

    def commit(self, messages: list[Attempt | None]) -> None:
        """A line for each task that wrote."""
        system, at = files.FileSystem.from_uri(staging(self.root, self.job))
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{DONE}") as out:
            out.write("\n".join(m.name for m in messages if m is not None and m.name).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        system, at = files.FileSystem.from_uri(staging(self.root, self.job))
        if system.get_file_info(at).type != files.FileType.NotFound:
            system.delete_dir(at)


class DocumentFiles(DataSource):
    """Options: path, the root of the tree, and job, a name of its own."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["job"])


def publish(spark: SparkSession, root: str, job: str) -> None:
    """Move what a committed job wrote to its place; one that broke off on the way may be run again."""
    system, at = files.FileSystem.from_uri(staging(root, job))
    with system.open_input_stream(f"{at}/{DONE}") as done:
        attempts = [a for a in done.read().decode().split("\n") if a]

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = files.FileSystem.from_uri(root.rstrip("/"))
        hidden = staging(top, job)
        for batch in batches:
            for attempt in batch["attempt"]:
                base = f"{hidden}/{attempt}"
                for info in system.get_file_info(files.FileSelector(base, recursive=True, allow_not_found=True)):
                    if info.type == files.FileType.File:
                        target = f"{top}/{info.path[info.path.index(attempt) + len(attempt) + 1 :]}"
                        system.create_dir(posixpath.dirname(target), recursive=True)
                        if not isinstance(system, files.LocalFileSystem) and system.get_file_info(target).type == files.FileType.File:
                            system.delete_file(target)  # other systems don't rename over a file
                        system.move(info.path, target)
            yield batch.iloc[:0]

    if attempts:
        spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts)).mapInPandas(move, "attempt string").count()
    system.delete_dir(at)


def take_away_stale(spark: SparkSession, root: str, paths: DataFrame) -> None:
    """Delete files under root that paths (path) doesn't have; hidden ones stay."""
    top = root.rstrip("/")
    system, at = files.FileSystem.from_uri(top)
    first = [i.base_name for i in system.get_file_info(files.FileSelector(at)) if not i.base_name.startswith(".")]  # projects

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spark's readers pass over empty files, so tasks list what is below each folder."""
        system, at = files.FileSystem.from_uri(top)
        for batch in batches:
            for name in batch["path"]:
                info = system.get_file_info(f"{at}/{name}")
                below = [info] if info.type == files.FileType.File else system.get_file_info(files.FileSelector(f"{at}/{name}", recursive=True))
                yield pd.DataFrame({"path": [i.path[len(at) + 1 :] for i in below if i.type == files.FileType.File]}, dtype=str)

    if not first:
        return
    there = spark.createDataFrame([(f,) for f in first], "path string").repartition(min(len(first), 1000)).mapInPandas(walk, "path string")
    stale = there.join(paths, "path", "left_anti")

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = files.FileSystem.from_uri(top)
        for batch in batches:
            for path in batch["path"]:
                if system.get_file_info(f"{at}/{path}").type == files.FileType.File:
                    system.delete_file(f"{at}/{path}")
            yield batch.iloc[:0]

    stale.mapInPandas(delete, "path string").count()


def write_document_files(df: DataFrame, root: str, path: str = "path", document: str = "document") -> None:
    """df's documents as the files of a tree, and no others: each row's text in the file of its path.

    Paths are below root, unique and not null; others are an error before
    anything is changed. A null document is an empty file.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.regexp_replace(path, "^/+", ""), F.raise_error(F.lit("a document without a path")).cast("string")).alias("path"), F.col(document).alias("document"))
    twice = rows.groupBy("path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two documents have the path {twice[0]['path']!r}")
    job = uuid.uuid4().hex
    spark.dataSource.register(DocumentFiles)
    rows.write.format(FORMAT).option("path", root).option("job", job).mode("append").save()
    publish(spark, root, job)
    take_away_stale(spark, root, rows.select("path"))
