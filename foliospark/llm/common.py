"""What the operators share: reading tables, cutting lineage, adding a UDF's fields.

Null policy used throughout unless an operator says otherwise: a null text is
an empty text, a null id is an ordinary (last) id, and an input column whose
name an operator also returns is replaced by the operator's column.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.shared import shared_folder, stored  # noqa: F401

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it

#: Words, as every operator here takes them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between Spark and Python: whole texts are long, and each batch stands in both.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's Python functions, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    Sessions with spark.cleaner.referenceTracking.cleanCheckpoints drop the
    files once nothing refers to them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """All of df's columns in one struct named row, and the needed ones beside it, so that no name can clash."""
    return df.select(F.struct(F.lit(0).alias("-"), *(name(c) for c in df.columns)).alias("row"), *(name(c) for c in needed))


def unpacked(columns: Sequence[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def with_fields(df: DataFrame, made: Column, fields: Sequence[str]) -> DataFrame:
    """df plus the named fields of the struct column made; input columns of those names give way."""
    kept = [c for c in df.columns if c not in fields]
    holder = "made"
    while holder in kept:
        holder += "_"
    return df.withColumn(holder, made).select(*(name(c) for c in kept), *(name(holder)[f].alias(f) for f in fields))


def ranges(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes; a longer row stands alone."""
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def give_back() -> None:
    """Return a worker's free memory to the machine: workers outlive their tasks, beside the JVM and each other."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def list_array(values: pa.Array, counts: Sequence[int] | np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def binary_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array laid end to end, and the row limits in them; null rows are empty."""
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if array.null_count:
        array = array.fill_null(b"")
    limits = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[limits[0] : limits[-1]], limits - limits[0]


def sql_crc32(value: str) -> str:
    """DuckDB SQL: the unsigned crc32 of a text's UTF-8 bytes, in a query from crc_table besides."""
    each = f"list_transform(range(CAST(octet_length(encode({value})) AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode({value})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


#: DuckDB SQL: the CTE that sql_crc32 needs, made by the polynomial's rule.
SQL_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i))"
