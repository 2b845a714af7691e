"""The folder that all tasks share, and what is stored there on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a session on one machine may go without and get a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: What this process has stored and not yet cleared.
_STORED: list[str] = []


def clear_stored(spark: SparkSession) -> int:
    """Delete what stored() wrote in this process, once no DataFrame over it is needed; how many folders went."""
    n = len(_STORED)
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return n
