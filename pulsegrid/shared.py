"""The folder that the driver and all executors share, and tables that are written there and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is set if the session runs on this machine alone, as in tests; on a cluster
    it is an error, as executors wouldn't see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by URI or by path, for use inside tasks."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_files(files: DataFrame, folder: str) -> int:
    """Write a file for each row (name, content) below ``folder``, each by the task that has the row; gives their number.

    A task that runs twice writes the same bytes to the same names once more.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(folder)
        for b in batches:
            for name, content in zip(b.name, b.content):
                system.create_dir(f"{path}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInPandas(each, "n bigint").agg(F.sum("n")).first()[0] or 0
