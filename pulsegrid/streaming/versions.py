"""Tables that a stream keeps up to date: each micro-batch writes a version of them from the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Versions:
    """Tables ``folder/name/number=n``, and commits, which are written last.

    A micro-batch reads what the one before committed and writes under its own number, so one that is repeated, as
    after a lost driver, writes the same again, and readers see no version that isn't whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def start(self) -> Versions:
        """Lets readers find commits before there is any."""
        self.spark.range(1).select(F.lit(-1).cast("bigint").alias("last")).write.mode("overwrite").parquet(f"{self.folder}/commits/number=-1")
        return self

    def last(self) -> int:
        return self.spark.read.schema("last bigint").parquet(f"{self.folder}/commits").agg(F.max("last")).first()[0]

    def read(self, name: str, schema: str, number: int) -> DataFrame:
        """A table as of a micro-batch's number, empty before the first one."""
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/number={number}")

    def write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/number={number}")

    def commit(self, number: int) -> None:
        self.write(self.spark.range(1).select(F.lit(number).cast("bigint").alias("last")), "commits", number)

    def added(self, name: str, schema: str) -> DataFrame:
        """What all committed micro-batches have written of a table that grows."""
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, number int").parquet(f"{self.folder}/{name}").where(F.col("number") <= last).drop("number")


def each_version(stream: DataFrame, versions: Versions, checkpoint: str, step: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Run ``step(batch, number)`` on each micro-batch and commit its number."""
    versions.start()

    def each(batch: DataFrame, number: int) -> None:
        step(batch, number)
        versions.commit(number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
