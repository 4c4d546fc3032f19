"""Gap statistics between consecutive messages, exact in integer nanoseconds.

Times are cut into buckets: gaps inside a bucket come from a window over (keys, bucket), gaps between buckets from a
second window over one row per bucket. A topic that holds most messages is thus spread over many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import big, floor_div, isqrt

BUCKET_NS = 3_600_000_000_000


def bucket_rows(messages: DataFrame, keys: list[str], bucket: Column, time: str = "log_time_ns", order: list[str] | None = None, arrivals: bool = False) -> DataFrame:
    """One row per keys and bucket: count, first and last time, and number, sum, sum of squares and maximum of its gaps.

    Gaps are taken in ``order``; one against the order of time is left out. With ``arrivals`` also the times of the
    first and the last one in that order.
    """
    order = order or [time]
    rows = messages.select(*keys, F.col(time).alias("t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], bucket.alias("bucket"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys, "bucket").orderBy(*[f"_o{i}" for i in range(len(order))]))
    rows = rows.withColumn("gap", F.when(gap >= 0, gap))
    place = F.struct(*[f"_o{i}" for i in range(len(order))])
    return rows.groupBy(*keys, "bucket").agg(
        *([F.min_by("t", place).alias("first_arrival_ns"), F.max_by("t", place).alias("last_arrival_ns")] if arrivals else []),
        F.count(F.lit(1)).alias("count"),
        F.min("t").alias("first_ns"),
        F.max("t").alias("last_ns"),
        F.count("gap").alias("gap_n"),
        F.coalesce(F.sum(big("gap")), F.lit(0)).cast("decimal(38,0)").alias("gap_sum"),
        F.coalesce(F.sum((F.col("gap").cast("decimal(19,0)") * F.col("gap").cast("decimal(19,0)")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("gap_sq"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("gap_max"),
    )


#: Buckets that are stitched in one group before their totals are.
STITCHED = 4096


def stitched(rows: DataFrame, keys: list[str], block: int = STITCHED) -> DataFrame:
    """Totals per keys of ``bucket_rows`` in time order, with the gaps between neighbouring buckets.

    First blocks of buckets are stitched, then the blocks, so no group holds all buckets of a topic.
    """
    blocks = rows.withColumn("_block", F.floor(F.col("bucket") / F.lit(block).cast("decimal(20,0)")).cast("bigint"))
    return _stitched(_stitched(blocks, [*keys, "_block"]).withColumnRenamed("_block", "bucket"), keys)


def _stitched(rows: DataFrame, keys: list[str]) -> DataFrame:
    between = F.col("first_ns") - F.lag("last_ns").over(Window.partitionBy(*keys).orderBy("bucket"))
    rows = rows.withColumn("between", F.when(between >= 0, between))
    wide = F.col("between").cast("decimal(19,0)")
    return rows.groupBy(*keys).agg(
        F.sum("count").alias("count"),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
        (F.sum("gap_n") + F.count("between")).alias("gap_n"),
        (F.sum("gap_sum") + F.coalesce(F.sum(wide), F.lit(0))).cast("decimal(38,0)").alias("gap_sum"),
        (F.sum("gap_sq") + F.coalesce(F.sum((wide * wide).cast("decimal(38,0)")), F.lit(0))).cast("decimal(38,0)").alias("gap_sq"),
        F.greatest(F.max("gap_max"), F.coalesce(F.max("between"), F.lit(0))).alias("gap_max"),
    )


def integer_jitter(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation in whole ns: isqrt((n * squares - total ** 2) // n ** 2), 0 without gaps."""
    wide = big(n)
    variance = floor_div((wide * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)"), F.greatest((wide * wide).cast("decimal(38,0)"), F.lit(1)).cast("decimal(38,0)"))
    return F.when(n > 0, isqrt(variance)).otherwise(F.lit(0).cast("bigint"))


def integer_mean(n: Column, total: Column) -> Column:
    return F.when(n > 0, floor_div(total, big(F.greatest(n, F.lit(1)))).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def gap_stats(messages: DataFrame, keys: list[str], bucket_ns: int = BUCKET_NS, time: str = "log_time_ns") -> DataFrame:
    """count, first / last, span, rate, mean / largest gap and jitter per keys, in seconds; all 0 under two messages."""
    totals = stitched(bucket_rows(messages, keys, F.floor(F.col(time) / F.lit(bucket_ns).cast("decimal(20,0)")).cast("bigint"), time), keys)
    n, g = F.col("count"), F.col("gap_n")
    span = (F.col("last_ns") - F.col("first_ns")) / 1e9
    squared = (big(g) * F.col("gap_sq")).cast("decimal(38,0)") - (F.col("gap_sum") * F.col("gap_sum")).cast("decimal(38,0)")
    many = lambda c: F.when(n >= 2, c).otherwise(0.0)
    return totals.select(
        *keys,
        n,
        "first_ns",
        "last_ns",
        many(span).alias("span_sec"),
        many(F.when(span > 1e-9, (n - 1) / F.when(span > 1e-9, span)).otherwise(0.0)).alias("observed_hz"),
        many(F.col("gap_sum").cast("double") / F.greatest(g, F.lit(1)) / 1e9).alias("avg_gap_sec"),
        many(F.col("gap_max") / 1e9).alias("max_gap_sec"),
        many(F.sqrt(squared.cast("double")) / F.greatest(g, F.lit(1)) / 1e9).alias("jitter_sec"),
    )


def range_stats(messages: DataFrame, keys: list[str], duration_sec: float, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """``gap_stats`` with the rate over a stated duration."""
    return gap_stats(messages, keys, bucket_ns).withColumn("window_hz", F.col("count") / F.lit(float(duration_sec)))
