"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.session import materialise


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based row number per key, in the given order, for groups of any size.

    Rows are dealt by ranges of key and order, so a large group spans many ranges and no task holds all of it. A row's number is
    its number within its range plus what its group has in earlier ranges, a running sum over one row per range and group. The
    dealt rows are a table that both parts read: bounds of ranges are sampled, so dealing twice would give other ranges.
    The order must be total up to rows that are equal.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = df.repartitionByRange(ranges, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*names, F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_of")
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return (
        dealt.withColumn("_here", here).join(offsets, same)
        .withColumn(out, F.col("_here") + F.col("_offset"))
        .drop("_range", "_here", "_of", "_offset", *names)
    )
