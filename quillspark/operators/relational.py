"""Relational forms that the library's users need beside Spark's own: global ranks, as-of and range
joins, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with each row's place (from 0) in the whole order, without one task for all rows: rows are
    range-partitioned, numbered inside their partition, and moved up by the sizes of those before.
    Only one number a partition reaches the driver."""
    from ..session import stored

    rows = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    rows = stored(rows)
    sizes = sorted((r["_p"], r["count"]) for r in rows.groupBy("_p").count().collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    where = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _start long"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_own", own).join(where, "_p").withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_p", "_own", "_start")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tie: str, unit: str = "day") -> DataFrame:
    """left with the latest value of right at or before its time, by key; null where none is.

    Both sides are merged and read in order, one unit of time of one key a group; what a group
    starts with is the last value of the units before, which are few a key.
    """
    cols = left.columns
    a = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.struct(*cols).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[tie].dataType).alias("_i"))
    b = right.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.col(tie).alias("_i"))
    rows = a.unionByName(b).withColumn("_u", F.date_trunc(unit, "_t")).withColumn("_mark", F.when(F.col("_l").isNull(), F.struct(F.col("_v").alias("v"))))
    ends = rows.where("_mark is not null").groupBy("_k", "_u").agg(F.max_by("_mark", F.struct("_t", "_i")).alias("_end"))
    units = rows.select("_k", "_u").distinct().join(ends, ["_k", "_u"], "left")
    before = W.partitionBy("_k").orderBy("_u").rowsBetween(W.unboundedPreceding, -1)
    units = units.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    w = W.partitionBy("_k", "_u").orderBy("_t", F.col("_l").isNotNull(), "_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_seen", F.last("_mark", ignorenulls=True).over(w)).where("_l is not null").join(units, ["_k", "_u"])
    return rows.select("_l.*", F.coalesce("_seen", "_carried")["v"].alias(f"{value}_as_of"))


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """points joined with the ranges that hold them, low <= at < high: ranges are cut into buckets
    of `width`, so that the join is on equality of the bucket and then on the condition."""
    first, last = F.floor(F.col(low) / width), F.floor((F.col(high) - 1e-9) / width)
    cut = ranges.where(F.col(low) < F.col(high)).withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
    rows = points.withColumn("_b", F.floor(F.col(at) / width))
    return rows.join(cut, "_b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, n): runs of events less than `gap` apart."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
