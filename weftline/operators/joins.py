"""Joins and deduplication that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST_BROADCAST = 100_000


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, take: Sequence[str], by: Sequence[str] = (), most_broadcast: int = MOST_BROADCAST, target: int = 1_000_000) -> DataFrame:
    """``left`` with columns ``take`` of the last ``right`` row at or before its time, per ``by``; null where there is none.

    Without keys a small right side (its size is checked) is sorted and searched by bisection in Arrow
    batches, so the left side is not shuffled at all. Otherwise time is cut into ranges of about
    ``target`` rows by its quantiles, and key and range together are what is shuffled: a range starts
    with the last value of the ranges before it, of which there is one row a key and range. Ranges of a
    key that many left rows share (equal times) are split further, so no key and no moment ends in one
    task. Of right rows with equal key and time the one with the greatest ``take`` counts. Null times
    and null keys match nothing.
    """
    kind = left.schema[left_time].dataType
    time = right.filter(F.col(right_time).isNotNull()).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(right_time).cast(kind).alias("_t"), F.struct(*take).alias("_v"))
    keys = [f"_k{i}" for i in range(len(by))]
    r = time.na.drop(subset=keys).groupBy(*keys, "_t").agg(F.max("_v").alias("_v"))
    l = left.select(F.struct(*left.columns).alias("_row"), *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(left_time).alias("_t"))
    if not by and time.limit(most_broadcast + 1).count() <= most_broadcast:
        out = _searched(l, r, kind)
    else:
        out = _in_ranges(l, r, keys, kind, target)
    return out.select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in take])


def _ticks(t: Column, kind: T.DataType) -> Column:
    """A time as a number, for searching."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(t.cast("timestamp"))
    return F.unix_date(t) if isinstance(kind, T.DateType) else t.cast("double" if isinstance(kind, T.FractionalType) else "bigint")


def _places(spark: SparkSession, times: list) -> Callable[[Column], Column]:
    """How many of the sorted ``times`` are not after a time; null for null."""
    known = spark.sparkContext.broadcast(np.array(times, dtype=np.float64 if any(isinstance(t, float) for t in times) else np.int64))

    @F.pandas_udf("bigint")
    def place(t: pd.Series) -> pd.Series:
        some = t.notna().to_numpy()
        out = np.full(len(t), -1, dtype=np.int64)
        out[some] = np.searchsorted(known.value, t.to_numpy()[some].astype(known.value.dtype), "right")
        return pd.Series(out)

    return place


def _searched(l: DataFrame, r: DataFrame, kind: T.DataType) -> DataFrame:
    """Bisection in the times of a right side of checked size."""
    rows = r.withColumn("_i", F.row_number().over(Window.orderBy("_t")))  # of checked size
    times = [x["x"] for x in r.select(_ticks(F.col("_t"), kind).alias("x")).orderBy("x").collect()]
    place = _places(l.sparkSession, times)
    return l.withColumn("_i", place(_ticks(F.col("_t"), kind))).join(F.broadcast(rows.select(F.col("_i").cast("bigint").alias("_i"), "_v")), "_i", "left")


def _in_ranges(l: DataFrame, r: DataFrame, keys: list[str], kind: T.DataType, target: int) -> DataFrame:
    """Key and range of time are shuffled together; every range starts with the last value before it."""
    both = l.select("_t").unionByName(r.select("_t")).select(_ticks(F.col("_t"), kind).alias("x"))
    fine = 1024
    stats = both.agg(F.count("x").alias("n"), F.percentile_approx("x", [k / fine for k in range(1, fine)], F.lit(10_000)).alias("q")).first()
    ranges = min(fine, max(1, -(-stats["n"] // target)))
    q = stats["q"] or []
    place = _places(l.sparkSession, sorted({q[k * len(q) // ranges] for k in range(1, ranges)} if q else set()))
    l, r = (d.withColumn("_p", place(_ticks(F.col("_t"), kind))) for d in (l, r))
    group = [*keys, "_p"]
    # what each range of each key starts with
    ends = r.groupBy(*group).agg(F.max(F.struct("_t", "_v")).alias("_e"))
    size = l.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows a key as ranges
    starts = size.join(ends, group, "full").withColumn("_c", F.last("_e", ignorenulls=True).over(before)).filter("_n is not null")
    parts = F.ceil(F.col("_n") / target).cast("int")
    crowded = starts.filter(F.col("_n") > target).select(*group, parts.alias("_s"))
    salted = l.join(crowded, group, "left").withColumn("_salt", F.when(F.col("_s") > 1, F.pmod(F.xxhash64("_row"), F.col("_s"))).otherwise(0).cast("int")).drop("_s")
    carried = starts.filter("_c is not null").select(*group, F.col("_c._t").alias("_t"), F.col("_c._v").alias("_v"))
    values = r.select(*group, "_t", "_v").unionByName(carried).join(crowded, group, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
    row, v = l.schema["_row"].dataType, r.schema["_v"].dataType
    merged = salted.select(*group, "_salt", "_t", F.lit(1).alias("_side"), "_row", F.lit(None).cast(v).alias("_v")).unionByName(
        values.select(*group, "_salt", "_t", F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_row"), "_v")
    )
    w = Window.partitionBy(*group, "_salt").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_t").isNotNull())
    return merged.withColumn("_v", F.when(known, F.last("_v", ignorenulls=True).over(w))).filter("_side = 1")
