"""Order statistics of large groups: counts by bucket first, then a look inside one bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fine_log(value: Column) -> Column:
    """Buckets of positive values: 64 to each doubling."""
    return F.floor(F.log2(value.cast("double")) * 64)


def nth_values(rows: DataFrame, key: str, value: str, bucket: Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``key, all_n`` and for each name of ``ranks`` the value at that place (from 1, given the number of values) of the group in order.

    ``bucket`` never falls as ``value`` grows.  The counts of buckets are few; only
    the values of the bucket that holds a place are ordered.  Groups are large and
    few, so the places (a row per group and rank) are broadcast.
    """
    w = Window.partitionBy(key)
    counted = rows.groupBy(key, bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    placed = counted.select("*", F.sum("__n").over(w.orderBy("__b")).alias("__upto"), F.sum("__n").over(w).alias("all_n"))
    wanted = placed.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("all_n")).cast("long").alias("at")) for n, f in ranks.items()])).alias("__w"))
    before = F.col("__upto") - F.col("__n")
    wanted = wanted.where((F.col("__w.at") <= F.col("__upto")) & (F.col("__w.at") > before)).select(key, "__b", "all_n", F.col("__w.name").alias("__name"), (F.col("__w.at") - before).alias("__inside"))
    inside = rows.select(key, value, bucket.alias("__b")).join(F.broadcast(wanted), [key, "__b"]).groupBy(key, "all_n", "__name", "__inside", value).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(key, "__name").orderBy(value))
    found = inside.select(key, "all_n", "__name", value, (upto >= F.col("__inside")).alias("__there"))
    return found.groupBy(key, "all_n").agg(*[F.min(F.when((F.col("__name") == n) & F.col("__there"), F.col(value))).alias(n) for n in ranks])


def medians(rows: DataFrame, key: str, value: str, bucket: Column, name: str) -> DataFrame:
    """``key, all_n`` and the median of each group: the middle value, or the mean of the two."""
    both = nth_values(rows, key, value, bucket, {"__low": lambda n: F.floor((n + 1) / 2), "__high": lambda n: F.floor(n / 2) + 1})
    return both.select(key, "all_n", ((F.col("__low") + F.col("__high")) / 2).alias(name))
