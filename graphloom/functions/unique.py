"""Exactly one candidate, or none: ambiguity never makes an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def exactly_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of ``keys`` with their ``value`` where just one distinct value is there.
    One partial aggregation; no group is gathered."""
    found = df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_high"))
    return found.filter(F.col(value) == F.col("_high")).drop("_high")


def first_tier(df: DataFrame, keys: list[str], tier: str, value: str) -> DataFrame:
    """The lowest tier that has candidates, and its value if it has just one: a tier
    that is ambiguous stops the search."""
    best = df.groupBy(*keys, tier).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    best = best.groupBy(*keys).agg(F.min(F.struct(tier, "lo", "hi")).alias("b"))
    return best.filter("b.lo = b.hi").select(*keys, F.col(f"b.{tier}").alias(tier), F.col("b.lo").alias(value))


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1: a sort over all partitions and
    the partitions' row counts, no window over everything."""
    rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    rows, base, at = stored(rows, "numbered"), [], 0
    for r in sorted(rows.groupBy("_part").count().collect()):
        base.append((r["_part"], at))
        at += r["count"]
    before = df.sparkSession.createDataFrame(base, "_part int, _base long")
    place = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "_part").withColumn(name, place).drop("_part", "_at", "_base")
