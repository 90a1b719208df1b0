"""Last-writer-wins resolution: one recency order everywhere, seq descending, then the newer table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def latest(log: DataFrame, *by: str, tie: str | None = None) -> DataFrame:
    """One row per key (and `by`): the version of greatest seq, tombstones included.

    An aggregate with map-side combining, so a key with a third of all versions costs one row per task in the shuffle."""
    rest = [c for c in log.columns if c not in ("key", *by)]
    order = F.struct("seq", *([tie] if tie else []))
    picked = log.groupBy(*by, "key").agg(F.max_by(F.struct(*rest), order).alias("v"))
    return picked.select(*by, "key", *[F.col("v")[c].alias(c) for c in rest]).select(log.columns)


def live(log: DataFrame, *by: str, tie: str | None = None) -> DataFrame:
    """What a reader sees: the latest versions without tombstones."""
    return latest(log, *by, tie=tie).filter(~F.col("tombstone"))


def first_hit(versions: DataFrame) -> DataFrame:
    """Positional recency: the lowest level and, within it, the newest table that holds the key."""
    rest = [c for c in versions.columns if c != "key"]
    v = versions.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(-F.col("level"), F.col("table_id"))).alias("v"))
    return v.select("key", *[F.col("v")[c].alias(c) for c in rest])


def union_all(*logs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, logs)


def merge_runs(versions: DataFrame, run: str = "run") -> DataFrame:
    """Ordered multiset union of sorted runs: `ord` is a version's place among its key's, newest first."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"), F.asc(run))
    return versions.withColumn("ord", F.row_number().over(order).cast("long"))


def sorted_scan(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """All entries in byte order of the key, range-partitioned so that no task sorts everything."""
    parts = [partitions] if partitions else []
    return df.repartitionByRange(*parts, "key").sortWithinPartitions("key")


def ranked_scan(df: DataFrame) -> DataFrame:
    """`sorted_scan` with the entry's global ordinal `i` from 0: a partition's rows count on from those before it."""
    from kvlake.operators import ordered

    return ordered.ranked(df, "key")
