"""Compaction policy and the logical rewrite."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kvlake.operators import lww

#: Runs that a level may hold before it is merged into the next; the last level is never merged.
THRESHOLDS = (32, 16, 16, 16, 16, 16, 16, 16, 16)


def candidates(tables: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(level, n, threshold, due) of each level that has runs."""
    limit = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.least(F.col("level") + 1, F.lit(len(thresholds))).cast("int"))
    top = F.col("level") < len(thresholds)
    return (tables.groupBy("level").agg(F.count("*").alias("n"))
            .select("level", "n", F.when(top, limit.cast("long")).alias("threshold"), F.when(top, F.col("n") >= limit).otherwise(F.lit(False)).alias("due")))


def compact(versions: DataFrame, purge: bool = False) -> DataFrame:
    """The merged run: the newest version per key. Tombstones stay unless nothing deeper or older can hold the key."""
    merged = lww.latest(versions)
    return merged.filter(~F.col("tombstone")) if purge else merged
