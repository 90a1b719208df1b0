"""Immutable sorted runs as Parquet with key statistics and a bloom filter on the key."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.functions.bloom import BloomConfig
from kvlake.functions.codec import encoded_size
from kvlake.schema import MUTATION


def write_run(df: DataFrame, path: str, ndv: int | None = None, config: BloomConfig = BloomConfig(), partitions: int | None = None) -> None:
    """Range-partitioned by key and sorted within files: disjoint fences per file, spill-aware, no single sorter.

    `ndv` sizes the bloom filter; without it the writer would reserve its maximum for every file."""
    parts = [partitions] if partitions else []
    out = df.repartitionByRange(*parts, "key").sortWithinPartitions("key").write
    if ndv:
        out = (out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(ndv, 1)))
               .option("parquet.bloom.filter.fpp#key", str(0.6185 ** max(config.bits_per_key, 1))))
    out.parquet(path)


def scan_run(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(MUTATION).parquet(*paths)


def describe(spark: SparkSession, path: str, table_id: int, level: int) -> dict:
    """The manifest entry of a run: fence, counts and greatest seq, by one aggregate."""
    r = (scan_run(spark, path).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"),
         F.coalesce(F.sum(encoded_size(F.col("key"), F.col("value"))), F.lit(0)).alias("bytes"), F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq")).first())
    return {"table_id": table_id, "level": level, "path": path, **r.asDict()}
