"""Helpers shared by the operators: table access, grouped Arrow streams, connected components."""
from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kvlake.operators.grouped import group_bounds, whole_groups  # noqa: F401  the operators take them from here
from kvlake.sources import scratch

#: The white space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The frame's schema with a field more."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    name = "_kvlake_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name))).setdefault("held", {})


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python objects exist for few rows at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b) of longs; component is the smallest node.

    Large-star and small-star rounds: every node points its larger neighbours at the smallest node it knows. Rows per
    round never exceed the edges', hubs are combined map-side or split by the join, and each round is written to
    shared storage. Isolated nodes and edges with NULLs do not appear."""
    def measure(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("a is not null and b is not null and a <> b").distinct()

    e = scratch.written(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    seen = measure(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join sees two plain shuffles and splits a hub
        low = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = scratch.written(tidy(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        low2 = scratch.written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low2, "a")
        e2 = tidy(small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b"))
        e, old = scratch.written(e2, "edges"), e
        scratch.drop(old, low, large, low2)
        now = measure(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct()
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    out._scratch = [e]  # for the caller to drop when it has read the result
    return out
