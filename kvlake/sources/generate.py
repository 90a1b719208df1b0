"""Load generators."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# The multiplier, increment and seed of the benchmark's key sequence.
LCG = (6364136223846793005, 1442695040888963407, 0x0123456789ABCDEF)


def people(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Keys "0".."n-1" with a JSON text of name, seeded age below 100 and location."""
    age = F.pmod(F.col("id") * 7919 + seed, F.lit(100))
    text = F.concat(F.lit('{"name": "Person'), F.col("id").cast("string"), F.lit('", "age": '), age.cast("string"), F.lit(', "location": "ca"}'))
    return spark.range(n).select(F.col("id").cast("string").alias("key"), text.alias("value"))


def _sequence(first: int, n: int) -> np.ndarray:
    """Terms first + 1 to first + n of the key sequence: x becomes x * multiplier + increment mod 2**64, from the seed.

    k steps at once are x * A + C, so that each task starts at its own place."""
    a, c, x = LCG
    jump, mask = (1, 0), (1 << 64) - 1
    step, k = (a, c), first
    while k:
        if k & 1:
            jump = (jump[0] * step[0] & mask, (jump[1] * step[0] + step[1]) & mask)
        step = (step[0] * step[0] & mask, (step[1] * step[0] + step[1]) & mask)
        k >>= 1
    x = (x * jump[0] + jump[1]) & mask
    many, plus = np.full(n, a, np.uint64), np.full(n, c, np.uint64)
    np.multiply.accumulate(many, out=many)  # wraps at 64 bits
    plus = np.concatenate([np.ones(1, np.uint64), many[:-1]]) * np.uint64(c)
    np.add.accumulate(plus, out=plus)
    return many * np.uint64(x) + plus


def _terms(spark: SparkSession, first: int, n: int, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            if len(i):
                yield make(i, _sequence(first + int(i[0]), len(i)))  # a batch of a range is consecutive

    return spark.range(n).mapInArrow(run, schema)


def random_keys(spark: SparkSession, n: int) -> DataFrame:
    """(key, value, i): the decimal text of the sequence's terms and their 8 little-endian bytes, in order of `i`."""
    def make(i, x):
        raw = pa.Array.from_buffers(pa.binary(8), len(x), [None, pa.py_buffer(x.astype("<u8").tobytes())])
        return pa.record_batch([pa.array(x).cast(pa.string()), raw.cast(pa.binary()), pa.array(i)], ["key", "value", "i"])

    return _terms(spark, 0, n, make, "key string, value binary, i long")


def random_reads(spark: SparkSession, written: int, n: int) -> DataFrame:
    """(key): of the `written` first keys, those that the sequence's next `n` terms choose by remainder."""
    places = _terms(spark, written, n, lambda i, x: pa.record_batch([pa.array((x % np.uint64(written)).astype(np.int64))], ["i"]), "i long")
    return random_keys(spark, written).select("key", "i").join(F.broadcast(places.distinct()) if n <= 1 << 20 else places.distinct(), "i", "left_semi").select("key")
