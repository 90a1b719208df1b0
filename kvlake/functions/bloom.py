"""Bloom filter as native expressions: double hashing with two 64-bit byte folds.

The folds need multiplication that wraps at 64 bits. Arithmetic raises under ANSI mode, which is fixed when an
expression is analysed, so the columns are attached inside `wrapping`, which restores the session afterwards.
"""
from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The hash constants that membership bits depend on.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
SECOND_BASIS_MASK = 0x9E3779B97F4A7C15
SECOND_PRIME_MASK = 0x517CC1B727220A95
SECOND_BYTE_ADD = 0x9E

MOD64 = "18446744073709551616"
#: Words of a segment of a filter: 64 KB, so that no filter is one row.
SEGMENT_BITS = 13
SEGMENT = 1 << SEGMENT_BITS


@dataclass(frozen=True)
class BloomConfig:
    bits_per_key: int = 8
    hash_count: int = 6

    @property
    def k(self) -> int:
        return max(self.hash_count, 1)

    def bits(self, n: Column) -> Column:
        return F.greatest(F.greatest(n, F.lit(1)) * max(self.bits_per_key, 1), F.lit(8)).cast("long")


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


@contextmanager
def wrapping(spark: SparkSession):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def _bytes(key: Column) -> Column:
    raw = F.encode(key, "UTF-8")
    n = F.octet_length(key)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))


def with_hash_pair(df: DataFrame, key: str = "key", h1: str = "h1", h2: str = "h2") -> DataFrame:
    """Two signed 64-bit hashes of the key's UTF-8 bytes; the second is forced odd."""
    with wrapping(df.sparkSession):
        one = F.aggregate(_bytes(F.col(key)), F.lit(signed(FNV_BASIS)), lambda h, b: h.bitwiseXOR(b) * F.lit(FNV_PRIME))
        two = F.aggregate(
            _bytes(F.col(key)), F.lit(signed(FNV_BASIS ^ SECOND_BASIS_MASK)),
            lambda h, b: h.bitwiseXOR(b + SECOND_BYTE_ADD) * F.lit(signed(FNV_PRIME ^ SECOND_PRIME_MASK)),
        ).bitwiseOR(F.lit(1))
        return df.withColumns({h1: one, h2: two})


def _position(i: Column, bits: Column, h1: str, h2: str) -> Column:
    """(h1 + i*h2 mod 2^64) mod bits, unsigned: twice the upper 63 bits and the last one."""
    x = F.col(h1) + i * F.col(h2)
    return (F.shiftrightunsigned(x, 1) % bits * 2 + x.bitwiseAND(F.lit(1).cast("long"))) % bits


def with_probe_bits(df: DataFrame, bits: Column, k: int, h1: str = "h1", h2: str = "h2", out: str = "probe") -> DataFrame:
    """The k bit positions (h1 + i*h2 mod 2^64) mod bits, unsigned."""
    with wrapping(df.sparkSession):
        return df.withColumn(out, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: _position(i, bits, h1, h2)))


def build(entries: DataFrame, by: str = "run", config: BloomConfig = BloomConfig()) -> DataFrame:
    """(by, bit_count, hash_count, seg, words): the set bits of each run, sized from its own entry count, as 64-bit words
    in segments of `SEGMENT`. Words after a segment's last set bit are left out."""
    sizes = entries.groupBy(by).agg(config.bits(F.count("*")).alias("bit_count"))
    hashed = with_hash_pair(entries.select(by, "key")).join(sizes, by)
    probed = with_probe_bits(hashed, F.col("bit_count"), config.k)
    bits = probed.select(by, "bit_count", F.explode("probe").alias("bit"))
    words = bits.groupBy(by, "bit_count", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w"))
    pair = F.struct((F.col("word") % SEGMENT).cast("int").alias("at"), "w")
    set_ = words.groupBy(by, "bit_count", F.expr(f"word div {SEGMENT}").alias("seg")).agg(F.array_sort(F.collect_list(pair)).alias("set"))
    earlier = F.concat(F.array(F.lit(-1)), F.transform("set", lambda x: x["at"]))
    dense = F.flatten(F.zip_with("set", F.slice(earlier, F.lit(1), F.size("set")), lambda x, e: F.concat(F.array_repeat(F.lit(0).cast("long"), x["at"] - e - 1), F.array(x["w"]))))
    return set_.select(by, "bit_count", F.lit(config.k).alias("hash_count"), "seg", dense.alias("words"))


def set_bits(filters: DataFrame, by: str = "run") -> DataFrame:
    """(by, bit_count, hash_count, bit): the set bits one by one."""
    at = F.expr(f"transform(filter(sequence(0, 63), k -> (shiftrightunsigned(w, k) & 1L) = 1L), k -> (seg * {SEGMENT} + i) * 64 + k)")
    return filters.select(by, "bit_count", "hash_count", "seg", F.posexplode("words").alias("i", "w")).select(by, "bit_count", "hash_count", F.explode(at).alias("bit"))


def probe(keys: DataFrame, filters: DataFrame, by: str = "run") -> DataFrame:
    """(by, bit_count, hash_count, key, maybe) for every distinct key and run; `maybe` is never false for a member.

    A key goes to the segments its bits lie in, one for all but large runs, and each bit is read by its place."""
    spark = keys.sparkSession
    runs = filters.select(by, "bit_count", "hash_count").distinct()
    # the keys are few bytes, the pairs are not: by number, so that they are not put together again
    pairs = with_hash_pair(keys.select("key").distinct()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").crossJoin(runs)
    with wrapping(spark):
        at = F.transform(F.sequence(F.lit(0).cast("long"), (F.col("hash_count") - 1).cast("long")), lambda i: _position(i, F.col("bit_count"), "h1", "h2"))
        rows = pairs.withColumn("at", at).drop("h1", "h2")
    rows = rows.withColumn("seg", F.explode(F.array_distinct(F.transform("at", lambda p: F.shiftright(p, 6 + SEGMENT_BITS)))))
    rows = rows.join(filters.select(by, "seg", "words"), [by, "seg"], "left")
    here = F.filter("at", lambda p: F.shiftright(p, 6 + SEGMENT_BITS) == F.col("seg"))
    word = lambda p: F.coalesce(F.try_element_at("words", (F.shiftright(p, 6) % SEGMENT + 1).cast("int")), F.lit(0).cast("long"))
    is_set = F.forall(F.transform(here, lambda p: F.struct(word(p).alias("w"), (p % 64).cast("int").alias("k"))), lambda x: F.getbit(x["w"], x["k"]) == 1)
    return rows.select(by, "bit_count", "hash_count", "key", is_set.alias("set")).groupBy(by, "bit_count", "hash_count", "key").agg(F.bool_and("set").alias("maybe"))


def is_member(words: str, h1: str, h2: str, bits: Column, k: Column, most: int) -> Column:
    """Whether all bits of a key are set in a filter of one segment; `most` is the greatest `k`. To be called inside `wrapping`.

    Written out bit by bit: the first that is not set ends it, and nothing is interpreted."""
    out = F.lit(True)
    for i in range(most):
        at = _position(F.lit(i).cast("long"), bits, h1, h2)
        is_set = F.coalesce(F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1, F.lit(False))
        out = out & (is_set if not i else (k <= i) | is_set)
    return out


def segments(key: str, bit_count: int, config: BloomConfig = BloomConfig()) -> set[int]:
    """The segments that one key's bits lie in, for reading no others."""
    def fold(basis: int, prime: int, add: int) -> int:
        for b in key.encode():
            basis = ((basis ^ (b + add)) * prime) & ((1 << 64) - 1)
        return basis

    one, two = fold(FNV_BASIS, FNV_PRIME, 0), fold(FNV_BASIS ^ SECOND_BASIS_MASK, FNV_PRIME ^ SECOND_PRIME_MASK, SECOND_BYTE_ADD) | 1
    return {((one + i * two) & ((1 << 64) - 1)) % bit_count >> (6 + SEGMENT_BITS) for i in range(config.k)}
