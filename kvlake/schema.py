"""The one logical schema: an append-only log of versioned upserts and deletes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MUTATION = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False),
])

#: Greatest value length that the encoded form can hold (a signed 32-bit length).
MAX_VALUE_BYTES = (1 << 31) - 1


def mutation_log(df: DataFrame, key: Column, value: Column, seq: Column, tombstone: Column | None = None, **extra: Column) -> DataFrame:
    """`df` as a mutation log. Deleted rows carry a NULL value; an empty value is a value."""
    dead = F.coalesce(tombstone, F.lit(False)) if tombstone is not None else F.lit(False)
    return df.select(
        key.cast("string").alias("key"),
        F.when(~dead, value).alias("value"),
        dead.alias("tombstone"),
        seq.cast("long").alias("seq"),
        *[c.alias(name) for name, c in extra.items()],
    )
