"""Point and set lookups over a log or snapshot."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kvlake.functions import bloom
from kvlake.operators import lww, ordered
from kvlake.sources import scratch


def point_get(log: DataFrame, key: str) -> DataFrame:
    """The live version of one key, or no row. The equality is pushed to the scan before the aggregate."""
    return lww.live(log.filter(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per distinct probe key; `value` is NULL and `found` false where the key is absent or deleted.

    The semi-join lets Spark choose: a small probe set is broadcast by its measured size, a large one is shuffled."""
    wanted = keys.select("key").distinct()
    hits = lww.live(log.join(wanted, "key", "left_semi")).withColumn("found", F.lit(True))
    return wanted.join(hits, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(log: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Extension: live entries with low <= key <= high."""
    if low is not None:
        log = log.filter(F.col("key") >= low)
    if high is not None:
        log = log.filter(F.col("key") <= high)
    return lww.live(log)


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    """Extension: live entries whose key starts with `prefix`."""
    return lww.live(log.filter(F.col("key").startswith(prefix)))


def fence_prune(keys: DataFrame, fences: DataFrame) -> DataFrame:
    """(key, run) for the runs whose inclusive key range may hold the key; a missing fence prunes nothing."""
    return ordered.intervals(keys.select("key"), fences.select("run", "min_key", "max_key"), "min_key", "max_key", "key").select("key", "run")


def _steps(keys: DataFrame, indexes: list[tuple[DataFrame, str, list[str]]], by: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Pieces of ranks of the sorted keys on which a run's floors stay the same, as (by, p0, p1, .., __lo, __hi), the keys
    with their ranks, and how many keys and runs there are.

    Keys and index rows are merged by one sort over range partitions; a window inside a partition carries floors forward
    and ends a piece where the run's next begins, and a partition takes both over from those beside it."""
    kinds = [index.select(F.struct(*payload).alias("p")).schema["p"].dataType for index, _, payload in indexes]
    ps = [f"p{n}" for n in range(len(indexes))]
    run = indexes[0][0].schema[by].dataType
    marks = [index.select(F.col(at).alias("key"), F.lit(0).alias("__kind"), by, *[(F.struct(*payload) if p == f"p{n}" else F.lit(None).cast(kind)).alias(p) for p, kind in zip(ps, kinds)]) for n, (index, at, payload) in enumerate(indexes)]
    probes = keys.select("key").distinct().select("key", F.lit(1).alias("__kind"), F.lit(None).cast(run).alias(by), *[F.lit(None).cast(kind).alias(p) for p, kind in zip(ps, kinds)])
    rows = ordered.placed(lww.union_all(probes, *marks), "key", "__kind", by)
    points, rows = rows.filter("__kind = 1").select("__rank", "key"), rows.filter("__kind = 0")
    total, share = points.count(), [by, ordered.PART]
    shares = rows.groupBy(*share).agg(F.min("__rank").alias("first"), *[F.max_by(p, F.when(F.col(p).isNotNull(), F.col(ordered.ROW))).alias(p) for p in ps])
    along = Window.partitionBy(by).orderBy(ordered.PART)
    beside = shares.select(*share, F.lead("first").over(along).alias("next"), *[F.last(p, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"carried_{p}") for p in ps])
    here = ordered.earlier_rows([by], inclusive=True)
    rows = rows.join(beside, share).withColumns({
        "__lo": F.col("__rank"), "__hi": F.coalesce(F.lead("__rank").over(Window.partitionBy(*share).orderBy(ordered.ROW)), F.col("next"), F.lit(total)),
        **{p: F.coalesce(F.last(p, ignorenulls=True).over(here), F.col(f"carried_{p}")) for p in ps}})
    heads = shares.groupBy(by).agg(F.lit(0).cast("long").alias("__lo"), F.min("first").alias("__hi")).select(by, *[F.lit(None).cast(kind).alias(p) for p, kind in zip(ps, kinds)], "__lo", "__hi")
    return rows.select(heads.columns).unionByName(heads), points, total, shares.select(by).distinct().count()


def floor_join(keys: DataFrame, index: DataFrame, index_key: str, payload: list[str], by: str = "run") -> DataFrame:
    """As-of lookup: for each key and run, the payload of the greatest index key that is not above it, else NULLs."""
    pieces, points, total, runs = _steps(keys, [(index, index_key, payload)], by)
    both = ordered.with_points(ordered.blocks_of(pieces), points, total, runs, by, strips=True)
    return both.select(by, *[F.col("p0")[c].alias(c) for c in payload], F.inline(ordered.part_of_strip())).select(by, "key", *payload)


def _by_size(filters: DataFrame, by: str) -> tuple[DataFrame, DataFrame | None, int, int]:
    """Filters of one segment, the others if there are any, the number of the former and their greatest hash count."""
    filters = scratch.written(filters, "filters")
    one = F.col("bit_count") <= bloom.SEGMENT * 64
    n, most, all_ = filters.agg(F.count_if(one), F.max(F.when(one, F.col("hash_count"))), F.count("*")).first()
    return filters.filter(one), filters.filter(~one) if all_ > n else None, n, most or 0


def bloom_probe(keys: DataFrame, filters: DataFrame, by: str = "run") -> DataFrame:
    """(by, bit_count, hash_count, key, maybe) for every distinct key and run, as `bloom.probe` gives it.

    A filter of one segment, as all but large runs have, meets blocks of keys whole; larger ones are read by segment."""
    spark = keys.sparkSession
    keys = keys.select("key").distinct()
    small, large, runs, most = _by_size(filters, by)
    points = ordered.ranked(bloom.with_hash_pair(keys), "key", rank="__rank")
    total = keys.count()
    whole = small.select(by, "bit_count", "hash_count", "words", F.lit(0).cast("long").alias("__lo"), F.lit(total).cast("long").alias("__hi"))
    both = ordered.with_points(ordered.blocks_of(whole), points, total, runs, by)
    rows = both.select(by, "bit_count", "hash_count", "words", F.inline("__points"))
    with bloom.wrapping(spark):
        rows = rows.select(by, "bit_count", "hash_count", "key", bloom.is_member("words", "h1", "h2", F.col("bit_count"), F.col("hash_count"), most).alias("maybe"))
    return rows if large is None else rows.unionByName(bloom.probe(keys, large, by))


def debug_lookup(keys: DataFrame, filters: DataFrame, sparse: DataFrame, blocks: DataFrame, by: str = "run") -> DataFrame:
    """What each run would do for each key: the filter's verdict, the floor block and the sparse offset.

    Both floors come from one sort; a run's pieces in a block of keys share a row with its filter. For runs of several
    segments the filter's verdicts are joined."""
    spark = keys.sparkSession
    keys = keys.select("key").filter("key is not null").distinct()
    small, large, _, most = _by_size(filters, by)
    pieces, points, total, runs = _steps(keys, [(blocks, "first_key", ["first_key", "off", "entry_count", "byte_len"]), (sparse, "key", ["off"])], by)
    points = scratch.written(bloom.with_hash_pair(points), "hashed")
    grouped = ordered.blocks_of(pieces).groupBy(by, "__block").agg(F.collect_list(F.struct("p0", "p1", "__lo", "__hi")).alias("pieces"))
    shown = ["p0.first_key", F.col("p0.off").alias("block_off"), "p0.entry_count", "p0.byte_len", F.coalesce("p1.off", F.lit(0)).alias("sparse_offset")]

    def pairs(rows, *kept):
        rows = ordered.with_points(rows, points, total, runs, by).select(by, "__block", "__points", *kept, F.inline("pieces"))
        return rows.select(by, *kept, "p0", "p1", F.inline(ordered.part_of_block()))

    rows = pairs(grouped.join(small, by), "bit_count", "hash_count", "words")
    with bloom.wrapping(spark):
        maybe = bloom.is_member("words", "h1", "h2", F.col("bit_count"), F.col("hash_count"), most).alias("bloom_maybe")
        rows = rows.select(by, "key", maybe, *shown)
    if large is None:
        return rows
    verdict = bloom.probe(keys, large, by).select(by, "key", F.col("maybe").alias("bloom_maybe"))
    rest = pairs(grouped.join(large.select(by).distinct(), by)).select(by, "key", *shown)
    return rows.unionByName(rest.join(verdict, [by, "key"]).select(rows.columns))
