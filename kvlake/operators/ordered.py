"""Work along a global order without a task that sees it all: range partitions, and what each hands to the next.

A table is dealt into range partitions and written once, so that its partitions and places are facts of the files and
not of a plan that may be run twice. What passes from one partition to the next (row counts, sums, last values) is one
row per partition and group; only windows over those rows follow a whole group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kvlake.sources import scratch

PART, ROW = "__part", "__row"
#: Ranks that share a block, and pairs that a block and a share of its pieces make at most, about.
BLOCK = 8192
PAIRS = 1 << 23
#: Ranks of a block that follow each other for one piece after the other; 504 values are a bit-packed run of Parquet.
STRIP = 504


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` in range partitions of `order`, with each row's partition and its place in it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    written = scratch.written(rows, "ordered")
    return written.select(*df.columns, F.shiftright("__id", 33).alias(PART), F.col("__id").bitwiseAND((1 << 33) - 1).alias(ROW))


def before(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """(by, part, first row, sums): what lies before each partition's share of each group."""
    shares = rows.groupBy(*by, PART).agg(F.min(ROW).alias("__first"), *[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return shares.select(*by, PART, "__first", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def earlier_rows(by: list[str], inclusive: bool = False):
    """The window over a group's rows in one partition up to the current one."""
    return Window.partitionBy(*by, PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def ranked(df: DataFrame, *order: str, rank: str = "i") -> DataFrame:
    """`df` with the row's global ordinal from 0."""
    rows = numbered(df, *order)
    base = before(rows, [], __n=F.lit(1))
    return rows.join(F.broadcast(base), PART).withColumn(rank, F.col("__n") + F.col(ROW)).select(*df.columns, rank)  # one row per partition


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows`, written, with their partition, place, and the number of points (rows of `__kind` 1) before each in `order`."""
    kept = rows.columns
    rows = numbered(rows, *order)
    point = F.when(F.col("__kind") == 1, 1).otherwise(0)
    base = before(rows, [], __n=point)
    rows = rows.join(F.broadcast(base), PART).withColumn("__rank", F.col("__n") + F.coalesce(F.sum(point).over(earlier_rows([])), F.lit(0)))
    return scratch.written(rows.select(*kept, PART, ROW, "__rank"), "ranks")


def blocks_of(pieces: DataFrame) -> DataFrame:
    """Each piece of ranks [`__lo`, `__hi`) with each block that it meets."""
    return pieces.filter("__hi > __lo").withColumn("__block", F.explode(F.sequence(F.expr(f"__lo div {BLOCK}"), F.expr(f"(__hi - 1) div {BLOCK}"))))


def _part(start: Column) -> Column:
    """Of the points from the rank `start` on, those that a piece holds."""
    low = F.greatest(F.col("__lo") - start, F.lit(0))
    n = F.least(F.col("__hi") - start, F.size("__points")) - low
    return F.when(n >= F.size("__points"), F.col("__points")).otherwise(F.slice("__points", (low + 1).cast("int"), n.cast("int")))


def part_of_block() -> Column:
    """Of the points of a block, those that a piece holds."""
    return _part(F.col("__block") * BLOCK)


def part_of_strip() -> Column:
    """Of the points of a strip, those that a piece holds."""
    return _part(F.col("__block") * BLOCK + F.col("__strip") * STRIP)


def with_points(rows: DataFrame, points: DataFrame, total: int, groups: int, by: str, strips: bool = False) -> DataFrame:
    """`rows`, of `groups` values of `by` and a `__block`, with the block's points as one array `__points`.

    Pairs are made only when the array is unpacked, after the last shuffle: what moves is a row for a group and block, and
    each block once for a share of the groups. Shuffles are by number, as their bytes do not tell the pairs.

    With `strips`, pieces meet the strips of a block and come strip by strip: a stored result repeats few keys at a time,
    which dictionaries find and files compress well."""
    columns = [c for c in points.columns if c != "__rank"]
    shares, blocks = 1 + groups * BLOCK // PAIRS, 1 + total // BLOCK
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(2 * blocks * shares, max(wanted, total * groups // PAIRS))
    packed = points.groupBy(F.expr(f"__rank div {BLOCK}").alias("__block")).agg(F.array_sort(F.collect_list(F.struct("__rank", *columns))).alias("__points"))
    packed = packed.withColumn("__points", F.transform("__points", lambda x: F.struct(*[x[c].alias(c) for c in columns])))
    packed = packed.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    rows = rows.withColumn("__share", F.pmod(F.xxhash64(by), F.lit(shares)).cast("int"))
    rows, packed = (x.repartition(parts, "__block", "__share") for x in (rows, packed))
    if strips:
        first, last = (f"cast(({at} - __block * {BLOCK}) div {STRIP} as int)" for at in (f"greatest(__lo, __block * {BLOCK})", f"least(__hi, (__block + 1) * {BLOCK}) - 1"))
        rows = rows.withColumn("__strip", F.explode(F.sequence(F.expr(first), F.expr(last))))
        # a sort right below a join would be dropped, but not below this filter, which all rows pass
        rows = rows.sortWithinPartitions("__block", "__share", "__strip", by, "__lo").filter(F.monotonically_increasing_id() >= 0)
        packed = packed.withColumn("__points", F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(__points) - 1) div {STRIP} as int)")), lambda i: F.slice("__points", i * STRIP + 1, F.lit(STRIP))))
    both = rows.join(packed, ["__block", "__share"])
    return both.withColumn("__points", F.col("__points")[F.col("__strip")]) if strips else both


def intervals(points: DataFrame, spans: DataFrame, low: str, high: str, on: str) -> DataFrame:
    """Each row of `spans` with each row of `points` whose `on` lies in [low, high], both ends included; a NULL end is open.

    Ends are placed among the sorted points, and the ranks between them meet the points block by block in an equal join:
    the work is a sort and the result, not all pairs."""
    spans = spans.withColumn("__span", F.monotonically_increasing_id())
    spans = scratch.written(spans, "spans")
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c != on]
    marks = points.select(on, *[c for c in points.columns if c != on], F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__span"))
    for column, kind in ((low, 0), (high, 2)):
        marks = marks.unionByName(spans.filter(F.col(column).isNotNull()).select(F.col(column).alias(on), *none, F.lit(kind).alias("__kind"), "__span"))
    rows = placed(marks, on, "__kind")
    ends = rows.filter("__kind <> 1").groupBy("__span").agg(F.max(F.when(F.col("__kind") == 0, F.col("__rank"))).alias("__lo"), F.max(F.when(F.col("__kind") == 2, F.col("__rank"))).alias("__hi"))
    met = rows.filter("__kind = 1").select("__rank", *points.columns)
    total = met.count()
    full = spans.join(ends, "__span", "left").withColumns({"__lo": F.coalesce("__lo", F.lit(0)), "__hi": F.coalesce("__hi", F.lit(total))})
    both = with_points(blocks_of(full), met, total, spans.count(), "__span", strips=True)
    return both.select(*[c for c in spans.columns if c != "__span"], F.inline(part_of_strip()))
