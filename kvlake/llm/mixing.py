"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Each source's target is its weight's share of the budget, clamped at `max_epochs` times its size; what is over goes to
the other sources by weight until none is above. A source repeats all its documents whole as often as its target
holds; the rest of its target is filled in a seeded order of its documents, the last of them in part.

Sources are taken in code-point order, NULL last, and weigh 1, 2, 3, repeating. Sizes are word counts; a NULL or empty
text has size 0 and takes 0. A source of size 0 has target 0. Rows that repeat a doc_id each count. A NULL doc_id is
ordered like any other; documents that tie in the seeded order have the same doc_id and size, and go by their text's hash.
Very long texts are sized whole. There may be as many sources as documents. Empty tables give empty results; further
columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kvlake.llm.common import WORD
from kvlake.operators import ordered
from kvlake.sources import scratch

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, 42
#: Hex digits of the seeded hash by which a source's documents are grouped: a group holds about 1/4096 of its source.
DIGITS = 3


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    return docs.select(*([F.col(row).alias("row")] if row else []), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(source, source_size, target). Sources are ordered in range partitions; no task sees them all.

    With sources ordered by cap over weight, the clamped ones are a prefix: a source is clamped if its cap is below
    its share of what the clamped ones before it leave."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = ordered.ranked(per, "last", "source", rank="rank").withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    rows = ordered.numbered(rows.withColumn("fill", F.col("cap") / F.col("w")), "fill", "last", "source")
    all_ = rows.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("size")).first()
    rows = rows.join(F.broadcast(ordered.before(rows, [], __cap=F.col("cap"), __w=F.col("w"))), ordered.PART)  # a row a partition
    here = lambda c: F.coalesce(F.sum(c).over(ordered.earlier_rows([])), F.lit(0))
    total = F.lit(float(budget if budget is not None else all_["size"]))
    rows = rows.withColumn("left", total - (F.col("__cap") + here("cap"))).withColumn("w_left", F.lit(all_["w"]) - (F.col("__w") + here("w")))
    rows = scratch.written(rows.withColumn("level", F.col("left") / F.col("w_left")), "levels")
    first = rows.filter(F.col("cap") >= F.col("w") * F.col("level")).agg(F.min(F.struct(ordered.PART, ordered.ROW, "level")).alias("at")).first()["at"]
    cap = F.col("cap").cast("double")
    if first is None:
        return rows.select("source", "source_size", cap.alias("target"))
    clamped = F.struct(ordered.PART, ordered.ROW) < F.struct(F.lit(first[0]).cast("long").alias(ordered.PART), F.lit(first[1]).cast("long").alias(ordered.ROW))
    return rows.select("source", "source_size", F.when(clamped, cap).otherwise(F.col("w") * F.lit(first[2])).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float | None = None, seed: int = SEED, row: str | None = None) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, whole, part, taken): key is the text's hash, `whole` copies of the document and `part` words of one more.
    With `row`, a column that tells rows apart, that column too, as `row`.

    The order within a source is by a seeded hash. Its first hex digits make groups whose sizes are summed map-side;
    running sums over those sums say where the fill ends, and rows are ordered only inside a group."""
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    sized = sizes(docs, row).withColumn("h", seeded).withColumn("g", F.substring("h", 1, DIGITS))
    sized = scratch.written(sized, "sizes")
    goal = targets(sized, weights, max_epochs, budget)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sized.groupBy("source", "g").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(running), F.lit(0)))
    groups = groups.select(F.col("source").alias("source_"), F.col("g").alias("g_"), "before")
    goal = goal.withColumnRenamed("source", "goal_")
    groups = groups.join(goal, F.col("source_").eqNullSafe(F.col("goal_"))).drop("goal_")
    rows = sized.join(groups, F.col("source").eqNullSafe(F.col("source_")) & (F.col("g") == F.col("g_"))).drop("source_", "g_")
    inner = Window.partitionBy("source", "g").orderBy("h", "doc_id", "size", "key", *(["row"] if row else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at"))).cast("long"))
    return rows.select(*(["row"] if row else []), "doc_id", "key", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))
