"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

Cases: a NULL or empty text passes the classifier, is a copy of other empty ones, holds nothing private, takes part in no mix
and has no tokens; very long texts go through whole; of ties one row stays or comes first by hash of the row; repeated rows
are copies in the near-dedup, and in the mix each takes its own share; rows without doc_id, source or label are rows like
others; columns of any other name pass through up to the last stage, which replaces `ids` and `n_tokens`; names that start
with two underscores are the stages' own; empty tables give empty results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.llm import catalogue, mixing, pii, simhash, toxicity
from kvlake.llm.common import table
from kvlake.sources import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier does not call toxic."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, out="__score").filter("__score < 0.5").drop("__score")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with `__row`, which tells them apart: of a table in files their file and place in it, else they are written
    with numbers first, so that they keep them."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and docs.inputFiles():
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("__row"))
    return scratch.written(docs.withColumn("__row", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8 or more): of smallest doc_id, rows
    without one last, then by hash of the row. Rows that share a doc_id are apart unless they are near copies."""
    rows = _numbered(docs)
    about = rows.select(F.col("__row").alias("row"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), F.col("__row").alias("row")).alias("order"))
    kept = simhash.near_copies(rows).join(about, "row").groupBy("component").agg(F.min("order").alias("order")).select(F.col("order.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    out = pii.replace(docs).drop("__types")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes, and one with the first words of a copy taken in part. Texts without
    words take part in no mix and stay as they are."""
    rows = _numbered(docs)
    share = mixing.mix(rows, row="__row").select(F.col("row").alias("__row"), F.col("whole").alias("__whole"), F.col("part").alias("__part"), F.col("size").alias("__size"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__whole").cast("int")), F.when(F.col("__part") > 0, F.array("__part")).otherwise(F.array().cast("array<long>")))
    copies = F.when(F.col("__size") == 0, F.array(F.lit(-1).cast("long"))).otherwise(copies)
    rows = rows.join(share, "__row").withColumn("__words", F.explode(copies))
    whole = (F.col("__words") < 0) | (F.col("__words") >= F.col("__size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(F.col("__words"), F.lit(1)).cast("int")), "")
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(head))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else rows
    return rows.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    out = catalogue.tokenizer(spark).fit(docs).encode(docs)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("pii", replace_private), ("mixing", mix_sources), ("bpe", encode)]

#: The stages fit models, hash and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
