"""KVStore: a thin stateful shell over the DataFrame operators. One directory is one store, with one writer.

Layout: manifest/ (versions), log/ (mutations not yet flushed), runs/ (immutable sorted runs), index/ (block and sparse
indexes and filters of runs, made when first asked for)."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kvlake.functions import bloom
from kvlake.functions.bloom import BloomConfig
from kvlake.operators import compaction, lookup, lww, stats
from kvlake.schema import MAX_VALUE_BYTES, MUTATION
from kvlake.sources import fs, runs
from kvlake.sources.manifest import Conflict, Manifest

#: Log bytes after which a put flushes, as measured on the encoded records.
FLUSH_BYTES = 64 << 20
_ORD = "__ord"


class KVStore:
    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, thresholds=compaction.THRESHOLDS, flush_bytes: int = FLUSH_BYTES):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest
        self.thresholds, self.flush_bytes, self.bloom = tuple(thresholds), flush_bytes, BloomConfig()

    # -- life cycle

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> KVStore:
        """The store at `root`: its manifest, or one rebuilt from its runs, or a new store."""
        root = root.rstrip("/")
        found = Manifest.load(spark, root) or Manifest.rebuild(spark, root).commit(spark, root)
        return cls(spark, root, found, **options)

    def refresh(self) -> None:
        """What other handles have committed since."""
        self.manifest = Manifest.load(self.spark, self.root) or self.manifest

    def _newest(self) -> None:
        """Conflict, before any work, if another handle has committed: what this one knows may be deleted by now."""
        there = Manifest.versions(self.spark, self.root)
        if there and there[-1] != self.manifest.version:
            self.refresh()
            raise Conflict(f"{self.root}: version {there[-1]} exists")

    def _commit(self, made: str, **changes) -> None:
        """Goes on with the next version once it is on storage. A refused handle keeps nothing of what it tried (`made`
        is deleted) and takes the newest version, on which the caller may try again."""
        try:
            self.manifest = self.manifest.commit(self.spark, self.root, **changes)
        except Conflict:
            fs.delete(self.spark, made)
            self.refresh()
            raise

    def close(self) -> None:
        self.flush()

    sync = close

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None:
            self.close()

    def set_bloom_config(self, config: BloomConfig) -> None:
        """For runs written from now on."""
        self.bloom = config

    # -- frames

    def log(self) -> DataFrame:
        """Mutations not yet flushed, in arrival order by seq."""
        parts = []
        for b in self.manifest.log:
            offsets = F.create_map(*[F.lit(x) for pair in ((int(k), v) for k, v in b["offsets"].items()) for x in pair]) if b["offsets"] else None
            if offsets is None:
                continue
            seq = F.lit(b["base"]) + F.element_at(offsets, F.shiftright(F.col(_ORD), 33)) + F.col(_ORD).bitwiseAND((1 << 33) - 1) + 1
            parts.append(self.spark.read.parquet(b["path"]).select("key", "value", "tombstone", seq.cast("long").alias("seq")))
        return lww.union_all(*parts) if parts else self.spark.createDataFrame([], MUTATION)

    def tables(self, key: str | None = None, level: int | None = None) -> list[dict]:
        """Manifest entries whose fence may hold `key`."""
        return [t for t in self.manifest.tables
                if (level is None or t["level"] == level)
                and (key is None or (t["min_key"] is not None and t["min_key"].encode() <= key.encode() <= t["max_key"].encode()))]

    def versions(self, key: str | None = None) -> DataFrame:
        """All stored versions, of every run that may hold `key` and of the log."""
        paths = [t["path"] for t in self.tables(key)]
        stored = [runs.scan_run(self.spark, *paths)] if paths else []
        return lww.union_all(*([self.log()] if self.manifest.log or not stored else []), *stored)

    def latest(self) -> DataFrame:
        return lww.latest(self.versions())

    def snapshot(self) -> DataFrame:
        return lww.live(self.versions())

    def register_view(self, name: str) -> None:
        """Extension: the live snapshot as a SQL view."""
        self.snapshot().createOrReplaceTempView(name)

    # -- mutations

    def apply(self, df: DataFrame, order: str | Column | None = None, **changes) -> int:
        """Appends mutations (key, value, tombstone) and returns their number. `changes` go into the same commit.

        `order` names what gives arrival order within the batch; sequence numbers follow it without gaps. It may be
        left out only if keys do not repeat. Range partitions are numbered by their row counts, so no task sees all rows."""
        self._newest()
        bad = F.col("key").isNull() | (F.octet_length("value") > F.lit(MAX_VALUE_BYTES))
        rows = df.select("key", F.when(~F.col("tombstone"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value"), "tombstone", *([F.expr(order) if isinstance(order, str) else order] if order is not None else []))
        rows = rows.toDF("key", "value", "tombstone", *(["__at"] if order is not None else []))
        rows = rows.withColumn("key", F.when(bad, F.raise_error(F.lit("a key is NULL or a value too long"))).otherwise(F.col("key")))
        if order is not None:
            rows = rows.repartitionByRange("__at").sortWithinPartitions("__at").drop("__at")
        path = f"{self.root}/log/{uuid.uuid4().hex}"
        rows.withColumn("__bytes", stats.encoded_size(F.col("key"), F.col("value"))).withColumn(_ORD, F.monotonically_increasing_id()).write.parquet(path)
        counts = self.spark.read.parquet(path).groupBy(F.shiftright(_ORD, 33).alias("p")).agg(F.count("*").alias("n"), F.sum("__bytes").alias("b")).collect()
        offsets, total = {}, 0
        for r in sorted(counts, key=lambda r: r.p):
            offsets[str(r.p)] = total
            total += r.n
        now = self.manifest
        made = {"path": path, "base": now.max_seq, "offsets": offsets, "bytes": sum(r.b for r in counts)}
        self._commit(path, log=[*now.log, made], max_seq=now.max_seq + total, **changes)
        if sum(b["bytes"] for b in self.manifest.log) >= self.flush_bytes:
            self.flush()
        return total

    def put_df(self, df: DataFrame, order: str | Column | None = None) -> int:
        """Upserts (key, value); an empty or NULL value is stored as empty, not as a delete."""
        return self.apply(df.withColumn("tombstone", F.lit(False)), order)

    def delete_df(self, df: DataFrame, order: str | Column | None = None) -> int:
        """Deletes `key`s; absent keys get a tombstone too."""
        return self.apply(df.withColumns({"value": F.lit(None).cast("binary"), "tombstone": F.lit(True)}), order)

    def put(self, key: str, value: bytes | str) -> None:
        self.put_df(self.spark.createDataFrame([(key, bytearray(value.encode() if isinstance(value, str) else value))], "key string, value binary"))

    def delete(self, key: str) -> None:
        self.delete_df(self.spark.createDataFrame([(key,)], "key string"))

    def ingest(self, df: DataFrame, source: str, batch: int, order: str | Column | None = None) -> bool:
        """`apply` once per batch of a source, whose batches come in ascending order: one at or below the last that was
        committed is not applied again. The number is committed with the rows, so a batch that failed can be tried again."""
        if batch <= self.manifest.batches.get(source, -1):
            return False
        self.apply(df, order, batches={**self.manifest.batches, source: batch})
        return True

    # -- reads

    def get(self, key: str) -> bytes | None:
        row = lookup.point_get(self.versions(key), key).select("value").first()
        return None if row is None else bytes(row[0])

    get_uncached = get

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(self.versions(), keys)

    def scan(self, low: str | None = None, high: str | None = None) -> DataFrame:
        return lookup.range_scan(self.versions(), low, high)

    def debug_lookup(self, key: str) -> DataFrame:
        """Per run: filter verdict, floor block and sparse offset. The log and fences play no part.

        Reads of each stored index only what the key needs: the segments of the filter that hold its bits, and the index
        rows at or below it (a bound that reaches the files' row groups)."""
        tables = self.manifest.tables
        if not tables:
            return self.spark.createDataFrame([], "run long, key string, bloom_maybe boolean, first_key string, block_off long, entry_count long, byte_len long, sparse_offset long, level int")
        paths = [self.index(t) for t in tables]
        probe = self.spark.createDataFrame([(key,)], "key string")
        filters = lww.union_all(*[self.spark.read.parquet(f"{p}/bloom") for p in paths])
        bits = {(r.run, r.bit_count, r.hash_count) for r in filters.select("run", "bit_count", "hash_count").distinct().collect()}
        wanted = set().union(*(bloom.segments(key, n, BloomConfig(hash_count=k)) for _, n, k in bits))
        verdict = bloom.probe(probe, filters.filter(F.col("seg").isin(*wanted) | (F.col("seg") == 0))).select("run", "key", F.col("maybe").alias("bloom_maybe"))
        block = self.spark.read.parquet(*[f"{p}/blocks" for p in paths]).filter(F.col("first_key") <= key).groupBy("run").agg(F.max_by(F.struct("first_key", "off", "entry_count", "byte_len"), "first_key").alias("b"))
        sparse = self.spark.read.parquet(*[f"{p}/sparse" for p in paths]).filter(F.col("key") <= key).groupBy("run").agg(F.max("off").alias("off"))
        levels = self.manifest.frame(self.spark).select(F.col("table_id").alias("run"), "level")
        rows = verdict.join(block, "run", "left").join(sparse, "run", "left").join(levels, "run")
        return rows.select("run", "key", "bloom_maybe", "b.first_key", F.col("b.off").alias("block_off"), "b.entry_count", "b.byte_len", F.coalesce("off", F.lit(0)).alias("sparse_offset"), "level")

    def index(self, table: dict) -> str:
        """Where a run's filter, block index and sparse index lie; they are built once, when first asked for."""
        path = f"{self.root}/index/{table['path'].rstrip('/').rpartition('/')[2]}"
        if not fs.exists(self.spark, path):
            made = f"{self.root}/index/.{uuid.uuid4().hex}"
            entries = runs.scan_run(self.spark, table["path"]).withColumn("run", F.lit(table["table_id"]).cast("long"))
            bloom.build(entries, config=self.bloom).write.parquet(f"{made}/bloom")
            lww.sorted_scan(stats.block_build(entries).withColumnRenamed("first_key", "key")).withColumnRenamed("key", "first_key").write.parquet(f"{made}/blocks")
            lww.sorted_scan(stats.sparse_build(entries)).write.parquet(f"{made}/sparse")
            if not fs.rename(self.spark, made, path):  # another handle was first
                fs.delete(self.spark, made)
        return path

    def entries(self) -> DataFrame:
        """Every run's entries with its table id as `run`."""
        per = [runs.scan_run(self.spark, t["path"]).withColumn("run", F.lit(t["table_id"]).cast("long")) for t in self.manifest.tables]
        return lww.union_all(*per) if per else self.spark.createDataFrame([], MUTATION).withColumn("run", F.lit(0).cast("long"))

    # -- runs

    def flush(self) -> dict | None:
        """Makes the log one sorted run of level 0; nothing happens if it is empty. Compacts what is due afterwards."""
        if not any(b["offsets"] for b in self.manifest.log):
            return None
        self._newest()
        made = self._write(lww.latest(self.log()), 0)
        old = [b["path"] for b in self.manifest.log]
        self._commit(made["path"], tables=[*self.manifest.tables, made], log=[], next_id=made["table_id"] + 1)
        for path in old:
            fs.delete(self.spark, path)
        for level in range(len(self.thresholds)):
            if len(self.tables(level=level)) >= self.thresholds[level]:
                self.compact(level)
        return made

    def compact(self, level: int, purge: bool = False) -> dict | None:
        """Merges all runs of `level` and the next into one run of the next; publishes it, then deletes the inputs.

        `purge` drops tombstones and is refused while a deeper run could hold a deleted key."""
        self._newest()
        inputs = self.tables(level=level) + self.tables(level=level + 1)
        if not inputs:
            return None
        if purge and any(t["level"] > level + 1 for t in self.manifest.tables):
            raise ValueError("tombstones can go only when nothing older is left out")
        made = self._write(compaction.compact(runs.scan_run(self.spark, *[t["path"] for t in inputs]), purge), level + 1)
        gone = {t["table_id"] for t in inputs}
        self._commit(made["path"], tables=[t for t in self.manifest.tables if t["table_id"] not in gone] + [made], next_id=made["table_id"] + 1)
        for t in inputs:
            fs.delete(self.spark, t["path"])
            fs.delete(self.spark, f"{self.root}/index/{t['path'].rstrip('/').rpartition('/')[2]}")
        return made

    def candidates(self) -> DataFrame:
        return compaction.candidates(self.manifest.frame(self.spark), self.thresholds)

    def collect_garbage(self) -> int:
        """Deletes runs and log batches that no manifest entry names, as a crash between publishing and deleting leaves."""
        used = {t["path"].rstrip("/").rpartition("/")[2] for t in self.manifest.tables} | {b["path"].rpartition("/")[2] for b in self.manifest.log}
        gone = [f"{self.root}/{d}/{n}" for d in ("runs", "log", "index") for n in fs.names(self.spark, f"{self.root}/{d}") if n not in used]
        for path in gone:
            fs.delete(self.spark, path)
        return len(gone)

    def _write(self, df: DataFrame, level: int) -> dict:
        table_id = self.manifest.next_id
        path = f"{self.root}/runs/L{level}_{table_id}-{uuid.uuid4().hex[:8]}"  # no two writers share a folder
        about = sum(t["n"] for t in self.manifest.tables) + sum(b["bytes"] for b in self.manifest.log) // 16
        runs.write_run(df, path, ndv=min(about, 1_000_000), config=self.bloom)
        return runs.describe(self.spark, path, table_id, level)
