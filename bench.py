"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the published key-value workloads; prints one JSON line.

Queries are medians of three runs. Workloads are in rows a second, random puts and the compaction once, the others as the
median of three: random puts and gets of the benchmark's key sequence, sequential puts (TW) and gets (TG), a snapshot, a compaction."""
import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from kvlake import KVStore
from kvlake.plans import catalogue
from kvlake.sources.generate import people, random_keys, random_reads

HEADLINE = ["lww_latest", "live_snapshot", "multi_get", "put_upsert", "wal_replay", "merge_runs", "sorted_scan", "fence_build", "entry_offsets", "sparse_build",
            "block_build_4096", "bloom_build", "compact_keep_tombstones", "flush_run"]
#: The published workloads' sizes.
RANDOM_PUTS, RANDOM_GETS, TW, TG = 10_000_000, 100_000, 500_000, 120_000


def run(df):
    df.write.format("noop").mode("overwrite").save()


def rates(spark, root):
    """Rows a second of each workload. Puts are timed until they can be read after a crash; gets as one set."""
    out = {}

    def timed(name, rows, work, times=1):
        took = []
        for _ in range(times):
            t = time.time()
            work()
            took.append(time.time() - t)
        out[name] = round(rows / statistics.median(took))

    keys = spark.read.parquet(_made(random_keys(spark, RANDOM_PUTS), f"{root}/keys"))
    wanted = spark.read.parquet(_made(random_reads(spark, RANDOM_PUTS, RANDOM_GETS), f"{root}/wanted"))
    store = KVStore.open(spark, f"{root}/random", flush_bytes=1 << 62)
    timed("random_puts", RANDOM_PUTS, lambda: store.put_df(keys, order="i"))
    timed("random_puts_flush", RANDOM_PUTS, store.flush)
    got = {}
    timed("random_gets", wanted.count(), lambda: got.update(n=store.multi_get(wanted).agg(F.count(F.when(F.col("found"), 1)), F.count(F.when(~F.col("found"), 1))).first()), 3)
    assert got["n"][1] == 0, "missing inserted keys"
    timed("snapshot", RANDOM_PUTS, lambda: run(store.snapshot()), 3)
    store.put_df(keys.limit(RANDOM_PUTS // 10), order="i")
    store.flush()
    timed("compaction", RANDOM_PUTS + RANDOM_PUTS // 10, lambda: store.compact(0))
    rows = spark.read.parquet(_made(people(spark, TW), f"{root}/people"))
    stores = [KVStore.open(spark, f"{root}/sequential{k}") for k in range(3)]
    fresh = iter(stores)
    timed("sequential_puts", TW, lambda: next(fresh).put_df(rows, order="cast(key as bigint)"), 3)
    store = stores[0]
    store.flush()
    timed("sequential_gets", TG, lambda: run(store.multi_get(spark.range(TG).select(F.col("id").cast("string").alias("key")))), 3)
    return out


def _made(df, path):
    df.write.parquet(path)
    return path


def main():
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            t = time.time()
            run(catalogue.QUERIES[name](spark, d))
            times.append(time.time() - t)
        took[name] = round(statistics.median(times), 3)
    root = tempfile.mkdtemp(prefix="kvlake-bench-")
    try:
        rows = rates(spark, "file://" + root)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_second": rows, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
