"""Queries over the driver's tables, one per operator, and the same results in SQL."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.cli import Shell
from kvlake.functions import bloom, codec
from kvlake.functions.codec import encoded_size, value_length
from kvlake.operators import compaction, lookup, lww, stats
from kvlake.plans.store import KVStore
from kvlake.schema import mutation_log
from kvlake.sources import binlog, fs, runs, scratch
from kvlake.sources.generate import LCG, people, random_keys, random_reads
from kvlake.sources.manifest import Manifest
from kvlake.streaming.ingest import ingest_stream, latest_view

RUN_ROWS = 500
BLOCK_TARGET = 512

# -- Spark side


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str) -> DataFrame:
    """The canonical log over `events`: text values, so that both engines compare them alike."""
    run = F.expr(f"event_id div {RUN_ROWS}")
    return mutation_log(_t(spark, d, "events"), F.col("user_id"), F.col("props"), F.col("event_id") + 1, F.col("event_type") == "error", run=run, table_id=run + 1)


def per_run(spark, d):
    return lww.latest(log(spark, d), "run")


def bare(df):
    return df.select("key", "value", "tombstone", "seq")


def _probes(spark, d):
    """Every customer key and keys that no store holds."""
    return _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")).unionByName(_t(spark, d, "nation").select(F.concat(F.lit("absent-"), F.col("n_nationkey").cast("string")).alias("key")))


def _orders(spark, d):
    return mutation_log(_t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderkey") + 1)


def _store(spark, d, batches):
    store = KVStore.open(spark, scratch.new_path(spark, "store"), thresholds=(1 << 30,) * 9)
    for b in batches:
        store.apply(b.select("key", F.col("value").cast("binary").alias("value"), "tombstone", "seq"), order="seq")
        store.flush()
    return store


def _halves(spark, d):
    both = log(spark, d)
    return [both.filter("run % 2 = 0"), both.filter("run % 2 = 1")]


def _text(df):
    return df.withColumn("value", F.col("value").cast("string"))


def q_flush_run(spark, d):
    path = scratch.new_path(spark, "run")
    runs.write_run(bare(lww.latest(log(spark, d))).withColumn("value", F.col("value").cast("binary")), path, ndv=10_000)
    return _text(runs.scan_run(spark, path))


def q_manifest(spark, d):
    store = _store(spark, d, _halves(spark, d))
    return Manifest.load(spark, store.root).frame(spark).select("table_id", "level", "min_key", "max_key", "n")


def q_compact_level(spark, d):
    store = _store(spark, d, _halves(spark, d))
    store.compact(0)
    return _text(store.snapshot()).select("key", "value")


def q_streaming(spark, d):
    """The stream of the log, run to its end; the memory sink holds the final update of each key."""
    import uuid

    path = scratch.new_path(spark, "stream")
    bare(log(spark, d)).write.parquet(path)
    table = "v" + uuid.uuid4().hex
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    latest_view(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", scratch.new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(table)


def _written(spark, d, *steps):
    """A store that holds the log and then what the steps do, read back by a second handle: nothing is flushed."""
    store = KVStore.open(spark, scratch.new_path(spark, "store"), flush_bytes=1 << 62)
    store.apply(bare(log(spark, d)), order="seq")
    for step in steps:
        step(store)
    return KVStore.open(spark, store.root)


def _put_customers(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey")
    return lambda store: store.put_df(rows, order="c_custkey")


def _delete_customers(spark, d):
    rows = _t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey")
    return lambda store: store.delete_df(rows, order="c_custkey")


def q_binlog_replay(spark, d):
    """The log as files of binary records, replayed."""
    path = scratch.new_path(spark, "binlog")
    binlog.write(bare(log(spark, d)), path)
    return _text(lww.latest(binlog.read(spark, path)))


def q_store_debug_lookup(spark, d):
    """What the stored indexes of a flushed and compacted store say about one key."""
    store = _store(spark, d, _halves(spark, d))
    store.compact(0)
    store.put_df(_t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"), "n_nationkey"), order="n_nationkey")
    store.flush()
    return store.debug_lookup("17")


def q_random_keys(spark, d):
    """The benchmark's load: put, then read back keys that the sequence goes on to choose."""
    store = KVStore.open(spark, scratch.new_path(spark, "store"))
    keys = random_keys(spark, 10_000)
    store.put_df(keys, order="i")
    store.flush()
    return store.multi_get(random_reads(spark, 10_000, 1_000)).select("key", F.hex("value").alias("value"), "found")


def q_manifest_rebuild(spark, d):
    """The manifest of a store whose manifest is lost, from the names and contents of its runs."""
    store = _store(spark, d, _halves(spark, d))
    fs.delete(spark, f"{store.root}/manifest")
    found = KVStore.open(spark, store.root).manifest
    name = F.regexp_extract("path", r"/(L\d+_\d+)[^/]*$", 1).alias("name")
    return found.frame(spark).select("table_id", "level", name, "min_key", "max_key", "n", "bytes", "max_seq", F.lit(found.next_id).cast("long").alias("next_id"))


def q_reopen(spark, d):
    """What is read after some rows were flushed by closing, some only logged, and the log was emptied by the flush.

    The buffer has no bound, so that only closing flushes, whatever the log's size."""
    both = _halves(spark, d)
    with KVStore.open(spark, scratch.new_path(spark, "store"), flush_bytes=1 << 62) as store:
        store.apply(bare(both[0]), order="seq")
    again = KVStore.open(spark, store.root, flush_bytes=1 << 62)
    emptied = again.log().isEmpty()
    again.apply(bare(both[1]), order="seq")
    final = KVStore.open(spark, store.root)
    return _text(final.snapshot()).select("key", "value", F.lit(len(final.manifest.tables)).cast("long").alias("tables"), F.lit(emptied).alias("emptied"))


def q_log_get(spark, d):
    """Lookups that only the log can answer."""
    return _text(_written(spark, d).multi_get(_probes(spark, d))).select("key", "value", "found")


def q_bounded_buffer(spark, d):
    """A log that exceeds its bound is flushed at once, one that does not stays."""
    rows, made = bare(log(spark, d)), []
    for name, size in (("small", 1), ("large", 1 << 40)):
        store = KVStore.open(spark, scratch.new_path(spark, "store"), flush_bytes=size)
        store.apply(rows, order="seq")
        made.append((name, len(store.manifest.tables), sum(t["n"] for t in store.manifest.tables), store.log().count()))
    return spark.createDataFrame(made, "bound string, tables long, entries long, logged long")


def q_stream_ingest(spark, d):
    """A stream landed as runs, a batch of it offered again, and the stream run again: each row counts once."""
    path, store = scratch.new_path(spark, "stream"), KVStore.open(spark, scratch.new_path(spark, "store"))
    bare(log(spark, d)).withColumn("value", F.col("value").cast("binary")).write.parquet(path)
    checkpoint = scratch.new_path(spark, "checkpoint")
    for _ in range(2):
        ingest_stream(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), store, checkpoint, "seq").awaitTermination()
    store.ingest(spark.read.parquet(path), checkpoint, 0, "seq")
    return _text(KVStore.open(spark, store.root).latest())


def q_shell(spark, d):
    """Lines that the shell answers to a session."""
    import io

    out = io.StringIO()
    root = scratch.new_path(spark, "shell")
    shell = Shell(spark, root, out, out)
    for line in ("PUT a  1   2", "GET a", "put b x", "DEL b", "GET b", "GET c", "nope", "SYNC", "CONNECT " + root + "/other", "GET a", "CONNECT " + root, "GET a", "EXIT"):
        shell.run(line)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "i long, line string")


def q_entry_encode(spark, d):
    """The record of each entry, spelled in hex."""
    def run(batches):
        for b in batches:
            records = [codec.encode(k, None if v is None else v.encode(), s).hex().upper() for k, v, s in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(records, pa.string())], ["key", "seq", "record"])

    return lww.latest(log(spark, d)).select("key", "value", "seq").mapInArrow(run, "key string, seq long, record string")


def q_debug_lookup(spark, d):
    entries = per_run(spark, d)
    return lookup.debug_lookup(_probes(spark, d), bloom.build(entries), stats.sparse_build(entries), stats.block_build(entries, target=BLOCK_TARGET))


QUERIES = {
    "lww_latest": lambda s, d: bare(lww.latest(log(s, d))),
    "live_snapshot": lambda s, d: bare(lww.live(log(s, d))).drop("tombstone"),
    "point_get": lambda s, d: lookup.point_get(bare(log(s, d)), "42").select("key", "value"),
    "multi_get": lambda s, d: lookup.multi_get(bare(log(s, d)), _probes(s, d)).select("key", "value", "found"),
    "range_scan": lambda s, d: lookup.range_scan(bare(log(s, d)), "2", "5").select("key", "value"),
    "prefix_scan": lambda s, d: lookup.prefix_scan(bare(log(s, d)), "1").select("key", "value"),
    "put_upsert": lambda s, d: bare(_text(_written(s, d, _put_customers(s, d)).latest())),
    "delete_tombstone": lambda s, d: _text(_written(s, d, _put_customers(s, d), _delete_customers(s, d)).snapshot()).select("key", "value"),
    "wal_replay": lambda s, d: bare(_text(lww.latest(_written(s, d).log()))),
    "binlog_replay": q_binlog_replay,
    "merge_runs": lambda s, d: lww.merge_runs(per_run(s, d).select("key", "seq", "run")),
    "sorted_scan": lambda s, d: lww.ranked_scan(lww.live(bare(log(s, d))).select("key", "seq")),
    "first_hit_read": lambda s, d: lww.first_hit(per_run(s, d).withColumn("level", F.when(F.col("run") < 1, 1).otherwise(0))).select("key", "value", "seq", "table_id"),
    "compact_keep_tombstones": lambda s, d: bare(compaction.compact(per_run(s, d))),
    "compact_purge_tombstones": lambda s, d: bare(compaction.compact(per_run(s, d), purge=True)),
    "compact_level": q_compact_level,
    "compaction_candidates": lambda s, d: compaction.candidates(per_run(s, d).select("run", F.when(F.col("run") % 5 == 0, 1).otherwise(0).alias("level")).distinct(), (3, 2)),
    "fence_build": lambda s, d: stats.fence_build(per_run(s, d)),
    "fence_prune": lambda s, d: lookup.fence_prune(_probes(s, d), stats.fence_build(per_run(s, d))),
    "entry_encoded_size": lambda s, d: per_run(s, d).select("run", "key", encoded_size(F.col("key"), F.col("value")).alias("n"), value_length(F.col("value"), F.col("tombstone")).alias("value_len")),
    "entry_offsets": lambda s, d: stats.entry_offsets(per_run(s, d)).select("run", "key", "i", "n", "off"),
    "sparse_build": lambda s, d: stats.sparse_build(per_run(s, d)),
    "sparse_floor": lambda s, d: lookup.floor_join(_probes(s, d), stats.sparse_build(per_run(s, d)), "key", ["off"]).select("run", "key", F.coalesce("off", F.lit(0)).alias("off")),
    "block_build": lambda s, d: stats.block_build(per_run(s, d), target=BLOCK_TARGET),
    "block_build_4096": lambda s, d: stats.block_build(_orders(s, d).withColumn("run", F.expr("cast(seq div 20000 as bigint)"))),
    "block_floor": lambda s, d: lookup.floor_join(_probes(s, d), stats.block_build(per_run(s, d), target=BLOCK_TARGET), "first_key", ["block", "off", "entry_count"]),
    "memtable_bytes": lambda s, d: stats.memtable_bytes(log(s, d)),
    "bloom_hash_pair": lambda s, d: bloom.with_hash_pair(_probes(s, d)),
    "bloom_build": lambda s, d: bloom.set_bits(bloom.build(per_run(s, d))).groupBy("run", "bit_count", "hash_count").agg(F.count("*").alias("n_bits"), F.sum("bit").alias("bit_sum")),
    "bloom_probe": lambda s, d: lookup.bloom_probe(_probes(s, d), bloom.build(per_run(s, d))).select("run", "key", "maybe"),
    "debug_lookup": q_debug_lookup,
    "store_debug_lookup": q_store_debug_lookup,
    "random_keys": q_random_keys,
    "tw_generate": lambda s, d: people(s, 1000),
    "flush_run": q_flush_run,
    "scan_run": lambda s, d: lww.ranked_scan(q_flush_run(s, d).select("key", "seq", "tombstone")),
    "manifest_tables": q_manifest,
    "manifest_rebuild": q_manifest_rebuild,
    "reopen": q_reopen,
    "log_get": q_log_get,
    "bounded_buffer": q_bounded_buffer,
    "stream_ingest": q_stream_ingest,
    "shell_session": q_shell,
    "entry_encode": q_entry_encode,
    "bloom_tuned": lambda s, d: bloom.set_bits(bloom.build(per_run(s, d), config=bloom.BloomConfig(3, 2))).groupBy("run", "bit_count", "hash_count").agg(F.count("*").alias("n_bits"), F.sum("bit").alias("bit_sum")),
    "streaming_latest": q_streaming,
}

# -- SQL side

LOG = f"""log as (select cast(user_id as varchar) as key, case when event_type = 'error' then null else props end as value,
  event_type = 'error' as tombstone, event_id + 1 as seq, cast(event_id // {RUN_ROWS} as bigint) as run, cast(event_id // {RUN_ROWS} + 1 as bigint) as table_id from events)"""
R = LOG + ", r as (select * from log qualify row_number() over (partition by run, key order by seq desc) = 1)"
LATEST = LOG + ", l as (select * from log qualify row_number() over (partition by key order by seq desc) = 1)"
PROBES = "probes as (select cast(c_custkey as varchar) as key from customer union all select 'absent-' || cast(n_nationkey as varchar) from nation)"
SIZE = "16 + strlen(key) + coalesce(strlen(value), 0)"
OFFSETS = f"""o as (select run, key, row_number() over (partition by run order by key) - 1 as i, {SIZE} as n,
  cast(coalesce(sum({SIZE}) over (partition by run order by key rows between unbounded preceding and 1 preceding), 0) as bigint) as off from r)"""
PUT = LOG + """, puts as (select cast(c_custkey as varchar) as key, c_mktsegment as value, false as tombstone, (select count(*) from log) + row_number() over (order by c_custkey) as seq from customer),
 dels as (select cast(c_custkey as varchar) as key, null as value, true as tombstone, (select count(*) from log) + (select count(*) from puts) + row_number() over (order by c_custkey) as seq from customer where c_custkey % 3 = 0),
 numbered as (select key, value, tombstone, row_number() over (order by seq) as seq from log)"""
WRITTEN = PUT + """, m as (select * from numbered union all select * from puts{more}), l as (select * from m qualify row_number() over (partition by key order by seq desc) = 1)"""
ORDER_ENTRIES = "r as (select cast(o_orderkey as varchar) as key, o_orderpriority as value, cast((o_orderkey + 1) // 20000 as bigint) as run from orders)"


def _blocks(target: int) -> str:
    """Recursive greedy fold over the numbered entries `o`."""
    return f"""f as (select run, i, key, off, n, cast(0 as bigint) as block, key as first_key, off as b_off, cast(1 as bigint) as cnt, n as len from o where i = 0
 union all select o.run, o.i, o.key, o.off, o.n, case when f.len >= {target} then f.block + 1 else f.block end, case when f.len >= {target} then o.key else f.first_key end,
  case when f.len >= {target} then o.off else f.b_off end, case when f.len >= {target} then 1 else f.cnt + 1 end, case when f.len >= {target} then o.n else f.len + o.n end
  from f join o on o.run = f.run and o.i = f.i + 1),
 b as (select run, block, first_key, b_off as off, max(cnt) as entry_count, cast(max(len) as bigint) as byte_len from f group by all)"""


def _fold(basis: int, prime: int, add: int) -> str:
    """A byte fold mod 2^64 over the key's UTF-8 bytes, in 128-bit arithmetic."""
    return (f"list_reduce(list_prepend('{basis}'::uhugeint, list_transform(range(0, strlen(key)), lambda j: ('0x' || substr(hex(encode(key)), j * 2 + 1, 2))::int::uhugeint)), "
            f"lambda h, x: (xor(h, x + {add}::uhugeint) * '{prime}'::uhugeint) % '{bloom.MOD64}'::uhugeint)")


_U1, _P1 = bloom.FNV_BASIS, bloom.FNV_PRIME
_U2, _P2 = bloom.FNV_BASIS ^ bloom.SECOND_BASIS_MASK, bloom.FNV_PRIME ^ bloom.SECOND_PRIME_MASK


def _hashes(source: str) -> str:
    return f"""h0 as (select *, {_fold(_U1, _P1, 0)} as u1, {_fold(_U2, _P2, bloom.SECOND_BYTE_ADD)} as u2x from {source}),
 h as (select * exclude (u2x), case when u2x % 2::uhugeint = 0::uhugeint then u2x + 1::uhugeint else u2x end as u2 from h0)"""


_BIT = f"cast(((u1 + i::uhugeint * u2) % '{bloom.MOD64}'::uhugeint) % bit_count::uhugeint as bigint)"
_SIGNED = "case when {0} >= '9223372036854775808'::uhugeint then cast({0}::hugeint - '18446744073709551616'::hugeint as bigint) else cast({0} as bigint) end"
FILTERS = _hashes("r") + f""", s as (select run, greatest(greatest(count(*), 1) * 8, 8) as bit_count from r group by run),
 bits as (select distinct h.run, s.bit_count, {_BIT} as bit from h join s on h.run = s.run, range(0, 6) t(i))"""
PROBE = f"""ph0 as (select *, {_fold(_U1, _P1, 0)} as u1, {_fold(_U2, _P2, bloom.SECOND_BYTE_ADD)} as u2x from (select distinct key from probes)),
 ph as (select key, u1, case when u2x % 2::uhugeint = 0::uhugeint then u2x + 1::uhugeint else u2x end as u2 from ph0),
 pb as (select ph.key, s.run, {_BIT} as bit from ph cross join s, range(0, 6) t(i)),
 verdict as (select pb.run, pb.key, bool_and(bits.bit is not null) as maybe from pb left join bits on bits.run = pb.run and bits.bit = pb.bit group by all)"""
RUNS = "runs as (select distinct run from r), k as (select distinct key from probes), kr as (select key, run from k cross join runs)"
TABLE = "select {id} as table_id, 0 as level, min(key) as min_key, max(key) as max_key, count(distinct key) as n from log where run % 2 = {half}"

STORE_RUNS = LOG + """, r as (select 3::bigint as run, key, value from (select * from log qualify row_number() over (partition by key order by run % 2 desc, seq desc) = 1)
 union all select 4::bigint, cast(n_nationkey as varchar), n_name from nation), probes as (select '17' as key)"""


def _debug(runs: str, target: int) -> str:
    """What each of the runs `r` says about each of the `probes`."""
    return f"""with recursive {runs}, {OFFSETS}, {_blocks(target)}, {FILTERS}, {PROBE}, {RUNS},
 x as (select run, key, off from o where i % 16 = 0),
 fb as (select kr.run, kr.key, b.first_key, b.off as block_off, b.entry_count, b.byte_len from kr asof left join b on kr.run = b.run and kr.key >= b.first_key),
 fs as (select kr.run, kr.key, coalesce(x.off, 0) as sparse_offset from kr asof left join x on kr.run = x.run and kr.key >= x.key)"""


SHOWN = """ select v.run, v.key, v.maybe as bloom_maybe, fb.first_key, fb.block_off, fb.entry_count, fb.byte_len, fs.sparse_offset
 from verdict v join fb on fb.run = v.run and fb.key = v.key join fs on fs.run = v.run and fs.key = v.key"""

ORACLE = {
    "lww_latest": f"with {LATEST} select key, value, tombstone, seq from l",
    "live_snapshot": f"with {LATEST} select key, value, seq from l where not tombstone",
    "point_get": f"with {LATEST} select key, value from l where not tombstone and key = '42'",
    "multi_get": f"with {LATEST}, {PROBES} select k.key, l.value, l.key is not null as found from (select distinct key from probes) k left join (select * from l where not tombstone) l on l.key = k.key",
    "range_scan": f"with {LATEST} select key, value from l where not tombstone and key between '2' and '5'",
    "prefix_scan": f"with {LATEST} select key, value from l where not tombstone and starts_with(key, '1')",
    "put_upsert": f"with {WRITTEN.format(more='')} select key, value, tombstone, seq from l",
    "delete_tombstone": f"with {WRITTEN.format(more=' union all select * from dels')} select key, value from l where not tombstone",
    "wal_replay": f"with {LATEST} select key, value, tombstone, seq from l",
    "binlog_replay": f"with {LATEST} select key, value, tombstone, seq from l",
    "merge_runs": f"with {R} select key, seq, run, row_number() over (partition by key order by seq desc, run) as ord from r",
    "sorted_scan": f"with {LATEST} select key, seq, row_number() over (order by key) - 1 as i from l where not tombstone",
    "first_hit_read": f"with {R} select key, value, seq, table_id from r qualify row_number() over (partition by key order by case when run < 1 then 1 else 0 end, table_id desc) = 1",
    "compact_keep_tombstones": f"with {LATEST} select key, value, tombstone, seq from l",
    "compact_purge_tombstones": f"with {LATEST} select key, value, tombstone, seq from l where not tombstone",
    "compact_level": f"with {LOG}, x as (select * from log qualify row_number() over (partition by key order by run % 2 desc, seq desc) = 1) select key, value from x where not tombstone",
    "compaction_candidates": f"with {R}, t as (select distinct run, case when run % 5 = 0 then 1 else 0 end as level from r) select level, count(*) as n, cast(case level when 0 then 3 else 2 end as bigint) as threshold, count(*) >= case level when 0 then 3 else 2 end as due from t group by level",
    "fence_build": f"with {R} select run, min(key) as min_key, max(key) as max_key from r group by run",
    "fence_prune": f"with {R}, {PROBES}, f as (select run, min(key) as lo, max(key) as hi from r group by run) select probes.key, run from probes join f on probes.key between lo and hi",
    "entry_encoded_size": f"with {R} select run, key, {SIZE} as n, cast(case when tombstone then -1 else strlen(value) end as int) as value_len from r",
    "entry_offsets": f"with {R}, {OFFSETS} select run, key, i, n, off from o",
    "sparse_build": f"with {R}, {OFFSETS} select run, key, off from o where i % 16 = 0",
    "sparse_floor": f"with {R}, {OFFSETS}, {PROBES}, {RUNS}, x as (select run, key, off from o where i % 16 = 0) select kr.run, kr.key, coalesce(x.off, 0) as off from kr asof left join x on kr.run = x.run and kr.key >= x.key",
    "block_build": f"with recursive {R}, {OFFSETS}, {_blocks(BLOCK_TARGET)} select run, block, first_key, off, entry_count, byte_len from b",
    "block_build_4096": f"with recursive {ORDER_ENTRIES}, {OFFSETS}, {_blocks(4096)} select run, block, first_key, off, entry_count, byte_len from b",
    "block_floor": f"with recursive {R}, {OFFSETS}, {_blocks(BLOCK_TARGET)}, {PROBES}, {RUNS} select kr.run, kr.key, b.block, b.off, b.entry_count from kr asof left join b on kr.run = b.run and kr.key >= b.first_key",
    "memtable_bytes": f"with {R} select run, cast(sum(strlen(key) + coalesce(strlen(value), 0)) as bigint) as bytes from r group by run",
    "bloom_hash_pair": f"with {PROBES}, {_hashes('probes')} select key, {_SIGNED.format('u1')} as h1, {_SIGNED.format('u2')} as h2 from h",
    "bloom_build": f"with {R}, {FILTERS} select run, bit_count, 6 as hash_count, count(*) as n_bits, cast(sum(bit) as bigint) as bit_sum from bits group by all",
    "bloom_probe": f"with {R}, {PROBES}, {FILTERS}, {PROBE} select run, key, maybe from verdict",
    "debug_lookup": _debug(f"{R}, {PROBES}", BLOCK_TARGET) + SHOWN,
    "store_debug_lookup": _debug(STORE_RUNS, stats.BLOCK_BYTES) + SHOWN.replace("select v.run", "select cast(case v.run when 3 then 1 else 0 end as int) as level, v.run"),
    "random_keys": f"""with recursive g as (select 0 as i, '{LCG[2]}'::uhugeint as x union all select i + 1, (x * '{LCG[0]}'::uhugeint + '{LCG[1]}'::uhugeint) % '{bloom.MOD64}'::uhugeint from g where i < 11000),
 r as (select distinct (x % 10000::uhugeint)::bigint as i from g where i > 10000), k as (select cast(x as varchar) as key, lpad(hex(x::ubigint), 16, '0') as h from g where i between 1 and 10000 and i - 1 in (select i from r))
 select key, {" || ".join(f"substr(h, {at}, 2)" for at in range(15, 0, -2))} as value, true as found from k""",
    "tw_generate": """select cast(i as varchar) as key, '{"name": "Person' || i || '", "age": ' || ((i * 7919 + 7) % 100) || ', "location": "ca"}' as value from range(0, 1000) t(i)""",
    "flush_run": f"with {LATEST} select key, value, tombstone, seq from l",
    "scan_run": f"with {LATEST} select key, seq, tombstone, row_number() over (order by key) - 1 as i from l",
    "manifest_tables": f"with {LOG} {TABLE.format(id='1::bigint', half=0)} union all {TABLE.format(id='2::bigint', half=1)}",
    "manifest_rebuild": f"""with {LOG}, t as (select run % 2 as half, key, arg_max(coalesce(strlen(value), 0), seq) as v, max(rank) as seq from (select *, row_number() over (order by run % 2, seq) as rank from log) group by all),
 m as (select half + 1 as table_id, 0 as level, 'L0_' || (half + 1) as name, min(key) as min_key, max(key) as max_key, count(*) as n, cast(sum(16 + strlen(key) + v) as bigint) as bytes, max(seq) as max_seq from t group by half)
 select *, cast((select max(table_id) + 1 from m) as bigint) as next_id from m""",
    "reopen": f"with {LOG}, x as (select * from log qualify row_number() over (partition by key order by run % 2 desc, seq desc) = 1) select key, value, 1::bigint as tables, true as emptied from x where not tombstone",
    "log_get": f"with {LATEST}, {PROBES} select k.key, l.value, l.key is not null as found from (select distinct key from probes) k left join (select * from l where not tombstone) l on l.key = k.key",
    "bounded_buffer": f"with {LATEST} select 'small' as bound, 1::bigint as tables, (select count(*) from l) as entries, 0::bigint as logged union all select 'large', 0, 0, (select count(*) from log)",
    "stream_ingest": f"with {LATEST} select key, value, tombstone, seq from l",
    "shell_session": "select i::bigint as i, line from (values (0, 'ok'), (1, '1 2'), (2, 'ok'), (3, 'ok'), (4, '(nil)'), (5, '(nil)'), (6, 'unknown command: NOPE'), (7, 'ok'), (8, 'ok'), (9, '(nil)'), (10, 'ok'), (11, '1 2')) v(i, line)",
    "entry_encode": f"""with {LATEST}, e as (select key, seq, lpad(hex(seq::ubigint), 16, '0') as s, lpad(hex(strlen(key)::uinteger), 8, '0') as k, case when tombstone then 'FFFFFFFF' else lpad(hex(strlen(value)::uinteger), 8, '0') end as v, hex(encode(key)) || coalesce(hex(encode(value)), '') as body from l)
 select key, seq, {" || ".join(f"substr(s, {at}, 2)" for at in range(15, 0, -2))} || {" || ".join(f"substr(k, {at}, 2)" for at in range(7, 0, -2))} || {" || ".join(f"substr(v, {at}, 2)" for at in range(7, 0, -2))} || body as record from e""",
    "bloom_tuned": f"with {R}, {FILTERS.replace('* 8, 8)', '* 3, 8)').replace('range(0, 6)', 'range(0, 2)')} select run, bit_count, 2 as hash_count, count(*) as n_bits, cast(sum(bit) as bigint) as bit_sum from bits group by all",
    "streaming_latest": f"with {LATEST} select key, value, tombstone, seq from l",
}
