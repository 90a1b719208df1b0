import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from kvlake import KVStore
from kvlake.cli import Shell
from kvlake.functions import bloom, codec
from kvlake.operators import stats
from kvlake.sources import binlog, fs
from kvlake.sources.generate import LCG, random_keys, random_reads
from kvlake.sources.manifest import Conflict, CorruptManifest, Manifest


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def live(store):
    return {r.key: bytes(r.value) for r in store.snapshot().collect()}


def test_put_get_delete(spark, root):
    s = KVStore.open(spark, root)
    s.put("a", b"1")
    s.put("b", b"2")
    assert s.get("a") == b"1"
    s.delete("a")
    assert s.get("a") is None and s.get("b") == b"2" and s.get_uncached("b") == b"2"


def test_recovers_from_log_and_runs(spark, root):
    KVStore.open(spark, root).put("name", "x")  # not flushed
    s = KVStore.open(spark, root)
    assert s.get("name") == b"x"
    s.sync()
    name = s.manifest.tables[0]["path"].rpartition("/")[2]
    assert name.startswith("L0_1-") and fs.exists(spark, f"{root}/runs/{name}/_SUCCESS")
    assert KVStore.open(spark, root).get("name") == b"x"


def test_sequence_goes_on_after_reopen(spark, root):
    for value in ("old", "new"):
        with KVStore.open(spark, root) as s:
            s.put("k", value)
    s = KVStore.open(spark, root)
    assert s.get("k") == b"new"
    s.compact(0)
    assert s.get("k") == b"new" and [t["level"] for t in s.manifest.tables] == [1]
    assert s.manifest.max_seq == 2


def test_empty_value_is_no_tombstone(spark, root):
    s = KVStore.open(spark, root)
    s.put("e", b"")
    s.put("", b"empty key")
    s.delete("never")
    s.flush()
    assert s.get("e") == b"" and s.get("") == b"empty key" and s.get("never") is None
    assert s.manifest.tables[0]["n"] == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_model(spark, root, seed):
    rnd, model = random.Random(seed), {}
    s = KVStore.open(spark, root, thresholds=(3,) + (16,) * 8)
    keys = [str(i) for i in range(12)] + ["\U0001F600", "￿", "a b'\""]
    for _ in range(6):
        rows = [(rnd.choice(keys), bytearray(rnd.randbytes(3)), rnd.random() < .3, i) for i in range(10)]
        s.apply(spark.createDataFrame(rows, "key string, value binary, tombstone boolean, at int"), order="at")
        for k, v, dead, _ in rows:
            model.pop(k, None) if dead else model.__setitem__(k, bytes(v))
        act = rnd.choice(["flush", "flush", "reopen", "none"])
        if act == "flush":
            s.flush()
        elif act == "reopen":
            s = KVStore.open(spark, root, thresholds=(3,) + (16,) * 8)
    assert live(s) == model
    s.flush()
    s.compact(0)
    s.compact(1, purge=True)
    assert live(s) == model
    assert all(t["n"] == len(model) for t in s.manifest.tables)
    got = s.multi_get(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {r.key: bytes(r.value) for r in got.collect() if r.found} == model


def test_unsafe_purge_is_refused(spark, root):
    s = KVStore.open(spark, root)
    s.put("a", "1")
    s.flush()
    s.compact(0)
    s.compact(1)
    s.delete("a")
    s.flush()
    with pytest.raises(ValueError):
        s.compact(0, purge=True)
    assert s.get("a") is None


def test_refused_writer(spark, root):
    one, two = KVStore.open(spark, root), KVStore.open(spark, root)
    one.put("a", "1")
    with pytest.raises(Conflict):
        two.put("b", "2")
    assert len(fs.names(spark, f"{root}/log")) == 1  # what was refused is gone
    two.put("c", "3")
    assert live(KVStore.open(spark, root)) == {"a": b"1", "c": b"3"} == live(two)
    with pytest.raises(Conflict):
        one.flush()
    assert len(fs.names(spark, f"{root}/runs")) == 0
    one.put("b", "2")
    assert live(KVStore.open(spark, root)) == {"a": b"1", "b": b"2", "c": b"3"}


def test_refused_flush_and_compaction_lose_nothing(spark, root):
    one, two = KVStore.open(spark, root), KVStore.open(spark, root)
    one.put("a", "1")
    two.refresh()
    one.flush()
    with pytest.raises(Conflict):
        two.flush()
    assert live(KVStore.open(spark, root)) == {"a": b"1"} and len(fs.names(spark, f"{root}/runs")) == 1
    one.compact(0)
    with pytest.raises(Conflict):
        two.compact(0)
    assert live(KVStore.open(spark, root)) == {"a": b"1"} and two.manifest.tables[0]["level"] == 1


def test_racing_publishers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        for k in range(20):
            made = list(pool.map(lambda i: fs.publish(spark, f"file://{tmp_path}/m/v{k}", f"text {i}"), range(8)))
            assert made.count(True) == 1 and fs.read_text(spark, f"file://{tmp_path}/m/v{k}") == f"text {made.index(True)}"
    assert sorted(fs.names(spark, f"file://{tmp_path}/m")) == sorted(f"v{k}" for k in range(20))


def test_old_versions_go_and_stay_gone(spark, root):
    m = Manifest().commit(spark, root)
    old = m
    for k in range(40):
        m = m.commit(spark, root, max_seq=k)
    assert len(Manifest.versions(spark, root)) <= 16 and Manifest.load(spark, root).max_seq == 39
    with pytest.raises(Conflict):  # its next version's name is free again, but it is not the newest
        old.commit(spark, root)
    assert Manifest.load(spark, root) == m


def test_failed_batch_is_tried_again(spark, root):
    s = KVStore.open(spark, root)
    bad = spark.createDataFrame([(None, bytearray(b"1"), False)], "key string, value binary, tombstone boolean")
    good = bad.fillna("a", ["key"])
    with pytest.raises(Exception, match="key is NULL"):
        s.ingest(bad, "q", 0)
    assert s.ingest(good, "q", 0) and s.get("a") == b"1"
    other = KVStore.open(spark, root)
    s.put("x", "1")
    with pytest.raises(Conflict):
        other.ingest(good, "q", 1)
    assert other.ingest(good, "q", 1) and not other.ingest(good, "q", 1) and not KVStore.open(spark, root).ingest(good, "q", 0)
    assert other.manifest.batches == {"q": 1}


def test_manifest_rebuild_and_corruption(spark, root, tmp_path):
    with KVStore.open(spark, root) as s:
        s.put("a", "1")
    fs.delete(spark, f"{root}/manifest")
    s = KVStore.open(spark, root)
    assert s.get("a") == b"1" and s.manifest.next_id == 2 and s.manifest.max_seq == 1
    (tmp_path / "store/runs/Lx_3").mkdir()
    assert s.collect_garbage() == 1
    (tmp_path / "store/manifest/v0000000009.json").write_text('{"tables": [{"table_id": 1, "level": 12}]}')
    with pytest.raises(CorruptManifest):
        Manifest.load(spark, root)


def test_bad_rows_are_refused(spark, root):
    s = KVStore.open(spark, root)
    with pytest.raises(Exception, match="key is NULL"):
        s.put_df(spark.createDataFrame([(None, bytearray(b"x"))], "key string, value binary"))


def test_ingest_is_idempotent(spark, root):
    s = KVStore.open(spark, root)
    df = spark.createDataFrame([("a", bytearray(b"1"), False)], "key string, value binary, tombstone boolean")
    assert s.ingest(df, "b", 0) and not s.ingest(df, "b", 0)
    assert s.manifest.max_seq == 1


def test_streaming_ingest(spark, root, tmp_path):
    from kvlake.streaming.ingest import ingest_stream

    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("k", bytearray(str(i).encode()), False, i), (f"o{i}", bytearray(b"x"), i == 1, i)], "key string, value binary, tombstone boolean, at int").coalesce(1).write.mode("append").parquet(src)
    s = KVStore.open(spark, root)
    for _ in range(2):
        ingest_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), s, str(tmp_path / "cp"), "at").awaitTermination()
    assert live(s).keys() == {"k", "o0", "o2"} and s.get("k") == b"2" and s.manifest.max_seq == 6


def test_binary_log(spark, tmp_path):
    records = [("a", b"1", 1), ("b", None, 2), ("c", b"", 3)]
    whole = b"".join(codec.encode(*r) for r in records)
    (tmp_path / "x.log").write_bytes(whole + codec.encode("torn", b"tail", 4)[:-2])
    rows = binlog.read(spark, str(tmp_path / "x.log")).collect()
    assert [(r.key, None if r.value is None else bytes(r.value), r.seq) for r in rows] == records
    assert [r.tombstone for r in rows] == [False, True, False]
    log = spark.createDataFrame([(k, None if v is None else bytearray(v), v is None, i) for k, v, i in records], "key string, value binary, tombstone boolean, seq long")
    assert binlog.write(log, f"{tmp_path}/folder") == 3 and binlog.write(log.limit(0), f"{tmp_path}/none") == 0
    assert sorted((r.key, None if r.value is None else bytes(r.value), r.seq) for r in binlog.read(spark, f"{tmp_path}/folder").collect()) == records
    assert binlog.read(spark, f"{tmp_path}/none").count() == binlog.read(spark, f"{tmp_path}/missing").count() == 0
    with pytest.raises(ValueError):
        list(codec.decode(struct.pack("<QIi", 1, 1, -2) + b"a"))


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("run"))
    f = bloom.build(keys)
    assert bloom.probe(keys.select("key"), f).filter("not maybe").count() == 0
    other = spark.range(10000, 14000).select(F.col("id").cast("string").alias("key"))
    assert bloom.probe(other, f).filter("maybe").count() < 4000 * 0.05


def test_bloom_segments(spark, monkeypatch):
    """Filters of many segments say what those of one segment say."""
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("run"))
    other = spark.range(2000, 8000).select(F.col("id").cast("string").alias("key"))
    says = lambda: sorted((r.run, r.key) for r in bloom.probe(other, bloom.build(keys)).filter("maybe").collect())
    want = says()
    monkeypatch.setattr(bloom, "SEGMENT_BITS", 3)
    monkeypatch.setattr(bloom, "SEGMENT", 8)
    assert says() == want and bloom.build(keys).select("run", "seg").distinct().count() == 3 * 16
    assert bloom.segments("77", 8000) <= set(range(16))


def test_debug_lookup_reads_stored_indexes(spark, root):
    s = KVStore.open(spark, root)
    assert s.debug_lookup("a").count() == 0
    for k in range(2):
        s.put_df(spark.range(k * 500, k * 500 + 500).select(F.col("id").cast("string").alias("key"), F.lit("v" * 40).alias("value")))
        s.flush()
    rows = {r.run: r for r in s.debug_lookup("499").collect()}
    assert rows[1].bloom_maybe and rows[1].first_key <= "499" and rows[1].sparse_offset <= 500 * 59 and rows[1].level == 0
    assert len(fs.names(spark, f"{root}/index")) == 2
    first = s.debug_lookup("!").collect()
    assert all(r.first_key is None and r.sparse_offset == 0 for r in first)
    s.compact(0)
    assert fs.names(spark, f"{root}/index") == [] and s.debug_lookup("499").first().bloom_maybe


@pytest.mark.parametrize("target", [1, 40, 300, 5000, 10**9])
def test_blocks_across_partitions(spark, target):
    """Runs of one entry, of small and of large ones, cut into many partitions, against the plain fold."""
    rnd = random.Random(target)
    rows = [(r, f"{i:05d}", "x" * rnd.choice([0, 3, 30, 400])) for r, n in ((1, 1), (2, 700), (3, 40), (4, 1500)) for i in range(n)]
    df = spark.createDataFrame(rows, "run long, key string, value string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, stats.block_build(df, target=target).collect()))
        offsets = sorted((r.run, r.key, r.i, r.off) for r in stats.entry_offsets(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    want, places = [], []
    for run in (1, 2, 3, 4):
        off, blocks = 0, []
        for i, (_, key, value) in enumerate(x for x in rows if x[0] == run):
            n = 16 + len(key) + len(value)
            places.append((run, key, i, off))
            if not blocks or blocks[-1][5] >= target:
                blocks.append([run, len(blocks), key, off, 0, 0])
            blocks[-1][4] += 1
            blocks[-1][5] += n
            off += n
        want += map(tuple, blocks)
    assert got == want and offsets == places


def test_random_keys(spark):
    x, want = LCG[2], []
    for _ in range(5000):
        x = (x * LCG[0] + LCG[1]) % 2**64
        want.append(x)
    got = random_keys(spark, 4000).orderBy("i").collect()
    assert [r.key for r in got] == [str(x) for x in want[:4000]] and [bytes(r.value) for r in got] == [x.to_bytes(8, "little") for x in want[:4000]]
    assert sorted(r.key for r in random_reads(spark, 4000, 1000).collect()) == sorted({str(want[x % 4000]) for x in want[4000:]})


def test_one_shot_commands(spark, tmp_path, capsys):
    from kvlake.cli import main

    path = ["--db-path", f"{tmp_path}/db"]
    assert main([*path, "put", "k", "v 1"]) == 0 and main([*path, "get", "k"]) == 0
    assert main([*path, "delete", "k"]) == main([*path, "get", "k"]) == main([*path, "sync"]) == main([*path, "debug-get", "k"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[:4] == ["ok", "v 1", "ok", "(nil)"] and any(x.startswith("level=0 table=1 bloom=true") for x in said)
    (tmp_path / "bad/manifest").mkdir(parents=True)
    (tmp_path / "bad/manifest/v0000000001.json").write_text("{")
    assert main(["--path", f"{tmp_path}/bad", "get", "k"]) == 1 and "error" in capsys.readouterr().err


def test_shell_connects(spark, tmp_path):
    out = io.StringIO()
    sh = Shell(spark, f"{tmp_path}/one", out, out)
    for line in ("PUT a 1", f"CONNECT {tmp_path}/two", "GET a", "PUT a 2", f"CONNECT {tmp_path}/one", "GET a", "CUR", f"CONNECT {tmp_path}/one", "TW 5", "TG 5", "EXIT"):
        sh.run(line)
    text = out.getvalue().splitlines()
    assert text[:7] == ["ok", "ok", "(nil)", "ok", "ok", "1", f"{tmp_path}/one"] and sum("finished in" in x for x in text) == 2


def test_shell(spark, tmp_path):
    out, err = io.StringIO(), io.StringIO()
    sh = Shell(spark, f"{tmp_path}/db", out, err)
    for line in ("put a  x   y", "GET a", "DEL a", "get a", "SYNC", "DEBUGGET a", "nope", "TG z", "TW 20", "GET 7", "CUR", "NEW n", "CUR", "HELP", ""):
        assert sh.run(line)
    assert not sh.run("QUIT")
    text = out.getvalue().splitlines()
    assert text[:4] == ["ok", "x y", "ok", "(nil)"] and any(x.startswith("level=0 table=1") for x in text)
    assert any("Person7" in x for x in text) and f"{tmp_path}/db/n" in text
    assert "unknown command" in err.getvalue() and "error" in err.getvalue()
