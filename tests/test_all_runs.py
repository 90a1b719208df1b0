"""Queries over probes and runs against a brute force, on a small log of more runs than any given table of the SQL tests has."""
from datetime import datetime

import pytest

from kvlake.functions import bloom
from kvlake.operators import compaction, ordered
from kvlake.plans import catalogue
from kvlake.plans.store import KVStore

RUNS, PER_RUN = 25, 40


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    rows = [(r * catalogue.RUN_ROWS + j, datetime(2024, 1, 1), (r * 7 + j * 13) % 60, "error" if (r + j) % 9 == 0 else "view", 0.0, "p" * (j % 30)) for r in range(RUNS) for j in range(PER_RUN)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, f"c{i}", 0, 0.0, "m") for i in range(70)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, f"n{i}", 0) for i in range(12)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    runs = {}
    for event, _, user, kind, _, props in rows:
        runs.setdefault(event // catalogue.RUN_ROWS, {})[str(user)] = None if kind == "error" else props
    return d, runs, [str(i) for i in range(70)] + [f"absent-{i}" for i in range(12)]


def entries(run):
    """(key, offset, size) in key order."""
    out, off = [], 0
    for key in sorted(run):
        n = 16 + len(key) + len(run[key] or "")
        out.append((key, off, n))
        off += n
    return out


def blocks(run):
    """(first key, offset, entries, bytes)."""
    out = []
    for key, off, n in entries(run):
        if not out or out[-1][3] >= catalogue.BLOCK_TARGET:
            out.append((key, off, 0, 0))
        first, at, cnt, size = out[-1]
        out[-1] = (first, at, cnt + 1, size + n)
    return out


def positions(key, bits):
    def fold(h, prime, add):
        for b in key.encode():
            h = ((h ^ (b + add)) * prime) % 2**64
        return h

    one, two = fold(bloom.FNV_BASIS, bloom.FNV_PRIME, 0), fold(bloom.FNV_BASIS ^ bloom.SECOND_BASIS_MASK, bloom.FNV_PRIME ^ bloom.SECOND_PRIME_MASK, bloom.SECOND_BYTE_ADD) | 1
    return {(one + i * two) % 2**64 % bits for i in range(6)}


def maybe(run, key):
    bits = max(8 * len(run), 8)
    return positions(key, bits) <= set().union(*(positions(k, bits) for k in run))


def floor(rows, key, none):
    """The last of rows, sorted by their first field, that is not above the key."""
    return max((x for x in rows if x[0] <= key), default=none)


def sparse_offset(run, key):
    return floor(entries(run)[::16], key, (None, 0))[1]


def got(spark, small, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, small[0]).collect()), key=repr)


def test_debug_lookup(spark, small):
    want = [(r, k, maybe(run, k), *floor(blocks(run), k, (None,) * 4), sparse_offset(run, k)) for r, run in small[1].items() for k in small[2]]
    assert got(spark, small, "debug_lookup", "run", "key", "bloom_maybe", "first_key", "block_off", "entry_count", "byte_len", "sparse_offset") == sorted(want, key=repr)


def test_bloom_probe(spark, small):
    want = [(r, k, maybe(run, k)) for r, run in small[1].items() for k in small[2]]
    assert got(spark, small, "bloom_probe", "run", "key", "maybe") == sorted(want, key=repr)


def test_sparse_floor(spark, small):
    want = [(r, k, sparse_offset(run, k)) for r, run in small[1].items() for k in small[2]]
    assert got(spark, small, "sparse_floor", "run", "key", "off") == sorted(want, key=repr)


def test_block_floor(spark, small):
    want = []
    for r, run in small[1].items():
        numbered = [(first, i, off, cnt) for i, (first, off, cnt, _) in enumerate(blocks(run))]
        want += [(r, k, *floor(numbered, k, (None,) * 4)[1:]) for k in small[2]]
    assert got(spark, small, "block_floor", "run", "key", "block", "off", "entry_count") == sorted(want, key=repr)


def test_fence_prune(spark, small):
    want = [(r, k) for r, run in small[1].items() for k in small[2] if min(run) <= k <= max(run)]
    assert got(spark, small, "fence_prune", "run", "key") == sorted(want, key=repr)


def test_reopen_of_a_log_over_the_bound(spark, small, monkeypatch):
    monkeypatch.setattr(KVStore.__init__, "__defaults__", (compaction.THRESHOLDS, 1))
    want = {}
    for half in (0, 1):
        for r in sorted(small[1])[half::2]:
            want |= small[1][r]
    assert got(spark, small, "reopen", "key", "value", "tables", "emptied") == sorted(((k, v, 1, True) for k, v in want.items() if v is not None), key=repr)


def moved(spark, frame):
    """Rows that the making and reading of a query's result put into shuffles and tables."""
    def stages():
        jvm = spark.sparkContext._jvm
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() + found.apply(i).outputRecords() for i in range(found.size())}

    before = stages()
    rows = frame().count()
    return rows, sum(n for at, n in stages().items() if at not in before)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Many keys and runs, few entries: 250 runs of 12 entries, 3,010 keys."""
    d = str(tmp_path_factory.mktemp("wide"))
    rows = spark.range(250 * 12).selectExpr(f"id div 12 * {catalogue.RUN_ROWS} + id % 12 as event_id", "timestamp'2024-01-01' as ts", "id * 37 % 3000 as user_id", "'view' as event_type", "0d as value", "'pp' as props")
    rows.write.parquet(f"{d}/events.parquet")
    spark.range(3000).selectExpr("id as c_custkey", "'c' as c_name", "0 as c_nationkey", "0d as c_acctbal", "'m' as c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(10).selectExpr("cast(id as int) as n_nationkey", "'n' as n_name", "0 as n_regionkey").write.parquet(f"{d}/nation.parquet")
    return d


@pytest.mark.parametrize("name", ["block_floor", "sparse_floor", "debug_lookup"])
def test_pairs_are_not_moved(spark, wide, name):
    rows, shuffled = moved(spark, lambda: catalogue.QUERIES[name](spark, wide))
    assert rows == 3010 * 250
    assert shuffled < rows / 5


@pytest.mark.parametrize("blocks, pairs", [(2, 4), (7, 1 << 23), (64, 1000)])
def test_blocks_and_shares_of_any_size(spark, small, monkeypatch, blocks, pairs):
    monkeypatch.setattr(ordered, "BLOCK", blocks)
    monkeypatch.setattr(ordered, "PAIRS", pairs)
    test_sparse_floor(spark, small)
    test_fence_prune(spark, small)


@pytest.mark.parametrize("name", ["fence_prune", "bloom_probe"])
def test_runs_meet_blocks_and_not_keys(spark, wide, name):
    rows = catalogue.QUERIES[name](spark, wide).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    at = store.executionsList().last().executionId()
    nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
    joins = [n for n in map(nodes.apply, range(nodes.size())) if "Join" in n.name()]
    counts = [m for n in joins for m in map(n.metrics().apply, range(n.metrics().size())) if m.name() == "number of output rows"]
    joined = [int(values.apply(m.accumulatorId()).replace(",", "")) for m in counts]
    assert rows > 100_000 and joined and max(joined) < rows / 5


@pytest.fixture
def mixed(spark, small, tmp_path, monkeypatch):
    """Runs of 40 and of 10 entries: filters of two segments and of one."""
    monkeypatch.setattr(bloom, "SEGMENT_BITS", 2)
    monkeypatch.setattr(bloom, "SEGMENT", 4)
    for t in ("customer", "nation"):
        spark.read.parquet(f"{small[0]}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{small[0]}/events.parquet").filter(f"event_id % {catalogue.RUN_ROWS} < if(event_id div {catalogue.RUN_ROWS} % 2 = 0, 40, 10)").write.parquet(f"{tmp_path}/events.parquet")
    runs = {}
    for r in spark.read.parquet(f"{tmp_path}/events.parquet").orderBy("event_id").collect():
        runs.setdefault(r.event_id // catalogue.RUN_ROWS, {})[str(r.user_id)] = None if r.event_type == "error" else r.props
    return str(tmp_path), runs, small[2]


def test_filters_of_one_segment_and_of_more(spark, mixed):
    assert {len(run) for run in mixed[1].values()} == {10, 40}
    test_bloom_probe(spark, mixed)
    test_debug_lookup(spark, mixed)


@pytest.mark.parametrize("blocks, strips, pairs", [(8, 3, 4), (64, 5, 1000), (64, 16, 1 << 23)])
def test_strips_of_any_size(spark, small, monkeypatch, blocks, strips, pairs):
    monkeypatch.setattr(ordered, "STRIP", strips)
    test_blocks_and_shares_of_any_size(spark, small, monkeypatch, blocks, pairs)
    test_block_floor(spark, small)


def stored(spark, name, d, to):
    """Rows of a query's result, and its bytes as a table."""
    catalogue.QUERIES[name](spark, d).write.parquet(str(to))
    return spark.read.parquet(str(to)).count(), sum(f.stat().st_size for f in to.glob("*.parquet"))


def test_stored_floors_are_small(spark, wide, tmp_path):
    rows, size = stored(spark, "sparse_floor", wide, tmp_path / "out")
    assert rows == 3010 * 250
    assert size < rows / 2


def test_stored_ranges_are_small(spark, wide, tmp_path):
    rows, size = stored(spark, "fence_prune", wide, tmp_path / "out")
    assert rows > 100_000
    assert size < rows / 2
