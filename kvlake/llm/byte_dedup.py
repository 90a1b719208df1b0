"""Removal of repeated byte strings by refining buckets of suffixes.

Suffixes are sampled where a 32-gram is the leftmost smallest (by hash) of some 200-byte window, so equal windows
sample the same place. The sampled suffixes start in buckets named by that 32-gram. Buckets with one member go; the
others are refined by the names of later offsets, where the name of a string of length 2L joins the names at its start
and L further on, so each level's names serve the next: first the bytes common to up to 64 neighbouring windows, then
all bytes these windows cover. Where a bucket still holds different strings, its windows are sorted by name: inside a
task for buckets of up to `GROUP` rows, else as rows of their own. Every refinement across tasks is a sort-and-count on
names with map-side combining, so a passage in a third of all documents costs a row a task, and no pairs are formed.
Names that decide a removal are 128 bits, a bucket's and its member's or two of a window.

Bytes covered by a `LENGTH`-byte string that also starts elsewhere go; overlaps and places in the same document count,
strings across documents do not. Cases: NULL and short texts keep all bytes; equal rows are copies of each other; rows
with the same doc_id and other texts are other documents; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvlake.llm.common import group_bounds, whole_groups
from kvlake.sources import scratch

LENGTH, GRAM, STEP = 200, 32, 64
#: Rows of a bucket that one task sorts, and windows it refines at once, about.
GROUP, WINDOWS = 512, 1 << 14
#: Windows that one task refines, about.
TASK_WINDOWS = 1 << 19
SPAN = LENGTH - GRAM + 1  # gram starts in a window
CORE = LENGTH - STEP + 1  # bytes that STEP neighbouring windows share
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def join(a: np.ndarray, b: np.ndarray, family: int = 0) -> np.ndarray:
    """The name of what is named a, then b."""
    x = a * _C[family] + (b ^ (b >> np.uint64(29))) * _C[family + 1]
    x ^= x >> np.uint64(32)
    x *= _C[(family + 2) % 4]
    x ^= x >> np.uint64(29)
    return x


def names(data: bytes, top: int, family: int = 0) -> np.ndarray:
    """The name of the `top` bytes (a power of two, 8 at least) at every place."""
    x = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype(np.uint64)
    size = 8
    while size < top:
        x = join(x[:-size], x[size:], family) if len(x) > size else x[:0]
        size *= 2
    return x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name of the anchor's gram, first window, last window, anchor): windows in runs that share an anchor."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    gram = names(data, GRAM)
    # the smaller hash wins, then the smaller place: a choice that the window's bytes alone decide
    key = (join(gram, gram, 2) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: len(key) - (SPAN - size)], key[SPAN - size:])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, len(place) - 1)
    return gram[place[first]], first, last, place[first]


def _pack(first, last, anchor):
    """One long: first window, run length and the anchor's distance, each below 2**8 by construction."""
    return (first << 16) | ((last - first) << 8) | (anchor - first)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [[np.empty(0, np.int64)] for _ in range(4)]
        for k1, k2, text in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)):
            name, first, last, anchor = anchors(text.as_py())
            if len(first):
                for out, x in zip(parts, (name.view(np.int64), np.full(len(first), k1), np.full(len(first), k2), _pack(first, last, anchor))):
                    out.append(x)
        yield pa.record_batch([pa.array(np.concatenate(p)) for p in parts], ["bucket", "k1", "k2", "run"])


class _Names:
    """Names of any string of 128 to 384 bytes of one text, in two families."""

    def __init__(self, data: bytes):
        self.half = [names(data, 128, f) for f in (0, 1)]

    def of(self, start: np.ndarray, length: np.ndarray, family: int) -> np.ndarray:
        h = self.half[family]
        end = start + length - 128
        return join(join(h[start], h[(start + end) // 2], family), h[end], family) + length.astype(np.uint64)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to STEP neighbouring windows a row: the name of what they share, and the name of all they cover."""
    fields = ["k1", "k2", "core", "cover", "start", "windows"]
    for b in batches:
        parts = [[np.empty(0, np.int64)] for _ in fields]
        for k1, k2, text, runs in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)):
            run = np.unique(np.array(runs.as_py(), np.int64))
            first, count, distance = run >> 16, (run >> 8) & 255, run & 255
            anchor, last = first + distance, first + count
            named = _Names(text.as_py())
            for g in range(-(-SPAN // STEP)):
                # windows that start g * STEP to (g + 1) * STEP - 1 before the anchor
                lo, hi = np.maximum(first, anchor - (g + 1) * STEP + 1), np.minimum(last, anchor - g * STEP)
                some = lo <= hi
                lo, hi, at = lo[some], hi[some], (anchor - g * STEP)[some]
                core = named.of(at, np.full(len(at), CORE), 0) + np.uint64(g)
                cover = named.of(lo, hi - lo + LENGTH, 1) + ((at - lo).astype(np.uint64) << np.uint64(32))
                for out, x in zip(parts, (np.full(len(lo), k1), np.full(len(lo), k2), core.view(np.int64), cover.view(np.int64), lo, hi - lo + 1)):
                    out.append(x)
        yield pa.record_batch([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], fields)


OPENED = "k1 long, k2 long, start long, windows long, core long, bytes binary, w1 long, w2 long"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets that hold different strings: with their bytes if the bucket is small, else window by window."""
    fields = ["k1", "k2", "start", "windows", "core", "bytes", "w1", "w2"]
    for b in batches:
        longs, data = [[np.empty(0, np.int64)] for _ in range(7)], []
        for k1, k2, text, runs in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)):
            text = text.as_py()
            rows = sorted({(r["start"], r["windows"], r["core"], r["large"]) for r in runs.as_py()})
            small = [r for r in rows if not r[3]]
            if small:
                start, count, core = (np.array(x, np.int64) for x in list(zip(*small))[:3])
                zero = np.zeros(len(start), np.int64)
                for out, x in zip(longs, (np.full(len(start), k1), np.full(len(start), k2), start, count, core, zero, zero)):
                    out.append(x)
                data += [text[s: s + c - 1 + LENGTH] for s, c, *_ in small]
            large = [r for r in rows if r[3]]
            if large:
                p = np.unique(np.concatenate([np.arange(s, s + c) for s, c, *_ in large]))
                named, size, one = _Names(text), np.full(len(p), LENGTH), np.ones(len(p), np.int64)
                for out, x in zip(longs, (np.full(len(p), k1), np.full(len(p), k2), p, one, 0 * one, named.of(p, size, 0).view(np.int64), named.of(p, size, 1).view(np.int64))):
                    out.append(x)
                data += [None] * len(p)
        k1, k2, start, count, core, w1, w2 = (pa.array(np.concatenate(x)) for x in longs)
        yield pa.record_batch([k1, k2, start, count, core, pa.array(data, pa.binary()), w1, w2], fields)


def refine(data: bytes, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the LENGTH-byte strings at `at` occur twice in their bucket; `bucket` numbers the bucket of each byte.

    Buckets of 8-grams are refined by sorting on the bucket identifiers of offset and offset + h; the identifiers made are
    those of the next round, with h doubled. Only places whose bucket has another member go on; the places that a round
    looks up went through the round before with them."""
    ids = np.full(len(data), -1, np.int64)
    live, twice = at, np.zeros(len(at), bool)
    size = 8
    word = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))

    def numbered(places: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Identifiers by sorted order; -1 for a key that only one place has."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.cumsum(new) - 1
        alone = np.bincount(rank, minlength=1) == 1
        out = np.empty(len(places), np.int64)
        out[order] = np.where(alone[rank], -1, rank)
        return out

    places = np.unique(np.concatenate([live + k for k in range(0, LENGTH - 7, 8)])) if len(live) else live
    ids[places] = numbered(places, bucket[places], word[places])
    while size * 2 <= LENGTH and len(live):
        # the places that strings still in question ask for in the rounds to come: multiples of the length reached, and the end's
        live = live[(ids[live] >= 0)]
        ask = [live + k for k in range(0, LENGTH - 2 * size + 1, 2 * size)] + [live + LENGTH - 2 * size - k for k in range(0, LENGTH - 2 * size + 1, 2 * size)]
        places = np.unique(np.concatenate(ask))
        one, two = ids[places], ids[places + size]
        known = (one >= 0) & (two >= 0)
        made = np.full(len(places), -1, np.int64)
        made[known] = numbered(places[known], one[known], two[known])
        ids = np.full(len(data), -1, np.int64)
        ids[places] = made
        size *= 2
    first, last = ids[live], ids[live + LENGTH - size] if len(live) else ids[live]
    known = (first >= 0) & (last >= 0)
    whole = numbered(live[known], bucket[live[known]], first[known], last[known])
    place = np.searchsorted(at, live[known])
    twice[place] = whole >= 0
    return twice


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of whole buckets, the span from its first to its last repeated window. All windows of a row hold the
    bucket's core, so what its repeated windows cover is one span. Buckets are taken together up to `WINDOWS` windows."""
    for t in whole_groups(batches, ["core"]):
        bounds = group_bounds(t.column("core").to_numpy())
        windows = np.append(0, np.cumsum(t.column("windows").to_numpy()))
        part = (windows[bounds[:-1]] // WINDOWS).astype(np.int64)
        cuts = np.append(bounds[:-1][np.append(True, part[1:] != part[:-1])], bounds[-1])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = t.slice(lo, hi - lo)
            k1, k2, start, count, core = (rows.column(c).to_numpy() for c in ("k1", "k2", "start", "windows", "core"))
            sizes = count - 1 + LENGTH
            base = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(count)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            bucket = np.repeat(np.cumsum(np.append(True, core[1:] != core[:-1])), sizes)
            twice = refine(b"".join(rows.column("bytes").to_pylist()), bucket, base[row] + inside)
            row, inside = row[twice], inside[twice]
            first, last = np.full(len(count), 1 << 40), np.full(len(count), -1)
            np.minimum.at(first, row, inside)
            np.maximum.at(last, row, inside)
            some = last >= 0
            yield pa.record_batch([pa.array(x[some]) for x in (k1, k2, start + first, start + last + LENGTH)], ["k1", "k2", "start", "end"])


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal removed runs."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]]), [tuple(m) for m in merged]


def _cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column(1), b.column(2)):
            data = text.as_py()
            kept, gone = cut(data, [(x["start"], x["end"]) for x in spans.as_py() or ()])
            rows.append((kept, [{"start": s, "end": e} for s, e in gone], len(data)))
        kept, gone, n = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([b.column(0), pa.array(kept, pa.binary()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(n, pa.int64())], ["doc_id", "kept", "removed", "n_bytes"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by doc_id and text, with keys that are never NULL."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("data"))
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("data", "doc_id").alias("k2"), "data", "doc_id")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): the covered spans of each text that has some."""
    rows = _keyed(docs, id_col, text_col).select("k1", "k2", "data")
    long_ = rows.filter(F.octet_length("data") >= LENGTH)
    sampled = scratch.written(long_.mapInArrow(_sampled, "bucket long, k1 long, k2 long, run long"), "sampled")
    # tables that are joined on a bucket are written first: the join then sees two plain shuffles, and splits a hot bucket
    shared = scratch.written(sampled.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    runs = scratch.written(sampled.join(shared, "bucket").groupBy("k1", "k2").agg(F.collect_list("run").alias("runs")), "runs")
    scratch.drop(sampled, shared)

    level = scratch.written(long_.join(runs, ["k1", "k2"]).select("k1", "k2", "data", "runs").mapInArrow(_refined, "k1 long, k2 long, core long, cover long, start long, windows long"), "refined")
    state = level.groupBy("core").agg(F.count("*").alias("n"), F.min("cover").alias("lo"), F.max("cover").alias("hi")).filter("n > 1").select("core", (F.col("lo") == F.col("hi")).alias("same"))
    state = scratch.written(state, "state")
    placed = scratch.written(level.join(state, "core").select("k1", "k2", "core", "cover", "start", "windows", "same"), "placed")
    scratch.drop(runs, level, state)

    # in buckets that hold different strings, all windows of a string that occurs twice are repeated; one row stands for
    # it when windows are compared
    mixed = placed.filter("not same")
    covers_ = scratch.written(mixed.groupBy("core", "cover").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("first")), "covers")
    crowd = scratch.written(covers_.groupBy("core").agg((F.count("*") > GROUP).alias("large")), "crowd")
    covers = covers_.join(crowd, "core")
    judged = scratch.written(mixed.join(covers, ["core", "cover"]).select("k1", "k2", "core", "start", "windows", "large", (F.col("n") > 1).alias("whole"), (F.struct("k1", "k2", "start") == F.col("first")).alias("first")), "judged")
    span = ("k1", "k2", "start", (F.col("start") + F.col("windows") - 1 + LENGTH).alias("end"))
    whole = placed.filter("same").select(*span).unionByName(judged.filter("whole").select(*span))
    mixed = judged.filter("first or not whole").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "windows", "core", "large")).alias("runs"))
    opened = scratch.written(long_.join(mixed, ["k1", "k2"]).select("k1", "k2", "data", "runs").mapInArrow(_opened, OPENED), "opened")
    small = opened.filter("bytes is not null").select("k1", "k2", "start", "windows", "core", "bytes")
    # tasks of a bounded number of windows, however large the corpus
    n = small.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_WINDOWS)
    settled = small.repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_settled, "k1 long, k2 long, start long, end long")
    large = opened.filter("bytes is null").select("k1", "k2", "start", "w1", "w2")
    twice = scratch.written(large.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "twice")
    large = large.join(twice, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + LENGTH).alias("end"))
    spans = whole.unionByName(settled).unionByName(large)
    spans = scratch.written(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop(placed, judged, opened, covers_, crowd, twice)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, removed, n_bytes): the bytes that stay, and the maximal removed runs."""
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col)
    return (rows.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans")
            .mapInArrow(_cut_all, "doc_id long, kept binary, removed array<struct<start:long,end:long>>, n_bytes long"))
