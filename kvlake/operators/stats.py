"""Statistics of sorted runs: fences, offsets, sparse and block indexes, buffer accounting.

A compacted run may be the whole store, so nothing here follows a run in one task: runs are cut into range partitions,
and counts, sums or open blocks are handed from one partition to the next."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kvlake.functions.codec import encoded_size, payload_size
from kvlake.operators import lww, ordered
from kvlake.operators.grouped import group_bounds, whole_groups

STRIDE = 16
BLOCK_BYTES = 4096


def fence_build(entries: DataFrame, by: str = "run") -> DataFrame:
    return entries.groupBy(by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def entry_sizes(entries: DataFrame) -> DataFrame:
    return entries.withColumn("n", encoded_size(F.col("key"), F.col("value")))


def entry_offsets(entries: DataFrame, by: str = "run") -> DataFrame:
    """Ordinal `i`, encoded size `n` and byte offset `off` of each entry in key order."""
    sized = entry_sizes(entries)
    rows = ordered.numbered(sized, by, "key")
    base = ordered.before(rows, [by], __i=F.lit(1), __off=F.col("n"))
    rows = rows.join(base, [by, ordered.PART])
    rows = rows.withColumn("i", F.col("__i") + F.col(ordered.ROW) - F.col("__first"))
    rows = rows.withColumn("off", F.col("__off") + F.coalesce(F.sum("n").over(ordered.earlier_rows([by])), F.lit(0)))
    return rows.select(*sized.columns, "i", "off")


def sparse_build(entries: DataFrame, by: str = "run", stride: int = STRIDE) -> DataFrame:
    return entry_offsets(entries, by).filter(F.col("i") % stride == 0).select(by, "key", "off")


def _next_starts(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the entries (and the end), and the entry after the one that closes a block opened at each."""
    ends = np.cumsum(sizes)
    off = np.append(0, ends)
    return off, np.searchsorted(ends, off + target, "left") + 1


def _pieces(by: str, target: int):
    """What a partition's share of a run does to an open block of any size.

    A block that is open at the share's start closes within its first `target` bytes, so the next block starts at one of
    few entries; for each of them: the bytes left open at the share's end, and the blocks started."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [by, ordered.PART]):
            run_, part, n = (t.column(c).combine_chunks() for c in (by, ordered.PART, "n"))
            bounds = group_bounds(run_.to_numpy(zero_copy_only=False), part.to_numpy())
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                size = hi - lo
                off, after = _next_starts(n.slice(lo, size).to_numpy(), target)
                closes = off[1:][: np.searchsorted(off[1:], target - 1, "left") + 1]
                at = np.arange(len(closes) + 1)
                left, started = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                live = np.flatnonzero(at < size)
                while live.size:
                    started[live] += 1
                    to = after[at[live]]
                    open_ = to > size
                    left[live[open_]] = off[-1] - off[at[live[open_]]]
                    at[live] = to
                    live = live[~open_ & (to < size)]
                out.append((size, off[-1], closes, left, started))
            size, total, closes, left, started = zip(*out)
            longs = pa.list_(pa.int64())
            yield pa.record_batch([run_.take(pa.array(bounds[:-1])), part.take(pa.array(bounds[:-1])), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(closes, longs), pa.array(left, longs), pa.array(started, longs)],
                                  [by, ordered.PART, "size", "total", "closes", "left", "started"])

    return run


def _chain(by: str, target: int):
    """Each share's first block start (-1: none), the places and blocks before it, and the next start after it."""
    fields = [by, ordered.PART, "first", "base_i", "base_off", "base_block", "next_i", "next_off"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [by]):
            runs = t.column(by).combine_chunks()
            bounds = group_bounds(runs.to_numpy(zero_copy_only=False))
            rows = t.select([ordered.PART, "size", "total", "closes", "left", "started"]).to_pylist()
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                carry = i = off = block = 0
                found = []
                for r in rows[lo:hi]:
                    first = 0 if carry == 0 else int(np.searchsorted(r["closes"], target - carry, "left")) + 1
                    if first > len(r["closes"]) and first > r["size"]:
                        found.append((-1, i, off, block, 0))
                        carry += r["total"]
                    else:
                        found.append((first if first < r["size"] else -1, i, off, block, r["closes"][first - 1] if first else 0))
                        carry, block = r["left"][first], block + r["started"][first]
                    i, off = i + r["size"], off + r["total"]
                made = []
                for r, (first, bi, bo, bb, inside) in zip(reversed(rows[lo:hi]), reversed(found)):
                    made.append((r[ordered.PART], first, bi, bo, bb, i, off))
                    if first >= 0:
                        i, off = bi + first, bo + inside
                out += reversed(made)
            yield pa.record_batch([runs, *[pa.array(c, pa.int64()) for c in zip(*out)]], fields)

    return run


def _blocks(by: str, target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [by, ordered.PART]):
            run_, part, key, n = (t.column(c).combine_chunks() for c in (by, ordered.PART, "key", "n"))
            known = {c: t.column(c).to_numpy() for c in ("first", "base_i", "base_off", "base_block", "next_i", "next_off")}
            bounds = group_bounds(run_.to_numpy(zero_copy_only=False), part.to_numpy())
            at, longs = [], [[np.empty(0, np.int64)] for _ in range(4)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                one = {c: int(v[lo]) for c, v in known.items()}
                if one["first"] < 0:
                    continue
                off, after = _next_starts(n.slice(lo, hi - lo).to_numpy(), target)
                starts, s = [], one["first"]
                while s < hi - lo:
                    starts.append(s)
                    s = int(after[s])
                starts = np.array(starts, np.int64)
                at.append(lo + starts)
                place, offset = one["base_i"] + starts, one["base_off"] + off[starts]
                for made, x in zip(longs, (one["base_block"] + np.arange(len(starts)), offset, np.diff(np.append(place, one["next_i"])), np.diff(np.append(offset, one["next_off"])))):
                    made.append(x)
            if at:
                at = pa.array(np.concatenate(at))
                block, off, count, size = (pa.array(np.concatenate(x)) for x in longs)
                yield pa.record_batch([run_.take(at), block, key.take(at), off, count, size], [by, "block", "first_key", "off", "entry_count", "byte_len"])

    return run


def block_build(entries: DataFrame, by: str = "run", target: int = BLOCK_BYTES) -> DataFrame:
    """Greedy blocks: a block closes with the entry that brings it to `target` bytes; the last may be smaller.

    Each share of a run in a range partition is summed up for every place at which its first block may start; one row
    per share is chained along the run, and then the shares' blocks are cut apart from each other."""
    kind = entries.schema[by].dataType
    schema = lambda longs, lists=(): T.StructType([T.StructField(by, kind), *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.ArrayType(T.LongType())) for c in lists]])
    rows = ordered.numbered(entry_sizes(entries).select(by, "key", "n"), by, "key")
    share = (by, ordered.PART)
    pieces = rows.select(*share, ordered.ROW, "n").repartition(*share).sortWithinPartitions(*share, ordered.ROW).mapInArrow(_pieces(by, target), schema([ordered.PART, "size", "total"], ["closes", "left", "started"]))
    chained = pieces.repartition(by).sortWithinPartitions(*share).mapInArrow(_chain(by, target), schema([ordered.PART, "first", "base_i", "base_off", "base_block", "next_i", "next_off"]))
    out = T.StructType([T.StructField(by, kind), T.StructField("block", T.LongType()), T.StructField("first_key", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("off", "entry_count", "byte_len")]])
    return rows.join(chained, [*share]).repartition(*share).sortWithinPartitions(*share, ordered.ROW).mapInArrow(_blocks(by, target), out)


def memtable_bytes(log: DataFrame, by: str = "run") -> DataFrame:
    """Live buffer bytes per batch: replaced versions give back their size."""
    return lww.latest(log, by).groupBy(by).agg(F.sum(payload_size(F.col("key"), F.col("value"))).cast("long").alias("bytes"))
