"""What `simhash.near_copies` needs beside SimHash: shingle sets, MinHash bands, and the exact comparison of sets.

A pair of Jaccard similarity 0.8 differs in about 10 of 64 SimHash bits, which no filter of segments proposes at a cost that
grows with the corpus; bands of minima do. `BANDS` bands of `ROWS` minima miss a pair of similarity 0.8 with a chance of
(1 - 0.8^6)^32 = 0.00006, and more similar ones more rarely.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kvlake.llm.common import group_bounds, pieces, whole_groups

NGRAM, SEED = 5, 42
BANDS, ROWS = 32, 6
#: Shingles that one task compares at once; larger clusters are cut into pairs of blocks.
CUT = 1 << 19
_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white spaces only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= NGRAM:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - NGRAM + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[NGRAM - 1:].tolist())], np.uint64))


def set_hash(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), SEED) if hashes.size else 0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A long for each band; none for a set that only its equals can be similar to."""
    if hashes.size < 4:
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, hashes.size, 1024):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at: at + 1024]).min(axis=1), out=least)
    key, band = np.arange(BANDS, dtype=np.uint64), least.reshape(BANDS, ROWS)
    for r in range(ROWS):
        key = (key ^ (key >> np.uint64(29)) ^ band[:, r]) * _MIX
    return (key ^ (key >> np.uint64(32))).view(np.int64)


MARKS = "fp long, sim long, n long, keys array<long>"


def marks(sketch):
    """For each (text, row): the hash of the set of shingles, its SimHash by `sketch`, its size and its band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(t.as_py()) for t in b.column(0)]
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([b.column(1), longs([set_hash(s) for s in sets]), longs([sketch(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], ["row", *[f.split()[0] for f in MARKS.split(", ")]])

    return run


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        hashes = [shingles(t.as_py()).view(np.int64) for t in b.column(3)]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(hashes, pa.list_(pa.int64()))], ["cluster", "fp", "blocks", "hashes"])


def forest(values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Links that span the groups of similar sets: (index, indexes it reaches). Set i is values[bounds[i]:bounds[i + 1]].

    A found member leaves the sets that are left, so a dense group costs about one pass a member over what is left."""
    sizes, ids = np.diff(bounds), np.unique(values, return_inverse=True)[1]
    mark, left = np.zeros(len(ids), bool), np.ones(len(sizes), bool)
    held, part, starts, stack, out = np.arange(len(sizes)), ids, bounds[:-1] - bounds[0], [], []
    own = [ids[s:s + n] for s, n in zip(starts, sizes)]
    while left.any():
        if not stack:
            stack = [int(np.argmax(left))]
            left[stack[0]] = False
            continue
        x = stack.pop()
        if 2 * np.count_nonzero(left) < held.size:
            held = np.flatnonzero(left)
            part, starts = np.concatenate([own[i] for i in held]), np.cumsum(sizes[held]) - sizes[held]
        mark[own[x]] = True
        common = np.add.reduceat(mark[part], starts, dtype=np.int64)
        mark[own[x]] = False
        hit = held[left[held] & (9 * common >= 4 * (sizes[x] + sizes[held]))]  # common / union >= 4 / 5
        if hit.size:
            out.append((x, hit))
            left[hit] = False
            stack.extend(hit.tolist())
    return out


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["cluster", "block"]):
        fp, hashes = t.column("fp").to_numpy(), t.column("hashes").combine_chunks()
        values, at = hashes.values.to_numpy(), hashes.offsets.to_numpy().astype(np.int64)
        bounds = group_bounds(t.column("cluster").to_numpy(), t.column("block").to_numpy())
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo > 1:
                for x, hit in forest(values[at[lo]:at[hi]], at[lo:hi + 1]):
                    left.append(np.full(len(hit), fp[lo + x]))
                    right.append(fp[lo + hit])
        yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
