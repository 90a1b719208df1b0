"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold sum(c[k] * BASE**k) mod P over its code points, for two moduli. The difference of two entries,
times the inverse power at the span's start, is the span's hash: equal for equal spans wherever they lie, 62 bits in all.
So the arrays answer any span equality, and longest common extensions, forwards and backwards, by binary search.

Likeness of two texts is the share of both that their common spans cover. Spans of `GRAM` characters whose hash falls into
one of `EVERY` classes are samples, the same in both texts; a sample that both texts hold is extended as far as they agree,
and so are the two starts and the two ends. Common spans of fewer than `GRAM` characters do not count, unless they are a
whole text. The fingerprint spells the whole text's hash under both moduli, its length, and its `SLOTS` smallest samples.

Cases: a NULL or empty text has a fingerprint of zeros, likeness 1 to another empty one and 0 to others; a text shorter than
a gram is like an equal one only; equal texts have equal fingerprints; very long texts are hashed whole, and of repeated
samples the first counts; rows that share a doc_id, or have none, are
ordered by their texts' hash, then text, those without doc_id first, and cut into ranges if they are many; a
single document is its own next; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvlake.llm.common import worker_cache

GRAM, SLOTS, EVERY = 24, 64, 16
# Moduli (a Mersenne prime first) and bases of the polynomials.
MODULI, BASES = (2147483647, 2147483629), (1000003, 911382323)
#: Pairs of places up to which extensions are found one by one.
FEW = 24
#: Documents, about, that share a range, and ranges at most; beyond that, ranges grow.
PART_ROWS, PARTS = 1024, 1 << 16


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse for k < n, kept by the worker and doubled as needed."""
    held, key = worker_cache(), ("powers", which)
    have = held.get(key)
    if have is None or len(have[0]) < n:
        p, out = MODULI[which], []
        for base in (BASES[which], pow(BASES[which], -1, p)):
            x = np.ones(1, np.uint64)
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), p)) % np.uint64(p)])
            out.append(x)
        held[key] = have = tuple(out)
    return have


class PrefixHash:
    """Prefix arrays of one text under both moduli."""

    def __init__(self, codes: np.ndarray):
        self.n, self.sums = len(codes), []
        for w in range(len(MODULI)):
            up, _ = powers(w, self.n + 1)
            # products are below 2**62 and reduced, so sums of 2**32 of them fit
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * up[: self.n] % np.uint64(MODULI[w]), out=sums[1:])
            self.sums.append(sums)

    def spans(self, length: int, which: int = 0) -> np.ndarray:
        """The hash of every span of that length."""
        p, s = np.uint64(MODULI[which]), self.sums[which]
        _, down = powers(which, self.n + 1)
        return (s[length:] - s[: self.n + 1 - length]) % p * down[: self.n + 1 - length] % p

    def span(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """The hashes of the spans from `start` to `end`."""
        p, s = np.uint64(MODULI[which]), self.sums[which]
        return (s[end] - s[start]) % p * powers(which, self.n + 1)[1][start] % p

    def same(self, start: np.ndarray, other: PrefixHash, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.span(start, start + length, w) == other.span(at, at + length, w) for w in range(len(MODULI))])

    def extension(self, start, other: PrefixHash, at, back: bool = False) -> np.ndarray:
        """The longest common extensions of pairs of places, by binary search on span equality: of what follows them, or
        of what comes before."""
        start, at = np.atleast_1d(np.asarray(start, np.int64)), np.atleast_1d(np.asarray(at, np.int64))
        if len(start) <= FEW:
            return np.array([self._extension(i, other, j, back) for i, j in zip(start.tolist(), at.tolist())], np.int64)
        lo, hi = np.zeros(len(start), np.int64), np.minimum(start, at) if back else np.minimum(self.n - start, other.n - at)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            equal = self.same(start - mid, other, at - mid, mid) if back else self.same(start, other, at, mid)
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        return lo


    def _extension(self, start: int, other: PrefixHash, at: int, back: bool) -> int:
        """The same for one pair of places, which is quicker by numbers than by arrays of one."""
        lo, hi = 0, min(start, at) if back else min(self.n - start, other.n - at)
        tables = [(p, s, t, powers(w, self.n + 1)[1], powers(w, other.n + 1)[1]) for w, (p, s, t) in enumerate(zip(MODULI, self.sums, other.sums))]
        while lo < hi:
            mid = (lo + hi + 1) // 2
            i, j = (start - mid, at - mid) if back else (start, at)
            for p, s, t, down, down2 in tables:
                if (int(s[i + mid]) - int(s[i])) * int(down[i]) % p != (int(t[j + mid]) - int(t[j])) * int(down2[j]) % p:
                    hi = mid - 1
                    break
            else:
                lo = mid
        return lo


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatters 31-bit hashes over 32 bits, one to one."""
    m = np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B) & m
    x = (x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35) & m
    return x ^ (x >> np.uint64(16))


class Print:
    """A text's prefix arrays, samples and fingerprint."""

    def __init__(self, text: str):
        self.prefix = PrefixHash(codes(text))
        n = self.n = self.prefix.n
        self.names = self.places = np.empty(0, np.int64)
        if n >= GRAM:
            mixed = _mix(self.prefix.spans(GRAM))
            at = np.flatnonzero(mixed % np.uint64(EVERY) == 0)
            both = (mixed[at] << np.uint64(31) | self.prefix.span(at, at + GRAM, 1)).astype(np.int64)
            self.names, first = np.unique(both, return_index=True)  # ordered by the mixed hash
            self.places = at[first]
        ends = np.zeros(1, np.int64), np.full(1, n, np.int64)
        whole = [int(self.prefix.span(*ends, w)[0]) for w in range(len(MODULI))]
        self.text = "".join(f"{x:08x}" for x in [*whole, n]) + self.names[:SLOTS].astype(">i8").tobytes().hex()


def _spans(a: Print, b: Print) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in a and in b, and lengths, of the common spans around shared samples, and at the texts' starts and ends."""
    _, i, j = np.intersect1d(a.names, b.names, assume_unique=True, return_indices=True)
    p, q = a.places[i], b.places[j]
    found = [(np.zeros(1, np.int64), np.zeros(1, np.int64), a.prefix.extension(0, b.prefix, 0))]
    tail = a.prefix.extension(a.n, b.prefix, b.n, back=True)
    found.append((a.n - tail, b.n - tail, tail))
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    while p.size:  # the first sample of each diagonal is extended; those in its span are done
        head = np.append(True, (p - q)[1:] != (p - q)[:-1])
        x, y = p[head], q[head]
        before, after = a.prefix.extension(x, b.prefix, y, back=True), a.prefix.extension(x, b.prefix, y)
        found.append((x - before, y - before, before + after))
        left = p >= (x + after)[np.cumsum(head) - 1]
        p, q = p[left], q[left]
    return tuple(np.concatenate(f) for f in zip(*found))


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> int:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def likeness(a: Print, b: Print) -> float:
    """The share of both texts that their common spans cover."""
    if a.n == b.n and a.text == b.text:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    x, y, size = _spans(a, b)
    kept = size >= GRAM
    return (_covered(a.n, x[kept], size[kept]) + _covered(b.n, y[kept], size[kept])) / (a.n + b.n)


FIELDS = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in order, each against the next; a borrowed row (from the next part) ends it."""
    last = part = None

    def row(now, after):
        doc_id, text, mine = now
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        changed = Print(edited)
        return doc_id, len(text), edited, mine.text, changed.text, likeness(mine, changed), likeness(mine, after[2]), int(mine.prefix.extension(0, changed.prefix, 0)[0])

    names = [f.split()[0] for f in FIELDS.split(", ")]
    for b in batches:
        out = []
        for p, doc_id, text, borrowed in zip(*(c.to_pylist() for c in b.columns)):
            now = (doc_id, text, Print(text))
            if last is not None and p == part:
                out.append(row(last, now))
            last, part = (None if borrowed else now), p
        if out:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names)


def _range(cuts: list[int]):
    """How many cuts lie below doc_id, found among every 256th cut first, then among the 256 that follow."""
    coarse = cuts[::256]
    count = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))
    block = count(F.lit(coarse).cast("array<bigint>"))
    fine = F.array(*[F.lit(cuts[k: k + 256]).cast("array<bigint>") for k in range(0, len(cuts), 256)])
    inside = F.transform(F.array(block), lambda b: F.when(b > 0, (b - 1) * 256 + count(F.element_at(fine, F.greatest(b, F.lit(1))))).otherwise(F.lit(0)))[0]
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(inside).cast("int")


def with_next(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and its likeness to that and to the next document.

    Documents are dealt into ranges of doc_id, cut by quantiles of the ids alone; the first document of each range is
    also lent to the range before it (of the first one: to the last), so ranges are worked on apart and texts move once."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 33))
    ids = rows.select("doc_id")
    total = ids.count()
    parts = max(1, min(PARTS, -(-total // part_rows)))
    share = max(part_rows, -(-total // parts))
    cuts = {int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)} if parts > 1 else set()
    # a doc_id of many rows, or NULL, is a range of its own, cut by the texts' hashes; there are fewer than PARTS of them
    hot = {r.doc_id: -(-r.n // share) for r in ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * share).collect()}
    cuts = sorted(cuts | {x + d for x in hot if x is not None for d in (-1, 0)})
    many = F.lit(1)
    if hot:
        known = spark.createDataFrame(list(hot.items()), "hot_id long, many int")
        rows = rows.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")
        many = F.coalesce("many", F.lit(1))
    sub = F.shiftright(F.col("h") * many, 31)
    rows = rows.withColumn("part", ((_range(cuts) if cuts else F.lit(0)) + F.when(F.col("doc_id").isNull(), 0).otherwise(1)).cast("long") * (1 << 24) + sub).select("part", "doc_id", "h", "text")
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("m")).select("part", "m.doc_id", "m.h").collect()
    firsts.sort(key=lambda r: r.part)
    if not firsts:
        return spark.createDataFrame([], FIELDS)
    # at most a few times PARTS rows; a range's first document goes to the range before
    lend = spark.createDataFrame([(firsts[k - 1].part, r.part, r.doc_id, r.h) for k, r in enumerate(firsts)], "to long, own long, first long, first_h long")
    lent = rows.join(F.broadcast(lend), (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")))
    lent = lent.groupBy("to").agg(F.min(F.struct("doc_id", "h", "text")).alias("m")).select(F.col("to").alias("part"), "m.doc_id", "m.h", "m.text", F.lit(True).alias("borrowed"))
    both = rows.withColumn("borrowed", F.lit(False)).unionByName(lent).select("part", "doc_id", "h", "text", "borrowed")
    dealt = both.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "borrowed", F.asc_nulls_first("doc_id"), "h", "text")
    return dealt.select("part", "doc_id", "text", "borrowed").mapInArrow(_compare, FIELDS)
