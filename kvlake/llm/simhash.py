"""SimHash near-duplicates with a pigeonring candidate filter.

Two fingerprints within `TAU` = 3 bits, cut into 4 segments on a ring, have a start from which every chain of 1, 2, 3
and 4 consecutive segments differs in at most 0, 1, 2 and 3 bits (the proportional budget, rounded down). So the first
segment is equal and the second differs in at most one bit: one of its halves is equal too. Those 24 bits are the
bucket key, 8 keys a fingerprint; the longer chains prune pairs before the full Hamming check.

Cases: a NULL or empty text has fingerprint zero and links like any other; a text of one or two words is one shingle;
equal fingerprints are one node, so copies are never paired; links run through documents without doc_id, which get the
smallest doc_id that they reach, NULL if there is none; a bit set in exactly half the shingles is 0; very long texts are
fingerprinted whole; repeated rows and doc_ids are rows of the same result; an empty table gives an empty result; further
columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvlake.llm import minhash
from kvlake.llm.common import components, group_bounds, whole_groups
from kvlake.sources import scratch

TAU, SEGMENTS, WIDTH = 3, 4, 16
NGRAM, SEED = 3, 42
#: Distinct fingerprints that one task compares at once; larger buckets are cut into pairs of blocks.
BLOCK = 1024


def fingerprint(text: bytes | None, ngram: int = NGRAM, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white spaces only
    if not words:
        return 0
    if len(words) <= ngram:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - ngram + 1].tolist()
    return sketch(np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[ngram - 1:].tolist())], "<u8"))


def sketch(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(doc_id, fp as a signed long) of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), ngram) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _segment(i: int):
    return F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)


def bucket_keys():
    """Start segment, half of the next segment, and the 24 bits: as one long."""
    half = WIDTH // 2
    keys = []
    for i in range(SEGMENTS):
        for j in range(2):
            bits = F.shiftrightunsigned(_segment(i + 1), half * j).bitwiseAND((1 << half) - 1)
            keys.append(F.lit((i * 2 + j) << 24).bitwiseOR(F.shiftleft(_segment(i), half)).bitwiseOR(bits).cast("long"))
    return F.array(*keys)


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """Bit mask and budget of the chains of 2, 3 and 4 segments from `start`."""
    out, mask = [], 0
    for length in range(1, SEGMENTS + 1):
        mask |= ((1 << WIDTH) - 1) << (WIDTH * ((start + length - 1) % SEGMENTS))
        if length > 1:
            out.append((np.uint64(mask), length * TAU // SEGMENTS))
    return out


def forest(fp: np.ndarray, start: int) -> list[tuple[int, np.ndarray]]:
    """Links that span the linked groups among distinct fingerprints of one bucket: (index, indexes it reaches).

    A found member leaves the remaining set, so a dense group costs about one pass a member over what remains."""
    masks = _chain_masks(start)
    remaining, stack, out = np.arange(1, len(fp)), [0], []
    while remaining.size:
        if not stack:
            stack, remaining = [int(remaining[0])], remaining[1:]
            continue
        x = stack.pop()
        diff, at = fp[remaining] ^ fp[x], np.arange(len(remaining))
        for mask, budget in masks:
            near = np.bitwise_count(diff[at] & mask) <= budget
            at = at[near]
            if not at.size:
                break
        if at.size:
            hit = remaining[at]
            out.append((x, hit))
            stack.extend(hit.tolist())
            remaining = np.delete(remaining, at)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["k", "blocks"]):
        key, blocks, fp, rep = (t.column(c).to_numpy() for c in ("k", "blocks", "fp", "rep"))
        fp = fp.view(np.uint64)
        bounds = group_bounds(key, blocks)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        sizes = np.diff(bounds)
        for g in np.flatnonzero(sizes > 1):
            lo, hi = bounds[g], bounds[g + 1]
            for x, hit in forest(fp[lo:hi], int(key[lo]) >> 25):
                left.append(np.full(len(hit), rep[lo + x]))
                right.append(rep[lo + hit])
        yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _dealt(key: str, cut: str):
    """The pairs of blocks (s, t), s <= t, of which one is the key's block of `cut`; one pair if `cut` is NULL."""
    own = F.pmod(F.xxhash64(key), F.col(cut)).cast("long")
    pair = lambda t: F.when(t < own, t * (1 << 20) + own).otherwise(own * (1 << 20) + t)
    return F.when(F.col(cut).isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col(cut).cast("long") - 1), pair))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between `rep`s of distinct `fp`s that span every linked group of (fp, rep)."""
    keyed = nodes.select("fp", "rep", F.explode(bucket_keys()).alias("k"))
    large = keyed.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("cut"))
    # a bucket of several blocks meets itself as pairs of blocks (s, t): each row goes to the pairs of its own block
    dealt = keyed.join(large, "k", "left").withColumn("blocks", _dealt("fp", "cut"))
    rows = dealt.select("fp", "rep", "k", F.explode("blocks").alias("blocks"))
    return rows.repartition("k", "blocks").sortWithinPartitions("k", "blocks").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach, itself included; NULL if they reach none."""
    fps = scratch.written(fingerprints(docs, id_col, text_col, ngram), "simhash")
    nodes = scratch.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    comp = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    reached = scratch.written(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "reached")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    label = scratch.written(reached.join(least, "component").select("fp", "component_id"), "labels")
    scratch.drop(nodes, reached, *comp._scratch)
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, row: str = "__row", text_col: str = "text") -> DataFrame:
    """(row, component): documents linked by a Jaccard similarity of 0.8 or more of their sets of five-word shingles, as
    compared exactly on whole texts; `row` is a column that tells rows apart, `component` names the group.

    SimHash links of the sets (within `TAU` bits, by the pigeonring filter) and shared MinHash bands only propose: what they
    connect is a cluster, inside which the sets are compared. Cases: words are those of `fingerprint`; a text of up to five
    words is one shingle, a NULL or empty text has none, and equal sets (also empty ones) are one node; two different sets
    of which one has fewer than 4 shingles are never similar enough; an empty table gives an empty result."""
    rows = docs.select(F.col(text_col).cast("binary").alias("t"), F.col(row).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    marks = scratch.written(rows.mapInArrow(minhash.marks(sketch), f"row {kind}, {minhash.MARKS}"), "marks")
    one = scratch.written(marks.groupBy("fp").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.min("sim").alias("sim")), "sets")
    some = one.filter("n >= 4").select("fp", "sim")
    near = some.groupBy("sim").agg(F.min("fp").alias("rep"))
    proposed = links(near.select(F.col("sim").alias("fp"), "rep")).unionByName(some.join(near, "sim").filter("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b")))
    keyed = marks.filter(F.size("keys") > 0).select("row", "fp", "keys").join(one.select("row"), "row", "left_semi").select("fp", F.explode("keys").alias("k"))
    shared = scratch.written(keyed.groupBy("k").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").select("k", "least"), "bands")
    clusters = components(keyed.join(shared, "k").select(F.col("fp").alias("a"), F.col("least").alias("b")).unionByName(proposed))
    members = scratch.written(one.join(clusters.select(F.col("node").alias("fp"), F.col("component").alias("cluster")), "fp").select("fp", "cluster", "row", "n"), "members")
    # a cluster of several blocks meets itself as pairs of blocks (s, t): each set goes to the pairs of its own block
    large = members.groupBy("cluster").agg(F.sum("n").alias("n")).filter(F.col("n") > minhash.CUT).select("cluster", F.ceil(F.col("n") / minhash.CUT).cast("int").alias("cut"))
    dealt = members.join(large, "cluster", "left").withColumn("blocks", _dealt("fp", "cut"))
    texts = rows.join(dealt, "row").select("cluster", "fp", "blocks", "t")
    sets = texts.mapInArrow(minhash.sets, "cluster long, fp long, blocks array<long>, hashes array<long>").select("cluster", "fp", "hashes", F.explode("blocks").alias("block"))
    comp = components(sets.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(minhash.similar, "a long, b long"))
    label = marks.select("row", "fp").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("row", F.coalesce("component", "fp").alias("component"))
    label = scratch.written(label, "copies")
    scratch.drop(marks, one, shared, members, *clusters._scratch, *comp._scratch)
    return label


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
