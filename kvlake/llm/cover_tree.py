"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared within their label and dimension. Equal vectors are one weighted node. Unit vectors within cosine
`COSINE` are within `RADIUS` of each other. Labels of more than `BLOCK` nodes are cut into cells around pivots (as many of
one nested sequence as the label needs), and cells into blocks. Each block gets one cover tree: nested levels of centres,
radii halved, points in the order of the tree, so that a centre's points are a range. A tree is traversed against itself,
then against those of the label's other blocks, unless pivots and covering radii keep the blocks apart: centres further
apart than their covering radii and RADIUS allow go with all their points. Distances of projections, which are never
longer, go first. What is left at the leaves is compared exactly, in double precision.

A traversal yields link counts per node and links that span its linked groups; all pairs are never held or emitted.
Blocks of large labels are files on shared storage that only the written table names, so a repeated task is harmless.
Where no bound prunes (vectors without clusters), the work grows with the square of a label's size.

Cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows without label, link with nothing
and are their own component; a NULL vec_id counts as a partner and gets the smallest vec_id its links reach, NULL if there
is none; rows that share a vec_id are apart, and each gets what its own vector reaches; very long vectors only cost more;
empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvlake.llm.common import components, group_bounds, whole_groups
from kvlake.sources import fs, scratch

COSINE = 0.98
#: Nodes of a block about, sampled vectors for pivots, and pivots of a label, at most.
BLOCK, SAMPLE, PIVOTS = 16384, 2048, 128
#: Centres, and their partners, whose distances are held at once; coordinates of the projection.
ROWS, COLUMNS, PROJECTED = 256, 2048, 16
#: Added to bounds on distances, and on squared distances in single precision.
SLACK, SINGLE = 1e-7, 5e-5


def radius_of(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK


def _cover(u: np.ndarray, left: np.ndarray, radius: float, new: np.ndarray, made: list) -> None:
    """Covers the points by some of them, the first one first: `new` gets each point's number of centre."""
    while left.size:
        near = u[left[:ROWS]] @ u[left].T >= 1 - radius * radius / 2
        taken = np.zeros(len(left), bool)
        alone = np.count_nonzero(near, axis=1) <= 1
        for c in range(min(ROWS, len(left))):
            if taken[c]:
                continue
            if alone[c]:
                new[left[c]] = len(made)
                made.append(left[c])
                taken[c] = True
            else:
                hit = near[c] & ~taken
                hit[c] = True
                new[left[hit]] = len(made)
                made.append(left[c])
                taken |= hit
        left = left[~taken]


def plant(u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A cover tree of unit vectors: their order, the first level at which each (in that order) is a centre, and each
    level's reaches. Every point lies within its centre's reach, which is at most the level's radius."""
    n = len(u)
    levels = [(np.zeros(1, np.int64), np.zeros(n, np.int64))]
    radius = 2.0
    while len(levels[-1][0]) < n and radius / 2 >= least:
        radius /= 2
        centres, of = levels[-1]
        order = np.argsort(of, kind="stable")
        bounds = np.append(np.searchsorted(of[order], np.arange(len(centres))), n)
        new, made = np.empty(n, np.int64), []
        for c, centre in enumerate(centres):
            left = order[bounds[c]: bounds[c + 1]]
            if len(left) == 1:
                new[centre] = len(made)
                made.append(centre)
            else:
                _cover(u, np.append(centre, left[left != centre]), radius, new, made)
        if len(made) > len(centres):
            levels.append((np.array(made), new))
    centres, of = levels[-1]
    own = centres[of] != np.arange(n)
    order = np.lexsort((own, of))  # numbers follow the parents' and a centre's own comes first: the tree's order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    if len(centres) < n:
        levels.append((np.arange(n), np.arange(n)))
    top, reaches = np.full(n, len(levels), np.int64), []
    for level, (centres, of) in enumerate(levels):
        at = place[centres]
        top[at] = np.minimum(top[at], level)
        gap = np.sqrt(((u.astype(np.float64) - u[centres[of]]) ** 2).sum(axis=1))
        reach = np.zeros(n)
        np.maximum.at(reach, place[centres[of]], gap)
        reaches.append(reach[np.sort(at)])
    return order, top, reaches


class Tree:
    """Points in the tree's order: a centre's points are the range from it to the level's next centre."""

    def __init__(self, node, weight, v, top, reaches):
        self.node, self.weight, self.v, self.top, self.reaches = node, weight, v, top, reaches
        self.norm = np.sqrt((v * v).sum(axis=1))
        self.u = (v / self.norm[:, None]).astype(np.float32)
        d = v.shape[1]
        p = self.u if d <= PROJECTED else (self.u @ np.linalg.qr(np.random.default_rng(1).normal(size=(d, PROJECTED)))[0].astype(np.float32))
        square, one = (p * p).sum(axis=1)[:, None], np.ones((len(p), 1), np.float32)
        self.left, self.right = np.hstack([-2 * p, square, one]), np.hstack([p, one, square])
        self.levels = [np.flatnonzero(top <= level) for level in range(len(reaches))]

    @classmethod
    def of(cls, node, weight, v, radius: float) -> Tree:
        u = (v / np.sqrt((v * v).sum(axis=1))[:, None]).astype(np.float32)
        order, top, reaches = plant(u, radius / 2)
        return cls(node[order], weight[order], v[order], top, reaches)

    def reach(self, level: int, centres: np.ndarray) -> np.ndarray:
        if level >= len(self.levels):
            return np.zeros(len(centres))
        return self.reaches[level][np.searchsorted(self.levels[level], centres)] + SLACK

    def children(self, level: int, centres: np.ndarray) -> np.ndarray:
        """The next level's centres in the ranges of these."""
        if level + 1 >= len(self.levels):
            return centres
        here, below = self.levels[level], self.levels[level + 1]
        at = np.searchsorted(here, centres)
        ends = np.append(here, len(self.v))[at + 1]
        a, b = np.searchsorted(below, centres), np.searchsorted(below, ends)
        size = b - a
        return below[np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)]

    def save(self, out) -> None:
        n, levels = len(self.node), len(self.reaches)
        full = np.zeros((n, levels))
        for level, r in enumerate(self.reaches):
            full[self.levels[level], level] = r
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
        t = pa.table({"node": self.node, "weight": self.weight, "v": lists(self.v), "top": self.top, "reach": lists(full)})
        with pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t)

    @classmethod
    def load(cls, source) -> Tree:
        with pa.ipc.open_stream(source) as r:
            t = r.read_all().combine_chunks()
        grid = lambda c: c.chunk(0).flatten().to_numpy().reshape(len(t), -1)
        top, full = t["top"].to_numpy(), grid(t["reach"])
        return cls(t["node"].to_numpy(), t["weight"].to_numpy(), grid(t["v"]), top, [full[top <= level, level] for level in range(full.shape[1])])


def _near(a: Tree, rows: np.ndarray, reach: float, b: Tree, columns: np.ndarray, reaches: np.ndarray) -> np.ndarray:
    """The columns that some row may be linked to, as far as bounds tell."""
    left, out = a.left[rows], []
    limit = (reach + reaches) ** 2 + SINGLE
    for at in range(0, len(columns), COLUMNS):
        some = slice(at, at + COLUMNS)
        out.append((left @ b.right[columns[some]].T).min(axis=0) <= limit[some])
    hit = np.flatnonzero(np.concatenate(out)) if out else np.empty(0, np.int64)
    if a.left.shape[1] - 2 < a.u.shape[1]:
        for at in range(0, len(hit), COLUMNS):
            some = hit[at: at + COLUMNS]
            hit[at: at + COLUMNS] = np.where(2 - 2 * (a.u[rows] @ b.u[columns[some]].T).max(axis=0) <= limit[some], some, -1)
        hit = hit[hit >= 0]
    return columns[hit]


def traverse(a: Tree, b: Tree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, which of them are linked), each linked pair once; a tree against itself gives i < j.

    Depth first over groups of centres, so what is held does not grow with the number of pairs."""
    radius, same = radius_of(cosine), a is b
    last = max(len(a.levels), len(b.levels)) - 1

    def visit(level: int, rows: np.ndarray, columns: np.ndarray):
        of_rows, of_columns = a.reach(level, rows), b.reach(level, columns) + radius
        wide = of_rows > 2 * SLACK
        for group, reaches in ((rows[~wide], of_rows[~wide]), (rows[wide], of_rows[wide])):
            for at in range(0, len(group), ROWS):
                some = group[at: at + ROWS]
                first = int(np.searchsorted(columns, some[0])) if same else 0
                near = _near(a, some, float(reaches[at: at + ROWS].max()), b, columns[first:], of_columns[first:])
                if not near.size:
                    continue
                if level < last:
                    yield from visit(level + 1, a.children(level, some), b.children(level, near))
                    continue
                x, y = a.v[some], b.v[near]
                c = (x @ y.T) / (a.norm[some][:, None] * b.norm[near][None, :])
                linked = c >= cosine
                for p, q in zip(*np.nonzero(np.abs(c - cosine) < 1e-9)):  # the same sums in any block
                    linked[p, q] = (x[p] * y[q]).sum() / (math.sqrt((x[p] * x[p]).sum()) * math.sqrt((y[q] * y[q]).sum())) >= cosine
                if same:
                    linked &= some[:, None] < near[None, :]
                if linked.any():
                    yield some, near, linked

    yield from visit(0, a.levels[0], b.levels[0])


def tree_links(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight): b = -1 rows carry the number of vectors that a is linked to, the others span linked groups."""
    shift = 0 if a is b else len(a.node)
    node = a.node if a is b else np.concatenate([a.node, b.node])
    group = np.arange(len(node))
    count = np.zeros(len(node), np.int64)
    ends: list[list[int]] = [[], []]
    for rows, columns, linked in traverse(a, b, cosine):
        columns_at = columns + shift
        count[rows] += linked @ b.weight[columns]
        count[columns_at] += a.weight[rows] @ linked
        for k in np.flatnonzero(linked.any(axis=1)).tolist():
            i, js = int(rows[k]), columns_at[linked[k]]
            other = group[js] != group[i]
            if other.any():
                js = js[other]
                merged, first = np.unique(group[js], return_index=True)
                ends[0] += [i] * len(first)
                ends[1] += js[first].tolist()
                group[np.isin(group, merged)] = group[i]
    some = np.flatnonzero(count)
    return (np.concatenate([node[some], node[np.array(ends[0], np.int64)]]), np.concatenate([np.full(len(some), -1), node[np.array(ends[1], np.int64)]]),
            np.concatenate([count[some], np.zeros(len(ends[0]), np.int64)]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


FIELDS = "a long, b long, weight long, label long, dim int, cell int, file string, reach double"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("weight", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("file", pa.string()), ("reach", pa.float64())])


def _rows(a, b, weight) -> pa.RecordBatch:
    n = len(a)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(weight, pa.int64()), *[pa.nulls(n, f.type) for f in _LINKS][3:]], schema=_LINKS)


def _own(cosine: float, pivots: dict[int, np.ndarray], base: str):
    """Links inside each block; a block of a large label is also saved, for the others to meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as store

        files, root = store.FileSystem.from_uri(base)
        for t in whole_groups(batches, ["label", "dim", "cell", "k"]):
            label, dim, cell, k, node, m, cells = (t.column(c).to_numpy() for c in ("label", "dim", "cell", "k", "node", "m", "cells"))
            vectors = t.column("v").combine_chunks()
            bounds = group_bounds(label, dim, cell, k)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo == 1 and cells[lo] == 0:
                    continue
                order = np.argsort(node[lo:hi])
                tree = Tree.of(node[lo:hi][order], m[lo:hi][order], _matrix(vectors.slice(lo, hi - lo))[order], radius_of(cosine))
                yield _rows(*tree_links(tree, tree, cosine))
                if cells[lo]:
                    name = f"{uuid.uuid4().hex}.tree"
                    with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                        tree.save(out)
                    p = pivots.get(int(dim[lo]))
                    reach = 0.0 if p is None else float(np.sqrt(((tree.u - p[cell[lo]]) ** 2).sum(axis=1).max()))
                    yield pa.record_batch([pa.nulls(1, pa.int64())] * 3 + [pa.array([x], f.type) for x, f in zip((label[lo], dim[lo], cell[lo], name, reach), list(_LINKS)[3:])], schema=_LINKS)

    return run


def _across(cosine: float, pivots: dict[int, np.ndarray], base: str, held_trees: int = 3):
    """Links between two blocks of a label, unless pivots and reaches keep them apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as store

        files, root = store.FileSystem.from_uri(base)
        held: OrderedDict[str, Tree] = OrderedDict()

        def tree(name: str) -> Tree:
            if name not in held:
                if len(held) >= held_trees:
                    held.popitem(last=False)
                with files.open_input_stream(f"{root}/{name}") as f:
                    held[name] = Tree.load(f)
            held.move_to_end(name)
            return held[name]

        for b in batches:
            for one, two, dim, c, d, reach in zip(*(x.to_pylist() for x in b.columns)):
                p = pivots.get(dim)
                if p is None or np.sqrt(((p[c] - p[d]) ** 2).sum()) <= reach + radius_of(cosine):
                    yield _rows(*tree_links(tree(one), tree(two), cosine))

    return run


def _farthest(x: np.ndarray, n: int) -> np.ndarray:
    """The first point, then each time the one farthest from those chosen, while it adds something."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 1e-12:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, weight) over nodes (label, dim, v, node, m); see `tree_links`."""
    spark = nodes.sparkSession
    large = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("label", "dim", F.ceil(F.col("n") / BLOCK).cast("int").alias("cells"))
    large = scratch.written(large, "large")
    pivots: dict[int, np.ndarray] = {}
    if large.limit(1).count():
        sampled: dict[int, list] = {}
        # SAMPLE rows of all; a dimension that none of them has gets no pivots, and its labels are one cell each
        for r in nodes.select("dim", "v", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(SAMPLE).collect():
            sampled.setdefault(r.dim, []).append(r.v)
        for dim, x in sampled.items():
            x = np.array(x, np.float64)
            pivots[dim] = _farthest(x / np.sqrt((x * x).sum(axis=1))[:, None], PIVOTS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cells = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "cells"))
            vectors, cell = b.column(b.schema.get_field_index("v")), np.zeros(b.num_rows, np.int32)
            for dim, p in pivots.items():
                at = np.flatnonzero((dims == dim) & (cells > 0))
                if at.size:
                    x = _matrix(vectors.take(pa.array(at)))
                    # of the label's share of the nested pivots, the nearest: the largest cosine
                    c = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ p.T
                    c[np.arange(len(p))[None, :] >= cells[at][:, None]] = -2
                    cell[at] = c.argmax(axis=1)
            yield pa.record_batch([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    kind = nodes.schema["v"].dataType.simpleString()
    placed = nodes.join(large, ["label", "dim"], "left").withColumn("cells", F.coalesce("cells", F.lit(0))).select("label", "dim", "v", "node", "m", "cells")
    if pivots:
        placed = scratch.written(placed.mapInArrow(assign, f"label long, dim int, v {kind}, node long, m long, cells int, cell int"), "cells")
        cut = placed.filter("cells > 0").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cut"))
        placed = placed.join(cut, ["label", "dim", "cell"], "left").withColumn("k", F.coalesce(F.pmod(F.xxhash64("node"), F.col("cut")), F.lit(0)).cast("int"))
    else:
        placed = placed.withColumns({"cell": F.lit(0), "k": F.lit(0)})
    base = scratch.new_path(spark, "trees")
    jfs, p = fs._fs(spark, base)
    jfs.mkdirs(p)
    key = ("label", "dim", "cell", "k")
    own = scratch.written(placed.select(*key, "node", "m", "v", "cells").repartition(*key).sortWithinPartitions(*key).mapInArrow(_own(cosine, pivots, base), FIELDS), "own")
    if not pivots:
        return own.select("a", "b", "weight")
    # pairs of blocks of one label, by name: as many as the exact comparison of the label needs
    blocks = own.filter("file is not null").select("label", "dim", "cell", "file", "reach")
    other = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("file").alias("file2"), F.col("reach").alias("reach2"))
    pairs = blocks.join(other, ["label", "dim"]).filter("file < file2").select("file", "file2", "dim", "cell", "cell2", (F.col("reach") + F.col("reach2")).alias("reach"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = pairs.repartition(parts, "file", "file2").sortWithinPartitions("file", "file2").mapInArrow(_across(cosine, pivots, base), FIELDS)
    return own.filter("file is null").select("a", "b", "weight").unionByName(across.select("a", "b", "weight"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id): other vectors linked directly, and the smallest vec_id that links reach."""
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(fine, e).alias("v"))
    # equal vectors have the same two hashes; if two equal ones had not (signed zeros), they would be linked nodes
    k = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64(F.lit(1), "v").alias("x"), F.xxhash64(F.lit(2), F.reverse("v")).alias("y")))
    rows = rows.withColumn("k", k)
    usable = rows.filter("v is not null")
    nodes = usable.groupBy("label", "k").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("m"))
    nodes = scratch.written(nodes.select("label", "k", F.size("v").alias("dim"), "v", "least", "m").withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = scratch.written(links(nodes.select("label", "dim", "v", "node", "m"), cosine), "links")
    weights = found.filter("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("w"))
    comp = components(found.filter("b <> -1").select("a", "b"))
    table = nodes.select("label", "k", "least", "m", "node").join(weights, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    table = scratch.written(table, "reached")
    scratch.drop(nodes, found, *comp._scratch)
    least = table.groupBy("component").agg(F.min("least").alias("id"))
    table = table.join(least, "component").select(F.col("label").alias("l"), F.col("k").alias("q"), (F.col("m") - 1 + F.coalesce("w", F.lit(0))).alias("n"), "id")
    joined = rows.select("vec_id", "label", "k").join(table, (F.col("label") == F.col("l")) & (F.col("k") == F.col("q")), "left")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k").isNotNull(), F.col("id")).otherwise(F.col("vec_id")).alias("component_id"))
