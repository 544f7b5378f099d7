"""Exact near-dedup of embeddings by a dual traversal of cover trees.

Unit vectors are compared by chord length (cosine c is chord sqrt(2 - 2c)).  The
top level is a set of pivots, far from each other and more of them as the table
grows (``PIVOTS`` at most); each vector belongs to its nearest pivot's cell, and
cells are dealt into blocks.  In each block a tree is built once: nested levels of
halving radii, down to nodes of one point each or of radius ``LEAST_RADIUS``;
levels that group hardly anything are left out.

For each pair of blocks both trees are walked down together, from the pair of
roots.  Only children of live node pairs are looked at.  A pair of nodes is
pruned where the centres are farther apart than both covering radii and the
threshold, and accepted whole where even the farthest points must be near enough;
both in single precision with a margin.  Pairs of points of live leaf pairs are
compared in double precision, and no others.  Nothing is approximate.

Tasks compare a tile of blocks with another; pairs of tiles with no pair of near
cells are never formed.  The driver sees one row a cell.

Rows are vertices: rows that share a vec_id keep their own links and components.
Vectors that are null or zero, or hold null or non-finite components, and rows
without a vec_id, link with nothing.  Vectors of different lengths don't link.
Equal vectors are traversed once and counted as often as they occur.  A cosine
equal to the threshold in double precision links.  An empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.operators.components import connected_components

from .common import looked_up, written

#: Vectors of a block; pivots of the top level at most; vectors they are chosen from.
BLOCK, PIVOTS, PIVOT_SAMPLE = 4096, 1024, 4096
#: Blocks of a tile at most, and the number of tiles that is aimed at before tiles grow.
TILE, TILES = 16, 8
#: Nodes below this radius are not split; a level of more than this share of the next one's nodes is left out.
LEAST_RADIUS, SPARSE = 1 / 64, 0.75
#: Sums of single-precision chords and radii are off by less.
SLACK = 5e-3


def _points(kind: np.dtype):
    """vec_id, print of the vector, its length and its bytes; null where a vector can't link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, raws = [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = None if vec_id is None or not values or None in values else np.array(values, dtype=kind) + kind.type(0)
                top = np.abs(v).max() if v is not None else 0.0
                good = v is not None and np.isfinite(top) and top > 0
                prints.append(xxhash.xxh3_128_digest(v.tobytes()) if good else None)
                sizes.append(len(v) if good else None)
                raws.append(v.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "print", "dims", "raw"])

    return run


def _units(raws: Iterable[bytes], dims: int, kind: np.dtype) -> np.ndarray:
    """Unit vectors in double precision, scaled first by a power of two so that squares neither overflow nor vanish."""
    v = np.frombuffer(b"".join(raws), kind).reshape(-1, dims).astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` points of the sample, each the farthest from those before it."""
    chosen, distance = [0], _chords(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and distance.max() > 1e-9:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, _chords(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass
class Tree:
    """Points in tree order; for each level its nodes' centres (as points), covering radii, first points and first children."""

    points: np.ndarray
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    #: First point of each node, and the end of the last.
    starts: list[np.ndarray]
    #: First child of each node in the next level, and the end of the last's.
    children: list[np.ndarray]
    order: np.ndarray


def build(points: np.ndarray) -> Tree:
    """Cover tree of unit vectors: levels of radius 1, 1/2, ... under one root.

    A level that groups hardly anything, next to the one below it, is left out.
    """
    single = points.astype(np.float32)
    dots = single @ single.T  # a block's at most
    levels, radius = [[np.arange(len(points))]], 1.0
    while radius >= LEAST_RADIUS and any(len(g) > 1 for g in levels[-1]):
        below = []
        for rest in levels[-1]:
            while len(rest) > 1:
                # half the square of the radius is the loss of the dot product
                near = dots[rest[0]][rest] >= 1 - radius * radius / 2
                near[0] = True
                below.append(rest[near])
                rest = rest[~near]
            if len(rest):
                below.append(rest)
        levels.append(below)
        radius /= 2
    levels = [x for k, x in enumerate(levels) if k in (0, len(levels) - 1) or len(x) <= SPARSE * len(levels[k + 1])]
    order = np.concatenate(levels[-1])
    place = np.argsort(order)
    centres = [np.array([g[0] for g in level]) for level in levels]
    radii = [np.array([0.0 if len(g) == 1 else np.sqrt(max(0.0, 2 - 2 * float(dots[x][g].min()))) for g, x in zip(level, centre, strict=True)], dtype=np.float32) for level, centre in zip(levels, centres, strict=True)]
    starts = [np.cumsum([0, *map(len, level)]) for level in levels]
    # nodes are nested runs of points, so a node's children begin where it does
    children = [np.searchsorted(below, own) for own, below in zip(starts, starts[1:], strict=False)]
    return Tree(points[order], [place[x] for x in centres], radii, starts, children, order)


@dataclass
class Found:
    """What a traversal found: accepted node pairs (as ranges of points), linked point pairs, and how many pairs were compared."""

    ranges: np.ndarray
    x: np.ndarray
    y: np.ndarray
    nodes: int = 0
    points: int = 0


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, ``count`` of them."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _products(first_a: np.ndarray, count_a: np.ndarray, first_b: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the members of each pair of ranges."""
    size = count_a * count_b
    at = _spread(np.zeros(len(size), dtype=np.int64), size)
    width = np.repeat(count_b, size)
    return np.repeat(first_a, size) + at // width, np.repeat(first_b, size) + at % width


#: Pairs that are looked at together.
_STRIP = 1 << 20


def _strips(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows of about ``_STRIP`` pairs together."""
    run = np.cumsum(sizes) // _STRIP
    edges = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


class _Walk:
    """A dual traversal of two trees."""

    def __init__(self, a: Tree, b: Tree, chord: float):
        self.a, self.b, self.chord = a, b, chord
        self.single = a.points.astype(np.float32), b.points.astype(np.float32)
        self.ranges: list[np.ndarray] = []
        self.nodes = 0

    def judged(self, level: tuple[int, int], i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node pairs that live on; accepted ones are put down."""
        self.nodes += len(i)
        reach = self.a.radii[level[0]][i] + self.b.radii[level[1]][j]
        # a dot product below this is a chord above the radii and the threshold
        live = dot >= 1 - (reach + np.float32(self.chord + SLACK)) ** 2 / 2
        i, j, dot, reach = i[live], j[live], dot[live], reach[live]
        spare = np.float32(self.chord - SLACK) - reach
        sure = (spare > 0) & (dot > 1 - spare**2 / 2)
        s, t = self.a.starts[level[0]], self.b.starts[level[1]]
        self.ranges.append(np.stack([s[i[sure]], s[i[sure] + 1], t[j[sure]], t[j[sure] + 1]], axis=1))
        return i[~sure], j[~sure]

    def multiplied(self, level: tuple[int, int], i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Live pairs of all nodes i and j: one bound for a row of the product, then each pair's own."""
        there = self.single[1][self.b.centres[level[1]][j]].T
        widest = self.b.radii[level[1]][j].max() + np.float32(self.chord + SLACK)
        step = max(1, _STRIP // len(j))
        for start in range(0, len(i), step):
            some = i[start : start + step]
            dot = self.single[0][self.a.centres[level[0]][some]] @ there
            self.nodes += dot.size
            x, y = np.nonzero(dot >= (1 - (self.a.radii[level[0]][some] + widest) ** 2 / 2)[:, None])
            yield self.judged(level, some[x], j[y], dot[x, y])

    def compared(self, level: tuple[int, int], first_a, count_a, first_b, count_b) -> tuple[np.ndarray, np.ndarray]:
        """Live pairs among the products of ranges of nodes."""
        ca, cb = self.a.centres[level[0]], self.b.centres[level[1]]
        left, right = [], []
        size = count_a * count_b
        large = size >= 4096
        for fa, na, fb, nb in zip(first_a[large].tolist(), count_a[large].tolist(), first_b[large].tolist(), count_b[large].tolist(), strict=True):
            j = np.arange(fb, fb + nb)
            wide = self.b.radii[level[1]][j] > self.chord
            # wide nodes, whose bound prunes little, don't loosen that of the others
            for part in (j[~wide], j[wide]):
                for x, y in self.multiplied(level, np.arange(fa, fa + na), part) if len(part) else ():
                    left.append(x)
                    right.append(y)
        first_a, count_a, first_b, count_b, size = (v[~large] for v in (first_a, count_a, first_b, count_b, size))
        for part in _strips(size):
            i, j = _products(first_a[part], count_a[part], first_b[part], count_b[part])
            x, y = self.judged(level, i, j, np.einsum("ij,ij->i", self.single[0][ca[i]], self.single[1][cb[j]]))
            left.append(x)
            right.append(y)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(a: Tree, b: Tree, chord: float, cosine: float) -> Found:
    """Links of the points of two trees, by dual traversal."""
    walk = _Walk(a, b, chord)
    one = np.ones(1, dtype=np.int64)
    level = (0, 0)
    x, y = walk.compared(level, one - 1, one, one - 1, one)
    while len(x) and (level[0] < len(a.children) or level[1] < len(b.children)):
        spans = []
        for tree, at, nodes in ((a, level[0], x), (b, level[1], y)):
            # a tree that has no further level waits for the other
            spans += [tree.children[at][nodes], np.diff(tree.children[at])[nodes]] if at < len(tree.children) else [nodes, np.ones(len(nodes), dtype=np.int64)]
        level = (min(level[0] + 1, len(a.children)), min(level[1] + 1, len(b.children)))
        x, y = walk.compared(level, *spans)
    s, t = a.starts[level[0]], b.starts[level[1]]
    size = np.diff(s)[x] * np.diff(t)[y]
    some_x, some_y = [], []
    for part in _strips(size):
        i, j = _products(s[x[part]], np.diff(s)[x[part]], t[y[part]], np.diff(t)[y[part]])
        near = np.einsum("ij,ij->i", a.points[i], b.points[j]) >= cosine
        some_x.append(i[near])
        some_y.append(j[near])
    none = np.zeros(0, dtype=np.int64)
    return Found(np.concatenate([np.zeros((0, 4), dtype=np.int64), *walk.ranges]), np.concatenate([none, *some_x]), np.concatenate([none, *some_y]), walk.nodes, int(size.sum()))


_NODES = "dims int, ids binary, copies binary, raw binary, level binary, radius binary, centre binary, start binary, child binary"


def _trees(kind: np.dtype):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # the root is the vector nearest to the pivot
        rows = rows.sort_values(["distance", "class_no"])
        dims = int(rows["dims"].iloc[0])
        tree = build(_units(rows["raw"], dims, kind))
        level = np.repeat(np.arange(len(tree.radii), dtype=np.int32), [len(r) for r in tree.radii])
        arrays = {"ids": rows["class_no"].to_numpy()[tree.order], "copies": rows["copies"].to_numpy()[tree.order], "raw": None, "level": level, "radius": np.concatenate(tree.radii)}
        arrays |= {"centre": np.concatenate(tree.centres).astype(np.int32), "start": np.concatenate([s[:-1] for s in tree.starts]).astype(np.int32)}
        # of the last level, the ends of the children are points
        arrays["child"] = np.concatenate([*(c[:-1] for c in tree.children), np.zeros(len(tree.radii[-1]), dtype=np.int64)]).astype(np.int32)
        packed = {k: [b"".join(rows["raw"].iloc[tree.order]) if x is None else x.tobytes()] for k, x in arrays.items()}
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "dims": [dims]} | packed)[["block", *(x.split()[0] for x in _NODES.split(", "))]]

    return run


def _unpacked(r, kind: np.dtype) -> tuple[Tree, np.ndarray, np.ndarray]:
    of = lambda name: np.frombuffer(getattr(r, name), np.int32).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of("level"))) + 1
    ids, copies = np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64)
    centres, starts, child = np.split(of("centre"), cuts), np.split(of("start"), cuts), np.split(of("child"), cuts)
    children = [np.r_[c, len(centres[k + 1])] for k, c in enumerate(child[:-1])]
    tree = Tree(_units([r.raw], int(r.dims), kind), centres, np.split(np.frombuffer(r.radius, np.float32), cuts), [np.r_[s, len(ids)] for s in starts], children, np.arange(len(ids)))
    return tree, ids, copies


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest point that each of n points reaches by the links x-y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _counted(found: Found, n: int, side: int, others: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Links of each point of one side, equal vectors of the other counted; ``own`` are the copies of a point itself, where it is on both sides."""
    before = np.r_[0, np.cumsum(others)]
    r = found.ranges if side == 0 else found.ranges[:, [2, 3, 0, 1]]
    x, y = (found.x, found.y) if side == 0 else (found.y, found.x)
    gain = (before[r[:, 3]] - before[r[:, 2]]).astype(np.int64)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, r[:, 0], gain)
    np.add.at(change, r[:, 1], -gain)
    count = np.cumsum(change)[:-1] + np.bincount(x, others[y], n).astype(np.int64)
    # every point is near to itself
    return count if own is None else count - own


def _edges(found: Found) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the found ones do: all of an accepted range with the first of the other."""
    r = found.ranges
    size_a, size_b = r[:, 1] - r[:, 0], r[:, 3] - r[:, 2]
    x = np.concatenate([found.x, _spread(r[:, 0], size_a), np.repeat(r[:, 0], size_b)])
    y = np.concatenate([found.y, np.repeat(r[:, 2], size_a), _spread(r[:, 2], size_b)])
    return x, y


def _linked_blocks(left: tuple, right: tuple, same: bool, chord: float, cosine: float) -> pd.DataFrame | None:
    """Links of two blocks: for each vector their number and the smallest vector it reaches by them."""
    (a, ids_a, copies_a), (b, ids_b, copies_b) = left, right
    found = links(a, b, chord, cosine)
    if not len(found.x) and not len(found.ranges):
        return None
    n = len(ids_a)
    count = [_counted(found, n, 0, copies_b, copies_a if same else None)]
    ids = [ids_a]
    x, y = _edges(found)
    if not same:
        count.append(_counted(found, len(ids_b), 1, copies_a, None))
        ids.append(ids_b)
        y = y + n
    ids, count = np.concatenate(ids), np.concatenate(count)
    # points in order of their ids, so that the smallest point is the smallest id
    order = np.argsort(ids, kind="stable")
    place = np.argsort(order, kind="stable")
    label = ids[order][_labels(len(ids), place[x], place[y])][place]
    some = count > 0
    return pd.DataFrame({"class_no": ids[some], "n": count[some], "label": label[some]}) if some.any() else None


def _joined(chord: float, cosine: float, kind: np.dtype):
    """Links of the blocks of one tile with those of another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        blocks = {r.block: _unpacked(r, kind) for r in rows.drop_duplicates("block").itertuples()}
        tile = {b: t for b, t in zip(rows["block"], rows["tile"], strict=True)}
        found = []
        for x in sorted(b for b in blocks if tile[b] == i):
            for y in sorted(b for b in blocks if tile[b] == j):
                if i != j or x <= y:
                    found.append(_linked_blocks(blocks[x], blocks[y], x == y, chord, cosine))
        found = [f for f in found if f is not None]
        return pd.concat(found) if found else pd.DataFrame({"class_no": [], "n": [], "label": []}, dtype="int64")

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    chord = float(np.sqrt(2 - 2 * cosine))
    # single-precision vectors stay so until they are compared
    kind = np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind.itemsize == 4 else "array<double>"))
    points = written(given.mapInArrow(_points(kind), "vec_id long, print binary, dims int, raw binary"), "vectors")
    # a row for each distinct vector, numbered once and for all
    classes = written(
        points.where("print IS NOT NULL").groupBy("print").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.any_value("dims").alias("dims"), F.any_value("raw").alias("raw"))
        .withColumn("class_no", F.monotonically_increasing_id()),
        "vector-classes",
    )
    found = []
    for (dims,) in classes.select("dims").distinct().collect():  # a row a vector length
        found.append(_block_links(spark, classes.where(F.col("dims") == dims).select("class_no", "dims", "raw", "copies"), dims, kind, chord, cosine, block))
    facts = classes.select("print", "class_no", "class_id", "copies")
    if found:
        every = found[0]
        for other in found[1:]:
            every = every.unionByName(other)
        every = written(every, "vector-links")
        nodes = connected_components(every.select(F.col("class_no").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "class_no")
        named = written(nodes.join(facts.select("class_no", "class_id"), "class_no"), "vector-components")
        least = named.groupBy("component").agg(F.min("class_id").alias("least"), F.count("*").alias("vectors"))
        reached = looked_up(named.select("class_no", "component"), least, ["component"], "vectors", "components").select("class_no", "least")
        facts = facts.join(every.groupBy("class_no").agg(F.sum("n").alias("n")), "class_no", "left").join(reached, "class_no", "left")
    else:
        facts = facts.withColumns({"n": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})
    facts = facts.select("print", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "class_id").alias("component_id"))
    linked = looked_up(points.where("print IS NOT NULL").select("vec_id", "print"), facts, ["print"], "copies", "vector-facts").select("vec_id", "n_links", "component_id")
    alone = points.where("print IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _block_links(spark, reps: DataFrame, dims: int, kind: np.dtype, chord: float, cosine: float, block: int) -> DataFrame:
    """class_no, links in one pair of blocks (n), smallest class it reaches there (label)."""
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("raw"), "class_no").limit(PIVOT_SAMPLE).select("raw").toPandas()
    pivots = _pivots(_units(sample["raw"], dims, kind), max(1, min(PIVOTS, n // block)))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _chords(_units(batch.column("raw").to_pylist(), dims, kind), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=[*batch.schema.names, "cell", "distance"])

    placed = written(reps.mapInArrow(assign, "class_no long, dims int, raw binary, copies long, cell int, distance double"), "cells")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).orderBy("cell").toPandas()  # PIVOTS rows at most
    cells["blocks"] = -(-cells["n"] // block)
    cells["first"] = cells["blocks"].cumsum() - cells["blocks"]
    tile = max(1, min(TILE, int(cells["blocks"].sum()) // TILES))
    table = F.broadcast(spark.createDataFrame(cells[["cell", "radius", "blocks", "first"]]))

    def near(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles of each cell with those of the cells that are near enough."""
        of = lambda c: np.arange(c.first // tile, (c.first + c.blocks - 1) // tile + 1)
        for part in parts:
            for c in part.itertuples():
                distance = _chords(pivots[[c.cell]], pivots[cells["cell"].to_numpy()])[0]
                for d in cells[distance <= c.radius + cells["radius"] + chord + SLACK].itertuples():
                    x, y = np.meshgrid(of(c), of(d), indexing="ij")
                    yield pd.DataFrame({"i": np.minimum(x, y).ravel(), "j": np.maximum(x, y).ravel()})

    pairs = written(table.mapInPandas(near, "i long, j long").distinct(), "tile-pairs")
    asked = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    dealt = placed.join(table.drop("radius"), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("class_no"), F.col("blocks")))
    trees = written(dealt.select("block", "class_no", "dims", "raw", "copies", "distance").groupBy("block").applyInPandas(_trees(kind), f"block long, {_NODES}"), "trees")
    met = trees.withColumn("tile", F.floor(F.col("block") / tile)).join(asked, "tile")
    return met.groupBy("i", "j").applyInPandas(_joined(chord, cosine, kind), "class_no long, n long, label long")


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND x.norm > 0 AND y.norm > 0
  WHERE list_inner_product(x.e, y.e) >= 0.9 * x.norm * y.norm
), reach AS (
  SELECT vec_id AS start, vec_id AS node FROM embeddings
  UNION
  SELECT r.start, l.b FROM reach r JOIN links l ON r.node = l.a
), m AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e JOIN m ON m.start = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
