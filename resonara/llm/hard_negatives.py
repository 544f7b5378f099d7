"""Hard negatives by threshold joins over an inverted index of embeddings.

A row's components become longs floor(256 * x); a score is the integer inner
product of a row with an anchor.  An anchor's positives are its best rows of the
same label; for each positive the best rows of another label follow whose score
lies between 50 and 95 % of the positive's.  Higher scores come first, ties by
smaller vec_id.

Rows are dealt into tiles, anchors into tiles of queries, and each pair of tiles
is a task's work.  Both searches are threshold joins: all pairs of a score of t or
more.  Per block of queries a tile is indexed by dimensions, falling by energy:

* a row is left out of the lists of its last dimensions while the norm of what is
  left out, times the query's norm, stays below t (suffix-norm bounds);
* partial scores are accumulated list by list, and pairs go once their partial
  score and the norms that remain can't reach t;
* what is left is scored in integers.

Thresholds come from one tile, where they start high and fall step by step until
a query's windows hold as many rows as are asked for, or the window's end is
reached.  The k-th best row of a part of the table is a lower bound for that of
all, so the search with these thresholds over all tiles is exact, with no cap.

Rows take no part whose label or vector or vec_id is null, whose vector is empty or
holds null or non-finite components, or is of another length than most (of lengths
as frequent the longest).  Rows that share a vec_id stay apart: each may be an
anchor, and a positive or negative of the others.  A score that may
reach 2**62 is an error.  An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
#: Bytes of a tile of rows and of a tile of queries, and tiles at least.
TILE_BYTES, QUERY_BYTES, TILES = 16 << 20, 4 << 20, 32
#: Queries and rows that are multiplied together; dimensions of a list.
QUERIES, ROWS, STEP = 256, 4096, 8
#: Shares of a window at which thresholds stop on their way down.
FALLS = (0.02, 0.1, 0.25, 0.5, 1.0)
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Tile:
    """Rows of a tile: numbers, ids, labels, vectors."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray


class Index:
    """A tile by dimensions of falling energy, with the norms of what follows each list."""

    def __init__(self, tile: Tile):
        self.tile = tile
        real = tile.x.astype(np.float64)
        self.order = np.argsort(-(real * real).sum(axis=0), kind="stable")
        self.real = real[:, self.order]
        self.edges = [*range(0, tile.x.shape[1], STEP), tile.x.shape[1]]
        self.rest = self.suffixes(self.real)

    def suffixes(self, real: np.ndarray) -> np.ndarray:
        """Norm of the dimensions from each edge on."""
        squares = np.stack([(real[:, e:] ** 2).sum(axis=1) for e in self.edges], axis=1)
        return np.sqrt(squares)

    def pairs(self, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of all pairs of a score of ``least`` of the query or more."""
        real = queries.astype(np.float64)[:, self.order]
        rest = self.suffixes(real)
        norm = rest[:, 0]
        if len(norm) and norm.max() * self.rest[:, 0].max(initial=0.0) > MOST:
            raise OverflowError("a score does not fit into a long")
        floor = least.astype(np.float64)
        with np.errstate(divide="ignore"):
            ratio = np.where(norm > 0, floor / np.where(norm > 0, norm, 1), np.where(floor > 0, np.inf, -np.inf))
        order = np.argsort(ratio, kind="stable")
        for start in range(0, len(order), QUERIES):
            some = order[start : start + QUERIES]
            for low in range(0, len(self.real), ROWS):
                i, j = self._block(real[some], rest[some], floor[some], ratio[some[0]], slice(low, low + ROWS))
                i, j = some[i], j + low
                for cut in range(0, len(i), 1 << 16):
                    a, b = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                    score = np.einsum("ij,ij->i", queries[a], self.tile.x[b])
                    real_hit = score >= least[a]
                    yield a[real_hit], b[real_hit], score[real_hit]

    def _block(self, a: np.ndarray, rest_a: np.ndarray, floor: np.ndarray, ratio: float, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block that may reach their threshold."""
        y, rest_y = self.real[rows], self.rest[rows]
        lists = len(self.edges) - 1
        # lists that hold a row: from the first on, while what follows could reach the threshold
        kept = (rest_y[:, :-1] >= ratio * (1 - 1e-9)).sum(axis=1)
        at = np.argsort(-kept, kind="stable")
        at = at[: int((kept > 0).sum())]
        partial = np.zeros((len(a), len(at)))
        for k in range(lists):
            held = int((kept[at] > k).sum())
            if not held:
                break
            lo, hi = self.edges[k], self.edges[k + 1]
            partial[:, :held] += a[:, lo:hi] @ y[at[:held], lo:hi].T
            if k + 1 in (lists // 2, 3 * lists // 4):
                alive = self._alive(partial, rest_a, rest_y[at], np.minimum(kept[at], k + 1), floor).any(axis=0)
                at, partial = at[alive], partial[:, alive]
        i, j = np.nonzero(self._alive(partial, rest_a, rest_y[at], kept[at], floor))
        return i, at[j]

    @staticmethod
    def _alive(partial: np.ndarray, rest_a: np.ndarray, rest_y: np.ndarray, seen: np.ndarray, floor: np.ndarray) -> np.ndarray:
        bound = partial + rest_a[:, seen] * rest_y[np.arange(len(seen)), seen]
        return bound + np.abs(bound) * 1e-9 + 1e-3 >= floor[:, None]


@dataclass
class Query:
    """Queries of a tile, with windows of scores: ``low`` and ``high`` have a column a window."""

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray


def best(index: Index, q: Query, low: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, window, row, score) of the k best rows of each window from ``low`` on, of the query's label or of others."""
    tile, open_ = index.tile, low <= q.high
    least = np.where(open_, low, MOST).min(axis=1) if low.shape[1] else np.full(len(low), MOST)
    asked = np.flatnonzero(open_.any(axis=1))
    found = []
    for i, j, score in index.pairs(q.x[asked], least[asked]):
        i = asked[i]
        right = ((q.label[i] == tile.label[j]) == same) & (q.row[i] != tile.row[j])
        i, j, score = i[right], j[right], score[right]
        for w in range(low.shape[1]):
            into = (score >= low[i, w]) & (score <= q.high[i, w])
            found.append((i[into], np.full(int(into.sum()), w), j[into], score[into]))
    none = np.zeros(0, np.int64)
    i, w, j, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none,) * 4
    order = np.lexsort((tile.vec_id[j], -score, w, i))
    i, w, j, score = i[order], w[order], j[order], score[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(w) != 0)]) if len(i) else none
    rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
    return i[rank < k], w[rank < k], j[rank < k], score[rank < k]


def lowered(index: Index, q: Query, same: bool, k: int) -> np.ndarray:
    """For each window the k-th best score of the tile, or the window's end if the tile does not fill it."""
    out = q.low.copy()
    reach = index.rest[:, 0].max(initial=0.0) * np.sqrt((q.x.astype(np.float64) ** 2).sum(axis=1))
    top = np.minimum(q.high, np.minimum(reach + 1, MOST).astype(np.int64)[:, None])
    bottom = np.maximum(q.low, np.maximum(-reach - 1, LEAST).astype(np.int64)[:, None])
    waiting = bottom <= top
    for fall in FALLS:
        if not waiting.any():
            break
        stop = top - np.ceil((top - bottom).astype(np.float64) * fall).astype(np.int64)
        stop = np.where(waiting, np.maximum(stop, bottom) if fall < 1 else bottom, MOST + 1)
        i, w, _, score = best(index, q, stop, same, k)
        count = np.zeros(out.shape, np.int64)
        np.add.at(count, (i, w), 1)
        last = np.full(out.shape, MOST)
        np.minimum.at(last, (i, w), score)
        full = waiting & (count == k)
        out[full] = last[full]
        waiting &= ~full
    return out


# Spark's side.

_TILE = "tile long, n int, row binary, vec_id binary, label binary, x binary"
_QUERY = "q long, n int, windows int, row binary, label binary, x binary, low binary, high binary"
_HITS = "row long, win int, vec_id long, score long"
_BOUNDS = "row long, lows array<long>"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _bytes(column: pa.ChunkedArray) -> bytes:
    return np.array(column.to_numpy(), np.int64).tobytes()


def _flat(column: pa.ChunkedArray) -> bytes:
    return np.array(column.combine_chunks().flatten(), np.int64).tobytes()


def _pack_tile(t: pa.Table) -> pa.Table:
    columns = [[t.column("tile")[0].as_py()], [t.num_rows], *([_bytes(t.column(c))] for c in ("row", "vec_id", "label")), [_flat(t.column("x"))]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=_names(_TILE))


def _pack_queries(t: pa.Table) -> pa.Table:
    low = _flat(t.column("low"))
    columns = [[t.column("q")[0].as_py()], [t.num_rows], [len(low) // 8 // t.num_rows], *([_bytes(t.column(c))] for c in ("row", "label")), [_flat(t.column("x"))], [low], [_flat(t.column("high"))]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=_names(_QUERY))


def _met(same: bool, k: int, seed: bool):
    """Of a tile of rows and a tile of queries: the hits, or the lowered thresholds."""

    def run(tiles: pa.Table, queries: pa.Table) -> pa.Table:
        of = lambda r, c: np.frombuffer(r[c], np.int64)
        out = []
        for t in tiles.to_pylist():
            index = Index(Tile(of(t, "row"), of(t, "vec_id"), of(t, "label"), of(t, "x").reshape(t["n"], -1)))
            for r in queries.to_pylist():
                q = Query(of(r, "row"), of(r, "label"), of(r, "x").reshape(r["n"], -1), of(r, "low").reshape(r["n"], -1), of(r, "high").reshape(r["n"], -1))
                if seed:
                    out.append(pa.table({"row": q.row, "lows": pa.array(list(lowered(index, q, same, k)), pa.list_(pa.int64()))}))
                else:
                    i, w, j, score = best(index, q, q.low, same, k)
                    out.append(pa.table({"row": q.row[i], "win": w.astype(np.int32), "vec_id": index.tile.vec_id[j], "score": score}))
        if out:
            return pa.concat_tables(out)
        return pa.table({"row": pa.array([], pa.int64()), "lows": pa.array([], pa.list_(pa.int64()))}) if seed else pa.table({c: pa.array([], pa.int32() if c == "win" else pa.int64()) for c in _names(_HITS)})

    return run


def _searched(tiles: DataFrame, count: int, queries: DataFrame, parts: int, same: bool, k: int) -> DataFrame:
    """row (of the query), win, vec_id, score, rank of the k best rows of each query's windows.

    ``queries``: row, q, label, x, low, high; ``low`` and ``high`` hold a window's ends
    at each place.
    """

    def met(queries: DataFrame, over: DataFrame, numbers: Column, seed: bool) -> DataFrame:
        packed = queries.groupBy("q").applyInArrow(_pack_queries, _QUERY).withColumn("tile", F.explode(numbers))
        asked = over.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
        return asked.groupBy("q", "tile").cogroup(packed.groupBy("q", "tile")).applyInArrow(_met(same, k, seed), _BOUNDS if seed else _HITS)

    # thresholds from one tile: any part of the table gives bounds for all of it
    bounds = written(met(queries, tiles.where("tile = 0"), F.array(F.lit(0).cast("long")), True), "thresholds")
    narrowed = queries.join(bounds, "row", "left").withColumn("low", F.coalesce("lows", "low")).drop("lows")
    hits = met(narrowed, tiles, F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"), False)
    order = Window.partitionBy("row", "win").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, relabel: int = 7, labels: int = 10, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; labels of rows whose
    vec_id is divisible by ``relabel`` move on by one, modulo ``labels``.
    """
    spark = vectors.sparkSession
    entries = F.col("embedding").cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = F.col("label").cast("long")
    usable = (
        vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine & (F.size(entries) > 0))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.col("vec_id") % relabel == 0, (own + 1) % labels).otherwise(own).alias("label"),
            F.transform(entries, lambda c: F.floor(c * SCALE)).alias("x"),
        )
    )
    shape = usable.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if shape is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, n = shape
    rows = written(usable.where(F.size("x") == dims).withColumn("row", F.monotonically_increasing_id()), "labelled-vectors")
    count = max(TILES, -(-n * dims * 8 // TILE_BYTES))
    tiles = written(rows.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(count))).groupBy("tile").applyInArrow(_pack_tile, _TILE), "tiles")
    anchors = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-anchors.count() * dims * 8 // QUERY_BYTES))
    anchors = anchors.withColumn("q", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)))
    one = lambda v: F.array(F.lit(v).cast("long"))
    near = written(_searched(tiles, count, anchors.select("row", "q", "label", "x", one(LEAST).alias("low"), one(MOST).alias("high")), parts, True, positives).select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # windows of a query in order of its positives; one that is not there ends before it begins
    listed = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.get("p", k)["positive_score"])
    ends = listed.select(
        "row",
        F.transform(scores, lambda s: F.coalesce(-_floor_div(-s * low, 100), F.lit(MOST))).alias("low"),
        F.transform(scores, lambda s: F.coalesce(_floor_div(s * high, 100), F.lit(LEAST))).alias("high"),
    )
    asked = anchors.select("row", "q", "label", "x").join(ends, "row")
    far = _searched(tiles, count, asked, parts, False, negatives)
    return (
        far.select("row", (F.col("win") + 1).alias("place"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near, ["row", "place"])
        .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def _floor_div(value: Column, by: int) -> Column:
    """Floor of a long divided by a positive number, exactly."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
