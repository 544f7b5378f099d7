"""Whitening of embeddings by a bidiagonal qd solver.

1. Exact sums: each component becomes floor(1024 * c) + 100000, a long; n and the
   sums S of each dimension are added up by Spark.
2. Blockwise QR: tasks reduce their centred rows (n*x - S) / n to a triangle of one
   row a dimension, and triangles are stacked and reduced FAN at a time until one
   is left.  No task or driver holds more than FAN triangles.
3. Householder reflections make that R bidiagonal; dqds finds the singular values,
   to high relative accuracy; twisted factorisations of the tridiagonal give each
   direction.  Directions of close values are made orthogonal to each other, by
   other twists and inverse iteration where they fall together.
4. Tasks project rows; the whitened rows' covariance is added up from moments of
   each task, centred before multiplying, and merged FAN at a time.

Rows drop out whose vector is null or holds null or non-finite entries, or is not
of the most frequent length (of lengths as frequent, the longest counts; a vector
without entries has no components).  Components without variance, to working
precision, are left out, so constant vectors give no rows.  Rows that share a vec_id, or have none,
stay apart.  A deviation beyond a long is an error.  An empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 1024, 100_000
#: Pieces that are merged together, and rows of a block of QR.
FAN, BLOCK = 32, 4096
EPS = np.finfo(np.float64).eps
#: Relative distance below which singular values' squares are close.
CLOSE = 1e-3
_PIECE = "piece long, body binary"
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


# The solver.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors of a square matrix, by Householder reflections from both sides."""
    a = r.copy()
    n = len(a)
    right = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        top = np.abs(x).max(initial=0.0)
        if top == 0 or not np.abs(x[1:]).max(initial=0.0):
            return None
        v = x / top
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        return v / np.sqrt(v @ v)

    for k in range(n):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :])
        right.append(v)
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd step with a shift; None if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:  # the rest stands alone
            new_e[i], d = 0.0, q[i + 1] - shift
            continue
        ratio = q[i + 1] / new_q[i]
        new_e[i], d = e[i] * ratio, d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, d


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds with deflation."""
    blocks, found = [(diagonal * diagonal, above * above, 0.0)], []
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(60 * len(q) + 60):
            if len(q) == 1:
                break
            # a coupling that no longer matters splits the block
            small = e <= EPS * EPS * np.minimum(q[:-1] + moved, q[1:] + moved)
            if small.any():
                at = int(np.flatnonzero(small)[-1]) + 1
                if at == len(q) - 1:
                    found.append(q[-1] + moved)
                    q, e = q[:-1], e[:-1]
                    continue
                blocks.append((q[:at], e[: at - 1], moved))
                q, e = q[at:], e[at:]
                continue
            # the smallest eigenvalue of the last two rows bounds a shift from above, often closely
            x, y, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            guess = y - c / ((x - y) / 2 + np.copysign(np.sqrt(((x - y) / 2) ** 2 + c), x - y)) if c else min(x, y)
            shift = max(0.0, 0.98 * min(guess, q[-1]))
            while (step := _dqds(q, e, shift)) is None:
                shift = shift / 4 if shift > EPS * q.max() else 0.0
            moved += shift
            q, e = step[0], step[1]
            if len(q) > 1 and q[-1] > q[0] * 16:  # graded the wrong way round
                q, e = _reversed(q, e)
        else:
            raise ArithmeticError("dqds did not converge")
        found.append(q[0] + moved)
    return np.sort(np.maximum(0.0, np.array(found)))[::-1]


def _reversed(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same singular values, from the other end: a bidiagonal matrix flipped is lower; its transpose is upper."""
    return q[::-1].copy(), e[::-1].copy()


def _twisted(diagonal: np.ndarray, off: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors of T - value from the top (pivots, multipliers) and from the bottom, and the twist elements."""
    n = len(diagonal)
    tiny = EPS * EPS * max(np.abs(diagonal).max(), np.finfo(np.float64).tiny / EPS / EPS)
    down, up = np.empty(n), np.empty(n)
    lower, upper = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    down[0], up[-1] = diagonal[0] - value, diagonal[-1] - value
    for i in range(n - 1):
        down[i] = down[i] or tiny
        lower[i] = off[i] / down[i]
        down[i + 1] = diagonal[i + 1] - value - lower[i] * off[i]
    for i in range(n - 1, 0, -1):
        up[i] = up[i] or tiny
        upper[i - 1] = off[i - 1] / up[i]
        up[i - 1] = diagonal[i - 1] - value - upper[i - 1] * off[i - 1]
    twist = down + up - (diagonal - value)
    return down, lower, up, upper, np.where(twist == 0, tiny, twist)


def _vector(lower: np.ndarray, upper: np.ndarray, at: int) -> np.ndarray:
    """The solution that is 1 at the twist: multipliers run away from it on both sides."""
    z = np.zeros(len(lower) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(at, len(lower)):
        z[i + 1] = -upper[i] * z[i]
    return z


def _solved(down: np.ndarray, lower: np.ndarray, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - value) x = b by the factorisation from the top."""
    x = b.copy()
    for i in range(len(lower)):
        x[i + 1] -= lower[i] * x[i]
    x /= np.where(down == 0, tiny, down)
    for i in range(len(lower) - 1, -1, -1):
        x[i] -= lower[i] * x[i + 1]
    return x


def directions(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix for its largest squared singular values, as columns."""
    main = diagonal * diagonal
    main[1:] += above * above
    off = diagonal[:-1] * above
    scale = main.max()
    columns: list[np.ndarray] = []
    for k, value in enumerate(squares):
        mates = [columns[j] for j in range(k) if squares[j] - value <= CLOSE * squares[j]]
        down, lower, _, upper, twist = _twisted(main, off, value)
        best = None
        for at in np.argsort(np.abs(twist), kind="stable")[: 2 + 2 * len(mates)].tolist():
            z = _vector(lower, upper, at)
            z /= np.sqrt(z @ z)
            for _ in range(2):
                for m in mates:
                    z -= (m @ z) * m
            left = np.sqrt(z @ z)
            if left > 1e-8:
                z /= left
                for _ in range(2 if mates else 0):  # what was taken out leaves other directions behind
                    w = _solved(down, lower, z, EPS * scale)
                    if not np.isfinite(w).all():
                        break
                    w /= np.sqrt(w @ w)
                    for m in mates:
                        w -= (m @ w) * m
                    if w @ w < 1e-12:
                        break
                    z = w / np.sqrt(w @ w)
                    for m in mates:
                        z -= (m @ z) * m
                    z /= np.sqrt(z @ z)
                image = main * z
                image[:-1] += off * z[1:]
                image[1:] += off * z[:-1]
                error = np.abs(image - value * z).max() / scale
                if best is None or error < best[0]:
                    best = error, z
                if error < 64 * EPS * len(z):
                    break
        if best is None:
            raise ArithmeticError("no direction found for a close singular value")
        columns.append(best[1])
    return np.stack(columns, axis=1) if columns else np.zeros((len(main), 0))


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared singular values of R, falling, unit right singular vectors as columns, and the sum of all squares."""
    top = np.abs(r).max(initial=0.0)
    if top == 0:
        return np.zeros(0), np.zeros((r.shape[1], 0)), 0.0
    power = np.ldexp(1.0, int(np.frexp(top)[1]))
    diagonal, above, right = bidiagonal(r / power)
    squares = singular_squares(diagonal, above)
    total = float(squares.sum())
    some = squares[:most][squares[:most] > len(squares) ** 2 * EPS * EPS * squares[0] * 16]
    z = directions(diagonal, above, some)
    for k in range(len(right) - 1, -1, -1):
        if right[k] is not None:
            z[k + 1 :] -= 2 * np.outer(right[k], right[k] @ z[k + 1 :])
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return some * power * power, z, total * power * power


# Spark's side.


def _pieces(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["body"])


def _vectors(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and longs of usable rows, in blocks."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part.column(0), np.array(part.column(1).flatten(), np.int64).reshape(part.num_rows, dims)


def _merged(df: DataFrame, merge, label: str) -> bytes | None:
    """One body of many: pieces are written and merged FAN at a time, until one is left."""
    df = written(df.withColumn("piece", F.monotonically_increasing_id()), label)
    numbered = df.sparkSession.createDataFrame
    while (n := df.count()) > 1:
        # pieces are numbered from 0 by their partition's first number; a row a partition
        sizes = df.groupBy(F.shiftright("piece", 33).alias("p")).count().orderBy("p").toPandas()
        sizes["first"] = sizes["count"].cumsum() - sizes["count"]
        table = numbered(sizes[["p", "first"]], "p long, first long")
        place = F.floor((F.col("first") + F.col("piece").bitwiseAND(F.lit((1 << 33) - 1))) / F.lit(FAN))
        groups = df.withColumn("p", F.shiftright("piece", 33)).join(F.broadcast(table), "p").select(place.alias("to"), "body")
        count = -(-n // FAN)
        df = written(
            groups.groupBy("to").applyInPandas(lambda m: pd.DataFrame({"body": [merge(m["body"].tolist())]}), "body binary").withColumn("piece", F.monotonically_increasing_id()).coalesce(max(1, min(count, 200))),
            label,
        )
    row = df.select("body").first()
    return bytes(row[0]) if row else None


def _triangle(stack: list[np.ndarray], dims: int) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(stack), mode="r")
    return np.concatenate([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def _merge_moments(bodies: list[bytes], k: int) -> bytes:
    """(n, mean, sum of centred products) of several parts."""
    n, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
    for b in bodies:
        v = np.frombuffer(b, np.float64)
        m, other, more = v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)
        gap = other - mean
        products = products + more + np.outer(gap, gap) * (n * m / (n + m))
        mean, n = mean + gap * (m / (n + m)), n + m
    return np.concatenate([[n], mean, products.ravel()]).tobytes()


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    spark = vectors.sparkSession
    entries = F.col("embedding").cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    shape = usable.where(F.size("x") > 0).groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if shape is None:
        return spark.createDataFrame([], _RESULT + ", identity_error double")
    dims, n = shape
    rows = written(usable.where(F.size("x") == dims), "whole-vectors")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for _, x in _vectors(batches, dims):
            total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], names=["d", "s"])

    added = rows.mapInArrow(sums, "d int, s long").groupBy("d").agg(F.sum("s").alias("s")).collect()  # a row a dimension
    s = np.array([r.s for r in sorted(added, key=lambda r: r.d)], np.int64)

    def triangles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _vectors(batches, dims):
            r = _triangle([(n * x - s) / n] + ([r] if r is not None else []), dims)
        if r is not None:
            yield _pieces([r.tobytes()])

    def stacked(bodies: list[bytes]) -> bytes:
        return _triangle([np.frombuffer(b, np.float64).reshape(dims, dims) for b in bodies], dims).tobytes()

    r = np.frombuffer(_merged(rows.mapInArrow(triangles, "body binary"), stacked, "triangles"), np.float64).reshape(dims, dims)
    squares, axes, total = principal(r, components)
    k = len(squares)
    if not k:
        return spark.createDataFrame([], _RESULT + ", identity_error double")
    across = axes / np.sqrt(squares / n)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, dims):
            gap = n * x - s
            near = (gap.astype(np.float64) ** 2).sum(axis=1)
            if near.max(initial=0.0) > 9.2e18:
                raise OverflowError("a deviation does not fit into a long")
            deviation = (gap * gap).sum(axis=1)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids.to_pylist(), object), k), pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k)),
                 pa.array(((gap / n) @ across).ravel()), pa.array(np.tile(squares / total, m))],
                names=[c.split()[0] for c in _RESULT.split(", ")],
            )

    white = written(rows.mapInArrow(project, _RESULT), "whitened")

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, x in _vectors(batches, dims):
            w = ((n * x - s) / n) @ across
            mean = w.mean(axis=0)
            found.append(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes())
            if len(found) == FAN:
                found = [_merge_moments(found, k)]
        if found:
            yield _pieces([_merge_moments(found, k)])

    body = _merged(rows.mapInArrow(moments, "body binary"), lambda bodies: _merge_moments(bodies, k), "moments")
    covariance = np.frombuffer(body, np.float64)[k + 1 :].reshape(k, k) / n
    return white.withColumn("identity_error", F.lit(float(np.abs(covariance - np.eye(k)).max())))
