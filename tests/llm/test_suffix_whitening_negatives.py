"""Suffix dedup, whitening and hard negatives against brute force and LAPACK."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from resonara.llm import hard_negatives, suffix_dedup, whitening

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("raw", T.LongType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("row", T.LongType())])


# Suffix dedup.


def passages():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(20) for _ in range(4)]
    texts = []
    for i in range(150):
        text = prose(rng.randint(1, 150))
        if i % 3 == 0:
            text += " " + rng.choice(shared) + " " + prose(10)
        if i % 7 == 0 and texts:
            text = rng.choice(texts)
        if i % 11 == 0 and texts:
            text = text[: len(text) // 2] + "!" + text[len(text) // 2 :]
        texts.append(text)
    texts += [None, "", "é" * 100, "中" * 40, "a" * 500, "a" * 300, shared[0][:49], shared[0][3:60], "x" + "a" * 60, prose(9000) + shared[1], "ab" * 200, "ab" * 90]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    rows += [rows[5], (rows[9][0], texts[12]), (None, texts[20]), (None, texts[30] + "tail")]
    return [(i, t, "c", 1) for i, t in rows]


def removed(rows, match=50):
    least = {}
    for i, t, *_ in rows:
        raw, i = (t or "").encode(), -1 if i is None else i
        for k in range(len(raw) - match + 1):
            s = raw[k : k + match]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - match + 1):
            if least[raw[k : k + match]] < (-1 if i is None else i):
                gone[k : k + match] = b"\1" * match
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(raw), sum(gone), spans, bytes(b for b, x in zip(raw, gone) if not x)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize(("match", "chunk", "hot"), [(50, 8 << 20, 4096), (50, 3000, 4096), (50, 3000, 2), (50, 2000, 0), (64, 5000, 30), (33, 5000, 30)])
def test_removed_bytes_equal_brute_force(spark, match, chunk, hot):
    rows = passages()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(suffix_dedup.suffix_dedup(docs, match, chunk, hot)) == removed(rows, match)


def test_hot_strings_travel_packed(spark, monkeypatch):
    """A row for a chunk and a bucket, not one for each string, and equal strings of a chunk once."""
    tables, write = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, label, *rest: tables.setdefault(label, write(df, label, *rest)))
    rows = passages()
    assert got(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), hot=0)) == removed(rows)
    strings, parts = tables["hot-strings"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, slices = strings.select("chunk").distinct().count(), strings.where("bucket < 0").count()
    buckets = strings.agg({"bucket": "max"}).first()[0] + 1
    assert chunks <= 3 and strings.count() <= slices * (1 + max(parts, buckets)) < 1000


def test_equal_strings_are_told_apart_whatever_their_hash(monkeypatch):
    text = np.random.default_rng(2).integers(0, 2, (400, 11)).astype(np.uint8)[:, [0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 6]]
    monkeypatch.setattr(suffix_dedup, "_mixed", lambda h, word: word & np.uint64(1))
    first, number = suffix_dedup._equal_strings(text)
    assert (text[first[number]] == text).all() and len(first) == len({bytes(t) for t in text})


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "short", "", 0)]
    assert got(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS))) == removed(rows)
    with pytest.raises(ValueError, match="match"):
        suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS), 20)


def test_anchors_cover_every_string_whatever_the_slices(monkeypatch):
    raws = [(t or "").encode() for _, t, *_ in passages()]
    text, lengths = np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws])
    whole = suffix_dedup.anchors(text, lengths)
    starts = np.cumsum(lengths) - lengths
    covered = {p - o for p, left, right in zip(whole.at.tolist(), whole.left.tolist(), whole.right.tolist()) for o in range(50 - right, left + 1)}
    assert covered == {int(s) + k for s, n in zip(starts, lengths) for k in range(n - 49)}
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    cut = suffix_dedup.anchors(text, lengths)
    assert all((getattr(whole, f) == getattr(cut, f)).all() for f in ("at", "gram", "left", "right", "key", "doc"))
    assert len(whole.at) < 0.12 * len(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=60), st.integers(0, 48))
def test_deep_shallow_order_sorts(texts, common):
    rows = np.zeros((len(texts), 70), np.uint8)
    for i, t in enumerate(texts):
        t = (b"p" * common + t)[:70]
        rows[i, : len(t)] = np.frombuffer(t, np.uint8)
    order = suffix_dedup.deep_shallow_order(rows)
    assert sorted(order.tolist()) == list(range(len(texts)))
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered)
    lcp = suffix_dedup.common_prefixes(rows, order)
    for k in range(1, len(texts)):
        a, b = ordered[k - 1], ordered[k]
        assert lcp[k] == next((i for i in range(70) if a[i] != b[i]), 70)


def test_texts_that_share_a_hash_stay_apart(monkeypatch):
    raw = b"one two three four five six seven eight nine ten eleven twelve. " * 2 + b"x" * 80
    text, lengths = np.frombuffer(raw, np.uint8), np.array([len(raw)])
    a = suffix_dedup.anchors(text, lengths)
    a.key[:] = 7
    first, inverse = suffix_dedup.distinct(text, a)
    context = suffix_dedup.contexts(text, a, np.arange(len(a.at)))
    assert (context[first[inverse]] == context).all()


# Whitening.


def principal_of(x, most):
    c = x - x.mean(axis=0)
    return c, whitening.principal(whitening._triangle([c], x.shape[1]), most)


def cases():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(200, 20)))[0]
    q = np.linalg.qr(q - q.mean(axis=0))[0]
    turn = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    small = rng.normal(size=(300, 16))
    doubled = rng.normal(size=(400, 20))
    doubled[:, 3], doubled[:, 5] = doubled[:, 4], 0
    plus = np.kron(np.array([[1, 1], [1, -1]]), np.kron(np.array([[1, 1], [1, -1]]), np.eye(8)))
    return {
        "random": rng.normal(size=(500, 64)), "even": rng.normal(size=(20000, 48)), "mirrored": np.concatenate([small, -small]), "equal values": np.concatenate([np.eye(12) * 5, -np.eye(12) * 5]),
        "fewer rows than dimensions": rng.normal(size=(5, 64)), "constant": np.ones((10, 8)), "one row": rng.normal(size=(1, 8)), "one dimension": rng.normal(size=(100, 1)), "equal dimensions": doubled,
        "graded": rng.normal(size=(400, 12)) @ np.diag(10.0 ** -np.arange(12)), "two clusters": q @ np.diag([3.0] * 10 + [1.0] * 10) @ turn, "near clusters": q @ np.diag([3 + 1e-9 * i for i in range(10)] + [1.0] * 10) @ turn,
        "signs": np.concatenate([plus, -plus]).astype(float),
    }


@pytest.mark.parametrize("name", cases())
def test_solver_equals_lapack(name):
    x = cases()[name]
    c, (squares, axes, total) = principal_of(x, 8)
    expected = np.linalg.svd(c, compute_uv=False) ** 2
    k = len(squares)
    assert k == min(8, np.linalg.matrix_rank(c))
    if not k:
        return
    assert np.abs(squares - expected[:k]).max() <= 1e-12 * expected[0]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-9
    assert np.abs(c.T @ (c @ axes) - axes * squares).max() <= 1e-12 * expected[0]
    assert total == pytest.approx(float((c**2).sum()), rel=1e-12)


def test_qd_values_are_accurate_one_by_one():
    rng = np.random.default_rng(4)
    d, e = 10.0 ** rng.uniform(-8, 0, 30), 10.0 ** rng.uniform(-8, 0, 29)
    b = np.diag(d) + np.diag(e, 1)
    expected = np.linalg.svd(b, compute_uv=False)
    assert np.allclose(np.sqrt(whitening.singular_squares(d, e)), expected, rtol=1e-6, atol=1e-14)


def vectors(rng, n=300, dims=12):
    rows = [(i, [float(v) for v in rng.normal(size=dims) * np.arange(1, dims + 1)], int(rng.integers(0, 4)), "x", i) for i in range(n)]
    rows += [(1000, None, 1, "x", 0), (1001, [None] * dims, 1, "x", 0), (1002, [float("nan")] * dims, 1, "x", 0), (1003, [float("inf")] + [0.0] * (dims - 1), 1, "x", 0), (1004, [], 1, "x", 0), (1005, [1.0], 1, "x", 0)]
    rows += [(1050, rows[0][1], 2, "x", 1), (1050, rows[0][1], 2, "x", 1), (50, rows[50][1], 1, "x", 1), (1100, [0.0] * dims, 0, "x", 1), (1101, rows[3][1], None, "x", 1)]
    return rows


def test_whitened_rows_equal_eigenvectors(spark):
    rows = vectors(np.random.default_rng(1)) + [(None, [0.5] * 12, 1, "x", 1)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(40)).collect()
    good = [(i, e) for i, e, *_ in rows if e and len(e) == 12 and None not in e and np.isfinite(e).all()]
    x = np.floor(1024 * np.array([e for _, e in good], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    expected = c @ axes[:, :8] / np.sqrt(values[:8])
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    key = lambda i: -1 if i is None else i
    for k in range(8):
        mine = sorted((key(r.vec_id), r.deviation, r.whitened) for r in out if r.component == k + 1)
        for sign in (1, -1):
            theirs = sorted((key(i), int(d), sign * w) for (i, _), d, w in zip(good, ((n * x - s) ** 2).sum(axis=1), expected[:, k]))
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(mine, theirs)):
                break
        else:
            raise AssertionError(k)
        assert all(r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) for r in out if r.component == k + 1)
    assert max(r.identity_error for r in out) < 1e-9


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None, 1, "x", 1), (2, [], 1, "x", 1)])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0], 1, "x", 1), (2, [1.0, 2.0], 1, "x", 1)])).collect() == []
    two = whitening.whiten(frame([(1, [1.0, 2.0], 1, "x", 1), (2, [2.0, 2.0], 1, "x", 1)])).collect()
    assert [(r.component, r.n, round(abs(r.whitened), 12), r.explained) for r in two] == [(1, 2, 1.0, 1.0)] * 2
    with pytest.raises(Exception, match="does not fit into a long"):
        whitening.whiten(frame([(1, [1e8, 0.0], 1, "x", 1), (2, [-1e8, 1.0], 1, "x", 1)])).collect()


# Hard negatives.


def mined(rows, every=50):
    good = [(k, i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(e, np.float32).astype(float)).astype(np.int64)) for k, (i, e, lab, *_) in enumerate(rows) if i is not None and lab is not None and e and len(e) == 12 and None not in e and np.isfinite(e).all()]
    out = []
    for k, i, lab, x in good:
        if i % every:
            continue
        scored = sorted((-int(x @ y), j, other == lab) for m, j, other, y in good if m != k)
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fits = [(s, n) for s, n, same in scored if not same and 50 * -score <= 100 * -s <= 95 * -score][:3]
            out += [(i, j, rank, n, -score, -s) for rank, (s, n) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile_bytes", [16 << 20, 2000])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr(hard_negatives, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(hard_negatives, "QUERY_BYTES", tile_bytes)
    monkeypatch.setattr(hard_negatives, "TILES", 3)
    rng = np.random.default_rng(2)
    rows = vectors(rng) + [(i, rng.normal(size=12).astype(np.float32).tolist(), 7, "x", 0) for i in range(400, 404)] + [(700, None, 3, "x", 1), (None, [1.0] * 12, 1, "x", 1)]
    rows += [(2000 + i, rows[7][1], 1, "x", 1) for i in range(8)]  # ties
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), every=10).collect()
    assert sorted(tuple(r) for r in found) == mined(rows, 10)


def test_hard_negatives_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert hard_negatives.hard_negatives(frame([])).collect() == []
    assert hard_negatives.hard_negatives(frame([(50, [1.0, 0.0], 1, "x", 1), (51, [1.0, 0.5], 1, "x", 1)])).collect() == []
    rows = [(50, [1.0, 0.0], 1, "x", 1), (51, [1.0, 0.5], 1, "x", 1), (52, [0.75, 0.0], 2, "x", 1), (53, [0.4, 0.0], 2, "x", 1), (54, [-1.0, 0.0], 2, "x", 1)]
    assert [tuple(r) for r in hard_negatives.hard_negatives(frame(rows)).collect()] == [(50, 51, 1, 52, 65536, 49152)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 20), st.floats(-1, 1))
def test_threshold_join_loses_nothing(seed, dims, share):
    rng = np.random.default_rng(seed)
    scale = rng.integers(1, 300, dims)
    x = (rng.normal(size=(40, dims)) * scale * rng.integers(0, 3, (40, 1))).astype(np.int64)
    q = (rng.normal(size=(9, dims)) * scale).astype(np.int64)
    scores = q @ x.T
    least = (share * np.abs(scores).max(axis=1)).astype(np.int64)
    index = hard_negatives.Index(hard_negatives.Tile(*(np.arange(40),) * 3, x))
    found = defaultdict(int)
    for i, j, s in index.pairs(q, least):
        for a, b, v in zip(i.tolist(), j.tolist(), s.tolist()):
            assert (a, b) not in found
            found[a, b] = v
    assert found == {(a, b): int(scores[a, b]) for a in range(9) for b in range(40) if scores[a, b] >= least[a]}
