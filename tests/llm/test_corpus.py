"""Corpus operators against brute force, other libraries and held-out labels."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonara.llm import bpe, chunks, common, embedding_dedup, exact_dedup, language_id, license_scan, line_dedup, near_dedup, packing, registry, sharding, token_counts

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("batch", T.LongType())])


def fold(text):
    return (text or "").translate(str.maketrans(UP, LOW))


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "  A Line that many documents share, well over forty characters \t"
    rows, last = [], None
    for i in range(60):
        text = prose(rng.randint(1, 120)) + ".\n" + prose(rng.randint(1, 40))
        if i % 5 == 1:
            text = last.upper() if i % 10 == 1 else last
        elif i % 5 == 2:
            parts = last.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif i % 5 == 3:
            text = shared + "\n" + text + "\n" + shared.upper()
        last = text
        rows.append((i, text, "en" if i % 2 else "fr", "x", i))
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, "one", "en", "x", 0), (103, "One", None, "x", 0), (104, " \t\n ", "fr", "x", 1)]
    rows += [(105, "z" * 3000, "fr", "x", 1), (106, prose(6000), "en", "x", 1), (107, "l’été — 中文 ½  it's\x1c 'tis\x00 <|endoftext|>  end  ", "fr", "x", 1), (5, rows[5][1], "fr", "x", 1), (None, "no id here", "en", "x", 1)]
    rows += [(200 + i, f"{shared}\nmine {i}", "en", "x", 2) for i in range(4)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_even_and_permuted(docs, rows, empty):
    got = sharding.shard(docs, 8).collect()
    n = len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r.law for r in got} == {"rows"}
    for size in (1, 2, 7, n, 1000):
        p = sharding.permuted(np.arange(size), size, 3)
        assert sorted(p) == list(range(size)) and (sharding.row_at(p, size, 3) == np.arange(size)).all()
    # places follow from row numbers in order of id
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    places = sharding.permuted(np.arange(n), n, 7)
    assert sorted((r.doc_id, r.shard, r.slot) for r in got if r.doc_id is not None) == sorted((r.doc_id, p % 8, p // 8) for r, p in zip(order, places.tolist(), strict=True) if r.doc_id is not None)
    assert sharding.shard(empty).count() == 0


def _tiktoken():
    import tiktoken

    with open(public_tokenizers.path(registry.BYTE_BPE), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(docs, rows, empty):
    path, pattern = public_tokenizers.path(registry.BYTE_BPE), public_tokenizers.PATTERN
    wanted = _tiktoken()
    got = bpe.encode_digests(docs, path, pattern).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.array(wanted.encode_ordinary(t or ""), dtype="<u4").tobytes()
        expected[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == expected
    assert bpe.encode_digests(empty, path, pattern).count() == 0
    rng = random.Random(1)
    encoder = bpe.encoder(path, pattern)
    texts = ["".join(rng.choice("aeinrst AB é中\n\t.,'19 ") for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["a" * 700, "the" * 200]
    texts += ["def f(x):\n    return x  # two   spaces \n\n\n  if  y:\n\t\tpass " * 200, " a  b   c ", "  ", " ", "\u3000 a \xa0 b\r\n c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [wanted.encode_ordinary(t) for t in texts]
    # indented texts are cut into words as well, and long words aren't remembered
    encoder.encode(["x" * 5000 + "  " + "indented  word pair " * 1000])
    assert max(map(len, encoder.words)) <= bpe.LONG and max(map(len, encoder.pieces)) <= bpe.LONG
    small = bpe.Encoder(encoder.vocab, pattern)
    small.held = bpe.MEMORY_BYTES
    assert small.encode(["all is forgotten"]) == encoder.encode(["all is forgotten"]) and not small.words and not small.held


def test_token_counts_equal_greedy_matching(docs, rows, empty):
    path = public_tokenizers.path(registry.WORD_BPE)
    pieces = token_counts.pieces_of(path)
    longest = max(map(len, pieces))

    def greedy(word, first, rest):
        at, n, vocab = 0, 0, first
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocab), 0)
            if not size:
                return 0
            at, n, vocab = at + size, n + 1, rest
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(docs, path).collect()}
    for i, t, *_ in rows:
        words = [w.encode() for p in (t or "").lower().split() for w in token_counts._WORD.findall(p)]
        assert got[i] == (len(words), sum(greedy(w, pieces, pieces) or 1 for w in words), sum(not greedy(w, pieces, pieces) for w in words))
    rng = random.Random(2)
    for _ in range(30):
        first = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))).encode() for _ in range(6)}
        rest = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))).encode() for _ in range(6)}
        automaton = token_counts.Automaton(first, rest)
        for _ in range(60):
            word = "".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randint(0, 12))).encode()
            assert automaton.count(word) == greedy(word, first, rest), (word, first, rest)
    assert token_counts.token_counts(empty, path).count() == 0


def _line_brute(rows, min_docs=5):
    held = defaultdict(list)
    for i, t, *_ in rows:
        for k in {fold(line.strip(BLANK)) for line in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(fold(x.strip(BLANK)), -1 if i is None else i) == (-1 if i is None else i)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(docs, rows, empty):
    assert Counter(map(tuple, line_dedup.line_dedup(docs).collect())) == _line_brute(rows)
    assert any(k[2] for k in _line_brute(rows))
    assert line_dedup.line_dedup(empty).count() == 0
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert {r.doc_id for r in kept.where("text IS NULL").collect()} == {100}


def _line_batch(spark, *keys):
    rows = spark.createDataFrame([(k, k, k) for k in keys], "h1 bigint, h2 int, doc bigint")
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))


def test_line_runs_hold_disjoint_keys(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    own = lambda: [sorted(r.h1 for r in run.rows.collect()) for run in runs.runs]
    updates = lambda: [[sorted((r.h1, r.n) for r in u.collect()) for u in run.updates] for run in runs.runs]
    runs.add(_line_batch(spark, 1, 2))
    assert own() == [[1, 2]]
    runs.add(_line_batch(spark, 2, 3, 3))
    assert own() == [[1, 2, 3]] and updates() == [[]] and [len(level) for level in runs.levels] == [0, 1]
    runs.add(_line_batch(spark, 3, 1, 4))
    assert own() == [[4], [1, 2, 3]] and updates() == [[], [[(1, 1), (3, 1)]]]
    assert sorted((r.h1, r.n, r.last) for r in runs.totals().collect()) == [(1, 2, 1), (2, 2, 2), (3, 3, 3), (4, 1, 4)]
    runs.add(_line_batch(spark, 4, 4, 1, 5))
    assert own() == [[1, 2, 3, 4, 5]] and sorted((r.h1, r.n) for r in runs.totals().collect()) == [(1, 3), (2, 2), (3, 3), (4, 3), (5, 1)]


def test_line_dedup_needs_the_anti_join(docs, rows, monkeypatch):
    """Where every key enters every batch's run, runs share keys and results are wrong, without any error."""
    monkeypatch.setattr(line_dedup.LineRuns, "held", lambda self, batch: batch.withColumn("run", F.lit(None).cast("int")))
    assert Counter(map(tuple, line_dedup.line_dedup(docs).collect())) != _line_brute(rows)


def test_line_runs_stay_where_they_are(spark):
    """A batch moves once to be grouped; the runs are neither moved nor sorted."""
    runs = line_dedup.LineRuns(spark, fanout=3)
    for keys in ((1, 2), (2, 3)):
        runs.add(_line_batch(spark, *keys))
    spark.conf.set(line_dedup._ORDERED, "true")
    try:
        plan = runs.held(_line_batch(spark, 3, 4))._jdf.queryExecution().executedPlan().toString()
        whole = runs.merged(*map(runs.current, runs.runs))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(line_dedup._ORDERED, "false")
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2 and plan.count("Sort [") == 1
    assert "Exchange" not in whole and "Sort [" not in whole and whole.count("SortMergeJoin") == 2


def test_line_dedup_with_more_frequent_lines_than_are_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "LOOKUP_ROWS", 40)
    for hot in (1, 8, 10**6):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert Counter(map(tuple, line_dedup.line_dedup(docs, min_docs=2).collect())) == _line_brute(rows, 2)


def _groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, empty, k):
    def shingles(t):
        words = [w for w in fold(t).replace("\x0b", " ").translate(str.maketrans(BLANK, " " * len(BLANK))).split(" ") if w]
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    named = [r for r in rows if r[0] is not None]
    named.sort(key=lambda r: r[0])
    sets = [shingles(r[1]) for r in named]
    ok = lambda a, b: named[a][0] == named[b][0] or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    group = _groups(len(named), ok)
    expected = Counter((r[0], len(sets[i]), named[group[i]][0], named[group[i]][0] == r[0]) for i, r in enumerate(named))
    got = near_dedup.near_duplicates(docs, k=k).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == expected
    assert [tuple(r)[2:] for r in got if r.doc_id is None] == [(None, True)]
    assert max(Counter(r.component_id for r in got).values()) > 1
    assert near_dedup.near_duplicates(empty, k=k).count() == 0


def _pair(rng, n, common):
    """Two random sets of 64-bit hashes with so many in common, ``n`` in their union."""
    union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    rest = rng.permutation(union)
    extra = rest[common:]
    return np.sort(np.r_[rest[:common], extra[: len(extra) // 2]]), np.sort(np.r_[rest[:common], extra[len(extra) // 2 :]])


def test_bands_meet_in_similar_pairs():
    """Recall of the candidate search, measured: similarities from 0.80 on, small and large sets."""
    rng, sketch = np.random.default_rng(5), near_dedup.Sketch()
    pairs = [_pair(rng, n, round(j * n)) for j in (0.80, 0.82, 0.85) for n in (40, 200, 1000) for _ in range(400)]
    regs = near_dedup.registers([s for p in pairs for s in p], sketch).reshape(len(pairs), 2, sketch.bands, sketch.rows)
    met = (regs[:, 0] == regs[:, 1]).all(axis=2).any(axis=1)
    assert met.mean() >= 0.9995
    sizes = np.array([[len(a), len(b)] for a, b in pairs], dtype=np.float64)
    flat = regs.reshape(len(pairs), 2, -1)
    guess = near_dedup.estimate(flat[:, 0], flat[:, 1], sizes[:, 0], sizes[:, 1], sketch.base)
    assert (guess >= 0.8 - sketch.margin).mean() >= 0.9995
    # so often do registers agree that decide whether sets of a mixed bucket are compared
    assert ((flat[:, 0] == flat[:, 1]).sum(axis=1) >= int((0.8 - sketch.margin) * sketch.size)).mean() >= 0.9995


@pytest.mark.parametrize("bounds", [{"block": 900}, {"block_docs": 3}])
def test_near_duplicates_of_a_chain_across_blocks(spark, bounds):
    """A group whose members are linked through each other only, in more blocks than one."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows, words = [], list(base)
    for i in range(40):
        for _ in range(3):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    group = _groups(len(rows), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = near_dedup.near_duplicates(docs, k=2, sketch=near_dedup.Sketch(**bounds))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(group))


def test_near_dedup_gives_python_small_batches_and_chunks(spark, monkeypatch):
    """Chunks go to Python one by one, in pieces of two megabytes; the session's setting is as before at the end."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), near_dedup.written

    def written(df, label, *by):
        seen.append((label, int(spark.conf.get(name))))
        return write(df, label, *by)

    monkeypatch.setattr(near_dedup, "written", written)
    sizes, make = [], chunks.Chunks.__init__
    monkeypatch.setattr(chunks.Chunks, "__init__", lambda self, df, label, size=None: (sizes.append(size or chunks.CHUNK), make(self, df, label, size))[1])
    rows = [(i, f"a{i % 5} b c d e f {'g' * (i % 3)} h") for i in range(30)]
    for judged in (near_dedup.near_duplicates, near_dedup.without_near_copies):
        judged(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()
    assert {n for label, n in seen if label == "sketches"} == {1} and max(n for _, n in seen) <= 1000
    assert sizes and max(sizes) <= 2 << 20
    assert spark.conf.get(name) == before


def test_sets_meet_once_however_many_buckets_their_documents_share(spark, monkeypatch):
    """Members of one group are dealt once for their sets, not once a bucket, and those of its largest component meet the others' only."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(0, 200, 2), 16 if i % 6 == 0 else 3):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    given, deal = [], near_dedup.dealt_blocks

    def dealt_blocks(docs, weight, sketch):
        if weight is not None:
            given.append([r.doc_id for r in docs.collect()])
        return deal(docs, weight, sketch)

    monkeypatch.setattr(near_dedup, "dealt_blocks", dealt_blocks)
    near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()
    assert len(given) == 1 and len(given[0]) > 20 and len(set(given[0])) == len(given[0])
    rows = [(1, i, i if i < 3 else 9, 1) for i in range(103)]
    dealt = deal(spark.createDataFrame(rows, "key bigint, doc_id bigint, component bigint, n bigint"), None, near_dedup.Sketch(block_docs=10)).collect()
    assert len(dealt) == 100 + 3 * (1 + 10) and {(r.lo, r.hi) for r in dealt} == {(0, i) for i in range(11)}


def test_buckets_of_the_same_documents_are_compared_once(spark):
    members = spark.createDataFrame([(k, d, 3) for k, ds in ((1, (1, 2, 3)), (2, (3, 2, 1)), (3, (1, 2, 4)), (4, (5, 6, 7))) for d in ds] + [(9, 1, 2), (9, 8, 2)], "key bigint, doc_id bigint, n bigint")
    components = spark.createDataFrame([(5, 5), (6, 5), (7, 5), (2, 1), (1, 1)], "node bigint, component bigint")
    got = {(r.key, r.doc_id, r.component) for r in near_dedup.mixed_buckets(members, components).collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (1, 3, 3), (3, 1, 1), (3, 2, 1), (3, 4, 4)}


def test_agreeing_documents_equal_brute_force():
    import pandas as pd

    rng = np.random.default_rng(6)
    regs = rng.integers(0, 3, (40, 12)).astype("<u2")
    frame = pd.DataFrame({"key": 5, "doc_id": range(40), "component": [i % 3 for i in range(40)], "lo": 0, "hi": 1, "block": [i % 2 for i in range(40)], "registers": [r.tobytes() for r in regs]})
    for part, pairs in ((frame, [(i, j) for i in range(0, 40, 2) for j in range(1, 40, 2)]), (frame[frame["block"] == 0].assign(hi=0), [(i, j) for i in range(0, 40, 2) for j in range(0, 40, 2)])):
        wanted = {x for i, j in pairs if i % 3 != j % 3 and (regs[i] == regs[j]).sum() >= 8 for x in (i, j)}
        got = near_dedup.agreeing(part, 8)
        assert sorted(got["doc_id"]) == sorted(wanted) and len(wanted) < 40
    assert not len(near_dedup.agreeing(frame[frame["block"] == 0], 1))


def test_compared_blocks_finds_all_links_between_components():
    import pandas as pd

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, 150)) for _ in range(30)]
    frame = pd.DataFrame({"lo": 0, "hi": 1, "block": [i % 2 for i in range(30)], "component": range(30), "shingles": [s.tobytes() for s in sets]})
    found = near_dedup.compared_blocks(frame, 40)
    linked = lambda a, b: a % 2 != b % 2 and near_dedup.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 40)
    edges = set(map(tuple, found.to_numpy().tolist()))
    assert _groups(30, linked) == _groups(30, lambda a, b: (a, b) in edges or (b, a) in edges)


def test_sketch_estimates_and_merges():
    sketch = near_dedup.Sketch()
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(values[:2000]), np.sort(values[500:2500])
    regs = near_dedup.registers([a, b, np.sort(values[:2500])], sketch)
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    guess = near_dedup.estimate(regs[:1], regs[1:2], np.array([2000.0]), np.array([2000.0]), sketch.base)
    assert abs(guess[0] - 1500 / 2500) < 0.1


def _exact_brute(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[fold(t)].append(i)
    expected = Counter()
    for i, t, *_ in rows:
        ids = by[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        expected[i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()] += 1
    return expected


def test_exact_dedup(docs, rows, empty, monkeypatch):
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == _exact_brute(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    # senders of few rows, and more groups than are broadcast
    monkeypatch.setattr(chunks, "CHUNK", 2000)
    monkeypatch.setattr(common, "LOOKUP_ROWS", 10)
    for hot in (1, 2, 10**6):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert Counter(map(tuple, exact_dedup.exact_dedup(docs, owners=5).collect())) == _exact_brute(rows)


def test_exact_dedup_needs_the_exchange(docs, rows, monkeypatch):
    """Without the owners' answers, equal texts of different senders aren't found."""
    answers = exact_dedup._answers
    monkeypatch.setattr(exact_dedup, "_answers", lambda messages: answers(messages).assign(bitmap=lambda d: [bytes(len(b)) for b in d["bitmap"]]))
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) != _exact_brute(rows)


def _exchanged(frame):
    """The columns that each exchange of a plan moves."""
    plan = frame._jdf.queryExecution().executedPlan()
    out, left = [], [plan]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            out.append([node.output().apply(i).name() for i in range(node.output().size())])
        left += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_fingerprints_travel_compressed_and_alone(spark, monkeypatch):
    texts = spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(3)
    own = chunks.Chunks(texts, "texts")
    marked = exact_dedup.marked_rows(own, 16)
    # messages to owners and bitmaps back; the senders' rows stay in their chunks
    assert len(_exchanged(marked)) == 2 and not {"rows", "text", "digest"} & {c for x in _exchanged(marked) for c in x}
    assert marked.where("suspect").count() == 0
    coded = pa.Table.from_batches(list(exact_dedup._messages(16)(1, texts.toArrow())))
    sent = sum(len(x) for c in ("unary", "rest") for x in coded.column(c).to_pylist())
    assert sum(coded.column("n").to_pylist()) == 40_000 and sent < 0.8 * 40_000 * exact_dedup.FINGERPRINT_BITS / 8


@pytest.mark.parametrize("size", [1, 3000, 1 << 20])
def test_chunks_hold_every_row_once(docs, rows, size):
    own = chunks.Chunks(docs, "rows", size)
    given = sorted(map(str, docs.collect()))

    def same(_, table, notes):
        return table

    assert sorted(map(str, own.met(own.home.select("chunk"), same, docs.schema).collect())) == given
    sizes = own.home.agg(F.sum("n"), F.count("*"), F.countDistinct("chunk")).first()
    assert sizes[0] == len(rows) and sizes[1] == sizes[2] and (sizes[1] == len(rows) if size == 1 else sizes[1] < len(rows))


def test_texts_stay_in_their_chunks_beyond_the_broadcast_bounds(docs, spark, monkeypatch):
    """No exchange of op5 and op6 moves the texts of all rows, whatever may be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "LOOKUP_ROWS", 1)
    moved = []
    for module in (exact_dedup, near_dedup):
        stored = module.written
        monkeypatch.setattr(module, "written", lambda df, *a, stored=stored, **k: (moved.append((a[0], _exchanged(df))), stored(df, *a, **k))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ends = [exact_dedup.exact_dedup(docs), near_dedup.near_duplicates(docs, k=2), near_dedup.without_near_copies(docs, k=2)]
        moved += [("result", _exchanged(df)) for df in ends]
        assert all(df.count() for df in ends)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # only the groups of suspects are dealt by text
    assert len(moved) > 10 and {label for label, exchanges in moved for x in exchanges if "text" in x or "rows" in x} <= {"text-groups"}


def test_without_near_copies_keeps_columns(docs, rows):
    kept = near_dedup.without_near_copies(docs, k=2)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    judged = Counter(r.doc_id for r in near_dedup.near_duplicates(docs, k=2).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == judged


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 4000):
        for top in (n + 1, 1 << 20, 1 << 46):
            values = np.unique(rng.integers(0, top, n))
            k, unary, rest = exact_dedup.golomb_encode(values)
            assert (exact_dedup.golomb_decode(len(values), k, unary, rest) == values).all()


def test_packing_covers_every_id_once(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(registry.WORD_BPE)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(docs.where("doc_id IS NULL OR doc_id <> 5 OR batch = 5"), path).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.loss_tokens == r.length
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist() and sum(r.length for r in pieces) == len(ids[i])
    assert set(by_doc) == set(ids)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist() and total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_keeps_all_three_limits():
    rng = random.Random(9)
    tokens = [rng.randint(1, 90) for _ in range(200)] + [500, 64]
    loss_from = [rng.randint(0, t) for t in tokens]
    limits = packing.Limits(tokens=64, segments=5, loss_tokens=40)
    counts = [np.r_[0, np.cumsum(np.arange(t) >= x)] for t, x in zip(tokens, loss_from, strict=True)]
    mixed = [np.r_[0, np.cumsum([rng.random() < 0.5 for _ in range(t)])] for t in tokens]
    # a prompt's end and a running count say the same
    assert packing.pack(tokens, loss_from, limits) == packing.pack(tokens, counts, limits)
    for losses in (counts, mixed):
        pieces = packing.pack(tokens, losses, limits)
        covered = defaultdict(list)
        sequences = defaultdict(list)
        for p in pieces:
            covered[p.example] += range(p.start, p.start + p.length)
            sequences[p.sequence].append(p)
        assert all(sorted(covered[i]) == list(range(t)) for i, t in enumerate(tokens))
        for ps in sequences.values():
            assert sum(p.length for p in ps) <= 64 and len(ps) <= 5
            assert sum(losses[p.example][p.start + p.length] - losses[p.example][p.start] for p in ps) <= 40


def test_packing_chooses_by_dot_product():
    """Brute force: examples that need no cut, one after the other by the largest dot product of demand and room."""
    rng = random.Random(4)
    limits = packing.Limits(tokens=64, segments=4, loss_tokens=24)
    for _ in range(20):
        tokens = [rng.choice([4, 8, 16, 32]) for _ in range(30)]
        losses = [t - rng.choice([0, 2, t // 2]) for t in tokens]
        left, wanted = set(range(30)), []
        while left:
            free = [limits.tokens, limits.segments, limits.loss_tokens]
            taken = []
            while True:
                need = {i: (tokens[i], 1, tokens[i] - losses[i]) for i in left}
                fits = [i for i in left if all(n <= f for n, f in zip(need[i], free, strict=True))]
                if not fits:
                    break
                worth = lambda i: sum(n * f / r**2 for n, f, r in zip(need[i], free, (limits.tokens, limits.segments, limits.loss_tokens), strict=True))  # noqa: B023, E731
                best = max(fits, key=lambda i: (round(worth(i), 12), -i))
                free = [f - n for f, n in zip(free, need[best], strict=True)]
                taken.append(best)
                left.discard(best)
            wanted.append(taken)
            if any(f for f in free[:1]) and left:
                break  # a sequence that isn't full cuts an example next
        pieces = packing.pack(tokens, losses, limits)
        first = wanted[0]
        got = []
        for p in sorted(pieces, key=lambda p: (p.sequence, p.offset)):
            if p.example not in got:
                got.append(p.example)
        assert got[: len(first)] == first


def test_packing_of_conversations(spark, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(registry.WORD_BPE)
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello there"), (1, 2, "assistant", "good morning to you"), (1, 3, "user", "bye"), (1, 4, "assistant", "so long"), (1, 5, "user", "unanswered")]
    rows += [(1, 4, "assistant", "so long"), (2, 63, "user", "the last of a stretch"), (2, 64, "assistant", "the first of the next"), (3, 0, "user", None), (3, 1, "assistant", ""), (None, 0, "user", "whose is this"), (4, None, "assistant", "when")]
    rows += [(5, 2 * i + k, ("user", "assistant")[k], " ".join(["word"] * (40 * k + 3))) for i in range(100) for k in (0, 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = {(r.conv_id, r.turn): [(t.turn, t.role, t.text) for t in r.turns] for r in packing.conversation_examples(frame).collect()}
    assert [t[0] for t in examples[1, 0]] == [0, 1, 2] and [t[0] for t in examples[1, 3]] == [3, 4] and examples[1, 5] == [(5, "user", "unanswered")]
    assert examples[2, 63] == [(63, "user", "the last of a stretch")] and examples[3, 0] == [(0, "user", ""), (1, "assistant", "")] and (None, 0) in examples and (4, None) in examples
    limits = packing.Limits(tokens=256, segments=8, loss_tokens=60)
    got = packing.pack_conversations(frame, path, limits=limits).collect()
    ids, bears = {}, {}
    for key, turns in examples.items():
        parts = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, _, t in turns]
        ids[key], bears[key] = sum(parts, []), sum(([role == "assistant"] * len(p) for p, (_, role, _) in zip(parts, turns, strict=True)), [])
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        key, span = (r.conv_id, r.turn), slice(r.start, r.start + r.length)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[key][span] and r.loss_tokens == sum(bears[key][span])
        covered[key] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append(r)
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(len(v))) for k, v in ids.items()}
    assert all(sum(r.length for r in rs) <= 256 and len(rs) <= 8 and sum(r.loss_tokens for r in rs) <= 60 for rs in sequences.values())
    # the limit on loss binds: without it far fewer sequences do
    wide = packing.pack_conversations(frame, path, limits=packing.Limits(tokens=256, segments=8, loss_tokens=256))
    assert len(sequences) > 1.5 * wide.select("sequence_id").distinct().count()
    report = packing.cut_report(packing.pack_conversations(frame, path, limits=limits), ["conv_id", "turn"]).first()
    assert report.examples == len(examples) and report.pieces == len(got) and report.tokens == sum(map(len, ids.values()))
    assert packing.pack_conversations(frame.limit(0), path).count() == 0


@pytest.mark.parametrize("split", ["sf0.01"])
def test_language_accuracy_on_held_out_rows(spark, split):
    docs = spark.read.parquet(f"/root/testdata/{split}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[1] > 100 and got[0] > 0.97


def test_language_filters_equal_sets(monkeypatch):
    """Brute force: n-gram sets for each language instead of filters, whole texts instead of windows."""
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(80)] for lang, a in (("aa", "abcdeo"), ("bb", "klmnoe"), ("cc", "ästuz"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))

    def grams(t):
        raw = (" " + t.lower() + " ").encode().translate(language_id._TABLE)
        return [raw[i : i + 4] for i in range(len(raw) - 3) if raw[i : i + 4].count(32) <= 1]

    known = {lang: set(grams(text(lang, 400))) for lang in words}
    languages = sorted(words)
    masks = np.zeros((1 << language_id.SLOT_BITS, 1), dtype=np.uint8)
    for k, lang in enumerate(languages):
        codes = np.array([int.from_bytes(g, "little") for g in known[lang]], dtype=np.uint32)
        for slot in language_id._slots(codes):
            np.bitwise_or.at(masks[:, 0], slot, np.uint8(1 << k))
    model = language_id.Model(languages, masks, "aa")
    texts = [text(lang, rng.randint(1, 300)) for lang in languages for _ in range(10)] + ["", "12 - 3", "É! x", text("aa", 40) + " " + text("bb", 40)]
    exact = np.array([[sum(g in known[lang] for g in grams(t)) / max(1, len(grams(t))) for lang in languages] for t in texts])
    for window in (language_id.WINDOW, 64, 5):
        monkeypatch.setattr(language_id, "WINDOW", window)
        got = language_id.scores(texts, model, model.false_positives())
        assert np.abs(got - exact).max() < 1e-2
        named, score = language_id.predict([*texts, None], model, model.false_positives())
        assert named[30] == named[31] == named[34] == "und" and score[34] == 0
        assert named[:30].tolist() == [lang for lang in languages for _ in range(10)]


def test_language_edges(docs, rows, empty):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 104))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert {r.lang_pred for i, r in got.items() if i not in (100, 101, 104)} <= {"en", "fr"}
    assert language_id.language_id(empty).count() == 0


def test_license_scan_finds_notices(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {"MIT License": "mit", "Apache License": "apache", "GNU General Public": "gpl", "CC BY-NC": "cc"}
    got = {r.doc_id: r for r in license_scan.license_scan(real).collect()}
    for r in real.collect():
        wanted = sorted({f for n, f in notices.items() if n in r.text})
        assert got[r.doc_id].families == ",".join(wanted)
    assert {r.families for r in license_scan.license_scan(docs).collect()} == {""}
    assert license_scan.license_scan(empty).count() == 0


def _licence_prose(spark):
    known = ("licen", "redistribut", "permission", "warrant")
    return " ".join(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if not any(k in r.text.lower() for k in known)).split()


@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.fit(license_scan.sample_windows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")))


#: Grants and notices that are no training texts, by family.
PLANTED = [
    ("apache", "You can use it under the terms of the Apache License 2.0"), ("bsd", "This library may be used under the BSD 3-Clause License."), ("mit", "// Copyright somebody.\n// SPDX-License-Identifier: MIT"),
    ("gpl", "GPL v2 or later"), ("gpl", "This software is licensed under the GPLv3, see the file COPYING"), ("epl", "Eclipse Public License 2.0"), ("isc", "ISC License"), ("mit", "The MIT License (MIT)"),
    ("cc", "All texts of this site are licensed under CC BY-SA 4.0 unless noted."), ("mpl", "Files here are released under the Mozilla Public License 2.0"), ("lgpl", "It is distributed under the terms of the LGPL v2.1 by its authors"),
]
#: Mentions, licences that training never sees, and near misses.
CLEAN = [
    "The MIT License was discussed at length by the committee.", "We like the Apache License 2.0 for its clarity", "Licensed under the Foo Public License, version 2.", "Released under the Nethack General License.",
    "European Union Public Licence 1.2", "software is provided as is", "the version 3 of this license, or any later one", "a copy of the software and its documentation", "", "\n\n \n",
]


#: Grants and texts that grant nothing, from which no form was made.
APART_GRANTS = [
    ("mit", "Everything in this folder is offered under the MIT License."), ("apache", "Copyright 2021 the authors, licensed under Apache-2.0"),
    ("gpl", "This plugin is free software under the GNU General Public License v2.0"), ("bsd", "The parser comes under the New BSD License"),
    ("cc", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 International License"), ("mpl", "Source code is subject to the Mozilla Public License, version 2.0"),
    ("lgpl", "The library is released under the LGPL"), ("agpl", "Server code: AGPL-3.0-only"),
    ("epl", "It is provided under the terms of the Eclipse Public License 2.0"), ("isc", "license = \"ISC\""),
    ("zlib", "Distributed under the zlib/libpng license"), ("boost", "Licensed under the Boost Software License 1.0"),
    ("cc0", "Data files are licensed under CC0 1.0"), ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("mit", "// Use of this source code is governed by the MIT license that can be found in the LICENSE file."), ("bsd", "Use of this source code is governed by a BSD license"),
    ("apache,gpl", "Licensed under GPL v3 or the Apache License 2.0"), ("lgpl,mpl", "You may choose between LGPL v2.1 and MPL 2.0"),
    ("mit,unlicense", "License: MIT OR Unlicense"), ("cc", "Images are licensed under CC BY-NC-ND 4.0"),
    ("apache", "license: Apache License, Version 2.0"), ("gpl", "Licence: GPLv2"),
    ("mit", "Released under the terms of the Expat License"), ("cc0", "This dataset is dedicated by CC0 1.0 Universal"),
]
APART_CLEAN = [
    "The MIT License is one of the shortest", "Why the GPL v3 took so long", "Our lawyers prefer the Apache License 2.0",
    "a lecture about Creative Commons Zero v1.0", "this file isn't covered by the BSD license", "The project left the GNU GPL behind",
    "GPLv3 versus GPLv2", "not released under CC BY 4.0", "The Eclipse Public License 2.0 was published in 2017",
    "Questions about the Mozilla Public License 2.0", "Licensed under the Open Data Commons License", "Distributed under the terms of the Ruby License",
    "the driver lost his license", "You need a licence to fish here", "Permission was granted by the mayor",
    "use of the source is forbidden", "see the details of the program", "she studied at MIT for two years",
    "the Zlib format and its headers", "Apache helicopters were seen",
]
#: Several families, headers and denials.
SHORT = [
    ("apache", "License: Apache 2.0"), ("mit", "MIT licensed."), ("bsd", "# License: BSD"), ("cc", "Creative Commons Attribution-ShareAlike 3.0 Unported License"), ("gpl,mit", "Dual licensed under MIT and GPL."),
    ("bsd,mit", "BSD-2-Clause OR MIT"), ("apache,mit", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."), ("", "is not licensed under the MIT License"),
]


def test_license_recall_and_precision(licences):
    name = lambda t: {f for w in license_scan.paragraphs_of(t) for f, *_ in licences.find(w)}
    assert [(",".join(sorted(name(t))), t) for _, t in SHORT] == SHORT
    found = wanted = right = 0
    for families, text in [*APART_GRANTS, *(("", t) for t in APART_CLEAN)]:
        own = set(filter(None, families.split(",")))
        found, wanted, right = found + len(name(text)), wanted + len(own), right + len(name(text) & own)
    assert right / wanted >= 0.85 and right / found >= 0.8, (right / wanted, right / found)


def test_license_classifier_decides(licences):
    """What the templates share counts for nothing where the classifier says unknown."""
    notice = license_scan.words_of(license_scan.NOTICES["mit"][0])
    assert [f for f, *_ in licences.find(notice)] == ["mit"]
    silent = license_scan.Classifier(licences.families, licences.features, licences.weights.copy(), licences.temperature)
    silent.index_cues()
    silent.weights[-2, -1] += 1000
    assert silent.find(notice) == [] and silent.probabilities(notice).argmax() == len(licences.families)
    # and a window that shares nothing with them is found by the classifier alone, with a lower score
    licences_only = license_scan.Classifier(licences.families, licences.features, licences.weights, licences.temperature)
    licences_only.index_cues()
    licences_only.shared = [frozenset() for _ in licences.families]
    assert licences_only.find(notice)[0][1] == pytest.approx(license_scan.UNSHARED * licences.find(notice)[0][1])


def test_license_scan_is_linear(licences):
    import time

    took = []
    for n in (2000, 8000):
        words = (["word"] * 4 + license_scan.words_of("Licensed under the MIT License")) * n
        began = time.process_time()
        assert len(licences.find(words)) >= 1
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_license_families_and_unknowns(licences):
    name = lambda t: sorted({f for w in license_scan.paragraphs_of(t) for f, *_ in licences.find(w)})
    assert [(name(t), t) for _, t in PLANTED] == [([f], t) for f, t in PLANTED]
    assert [(name(t), t) for t in CLEAN] == [([], t) for t in CLEAN]
    # licences of calibration's unseen families are unknown as well
    assert {t for n in license_scan.UNSEEN for t in (n, f"Licensed under the {n}") if name(t)} == set()
    for family, notices in license_scan.NOTICES.items():
        for notice in notices:
            words = notice.split()
            wrapped = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            assert name(wrapped) == [family], notice
            assert name(f"before\n\n{wrapped}\n\nafter") == [family]
    # the second half of a wrapped notice alone
    words = license_scan.NOTICES["mit"][0].split()
    assert name(" ".join(words[len(words) // 2 :])) == ["mit"]
    assert len(license_scan.paragraphs_of("a\nb\n\n--\n c\n\t\nd")) == 3 and license_scan.paragraphs_of(None) == []


def test_license_spans_equal_a_search_of_all_windows(spark, licences):
    """Brute force: every span of a long line that starts and ends with a template's bigram."""
    prose = _licence_prose(spark)
    for i, (family, notice) in enumerate(sorted((f, n) for f, ns in license_scan.NOTICES.items() for n in ns)):
        words = license_scan.words_of(" ".join(prose[80 * i : 80 * i + 80]) + f" {notice} " + " ".join(prose[80 * i + 80 : 80 * i + 160]))
        found = licences.find(words)
        inside = license_scan.words_of(notice)
        start = next(k for k in range(len(words)) if words[k : k + len(inside)] == inside)
        best = max((len(set(license_scan.bigrams(words[a:b])) & set(license_scan.bigrams(inside))), a - b) for a in range(start - 3, start + 3) for b in range(start + len(inside) - 3, start + len(inside) + 3))
        assert [f for f, *_ in found] == [family] and found[0][2] <= start + 2 and found[0][3] >= start - best[1] - 3, notice


def test_license_sample_does_not_depend_on_order(spark, docs):
    own = docs.select("doc_id", "text")
    assert license_scan.sample_windows(own, 20, 8) == license_scan.sample_windows(own.repartition(7).orderBy(F.rand(3)), 20, 8)
    twice = own.unionByName(own)
    got = Counter((r.doc_id, r.families) for r in license_scan.license_scan(twice).collect())
    assert all(n % 2 == 0 for n in got.values())


def _vector_brute(rows):
    """(vec_id, links, smallest id reached) of every row by comparing all pairs."""
    good = [(k, np.array(v, dtype=np.float64)) for k, (i, v, _) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    unit = [(v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for _, v in good]
    linked = lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.9
    group = _groups(len(good), linked)
    least = defaultdict(list)
    for a, (k, _) in enumerate(good):
        least[group[a]].append(rows[k][0])
    out = {k: (rows[k][0], 0, rows[k][0]) for k in range(len(rows))}
    out |= {k: (rows[k][0], sum(linked(a, b) for b in range(len(good)) if b != a), min(least[group[a]])) for a, (k, _) in enumerate(good)}
    return Counter(out.values())


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 16))
    vectors = [v.tolist() for v in base] + [(base[i] * 3 + rng.normal(size=16) * 0.25).tolist() for i in range(60)] + [base[0].tolist(), (base[0] * 2).tolist()]
    hub = rng.normal(size=16)
    vectors += [(hub + rng.normal(size=16) * 0.28).tolist() for _ in range(150)]
    # a tight group, whose nodes are accepted whole
    vectors += [(10 * base[3] + rng.normal(size=16) * 0.1).tolist() for _ in range(40)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e-200] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors + odd)] + [(None, base[1].tolist(), 0)]
    # a vec_id of several vectors, one row repeated
    rows += [(1000, base[5].tolist(), 0), (1000, base[7].tolist(), 0), (1000, base[7].tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    for block in (64, 4096):
        got = embedding_dedup.near_vectors(frame, block=block).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == _vector_brute(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_vectors_at_the_threshold_link(spark):
    """A cosine of exactly 9/10, and a little less."""
    rows = [(1, [10.0, 0.0, 0.0, 0.0], 0), (2, [9.0, 3.0, 3.0, 1.0], 0), (3, [-20.0, 0.0, 0.0, 0.0], 0), (4, [-9.0, -3.0, -3.0, -1.0001], 0)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_traversal_looks_at_live_pairs_only():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    points = np.concatenate([c + rng.normal(size=(25, 24)) * 0.02 for c in centres])
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    a, b = embedding_dedup.build(units[::2]), embedding_dedup.build(units[1::2])
    for tree in (a, b):
        assert len(tree.radii) > 2 and max(tree.radii[-1]) < 2 * embedding_dedup.LEAST_RADIUS or (np.diff(tree.starts[-1]) == 1).all()
        for level, starts in enumerate(tree.starts):
            for k, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                assert (np.linalg.norm(tree.points[s:e] - tree.points[tree.centres[level][k]], axis=1) <= tree.radii[level][k] + 2e-3).all()
    chord = float(np.sqrt(0.2))
    found = embedding_dedup.links(a, b, chord, 0.9)
    near = a.points @ b.points.T >= 0.9
    marked = np.zeros_like(near, dtype=int)
    for s, e, t, f in found.ranges:
        marked[s:e, t:f] += 1
    np.add.at(marked, (found.x, found.y), 1)
    assert (marked == near).all()
    # clusters are pruned or accepted as such; single pairs hardly occur
    assert found.nodes + found.points < near.size / 20


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("own", F.lit(1))
    columns = docs.columns
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").persist()
        assert out.columns == columns, name
        assert out.count() <= docs.count()
        if name == "line_dedup":
            assert out.count() == docs.count()
        docs = out
    assert docs.count() > 0.8 * first.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]


def test_pipeline_with_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    real = docs.where("length(text) > 300").orderBy("doc_id").limit(40)
    long = real.first()
    odd = [(None, long.text + " and more", "en", None, 1), (7 * 10**9, None, None, None, None), (7 * 10**9 + 1, "", "en", "x", 0), (long.doc_id, long.text, long.lang, long.source, long.n_chars), (7 * 10**9 + 2, " ".join(["word"] * 30_000), None, "x", 5)]
    both = real.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(1) for c in ("own", "gone", "key", "batch", "print")})
    for table, least in ((both, 40), (both.limit(0), 0)):
        folder = tmp_path / f"sf{least}"
        table.write.parquet(f"{folder}/documents.parquet")
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        ids = {r.doc_id for r in pieces}
        assert len(ids) >= 0.8 * least and not ids & {7 * 10**9, 7 * 10**9 + 1}
        if least:
            assert None in ids and long.doc_id in ids and 7 * 10**9 + 2 in ids
            # a document's pieces, of all rows that share its id, hold all its ids
            assert sum(r.length for r in pieces if r.doc_id == 7 * 10**9 + 2) == next(r.doc_tokens for r in pieces if r.doc_id == 7 * 10**9 + 2)


def test_pipeline_drops_only_undetermined_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    real = docs.collect()
    parts = [next(r.text for r in real if r.lang == lang and len(r.text) > 400)[:400] for lang in ("de", "es", "fr")]
    clean = ["Re.", "A.", "De.", "\n".join(parts), "\n".join(reversed(parts)), "我们"]
    planted = [(10**9 + i, t, "en", "x", len(t)) for i, t in enumerate(clean)]
    undetermined = [(2 * 10**9 + i, t, "en", "x", len(t or "")) for i, t in enumerate(["", "12 - 34", None])]
    both = docs.unionByName(spark.createDataFrame(planted + undetermined, docs.schema))
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, "").select("doc_id").collect()}
    assert left == {r.doc_id for r in real if any(ch.isalpha() for ch in r.text)} | {r[0] for r in planted}


def test_license_scan_finds_notices_inside_long_lines(spark, licences):
    prose = _licence_prose(spark)
    chunk = lambda i: " ".join(prose[100 * i : 100 * i + 100])
    grants = [(f, license_scan.FORMS[i % 7].format(n)) for f, ns in sorted(license_scan.NAMES.items()) for i, n in enumerate(ns)]
    planted = [(f, t) for f, ts in sorted(license_scan.NOTICES.items()) for t in ts] + grants
    rows, wanted = [], {}
    for i, (family, notice) in enumerate(planted):
        for k, line in enumerate((f"{chunk(i)} {notice} {chunk(i + 1)}", f"{notice} {chunk(i)} {chunk(i + 1)}", f"{chunk(i)} {chunk(i + 1)} {notice}")):
            rows.append((10**9 + 3 * i + k, line))
            wanted[rows[-1][0]] = (1, 1, family)
    mit, apache = license_scan.NOTICES["mit"][0], license_scan.NOTICES["apache"][0]
    rows += [(2 * 10**9, f"{chunk(1)} {mit} {chunk(2)} {apache} {chunk(3)}"), (2 * 10**9 + 1, f"{chunk(4)} {chunk(5)}"), (2 * 10**9 + 2, None)]
    wanted |= {2 * 10**9: (1, 1, "apache,mit"), 2 * 10**9 + 1: (1, 0, ""), 2 * 10**9 + 2: (0, 0, "")}
    both = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_paragraphs, r.n_licensed, r.families) for r in license_scan.license_scan(both, licences).collect()}
    off = {k: (v, wanted[k]) for k, v in got.items() if v != wanted[k]}
    # a few short grants between strange words stay unknown; none gets another family, and no notice is missed
    assert {v for v, _ in off.values()} <= {(1, 0, "")} and len(off) <= 0.03 * len(got), off
    assert not any(k < 10**9 + 3 * sum(map(len, license_scan.NOTICES.values())) or k >= 2 * 10**9 for k in off)
