"""Near-dedup of documents with SetSketch registers.

A register holds the exponentially spaced, truncated minimum of one hash over a
document's shingles: ``floor(1 - log_b(x))`` of the smallest exponential value x.
Registers of two sets merge by maximum and agree about as often as the sets are
similar.  Bands of registers give candidates; the joint likelihood of the
registers that are larger, smaller and equal estimates the similarity; sets of
shingles (64-bit hashes of all of them) decide.

No pair of a bucket's documents is lost, and none is enumerated in a bucket:

1. Documents with equal sets form a class; its smallest doc_id represents it.
2. Each bucket links its members to its smallest one; verified links give
   components.
3. Buckets whose members are then still in several components are looked at as
   wholes, each by itself, and buckets of the same documents once.  Their
   documents are dealt into blocks of a bounded size, and tasks, one for each pair
   of blocks, compare all registers; documents that agree with none of another
   component about as often as the threshold asks for are done.  The others form
   families over all buckets, by whom they agree with, and the sets of a family are
   compared exactly in blocks as well, once however many buckets its documents
   share; what comes back is no more than a spanning forest of the links found.
   In both steps documents of the largest component never meet each other.

No task gets all rows of a hot bucket or text: both are looked up by broadcast after
being counted, or the hot ones of them.  Texts stay in their chunks (``chunks``);
only the sets of candidates leave them.

With 48 bands of 7 registers a pair of similarity 0.8 shares a bucket with
probability 0.99999, one of 0.85 with 0.9999999.

Texts are lower-cased (A-Z only) and split at 0x20 and 0x09-0x0D.  Null texts
and texts without words have no shingles and no links; so have rows without a
doc_id.  Rows that share a doc_id are one document for links.  An empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonara.operators.components import connected_components

from .chunks import Chunks
from .common import arrow_rows, looked_up, slices, written

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
c = F.col
#: Bytes of a chunk; only ids travel to chunks here, so that small ones cost nothing and spare memory.
_CHUNK = 2 << 20
#: Rows with texts, registers or sets that go to Python at once.
_ROWS = 1000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Sketch:
    """Bands, registers a band, the registers' base and rate, and how far below the threshold an estimate may be."""

    bands: int = 48
    rows: int = 7
    base: float = 1.02
    rate: float = 20.0
    margin: float = 0.13
    #: Shingles and documents of a block of a bucket.
    block: int = 300_000
    block_docs: int = 2048

    @property
    def size(self) -> int:
        return self.bands * self.rows


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C1
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    out = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        out = out * _C2 + h[j : len(h) - width + 1 + j]
    return np.unique(_mixed(out + np.uint64(width)))


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20231))
    return rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, m, dtype=np.uint32)


def registers(sets: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """One row of registers for each set; zeros for an empty one."""
    a, b = _coefficients(sketch.size)
    least = np.full((len(sets), sketch.size), 0xFFFFFFFF, dtype=np.uint32)
    for i, s in enumerate(sets):
        short = (s >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(short), 512):
            part = short[start : start + 512]
            hashed = np.multiply.outer(part, a)
            hashed += b
            np.minimum(least[i], hashed.min(axis=0), out=least[i])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / sketch.rate
    out = np.clip(np.floor(1 - np.log(x) / np.log(sketch.base)), 0, 65535).astype("<u2")
    out[[not len(s) for s in sets]] = 0
    return out


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, base: float) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sets of known sizes from their registers."""
    above, below = (left > right).sum(axis=1), (left < right).sum(axis=1)
    equal = left.shape[1] - above - below
    u = n_left / (n_left + n_right)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, None) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return above * np.log(more) + below * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-12, None))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        rising = likelihood(a) < likelihood(b)
        lo, hi = np.where(rising, a, lo), np.where(rising, hi, b)
    return (lo + hi) / 2


def similar(common: int | np.ndarray, n_left, n_right, percent: int):
    """Whether a share of ``percent`` of the union, or more, is common."""
    return 100 * common >= percent * (n_left + n_right - common)


def _sketches(k: int, sketch: Sketch):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            regs = registers(sets, sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "n_shingles", "print", "registers"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            sets = [shingles(t, k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def _plausible(percent: int, sketch: Sketch):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, sketch.size) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            keep = estimate(left, right, na, nb, sketch.base) >= percent / 100 - sketch.margin
            keep &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _forest(left: np.ndarray, right: np.ndarray, links: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Links (by component) that connect all that ``links`` connects and ``parent`` does not yet, one less than the components at most."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[b] = a
            out.append((int(left[i]), int(right[j])))
    return out


def compared_blocks(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components among the documents of two blocks (or in one)."""
    low, high = rows["lo"].iloc[0], rows["hi"].iloc[0]
    first, second = rows[rows["block"] == low], rows[rows["block"] == high]
    sides = []
    for side in (first, second):
        sets = [np.frombuffer(s, np.uint64) for s in side["shingles"]]
        sides.append((sets, np.array([len(s) for s in sets]), side["component"].to_numpy()))
    (a, na, ca), (b, nb, cb) = sides
    if not len(na) or not len(nb):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    values, inverse = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)])
    left = np.arange(len(inverse)) < na.sum()
    both = np.flatnonzero(np.bincount(inverse[left], minlength=len(values)).astype(bool) & np.bincount(inverse[~left], minlength=len(values)).astype(bool))
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], both)
    ends = np.searchsorted(inverse[order], both, side="right")
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    for start in range(0, len(both), 512):  # a strip of shingles at a time
        strip = slice(start, start + 512)
        counts = ends[strip] - starts[strip]
        where = np.concatenate([order[s:e] for s, e in zip(starts[strip], ends[strip], strict=True)])
        column = np.repeat(np.arange(len(counts)), counts)
        mine = left[where]
        x, y = np.zeros((len(a), len(counts)), dtype=np.float32), np.zeros((len(b), len(counts)), dtype=np.float32)
        x[row[where[mine]], column[mine]] = 1
        y[row[where[~mine]], column[~mine]] = 1
        common += x @ y.T
    found, parent = [], {}
    for start in range(0, len(a), 128):  # a strip of documents at a time
        strip = slice(start, start + 128)
        links = similar(common[strip].astype(np.int64), na[strip, None], nb[None, :], percent) & (ca[strip, None] != cb[None, :])
        found += _forest(ca[strip], cb, links, parent)
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def mixed_buckets(members: DataFrame, components: DataFrame) -> DataFrame:
    """(key, doc_id, component) of buckets that hold several components, without buckets of the same documents."""
    labelled = written(
        members.where("n > 2").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")),
        "labelled",
    )
    facts = labelled.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("docs"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("xor")
    )
    once = facts.where("least < most").groupBy("docs", "sum", "xor").agg(F.min("key").alias("key")).select("key", "docs")
    return looked_up(labelled, once, ["key"], "docs", "mixed-buckets").select("key", "doc_id", "component")


def dealt_blocks(docs: DataFrame, weight: Column | None, sketch: Sketch) -> DataFrame:
    """``docs`` (with key, doc_id, component) with block, lo, hi: each document of a key once for each pair of blocks it has to meet in.

    Where one block won't do, documents of the key's largest component are in blocks of their own, which meet the others' only.
    ``weight`` is a document's number of shingles, where blocks are bounded in them as well.
    """
    sizes = docs.groupBy("key", "component").agg(F.count("*").alias("n"), (F.lit(0) if weight is None else F.sum(weight)).cast("long").alias("weight"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "weight")).alias("top"), F.sum("n").alias("docs"), F.sum("weight").alias("weight"))
    needed = lambda n, w: F.greatest(F.ceil(n / F.lit(sketch.block_docs)), F.ceil(w / F.lit(sketch.block)), F.lit(1)).cast("int")
    fits = needed(c("docs"), c("weight")) == 1
    few, many = needed(c("docs") - c("top")["n"], c("weight") - c("top")["weight"]), needed(c("top")["n"], c("top")["weight"])
    blocks = tops.select("key", F.when(~fits, c("top")["component"]).alias("main"), F.when(fits, 1).otherwise(few).alias("few"), F.when(fits, 0).otherwise(many).alias("many"), "docs")
    main, at = c("component").eqNullSafe(c("main")), F.xxhash64("doc_id")
    return (
        looked_up(docs, blocks, ["key"], "docs", "bucket-blocks")
        .withColumn("block", F.when(main, c("few") + F.pmod(at, c("many"))).otherwise(F.pmod(at, c("few"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, c("few")).otherwise(c("few") + c("many")) - 1)))
        .select(*docs.columns, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    )


def agreeing(rows: pd.DataFrame, least: int, percent: int = 0) -> pd.DataFrame:
    """Documents of two blocks (or one) that have ``least`` registers or more in common with one of another component.

    ``family`` is the smallest doc_id of those that such pairs tie together here.
    Pairs whose sizes (``n_shingles``, where given) rule out ``percent`` don't count.
    """
    found = []
    low, high = rows["lo"].iloc[0], rows["hi"].iloc[0]
    sides = [rows[rows["block"] == b] for b in (low, high)]
    if all(len(side) for side in sides):
        first, second = (np.frombuffer(b"".join(side["registers"]), "<u2").reshape(len(side), -1) for side in sides)
        own, other = (side["component"].to_numpy() for side in sides)
        n_own, n_other = (side["n_shingles"].to_numpy() if "n_shingles" in rows else np.ones(len(side), np.int64) for side in sides)
        ids, place = np.unique(np.concatenate([side["doc_id"].to_numpy() for side in sides]), return_inverse=True)
        here, there = place[: len(first)], place[len(first) :]
        family = np.arange(len(ids))
        met = np.zeros(len(second), dtype=bool)
        hit = np.zeros(len(first), dtype=bool)
        # in one block, two documents of its largest component never meet
        main = pd.Series(own).mode()[0] if low == high else None
        for i in np.flatnonzero(own != main) if low == high else range(len(first)):
            some = np.flatnonzero((other != own[i]) & (100 * np.minimum(n_other, n_own[i]) >= percent * np.maximum(n_other, n_own[i])))
            near = some[np.count_nonzero(second[some] == first[i], axis=1) >= least]
            if len(near):
                hit[i] = met[near] = True
                together = np.unique(np.append(family[there[near]], family[here[i]]))
                if len(together) > 1:
                    family[np.isin(family, together)] = together[0]
        found = [side[mine].assign(family=ids[family[at[mine]]]) for side, mine, at in zip(sides, (hit, met), (here, there), strict=True)]
    columns = ["key", "doc_id", "component", "family"]
    return pd.concat(found)[columns].drop_duplicates() if found else rows.iloc[:0].assign(family=rows["doc_id"].iloc[:0])[columns]


def _across(members: DataFrame, reps: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], components: DataFrame, percent: int, sketch: Sketch) -> DataFrame | None:
    """Links between components that still share buckets; None if there are none."""
    rows = written(mixed_buckets(members, components), "mixed")
    if rows.isEmpty():
        return None
    # registers of two sets agree at least as often as the sets are similar
    least = int((percent / 100 - sketch.margin) * sketch.size)
    kinds = "key long, doc_id long, component long, family long"
    dealt = dealt_blocks(rows, None, sketch).join(reps, "doc_id")
    near = written(dealt.groupBy("key", "lo", "hi").applyInPandas(lambda r: agreeing(r, least, percent), kinds).select("doc_id", "component", "family").distinct(), "agreeing")
    if near.isEmpty():
        return None
    families = connected_components(near.select(c("family").alias("a"), c("doc_id").alias("b")))
    sets = sets_of(near, "bucket-sets")
    sized = written(
        near.select("doc_id", "component").distinct().join(families.select(c("component").alias("key"), c("node").alias("doc_id")), "doc_id").join(reps.select("doc_id", "n_shingles"), "doc_id"), "families"
    )
    compared = dealt_blocks(sized, c("n_shingles"), sketch).join(sets, "doc_id").select("key", "lo", "hi", "block", "component", "shingles")
    return written(compared.groupBy("key", "lo", "hi").applyInPandas(lambda r: compared_blocks(r, percent), "a long, b long").distinct(), "bucket-links")


def _with_chunk(work):
    """``work`` over a chunk's ids and texts, with the chunk's number beside what it gives."""

    def run(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in work(rows.select([0, 1]).to_batches()):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, chunk, np.int64))], names=[*batch.schema.names, "chunk"])

    return run


def _asked_sets(k: int):
    """Sets of the rows whose doc_id is among a chunk's notes."""

    def run(_: int, rows: pa.Table, notes: pa.Table) -> pa.Table:
        asked = rows.filter(pc.is_in(rows.column(0), pc.unique(notes.column("doc_id")).cast(rows.schema.field(0).type)))
        found = list(_sets(k)(asked.select([0, 1]).to_batches()))
        return pa.Table.from_batches(found) if found else pa.table({"doc_id": pa.array([], pa.int64()), "shingles": pa.array([], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sketch: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with arrow_rows(docs.sparkSession, _ROWS):
        return _judged(Chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts", _CHUNK), k, percent, sketch).drop("chunk")


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, sketch: Sketch = Sketch()) -> DataFrame:
    """Rows of ``docs``, with their columns, that are no copy of a document with a smaller doc_id."""
    order = [F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    with arrow_rows(docs.sparkSession, _ROWS):
        rows = Chunks(docs.select(*order), "documents", _CHUNK)
        gone = written(_judged(rows, k, percent, sketch).where("NOT kept").select("chunk", "doc_id").distinct(), "near-copies")

    def rest(_: int, own: pa.Table, notes: pa.Table) -> pa.Table:
        return own.filter(pc.invert(pc.is_in(own.column(0), pc.unique(notes.column("doc_id")))))

    return rows.met(gone, rest, rows.schema).select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))


def _judged(texts: Chunks, k: int, percent: int, sketch: Sketch) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, chunk of every row."""
    with arrow_rows(texts.home.sparkSession, 1):  # a chunk at a time
        sketched = written(texts.each(_with_chunk(_sketches(k, sketch)), "doc_id long, n_shingles long, print binary, registers binary, chunk long"), "sketches")

    def sets_of(ids: DataFrame, label: str) -> DataFrame:
        """Sets of shingles of the documents of ``ids``; their ids travel to the chunks, and only the sets leave."""
        at = sketched.select("chunk", "doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return written(texts.met(at, _asked_sets(k), "doc_id long, shingles binary"), label)

    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    reps = written(
        known.join(classes.select(F.col("print"), F.col("class_id").alias("doc_id")), ["print", "doc_id"], "left_semi").select("doc_id", "n_shingles", "registers"),
        "representatives",
    )
    width = 2 * sketch.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(sketch.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    buckets = reps.select("doc_id", F.explode(keys).alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    members = written(looked_up(buckets, shared, ["key"], "n", "buckets"), "members")
    edges = members.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()

    def side(table: DataFrame, end: str, **names: str) -> DataFrame:
        return table.select(F.col("doc_id").alias(end), *(F.col(c).alias(n) for n, c in names.items()))

    # only pairs of sizes that may be similar take registers along
    sized = edges.join(side(reps, "a", na="n_shingles"), "a").join(side(reps, "b", nb="n_shingles"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    plausible = written(
        sized.join(side(reps, "a", ra="registers"), "a").join(side(reps, "b", rb="registers"), "b").mapInArrow(_plausible(percent, sketch), "a long, b long"),
        "candidates",
    )
    wanted = plausible.select(F.col("a").alias("doc_id")).union(plausible.select("b"))
    sets = sets_of(wanted, "shingles")
    links = written(plausible.join(side(sets, "a", sa="shingles"), "a").join(side(sets, "b", sb="shingles"), "b").mapInArrow(_verified(percent), "a long, b long"), "links")
    components = connected_components(links)
    more = _across(members, reps, sets_of, components, percent, sketch)
    if more is not None:
        components = connected_components(more.unionByName(components.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    facts = classes.join(components.withColumnRenamed("node", "class_id"), "class_id", "left").select("print", "copies", F.coalesce("component", "class_id").alias("component_id"))
    judged = looked_up(known.select("doc_id", "n_shingles", "chunk", "print"), facts, ["print"], "copies", "class-components")
    alone = sketched.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "chunk"]
    return judged.select(*columns).unionByName(alone.select(*columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "chunk")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT c.a, c.b FROM c JOIN n p ON c.a = p.doc_id JOIN n q ON c.b = q.doc_id WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)
), reach AS (
  SELECT doc_id AS start, doc_id AS node FROM n
  UNION
  SELECT r.start, l.b FROM reach r JOIN links l ON r.node = l.a
), m AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start)
SELECT w.doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.start = w.doc_id
"""
