"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. A sender is a chunk: a bounded run of rows that stays where it is, texts and all
   (``chunks``).  It sends every owner, a range of the fingerprint space, its sorted
   distinct 48-bit fingerprints there, Golomb-Rice coded, and nothing else.
2. Owners decode what they got and answer each message with a bitmap of the
   fingerprints that other senders have too.
3. Bitmaps go back to the senders, which mark as suspects the rows whose bit is
   set and those that repeat within the sender.  Only suspects leave it with their
   texts; grouping by the whole normalised text verifies them byte by byte.

Groups are looked up by broadcast after being counted, so that no task gets all
rows of one text.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest doc_id stays; null ids are smaller than
any other.  Rows that repeat id and text share their decision.  An empty table
gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .common import ascii_lower, looked_up, written

FINGERPRINT_BITS = 48
#: Rows for each owner of the fingerprint space, and owners at most.
OWNER_ROWS, MOST_OWNERS = 500_000, 4096

_MESSAGE = "chunk long, owner int, n long, rice_bits int, unary binary, rest binary"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and remainders of a sorted array's gaps."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    mean = max(1.0, float(values[-1]) / len(values)) if len(values) else 1.0
    k = max(0, int(np.log2(mean)))
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
    unary[ends] = 0
    rest = (gaps[:, None] >> np.arange(k)[None, :]) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The sorted array that ``golomb_encode`` was given."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(zeros, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + (bits << np.arange(k)[None, :]).sum(axis=1))


def _digests(texts: pa.ChunkedArray) -> np.ndarray:
    """SHA-256 of each text, a row of 32 bytes."""
    raw = b"".join(hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for part in texts.chunks for t in part.cast(pa.binary()))
    return np.frombuffer(raw, np.uint8).reshape(-1, 32)


def _prints(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sender's sorted distinct fingerprints, and the place of each row's among them."""
    size = FINGERPRINT_BITS // 8
    raw = np.zeros((len(digests), 8), dtype=np.uint8)
    raw[:, 8 - size :] = digests[:, :size]
    values, place = np.unique(raw.view(">i8").ravel().astype(np.int64), return_inverse=True)
    return values, place.ravel()


def _width(owners: int) -> int:
    """Fingerprints of an owner's range."""
    return -(-(1 << FINGERPRINT_BITS) // owners)


def _shares(distinct: np.ndarray, owners: int) -> np.ndarray:
    """Bounds of the owners' shares of sorted fingerprints."""
    return np.searchsorted(distinct // _width(owners), np.arange(owners + 1))


def _messages(owners: int):
    """One message from a sender to each owner that it has fingerprints for."""

    def send(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        distinct, _ = _prints(_digests(rows.column("text")))
        bounds = _shares(distinct, owners)
        to = np.flatnonzero(np.diff(bounds))
        coded = [golomb_encode(distinct[bounds[o] : bounds[o + 1]] - o * _width(owners)) for o in to.tolist()]
        columns = [pa.array([chunk] * len(to), pa.int64()), pa.array(to, pa.int32()), pa.array(np.diff(bounds)[to], pa.int64())]
        columns += [pa.array([c[k] for c in coded], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _MESSAGE.split(", ")])

    return send


def _answers(messages: pd.DataFrame) -> pd.DataFrame:
    decoded = [golomb_decode(n, k, u, r) for n, k, u, r in zip(messages["n"], messages["rice_bits"], messages["unary"], messages["rest"], strict=True)]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(d, shared, assume_unique=True)).tobytes() for d in decoded]
    return pd.DataFrame({"chunk": messages["chunk"], "owner": messages["owner"], "bitmap": bitmaps})


def _marked(owners: int):
    """A sender's rows with ``suspect``, from the owners' bitmaps, and the texts of suspects."""

    def mark(_: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        digests = _digests(rows.column("text"))
        distinct, place = _prints(digests)
        bounds = _shares(distinct, owners)
        elsewhere = np.zeros(len(distinct), dtype=bool)
        for owner, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True):
            lo, hi = bounds[owner], bounds[owner + 1]
            elsewhere[lo:hi] = np.unpackbits(np.frombuffer(bitmap, np.uint8))[: hi - lo].astype(bool)
        here = np.bincount(place, minlength=len(distinct)) > 1
        suspect = pa.array((elsewhere | here)[place])
        text = pc.if_else(suspect, rows.column("text").combine_chunks(), pa.scalar(None, pa.string()))
        return pa.table({"doc_id": rows.column("doc_id"), "digest": pa.array([d.tobytes() for d in digests], pa.binary()), "suspect": suspect, "text": text})

    return mark


def marked_rows(texts: Chunks, owners: int) -> DataFrame:
    """doc_id, digest, whether the row may have an equal one, by the exchange of fingerprints, and then its text."""
    answers = texts.each(_messages(owners), _MESSAGE).groupBy("owner").applyInPandas(_answers, "chunk long, owner int, bitmap binary")
    return texts.met(answers, _marked(owners), "doc_id long, digest binary, suspect boolean, text string")


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    texts = Chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")), "texts")
    owners = owners or min(MOST_OWNERS, max(16, -(-(texts.home.agg(F.sum("n")).first()[0] or 0) // OWNER_ROWS)))
    marked = written(marked_rows(texts, owners), "suspects")
    suspects = marked.where("suspect")
    verified = suspects.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.any_value("digest").alias("digest"))
    groups = (
        verified.groupBy("digest")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")))
        .drop("texts")
    )
    unique = marked.where("NOT suspect").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return (
        unique.unionByName(looked_up(suspects.select("doc_id", "digest"), groups, ["digest"], "group_size", "text-groups"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
