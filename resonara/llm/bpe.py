"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece's byte positions are the leaves of a segment tree that holds, for each
node, the leftmost minimum rank of the live pairs below it.  A merge reads the
root, joins two live neighbours and updates the three leaves this concerns, each
in logarithmic time.  Short pieces are merged in lockstep, a NumPy row for each;
long ones one after the other.

``encode`` gives the ids of every whole text, split by the tokenizer's pattern,
without special tokens; null and empty texts give no ids.  Rows are independent,
so repeated rows give equal results; an empty table gives an empty result;
further columns are not looked at.

Texts are first cut before single spaces between other characters, where patterns
that join at most one space to what follows (as ``public_tokenizers.PATTERN``
does) always split.  Workers remember words and pieces of up to ``LONG`` characters,
and of ``MEMORY_BYTES`` together at most.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of pieces and words that a worker remembers; all are forgotten when full.
MEMORY_BYTES = 64 << 20
#: Characters of a word or piece that is remembered.
LONG = 64
#: What an entry of a dictionary takes beside its characters.
_ENTRY = 200
#: Pieces of at most so many bytes are merged in lockstep.
SHORT = 120

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_AT = 24
_NO_ID = (1 << 20) - 1
_SINGLE = regex.compile(r"(?<=\S) (?=\S)")


class Ranks:
    """A vocabulary of byte strings by rank, which is also the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.slots = 1 << max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(self.slots, -1, dtype=np.int64)
        self.values = np.full(self.slots, _NONE, dtype=np.uint64)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.uint64, len(pairs))
        slot = self._slot(keys)
        while len(keys):  # linear probing, all keys at once
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            lands = np.zeros(len(keys), dtype=bool)
            lands[first] = True
            lands &= free
            self.keys[slot[lands]], self.values[slot[lands]] = keys[lands], values[lands]
            keys, values, slot = keys[~lands], values[~lands], (slot[~lands] + 1) % self.slots

    @classmethod
    def from_file(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (self.slots.bit_length() - 1))).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or none."""
        keys = left << 20 | right
        out = np.full(len(keys), _NONE, dtype=np.uint64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) % self.slots
        return out


def _lockstep(pieces: list[bytes], vocab: Ranks) -> list[np.ndarray]:
    """Ids of pieces of similar length; position 0 and the one after the end are sentinels."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    size = 1 << int(lengths.max() + 1).bit_length()
    n = len(pieces)
    ids = np.full((n, size), _NO_ID, dtype=np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    ids[row, column] = vocab.bytes_ids[raw]
    after = np.tile(np.arange(1, size + 1), (n, 1))
    before = np.tile(np.arange(-1, size - 1), (n, 1))
    live = np.zeros((n, size), dtype=bool)
    live[row, column] = True
    tree = np.full((n, 2 * size), _NONE, dtype=np.uint64)

    def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        ranks = vocab.pair_ranks(ids[rows, at], ids[rows, after[rows, at]])
        return np.where(ranks == _NONE, _NONE, ranks << np.uint64(_AT) | at.astype(np.uint64))

    tree[row, size + column] = leaf(row, column)
    level = size
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    rows = np.arange(n)
    while True:
        best = tree[rows, 1]
        rows, best = rows[best != _NONE], best[best != _NONE]
        if not len(rows):
            break
        at = (best & np.uint64((1 << _AT) - 1)).astype(np.int64)
        gone = after[rows, at]
        then = after[rows, gone]
        ids[rows, at] = (best >> np.uint64(_AT)).astype(np.int64)
        after[rows, at], before[rows, then] = then, at
        live[rows, gone] = False
        prior = before[rows, at]
        tree[rows, size + gone] = _NONE
        tree[rows, size + at] = leaf(rows, at)
        tree[rows, size + prior] = leaf(rows, prior)
        who, node = np.concatenate([rows, rows, rows]), size + np.concatenate([gone, at, prior])
        while node[0] > 1:
            node = node >> 1
            tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
    flat = ids[live]
    return np.split(flat, np.cumsum(live.sum(axis=1))[:-1])


def _one(piece: bytes, vocab: Ranks) -> np.ndarray:
    """Ids of one long piece."""
    n = len(piece)
    size = 1 << max(1, n - 1).bit_length()
    # 8 bytes a number, however long the piece
    ids = array("q", vocab.bytes_ids[np.frombuffer(piece, np.uint8)].tobytes())
    ids.append(_NO_ID)
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
    none, pairs = 1 << 62, vocab.pairs

    def leaf(at: int) -> int:
        rank = pairs.get(ids[at] << 20 | ids[after[at]], -1)
        return none if rank < 0 else rank << 40 | at

    tree = array("q", [none]) * (2 * size)
    tree[size : size + n] = array("q", map(leaf, range(n)))
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] != none:
        at, rank = tree[1] & ((1 << 40) - 1), tree[1] >> 40
        gone = after[at]
        then = after[gone]
        ids[at], ids[gone], after[at] = rank, -1, then
        before[then] = at
        prior = before[at]
        tree[size + gone], tree[size + at] = none, leaf(at)
        if prior >= 0:
            tree[size + prior] = leaf(prior)
        for leaf_at in (gone, at, *([prior] if prior >= 0 else [])):
            node = (size + leaf_at) >> 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1
    return np.array([i for i in ids[:n] if i >= 0], dtype=np.int64)


def merge_pieces(pieces: list[bytes], vocab: Ranks) -> list[np.ndarray]:
    """Ids of each piece; a piece that is a token itself is not merged."""
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocab.ranks.get(piece)
        if whole is not None:
            out[i] = np.array([whole], dtype=np.int64)
        elif len(piece) > SHORT:
            out[i] = _one(piece, vocab)
        else:
            classes.setdefault((len(piece) + 1).bit_length(), []).append(i)
    for members in classes.values():
        for start in range(0, len(members), 20_000):
            block = members[start : start + 20_000]
            for i, ids in zip(block, _lockstep([pieces[j] for j in block], vocab), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; remembers the short words and pieces it has met."""

    def __init__(self, vocab: Ranks, pattern: str):
        self.vocab, self.split = vocab, regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _words(text: str) -> list[str]:
        """Parts at whose ends the pattern always splits."""
        if not text:
            return []
        first, *others = _SINGLE.split(text) if "  " in text else text.split(" ")
        return [first, *(" " + w for w in others)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parted = [self._words(t) for t in texts]
        split = {w: self.split(w) for w in {w for words in parted for w in words}.difference(self.words)}
        fresh = list({p for pieces in split.values() for p in pieces}.difference(self.pieces))
        pieces = {}
        for piece, ids in zip(fresh, merge_pieces([p.encode() for p in fresh], self.vocab), strict=True):
            pieces[piece] = ids.astype("<u4").tobytes()
        words = {word: b"".join([pieces[p] if p in pieces else self.pieces[p] for p in parts]) for word, parts in split.items()}
        for known, met in ((self.words, words), (self.pieces, pieces)):
            short = {k: v for k, v in met.items() if len(k) <= LONG}
            known.update(short)
            self.held += sum(2 * len(k) + len(v) for k, v in short.items()) + _ENTRY * len(short)
        known = self.words
        out = [b"".join([known[w] if w in known else words[w] for w in ws]) for ws in parted]
        if self.held > MEMORY_BYTES:
            self.words.clear()
            self.pieces.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(Ranks.from_file(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (bytes) of every document."""
    return _mapped(docs, path, pattern, "doc_id long, ids binary, decoded binary", lambda ids, back: (ids, back))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, digested where it is encoded."""
    return _mapped(
        docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, back: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()),
    )


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, made: Callable) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, pattern)
        for batch in slices(batches):
            encoded = tokens.encode(batch.column(1).to_pylist())
            rows = list(zip(*(made(ids, tokens.decode(ids)) for ids in encoded), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema)
