"""Removal of repeated passages by a sparse suffix array with deep-shallow sorting.

A byte goes if a string of ``match`` bytes covers it that also starts in a
document with a smaller doc_id.  Every such string holds an anchor: the start of
the smallest hash among its grams of GRAM bytes, which equal strings have at the
same place.  So only suffixes that start at anchors (one byte of fourteen) are
sorted, each with the bytes before it:

1. Documents are gathered into chunks of about CHUNK bytes, written once.
2. Chunks send their anchors' gram hashes, Golomb coded, to owners, which answer
   with two bitmaps: grams that other chunks hold too, and hot grams.
3. Suffixes of repeated grams are dealt by gram into buckets.  A bucket sorts them,
   and the reversed bytes before them, by multikey quicksort on words of eight bytes
   to a shallow depth; groups with a longer common prefix are ordered by blind tries.
   Two anchors share a string that starts o bytes before them if their common
   prefixes are at least match - o bytes on the right and o on the left, which the
   sorted orders' LCP arrays tell; the smallest doc_id of each such class goes back.
4. Chunks mark what the answers cover.

Suffixes of a hot gram, which many documents hold with different neighbours, would
meet in one bucket; they are dealt by the whole string instead, once a chunk and
packed for its bucket, and the chunk's suffixes learn the smallest doc_id by the
string's name.  Equal suffixes travel once a chunk.

Texts are UTF-8 bytes; null counts as empty.  Strings are judged on the input and
don't cross documents.  A null doc_id is smaller than any other; rows that share a
doc_id take nothing from each other.  An empty table gives an empty result; further
columns are not looked at.  What is left may be no valid UTF-8, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, written
from .exact_dedup import FINGERPRINT_BITS, golomb_decode, golomb_encode

#: Bytes of a gram, and of a removed string.
GRAM, MATCH = 24, 50
#: Bytes of a chunk (a longer document is one by itself), and bytes that are looked at together.
CHUNK, SLICE = 8 << 20, 1 << 17
#: Fingerprints of an owner and suffixes of a bucket, about; suffixes beyond which a gram is hot.
OWNER_ROWS, BUCKET_ROWS, HOT = 500_000, 50_000, 4096
#: Words of eight bytes that the quicksort looks at before tries take over.
SHALLOW = 4
#: Hot suffixes whose strings are looked at together, and of a bucket of strings, about.
HOT_SLICE = 4096
NO_ID = np.iinfo(np.int64).min


def words_at_all(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; the last seven bytes have none."""
    out = np.empty(max(0, len(raw) - 7), np.uint64)
    for r in range(min(8, len(out))):
        out[r::8] = np.frombuffer(raw, np.uint64, count=(len(raw) - r) // 8, offset=r)
    return out


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sliding(v: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        v, span = least(v[:-span], v[span:]), span * 2
    return least(v[: -(width - span)], v[width - span :]) if span < width else v


@dataclass
class Anchors:
    """Places of anchors in a chunk, hashes of their grams, bytes before and from the place on that their strings cover, and their documents."""

    at: np.ndarray
    gram: np.ndarray
    left: np.ndarray
    right: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def anchors(raw: np.ndarray, lengths: np.ndarray, match: int = MATCH) -> Anchors:
    """Anchors of all strings of ``match`` bytes of the documents that lie in ``raw`` one after the other.

    ``key`` is a hash of all that an anchor's strings cover.
    """
    windows = match - GRAM + 1
    starts = np.cumsum(lengths) - lengths
    size = int(lengths.sum())
    # windows must lie in one document
    inside = np.zeros(size + 1, np.int8)
    some = lengths >= match
    inside[starts[some]] += 1
    inside[(starts + lengths)[some] - match + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    padded = np.concatenate([np.zeros(windows, np.uint8), raw[:size], np.zeros(match + windows + 8, np.uint8)])
    found = []
    for low in range(0, size, SLICE):
        high = min(size, low + SLICE)
        # places low - windows + 1 to high + windows - 1 decide about anchors from low to high
        part = np.ascontiguousarray(padded[low : high + 2 * windows + match + 8])
        words = words_at_all(part)
        n = high - low + 2 * windows
        h = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
        for k in range(0, GRAM, 8):
            h = _mixed(h, words[k : k + n])
        h |= np.uint64(1)
        least = _sliding(h, windows, np.minimum)
        whole = np.zeros(len(least), bool)
        a, b = max(0, low - windows), min(size, low - windows + len(least))
        whole[a - low + windows : b - low + windows] = inside[a:b]
        least[~whole] = 0
        top = _sliding(least, windows, np.maximum)  # of the windows that end at place windows - 1 and on
        own = np.flatnonzero(top[1 : 1 + high - low] == h[windows : windows + high - low]) + windows
        spread = np.stack([least[own - o] == h[own] for o in range(windows)]) if len(own) else np.zeros((windows, 0), bool)
        near, count = spread.argmax(axis=0), spread.sum(axis=0)  # the windows of an anchor follow each other
        far = near + count - 1
        key = np.zeros(len(own), np.uint64)
        for o in (far, near):
            for k in [*range(0, match - 8, 8), match - 8]:
                key = _mixed(key, words[own - o + k])
        key = _mixed(key, (far * match + near).astype(np.uint64))
        found.append((own + (low - windows), h[own], far, match - near, key))
    at, gram, left, right, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    return Anchors(at, gram, left, right, key, np.searchsorted(starts, at, side="right") - 1 if len(at) else at)


def contexts(raw: np.ndarray, a: Anchors, which: np.ndarray, match: int = MATCH) -> np.ndarray:
    """For each anchor the bytes before and from its place on, zero beyond what its strings cover."""
    before = match - GRAM
    padded = np.concatenate([np.zeros(before, np.uint8), raw, np.zeros(match, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, before + match)[a.at[which]]
    kept_left = np.arange(-before, 0) >= -np.arange(before + 1)[:, None]
    kept_right = np.arange(match) < np.arange(match + 1)[:, None]
    rows[:, :before] *= kept_left[a.left[which]]
    rows[:, before:] *= kept_right[a.right[which]]
    return rows


def distinct(raw: np.ndarray, a: Anchors, match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """First anchor of each distinct covered text, and the number of each anchor's."""
    _, first, inverse = np.unique(a.key, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    again = np.flatnonzero(first[inverse] != np.arange(len(inverse)))
    before, padded = match - GRAM, np.concatenate([np.zeros(match - GRAM, np.uint8), raw, np.zeros(match, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, before + match)
    odd = []
    for part in np.array_split(again, 1 + len(again) // 20_000):
        to = first[inverse[part]]
        # the covered part of both must be the same bytes
        alike = np.flatnonzero((a.left[part] == a.left[to]) & (a.right[part] == a.right[to]))
        x, y = part[alike], to[alike]
        differ = around[a.at[x]] != around[a.at[y]]
        # of the differences the nearest on either side must lie beyond what is covered
        right = np.where(differ[:, before:].any(axis=1), differ[:, before:].argmax(axis=1), match) < a.right[x]
        left = np.where(differ[:, :before].any(axis=1), differ[:, :before][:, ::-1].argmax(axis=1), before) < a.left[x]
        apart = np.ones(len(part), bool)
        apart[alike] = left | right
        odd.append(part[apart])
    odd = np.concatenate(odd)  # texts that only share their hash stand for themselves
    inverse[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), inverse


def shallow_order(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words by multikey quicksort, ``depth`` words deep, and starts of the groups that are equal so far.

    All segments are split at once, each by its own pivot; the equal part goes on
    with the next word.
    """
    lead = (words[:, 0] >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(lead, kind="stable")  # by the first two bytes
    begin = np.flatnonzero(np.r_[True, np.diff(lead[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(order)] if len(order) else begin
    level = np.zeros(len(begin), np.int64)
    done = []
    while len(begin):
        idle = (end - begin < 2) | (level >= depth)
        done.append(begin[idle])
        begin, end, level = begin[~idle], end[~idle], level[~idle]
        if not len(begin):
            break
        size = end - begin
        seg = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(seg)) + np.repeat(begin - first, size)
        rows = order[place]
        word = words[rows, level[seg]]
        three = np.stack([word[first], word[first + size // 2], word[first + size - 1]])
        pivot = np.repeat(np.sort(three, axis=0)[1], size)
        kind = (word > pivot).astype(np.int8) - (word < pivot).astype(np.int8) + 1
        count = np.bincount(seg * 3 + kind, minlength=3 * len(size)).reshape(-1, 3)
        edge = begin[:, None] + np.cumsum(count, axis=1) - count
        for k in range(3):
            mine = kind == k
            rank = np.arange(int(mine.sum())) - np.repeat(np.cumsum(count[:, k]) - count[:, k], count[:, k])
            order[edge[seg[mine], k] + rank] = rows[mine]
        some = count.ravel() > 0
        begin, end = edge.ravel()[some], (edge + count).ravel()[some]
        level = (level[:, None] + np.array([0, 1, 0])).ravel()[some]
    return order, np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)


class BlindTrie:
    """A trie of the places where keys differ; it orders keys by one comparison each."""

    def __init__(self, keys: list[int]):
        self.keys = keys
        self.bit: list[int] = []
        self.child: list[list[int]] = []
        self.same: dict[int, list[int]] = {}
        self.root = ~0
        for i in range(1, len(keys)):
            self._add(i)

    def _add(self, i: int) -> None:
        key, bit, child, node = self.keys[i], self.bit, self.child, self.root
        while node >= 0:  # blindly, bits between are not looked at
            node = child[node][key >> bit[node] & 1]
        differ = key ^ self.keys[~node]
        if not differ:
            self.same.setdefault(~node, []).append(i)
            return
        at = differ.bit_length() - 1
        above, node = None, self.root
        while node >= 0 and bit[node] > at:
            above = node, key >> bit[node] & 1
            node = child[node][above[1]]
        new = len(bit)
        bit.append(at)
        child.append([node, ~i] if key >> at & 1 else [~i, node])
        if above is None:
            self.root = new
        else:
            child[above[0]][above[1]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node < 0:
                out += [~node, *self.same.get(~node, ())]
            else:
                stack += [self.child[node][1], self.child[node][0]]
        return out


def deep_shallow_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows of one width: quicksort to SHALLOW words, then blind tries."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, starts = shallow_order(words, min(SHALLOW, words.shape[1]))
    if words.shape[1] > SHALLOW:
        sizes = np.diff(np.r_[starts, n])
        tails = np.ascontiguousarray(padded[:, SHALLOW * 8 :])
        for begin, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            group = order[begin : begin + size]
            keys = [int.from_bytes(tails[i], "big") for i in group.tolist()]
            order[begin : begin + size] = group[BlindTrie(keys).order()]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each row in order with the one before it; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for part in np.array_split(np.arange(1, len(order)), 1 + len(order) // 50_000):
        differ = rows[order[part]] != rows[order[part - 1]]
        out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def first_documents(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, match: int = MATCH) -> np.ndarray:
    """For each suffix and o, the smallest doc_id with the string that starts o bytes before the anchor; its own where it has none."""
    before = match - GRAM
    order_r = deep_shallow_order(context[:, before:])
    lcp_r = common_prefixes(context[:, before:], order_r)
    back = np.ascontiguousarray(context[:, :before][:, ::-1])
    order_l = deep_shallow_order(back)
    lcp_l = common_prefixes(back, order_l)
    least = np.repeat(doc[:, None], before + 1, axis=1)
    by_doc = np.argsort(doc, kind="stable")
    class_r, class_l = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    for o in range(before + 1):
        class_r[order_r] = np.cumsum(lcp_r < match - o)
        class_l[order_l] = np.cumsum(lcp_l < o)
        rows = by_doc[(left >= o)[by_doc] & (right >= match - o)[by_doc]]
        code, names = pd.factorize(class_r[rows] * (len(doc) + 1) + class_l[rows])
        head = np.empty(len(names), np.int64)
        head[code[::-1]] = rows[::-1]  # the first of each class has the smallest doc_id
        least[rows, o] = doc[head[code]]
    return least


# Spark's side.

_CHUNK = "chunk long, n_bytes long, ids binary, lengths binary, raw binary"
_ANSWER = "chunk long, owner int, n_seen long, n_hot long, seen binary, hot binary"
_SUFFIXES = "bucket long, chunk long, n int, at binary, left binary, right binary, doc binary, context binary"
_REPLY = "chunk long, at binary, low binary, high binary, least binary"
_STRINGS = "bucket long, chunk long, name binary, doc binary, last binary, string binary, at binary, o binary"
_SHARED = "chunk long, name binary, least binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _schema(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _arrow(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _chunks(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0

        def row():
            lengths = np.array([len(t) for t in texts], np.int64)
            return _arrow([(0, total, np.array(ids, np.int64).tobytes(), lengths.tobytes(), b"".join(texts))], _CHUNK).drop_columns("chunk").to_batches()[0]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if texts and total + len(text) > size:
                    yield row()
                    ids, texts, total = [], [], 0
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                total += len(text)
        if texts:
            yield row()

    return run


def _opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["raw"], np.uint8), np.frombuffer(r["lengths"], np.int64), np.frombuffer(r["ids"], np.int64)


def _width(owners: int) -> int:
    return -(-(1 << FINGERPRINT_BITS) // owners)


def _prints(a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of grams, and the place of each anchor's."""
    values, place = np.unique((a.gram >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.int64), return_inverse=True)
    return values, place.ravel()


def _messages(owners: int, match: int):
    """One message to each owner: the chunk's fingerprints there and the number of its suffixes of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                raw, lengths, _ = _opened(r)
                a = anchors(raw, lengths, match)
                first, _ = distinct(raw, a, match)
                values, place = _prints(a)
                count = np.bincount(place[first], minlength=len(values)).astype(np.int32)
                bounds = np.searchsorted(values // _width(owners), np.arange(owners + 1))
                out = []
                for o in np.flatnonzero(np.diff(bounds)).tolist():
                    x, y = bounds[o], bounds[o + 1]
                    k, unary, rest = golomb_encode(values[x:y] - o * _width(owners))
                    out.append((r["chunk"], o, y - x, k, unary, rest, pa.compress(count[x:y].tobytes(), "zstd", asbytes=True)))
                if out:
                    yield from _arrow(out, "chunk long, owner int, n long, rice_bits int, unary binary, rest binary, counts binary").to_batches()

    return run


def _answers(hot: int):
    def run(m: pd.DataFrame) -> pd.DataFrame:
        prints = [golomb_decode(n, k, u, r) for n, k, u, r in zip(m["n"], m["rice_bits"], m["unary"], m["rest"], strict=True)]
        counts = [np.frombuffer(pa.decompress(c, int(n) * 4, "zstd", asbytes=True), np.int32) for c, n in zip(m["counts"], m["n"], strict=True)]
        values, place, chunks = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        many = np.bincount(place.ravel(), np.concatenate(counts).astype(np.float64)) > hot
        cuts = np.cumsum([len(p) for p in prints])[:-1]
        places = np.split(place.ravel(), cuts)
        return pd.DataFrame({
            "chunk": m["chunk"], "owner": m["owner"], "n_seen": [int((chunks[p] > 1).sum()) for p in places], "n_hot": [int(c[many[p]].sum()) for p, c in zip(places, counts, strict=True)],
            "seen": [np.packbits(chunks[p] > 1).tobytes() for p in places], "hot": [np.packbits(many[p]).tobytes() for p in places],
        })

    return run


def _suspects(r: dict, answers: pa.Table, owners: int, match: int):
    """Of a chunk: raw, anchors, first anchors of the suspect texts, whether they are hot, and the smallest doc_id of each."""
    raw, lengths, ids = _opened(r)
    a = anchors(raw, lengths, match)
    first, inverse = distinct(raw, a, match)
    values, place = _prints(a)
    bounds = np.searchsorted(values // _width(owners), np.arange(owners + 1))
    seen, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for row in answers.to_pylist():
        x, y = bounds[row["owner"]], bounds[row["owner"] + 1]
        for bits, name in ((seen, "seen"), (hot, "hot")):
            bits[x:y] = np.unpackbits(np.frombuffer(row[name], np.uint8))[: y - x]
    doc = ids[a.doc]
    if len(values):
        order = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[order], np.arange(len(values)))
        seen |= np.minimum.reduceat(doc[order], edge) != np.maximum.reduceat(doc[order], edge)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, doc)
    some = seen[place[first]]
    return raw, a, first[some], hot[place[first[some]]], least[some]


def _cold(owners: int, buckets: int, match: int):
    """Suffixes of grams that are not hot, for their buckets."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in own.to_pylist():
            raw, a, first, hot, least = _suspects(r, answers, owners, match)
            first, least = first[~hot], least[~hot]
            bucket = (a.gram[first] >> np.uint64(1)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                f = first[part]
                context = pa.compress(contexts(raw, a, f, match).tobytes(), "zstd", asbytes=True)
                out.append((int(bucket[part[0]]), r["chunk"], len(f), a.at[f].tobytes(), a.left[f].astype(np.uint16).tobytes(), a.right[f].astype(np.uint16).tobytes(), least[part].tobytes(), context))
        return _arrow(out, _SUFFIXES)

    return run


def _replies(chunk: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> pd.DataFrame:
    """A row a chunk."""
    order = np.argsort(chunk, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else ():
        rows.append((int(chunk[part[0]]), at[part].astype(np.int64).tobytes(), low[part].astype(np.uint16).tobytes(), high[part].astype(np.uint16).tobytes(), least[part].astype(np.int64).tobytes()))
    return pd.DataFrame(rows, columns=_schema(_REPLY))


def _sorted_buckets(match: int):
    def run(m: pd.DataFrame) -> pd.DataFrame:
        of = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in m[name]])
        width = 2 * match - GRAM
        context = np.concatenate([np.frombuffer(pa.decompress(c, int(n) * width, "zstd", asbytes=True), np.uint8).reshape(-1, width) for c, n in zip(m["context"], m["n"], strict=True)])
        left, right, doc = of("left", np.uint16).astype(np.int64), of("right", np.uint16).astype(np.int64), of("doc", np.int64)
        least = first_documents(context, left, right, doc, match)
        # runs of o with one answer
        earlier = least < doc[:, None]
        begins = earlier & np.c_[np.ones(len(doc), bool), (least[:, 1:] != least[:, :-1]) | ~earlier[:, :-1]]
        ends = earlier & np.c_[(least[:, 1:] != least[:, :-1]) | ~earlier[:, 1:], np.ones(len(doc), bool)]
        row, low = np.nonzero(begins)
        _, high = np.nonzero(ends)
        chunk = np.repeat(m["chunk"].to_numpy(), m["n"].to_numpy())
        return _replies(chunk[row], of("at", np.int64)[row], low, high, least[row, low])

    return run


def _equal_strings(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct string (a row of bytes), and the number of each row's."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    words[:, : text.shape[1]] = text
    words = words.view(np.uint64)
    h = np.zeros(len(text), np.uint64)
    for k in range(words.shape[1]):
        h = _mixed(h, words[:, k])
    number, names = pd.factorize(h)
    first = np.empty(len(names), np.int64)
    first[number[::-1]] = np.arange(len(h))[::-1]
    odd = np.flatnonzero((words != words[first[number]]).any(axis=1))  # strings that only share their hash stand for themselves
    if len(odd):
        own, again = np.unique(text[odd], axis=0, return_index=True, return_inverse=True)[1:]
        number[odd] = len(first) + again.ravel()
        first = np.concatenate([first, odd[own]])
    return first, number


def _bucket_of(text: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(text), np.uint64)
    for k in range(0, text.shape[1] - 7, 8):
        h = _mixed(h, np.ascontiguousarray(text[:, k : k + 8]).view(np.uint64).ravel())
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _hot_strings(owners: int, buckets: int, match: int):
    """Distinct strings of a chunk's hot suffixes, packed for their buckets, and (bucket -1) which suffixes hold them."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        out, named = [], 0
        pack = lambda *columns: [pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) for x in columns]
        for r in own.to_pylist():
            raw, a, first, hot, least = _suspects(r, answers, owners, match)
            first, least = first[hot], least[hot]
            order = np.argsort(a.gram[first], kind="stable")  # equal strings lie side by side, whatever the slices
            for start in range(0, len(order), HOT_SLICE):
                part = order[start : start + HOT_SLICE]
                f = first[part]
                low = match - a.right[f]
                count = np.maximum(a.left[f] + 1 - low, 0)
                o = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
                at, doc = np.repeat(a.at[f], count), np.repeat(least[part], count)
                text = np.lib.stride_tricks.sliding_window_view(raw, match)[at - o] if len(at) else np.zeros((0, match), np.uint8)
                one, number = _equal_strings(text)
                lowest, highest = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), NO_ID)
                np.minimum.at(lowest, number, doc)
                np.maximum.at(highest, number, doc)
                name = named + np.arange(len(one))
                out.append((-1, r["chunk"], *pack(named + number, doc), None, None, *pack(at, o)))
                bucket = _bucket_of(text[one], buckets)
                dealt = np.argsort(bucket, kind="stable")
                for mine in np.split(dealt, np.flatnonzero(np.diff(bucket[dealt])) + 1) if len(dealt) else ():
                    out.append((int(bucket[mine[0]]), r["chunk"], *pack(name[mine], lowest[mine], highest[mine], text[one[mine]]), None, None))
                named += len(one)
        return _arrow(out, _STRINGS)

    return run


def _unpacked(parts: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(pa.CompressedInputStream(pa.BufferReader(x), "zstd").read(), np.int64) for x in parts]


def _shared_strings(match: int):
    """The smallest doc_id of each string of a bucket, for the chunks that hold it in a larger one."""

    def run(m: pd.DataFrame) -> pd.DataFrame:
        names = _unpacked(m["name"])
        text = np.concatenate([np.frombuffer(pa.decompress(t, len(n) * match, "zstd", asbytes=True), np.uint8).reshape(-1, match) for t, n in zip(m["string"], names, strict=True)])
        doc, last = np.concatenate(_unpacked(m["doc"])), np.concatenate(_unpacked(m["last"]))
        one, number = _equal_strings(text)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, number, doc)
        least = least[number]
        chunk, name = np.repeat(m["chunk"].to_numpy(), [len(n) for n in names]), np.concatenate(names)
        some = np.flatnonzero(least < last)
        some = some[np.argsort(chunk[some], kind="stable")]
        parts = np.split(some, np.flatnonzero(np.diff(chunk[some])) + 1) if len(some) else ()
        return pd.DataFrame([(int(chunk[p[0]]), name[p].tobytes(), least[p].tobytes()) for p in parts], columns=_schema(_SHARED))

    return run


def _told(members: pa.Table, shared: pa.Table) -> pa.Table:
    """Replies to a chunk's hot suffixes: runs of strings with one smallest doc_id."""
    out = []
    if members.num_rows and shared.num_rows:
        told = [(np.frombuffer(n, np.int64), np.frombuffer(x, np.int64)) for n, x in zip(shared.column("name").to_pylist(), shared.column("least").to_pylist(), strict=True)]
        names, found = (np.concatenate(x) for x in zip(*told, strict=True))
        least = np.full(int(names.max()) + 1, np.iinfo(np.int64).max)
        least[names] = found
        for r in members.to_pylist():
            name, doc, at, o = _unpacked(r[x] for x in ("name", "doc", "at", "o"))
            known = name < len(least)
            name, doc, at, o = name[known], doc[known], at[known], o[known]
            earlier = least[name] < doc
            at, o, value = at[earlier], o[earlier], least[name[earlier]]
            if len(at):  # o runs upwards for each suffix
                fresh = np.r_[True, (at[1:] != at[:-1]) | (o[1:] != o[:-1] + 1) | (value[1:] != value[:-1])]
                begin = np.flatnonzero(fresh)
                end = np.r_[begin[1:], len(at)] - 1
                out.append((r["chunk"], at[begin].tobytes(), o[begin].astype(np.uint16).tobytes(), o[end].astype(np.uint16).tobytes(), value[begin].tobytes()))
    return _arrow(out, _REPLY)


def _covered(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    change = np.zeros(size + 1, np.int8)
    if len(start):
        order = np.argsort(start)
        start, end = start[order], np.maximum.accumulate(end[order])
        fresh = start[1:] > end[:-1]  # ranges that meet are one
        change[start[np.r_[True, fresh]]] += 1
        change[end[np.r_[fresh, True]]] -= 1
    return np.cumsum(change[:-1], dtype=np.int8).astype(bool)


def _cut(match: int):
    """The documents of a chunk without what the replies cover."""

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for r in own.to_pylist():
            raw, lengths, ids = _opened(r)
            a = anchors(raw, lengths, match)
            first, inverse = distinct(raw, a, match)
            doc = ids[a.doc]
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, doc)
            here = np.flatnonzero(least[inverse] < doc)
            place, low, high = [a.at[here]], [match - a.right[here]], [a.left[here]]
            if replies.num_rows:
                of = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in replies.column(name).to_pylist()]).astype(np.int64)
                text = np.empty(int(a.at.max()) + 1 if len(a.at) else 0, np.int64)
                text[a.at] = inverse
                mine = text[of("at", np.int64)]
                order = np.argsort(mine, kind="stable")
                mine, low_r, high_r, least_r = mine[order], of("low", np.uint16)[order], of("high", np.uint16)[order], of("least", np.int64)[order]
                begin, end = np.searchsorted(mine, inverse), np.searchsorted(mine, inverse, side="right")
                count = end - begin
                anchor = np.repeat(np.arange(len(inverse)), count)
                reply = np.arange(len(anchor)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
                real = least_r[reply] < doc[anchor]
                place.append(a.at[anchor[real]])
                low.append(low_r[reply[real]])
                high.append(high_r[reply[real]])
            place, low, high = map(np.concatenate, (place, low, high))
            gone = _covered(place - high, place - low + match, len(raw))
            start = 0
            for doc_id, length in zip(ids.tolist(), lengths.tolist(), strict=True):
                mask = gone[start : start + length]
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                text = raw[start : start + length]
                out.append((None if doc_id == NO_ID else doc_id, length, int(mask.sum()), spans, (text[~mask] if spans else text).tobytes()))
                start += length
        return _arrow(out, _RESULT)

    return run


def suffix_dedup(docs: DataFrame, match: int = MATCH, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) of every row.

    ``match`` is GRAM + 8 at least.
    """
    if match < GRAM + 8:
        raise ValueError(f"match must be {GRAM + 8} at least")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col("doc_id").cast("long"), "text")
    gathered = given.mapInArrow(_chunks(chunk), _CHUNK.removeprefix("chunk long, ")).withColumn("chunk", F.monotonically_increasing_id())
    home = bucketed(gathered.select(*_schema(_CHUNK)), "text-chunks", ["chunk"], parts)
    total = home.agg(F.sum("n_bytes")).first()[0] or 0
    owners = max(16, -(-total // (14 * OWNER_ROWS)))
    messages = home.mapInArrow(_messages(owners, match), "chunk long, owner int, n long, rice_bits int, unary binary, rest binary, counts binary")
    answers = written(messages.groupBy("owner").applyInPandas(_answers(hot), _ANSWER), "gram-answers")
    repeated, many = answers.agg(F.sum("n_seen"), F.sum("n_hot")).first()
    buckets = max(parts, -(-(repeated or 0) // BUCKET_ROWS))
    asked = lambda work, ddl: home.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, ddl)
    replies = asked(_cold(owners, buckets, match), _SUFFIXES).groupBy("bucket").applyInPandas(_sorted_buckets(match), _REPLY)
    if many:
        wide = max(parts, -(-many // HOT_SLICE))
        strings = written(asked(_hot_strings(owners, wide, match), _STRINGS), "hot-strings")
        shared = strings.where("bucket >= 0").groupBy("bucket").applyInPandas(_shared_strings(match), _SHARED)
        members = strings.where("bucket < 0").select("chunk", "name", "doc", "at", "o")
        replies = replies.unionByName(members.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_told, _REPLY))
    return home.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_cut(match), _RESULT)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, at, substr(h, 2 * at + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS at FROM d) x),
w AS (SELECT doc_id, at + s AS s, substr(h, 2 * s + 1, 100) AS k FROM (SELECT doc_id, at, h, unnest(range(0, greatest(0, least(500, length(h) // 2 - 49)))) AS s FROM c) x),
f AS (SELECT w.doc_id, w.s FROM w JOIN (SELECT k, min(doc_id) AS least FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)) m ON w.k = m.k AND m.least < w.doc_id),
e AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS fresh FROM f),
r AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM e) x GROUP BY doc_id, g),
p AS (SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS before FROM r JOIN d ON d.doc_id = r.doc_id),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) AS heads, max(b) AS last FROM p GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(heads, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
