"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of bytes with two roots, for the first piece of a word
and for its continuations.  Every node has a failure link, to the node where
matching goes on when no longer match is possible, and the number of tokens that
are then complete ("popped").  A word's count follows from one walk over its
bytes, without a piece being built; each byte takes amortised constant time.

Texts are lower-cased and split at white space; letters and digits form words,
any other character is a word of its own.  A word that the vocabulary can't cover
counts as one unknown token.  Null and empty texts have no tokens.  Repeated rows
give equal results; an empty table gives an empty result; further columns are
not looked at.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_alphabet, slices

#: Words that a worker remembers; forgotten when full.
MEMORY = 250_000
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """Trie with failure links and popped-token counts over byte strings."""

    def __init__(self, first: set[bytes], rest: set[bytes]):
        self.next: dict[int, int] = {}
        accepts = bytearray(2)
        self.root, self.rest_root = 0, 1
        chars = [(-1, -1), (-1, -1)]  # parent and byte of each node
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    child = self.next.get(key)
                    if child is None:
                        child = self.next[key] = len(accepts)
                        accepts.append(0)
                        chars.append((node, byte))
                    node = child
                if piece:
                    accepts[node] = 1
        fail, popped = [-1] * len(accepts), [0] * len(accepts)
        depth = [0] * len(accepts)
        for node in range(2, len(accepts)):
            depth[node] = depth[chars[node][0]] + 1
        for node in sorted(range(2, len(accepts)), key=depth.__getitem__):
            parent, byte = chars[node]
            if accepts[node]:
                fail[node], popped[node] = self.rest_root, 1
                continue
            at, count = fail[parent], popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.next:
                count += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = self.next[at << 8 | byte], count
        self.fail, self.popped = fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match cover; 0 if there is none (or no word)."""
        node, total = self.root, 0
        follow, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            child = follow.get(node << 8 | byte)
            while child is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                child = follow.get(node << 8 | byte)
            node = child
        while node != self.rest_root:
            if node < 0 or node == self.root:
                return 0
            total += popped[node]
            node = fail[node]
        return total


def pieces_of(path: str) -> set[bytes]:
    """Byte strings of a tokenizer file's vocabulary, without its mark of word ends."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte = byte_alphabet()
    plain = (t.removesuffix("</w>") for t in vocab)
    return {bytes(to_byte[c] for c in t) for t in plain if t and all(c in to_byte for c in t)}


class Counter:
    """Counts of texts; remembers the words it has met."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.known: dict[str, tuple[int, int, int]] = {}

    def _part(self, part: str) -> tuple[int, int, int]:
        words = _WORD.findall(part)
        counts = [self.automaton.count(w.encode()) for w in words]
        return len(words), sum(c or 1 for c in counts), sum(not c for c in counts)

    def count(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown tokens."""
        known, words, tokens, unknown = self.known, 0, 0, 0
        for part in text.lower().split():
            found = known.get(part)
            if found is None:
                found = known[part] = self._part(part)
            words += found[0]
            tokens += found[1]
            unknown += found[2]
        if len(known) > MEMORY:
            known.clear()
        return words, tokens, unknown


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker and vocabulary; words begin and go on with the same pieces."""
    pieces = pieces_of(path)
    return Counter(Automaton(pieces, pieces))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches):
            counts = np.array([count(t or "") for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
