"""Packing into training sequences by vector bin packing.

An example takes room in three dimensions: tokens, segments and loss-bearing
tokens.  Sequences are filled one at a time; the next example is the one whose
demand has the largest dot product with the sequence's remaining room, both in
shares of the limits.  Where no whole example fits, the best one is cut, so that
the sequence ends full.  What can't fill a sequence at the end of a group (or
where another limit closes it early) is laid out in sequences of powers of two,
which need no padding.

A group is a bounded run of examples of one task; every group is packed on its
own, so nothing is shuffled, and a sequence is known by task and number.  Every
id lies in exactly one piece, and pieces carry their ids.

``pack_documents`` packs documents, whose every id bears loss.  ``pack_conversations``
packs instruction data: the ids of assistant turns bear loss, those of other turns
don't.  Null and empty texts still have their end id.  Repeated documents are
packed separately; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordRuns, byte_alphabet, slices

#: A group is packed when it has so many tokens or examples.
GROUP_TOKENS, GROUP_EXAMPLES = 1 << 20, 2048
#: Words whose ids a worker remembers; forgotten when full.
MEMORY = 250_000

#: Turns of a conversation that an example is made from, by number.
STRETCH = 64

_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass(frozen=True)
class Piece:
    """``length`` tokens of ``example`` from ``start`` on, at ``offset`` of ``sequence``."""

    example: int
    start: int
    length: int
    sequence: int
    offset: int


#: Tokens from a number on bear loss, or those that a running count says (one longer than the tokens).
Loss = int | np.ndarray


def pack(tokens: list[int], losses: list[Loss], limits: Limits) -> list[Piece]:
    """Pieces of examples with so many tokens."""
    out: list[Piece] = []
    sequence = 0
    room = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    start, left = [0] * len(tokens), list(tokens)

    def loss(i: int, length: int) -> int:
        """Loss-bearing ones of the next ``length`` tokens of example i."""
        own, s = losses[i], start[i]
        return max(0, s + length - max(s, own)) if isinstance(own, int) else int(own[s + length] - own[s])

    def most(i: int, length: int, loss_room: int) -> int:
        """Tokens of example i that may be taken, of at most ``length``."""
        own, s = losses[i], start[i]
        if isinstance(own, int):
            return min(length, max(0, own - s) + loss_room)
        return min(length, int(np.searchsorted(own, own[s] + loss_room, side="right")) - 1 - s)

    def close(taken: list[tuple[int, int, int]]) -> None:
        nonlocal sequence
        total = sum(t[2] for t in taken)
        queue, at = list(reversed(taken)), 0
        while total:
            width = limits.tokens if total == limits.tokens else 1 << (total.bit_length() - 1)
            total -= width
            at = 0
            while at < width:
                i, begin, length = queue.pop()
                used = min(length, width - at)
                out.append(Piece(i, begin, used, sequence, at))
                at += used
                if used < length:
                    queue.append((i, begin + used, length - used))
            sequence += 1

    demand = np.zeros((len(tokens), 3))
    open_ = np.zeros(len(tokens), dtype=bool)

    def settle(i: int) -> None:
        demand[i] = (left[i], 1, loss(i, left[i]))
        open_[i] = left[i] > 0

    for i in range(len(tokens)):
        # whole sequences of a long example need no company
        while left[i] >= limits.tokens and most(i, limits.tokens, limits.loss_tokens) == limits.tokens:
            close([(i, start[i], limits.tokens)])
            start[i] += limits.tokens
            left[i] -= limits.tokens
        settle(i)
    while open_.any():
        free, taken = room.copy(), []
        while free[0] > 0 and free[1] > 0:
            candidates = np.flatnonzero(open_)
            if not len(candidates):
                break
            need = demand[candidates]
            value = np.minimum(need, free) / room @ (free / room)
            fits = (need <= free).all(axis=1)
            if fits.any():
                i = int(candidates[np.argmax(np.where(fits, value, -1.0))])
                used = left[i]
            else:
                i = int(candidates[np.argmax(value)])
                used = most(i, min(left[i], int(free[0])), int(free[2]))
                if used == 0:
                    # the loss limit is met: only examples with a prompt left can go on
                    able = [j for j in candidates.tolist() if most(j, 1, 0)]
                    if not able:
                        break
                    i = able[0]
                    used = most(i, min(left[i], int(free[0])), int(free[2]))
            free -= (used, 1, loss(i, used))
            taken.append((i, start[i], used))
            start[i] += used
            left[i] -= used
            settle(i)
        close(taken)
    return out


class WordTokens:
    """Ids of texts by a BPE tokenizer that drops white space, lower-cases and marks word ends.

    Words of letters, with a full stop or comma behind them or not, are merged by
    one call for a whole batch; the tokenizer itself does all others.  Texts with
    characters that only Python takes for white space, or with the mark that
    stands for word ends here, go to the tokenizer as they are.
    """

    END = "\x00"
    ODD = "\x00\x1c\x1d\x1e\x1f"
    #: Letters whose lower case depends on their neighbours or isn't one letter.
    SPECIAL = "\u03a3\u0130"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t.removesuffix("</w>")) + b"\x00" * t.endswith("</w>"): i for t, i in model["vocab"].items()}
        # ids follow the order of merges, single bytes and word ends first
        ordered = all(model["vocab"]["".join(pair)] == 512 + i for i, pair in enumerate(model["merges"]))
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ordered else None
        self.ends = np.zeros(1 << 20, dtype=bool)
        self.ends[[i for t, i in ranks.items() if t.endswith(b"\x00")]] = True
        self.known = WordRuns()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _marked(self, word: str) -> str | None:
        """Lower-case pieces of a simple word with their ends marked; None for others."""
        if word.isalpha():
            stem, stop = word, ""
        elif word[-1] in ".," and word[:-1].isalpha():
            stem, stop = word[:-1], word[-1] + self.END
        else:
            return None
        if not stem.isascii():
            if any(c in stem for c in self.SPECIAL):
                return None
            stem = unicodedata.normalize("NFC", stem)
        return stem.lower() + self.END + stop

    def _learn(self) -> None:
        fresh = self.known.index.fresh
        marked = [self._marked(w) if self.merges else None for w in fresh]
        simple = np.array([m is not None for m in marked], dtype=bool)
        flat = np.array(self.merges("".join(filter(None, marked))) if simple.any() else [], dtype=np.uint32)
        others = self._ids([w for w, m in zip(fresh, marked, strict=True) if m is None])
        lengths = np.zeros(len(fresh), dtype=np.int64)
        ends = np.flatnonzero(self.ends[flat]) + 1
        pieces = np.cumsum([m.count(self.END) for m in marked if m is not None], dtype=np.int64)
        lengths[simple] = np.diff(ends[pieces - 1], prepend=0)
        lengths[~simple] = [len(i) for i in others]
        ids = np.empty(lengths.sum(), dtype=np.uint32)
        from_merges = np.repeat(simple, lengths)
        ids[from_merges] = flat
        ids[~from_merges] = [i for own in others for i in own]
        self.known.learn(ids, lengths)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        odd = {i for i, t in enumerate(texts) if any(c in t for c in self.ODD)}
        numbers = self.known.number([[] if i in odd else t.split() for i, t in enumerate(texts)])
        if self.known.index.fresh:
            self._learn()
        out = self.known.spell(numbers)
        for i in odd:
            out[i] = np.array(self._ids([texts[i]])[0], dtype=np.uint32)
        if len(self.known.index) > MEMORY:
            self.known.forget()
        return out


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for each worker and tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path)


def _packed(examples: DataFrame, schema: str, made, limits: Limits) -> DataFrame:
    """Pieces of examples; ``made`` gives keys, ids and losses of a batch's rows."""
    names = [x.split()[0] for x in f"{schema}, {_PIECE}".split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        group: list[tuple[tuple, np.ndarray, Loss]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, group, held
            sizes, losses = [len(ids) for _, ids, _ in group], [loss for *_, loss in group]
            pieces = pack(sizes, losses, limits)
            rows = []
            for p in pieces:
                key, ids, loss = group[p.example]
                end = p.start + p.length
                bearing = max(0, end - max(p.start, loss)) if isinstance(loss, int) else int(loss[end] - loss[p.start])
                rows.append((*key, p.start, p.length, ids[p.start : end].astype("<u4").tobytes(), sizes[p.example], sequence + p.sequence, p.offset, bearing))
            sequence += max(p.sequence for p in pieces) + 1
            group, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in slices(batches, 2 << 20):
            for example in made(batch):
                group.append(example)
                held += len(example[1])
                if held >= GROUP_TOKENS or len(group) >= GROUP_EXAMPLES:
                    yield flush()
        if group:
            yield flush()

    return examples.mapInArrow(run, f"{schema}, {_PIECE}")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, loss_tokens.

    Every id of a document, its end id included, bears loss.
    """
    end = np.array([end_id], dtype=np.uint32)

    def made(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, Loss]]:
        for doc_id, ids in zip(batch.column(0).to_pylist(), word_tokens(path).encode(batch.column(1).to_pylist()), strict=True):
            yield (doc_id,), np.concatenate([ids, end]), 0

    return _packed(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), "doc_id long", made, limits)


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turns): each assistant turn with the turns before it, back to the assistant turn before.

    ``turns`` is an array of (turn, role, text) in order, ``turn`` the first one's
    number.  Examples are made within stretches of ``STRETCH`` turns, so that a
    conversation of any length is many bounded groups; turns without an assistant
    turn after them in their stretch, and rows without a conv_id or a turn, are
    examples of their own.  Rows that agree in conv_id, turn, role and text are one.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    row = F.struct("turn", "role", "text")
    named = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct().withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    # from the last turn on: the number of the assistant turn that each leads to
    onward = W.partitionBy("conv_id", "stretch").orderBy(F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()).rowsBetween(W.unboundedPreceding, 0)
    after = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(onward)
    led = named.withColumn("leads", F.coalesce(after, -1 - F.col("turn"))).groupBy("conv_id", "stretch", "leads").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull() | F.col("turn").isNull()).select("conv_id", "turn", F.array(row).alias("turns"))
    return led.select("conv_id", F.col("turns")[0]["turn"].alias("turn"), "turns").unionByName(alone)


def pack_conversations(conversations: DataFrame, path: str, end_id: int = 1, limits: Limits = Limits(segments=16, loss_tokens=1024)) -> DataFrame:
    """Pieces of all examples of ``conversation_examples``: conv_id, turn (the example's first) and as ``pack_documents``.

    Each turn ends with ``end_id``; ids of assistant turns bear loss, end included.
    """
    end = np.array([end_id], dtype=np.uint32)

    def made(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, Loss]]:
        turns = batch.column(2).to_pylist()
        encoded = iter(word_tokens(path).encode([t["text"] for ts in turns for t in ts]))
        for conv_id, turn, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), turns, strict=True):
            ids = [np.concatenate([next(encoded), end]) for _ in ts]
            bears = np.concatenate([np.full(len(x), t["role"] == "assistant") for x, t in zip(ids, ts, strict=True)])
            yield (conv_id, turn), np.concatenate(ids), np.concatenate([[0], np.cumsum(bears)])

    return _packed(conversation_examples(conversations), "conv_id long, turn long", made, limits)


def cut_report(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """examples, pieces, examples that were cut, tokens."""
    by_example = pieces.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    return by_example.agg(F.count("*").alias("examples"), F.sum("n").alias("pieces"), F.count_if(F.col("n") > 1).alias("cut"), F.sum("length").alias("tokens"))
