"""Language identification by language-bitmask n-gram filters.

Each slot of a Bloom filter holds a bitmask over the languages, so that the AND
of an n-gram's slots names all languages that contain it (bit-sliced filters:
slice l is the Bloom filter of language l).  A text's hits are counted for each
language; the hit rate is corrected by the filter's false-positive rate, which
its fill determines; the largest corrected rate decides.

The filters are fitted on a bounded sample of labelled rows (about ``SAMPLE_DOCS``
a language, by hash of id and text).  They hold n-grams (4 bytes of the lower-case
text, letters and word ends) that ``MIN_DOCS`` documents of the sample or more
have, the ``GRAMS`` most frequent ones of each language at most, as far as the
language uses them at least ``CONTRAST`` times as often as the language that uses
them most.  Prediction reads whole texts, in windows of ``WINDOW`` bytes, and
nothing but the text.

``und`` with score 0 is given for null texts, texts without a letter, and all
texts where nothing was learned.  A text with letters but without known n-grams
gets the most frequent learned language with score 0.  Ties go to the language
that comes first in order of name.  Repeated rows give equal results; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Labelled documents a language that the filters are fitted on.
SAMPLE_DOCS = 1500
#: N-grams a language, the most frequent ones first.
GRAMS = 50_000
#: Least documents of the sample that hold an n-gram.
MIN_DOCS = 3
CONTRAST = 0.25
SLOT_BITS = 20
#: Bytes of text that are looked at together.
WINDOW = 2 << 20
HASHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)

#: ASCII letters stay; all other ASCII is a word's end.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Model:
    """Languages, bitmasks (slots x bytes) and the most frequent language."""

    languages: list[str]
    masks: np.ndarray
    common: str

    def false_positives(self) -> np.ndarray:
        """Rate at which each language's filter holds an n-gram it wasn't given."""
        bits = np.unpackbits(self.masks, axis=1, bitorder="little")[:, : len(self.languages)]
        return bits.mean(axis=0, dtype=np.float64) ** len(HASHES)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all valid n-grams and the text each is from, about ``WINDOW`` bytes of text at a time."""
    parts, owners, held = [], [], 0
    for i, t in enumerate(texts):
        raw = (" " + t.lower() + " ").encode().translate(_TABLE)
        # windows overlap by the three bytes that the last n-gram of one reaches into the next
        for start in range(0, max(1, len(raw) - 3), WINDOW):
            parts.append(raw[start : start + WINDOW + 3])
            owners.append(i)
            held += len(parts[-1])
            if held >= WINDOW:
                yield _grams(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield _grams(parts, owners)


def _grams(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts) + b"    ", np.uint8)
    n = len(raw) - 4
    code = raw[:n].astype(np.uint32)
    blanks = (raw == 32).astype(np.int8)
    count = blanks[:n].copy()
    for j in (1, 2, 3):
        code |= raw[j : n + j].astype(np.uint32) << np.uint32(8 * j)
        count += blanks[j : n + j]
    own = np.repeat(np.array(owners, dtype=np.int64), lengths)
    last = np.repeat(np.cumsum(lengths), lengths) - 3
    valid = (count <= 1) & (np.arange(n) < last)
    return code[valid], own[valid]


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    out = []
    for m in HASHES:
        h = codes * np.uint32(m)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append(h >> np.uint32(32 - SLOT_BITS))
    return out


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        met = [np.unique(np.stack([own, codes.astype(np.int64)]), axis=1, return_counts=True) for codes, own in _windows(batch.column(1).to_pylist())]
        if not met:
            continue
        # a text's windows come together
        pairs, place = np.unique(np.concatenate([p for p, _ in met], axis=1), axis=1, return_inverse=True)
        uses = np.bincount(place.ravel(), np.concatenate([u for _, u in met]), pairs.shape[1]).astype(np.int64)
        langs, lang_of = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        key = np.stack([lang_of[pairs[0]], pairs[1]])
        order = np.lexsort(key[::-1])
        key, uses = key[:, order], uses[order]
        first = np.flatnonzero(np.r_[True, (np.diff(key, axis=1) != 0).any(axis=0)]) if key.shape[1] else np.zeros(0, dtype=int)
        if len(first):
            docs = np.diff(np.r_[first, key.shape[1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[key[0][first]].tolist()), pa.array(key[1][first]), pa.array(docs), pa.array(np.add.reduceat(uses, first))], names=["lang", "gram", "docs", "uses"]
            )


def fit(docs: DataFrame) -> Model:
    """Filters from the rows that are not held out and have text, language and id."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << SLOT_BITS, 1), dtype=np.uint8), "und")
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, SAMPLE_DOCS / sizes[lang]))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = (
        sample.select("lang", "text").mapInArrow(_counted, "lang string, gram long, docs long, uses long")
        .groupBy("lang", "gram").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))
    )
    # bounded by the sample, and by GRAMS for each language
    grams = counts.where(F.col("docs") >= MIN_DOCS).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY uses DESC, gram)")).where(F.col("rank") <= GRAMS).toPandas()
    index = {lang: i for i, lang in enumerate(languages)}
    codes, where = np.unique(grams["gram"].to_numpy(dtype=np.int64), return_inverse=True)
    rates = np.zeros((len(codes), len(languages)))
    rates[where, grams["lang"].map(index).to_numpy(dtype=np.int64)] = grams["uses"]
    rates /= np.maximum(1, rates.sum(axis=0))
    member = (rates > 0) & (rates >= CONTRAST * rates.max(axis=1, keepdims=True)) if len(codes) else np.zeros((0, len(languages)), dtype=bool)
    masks = np.zeros((1 << SLOT_BITS, -(-len(languages) // 8)), dtype=np.uint8)
    packed = np.packbits(member, axis=1, bitorder="little")
    for slot in _slots(codes.astype(np.uint32)):
        np.bitwise_or.at(masks, slot, packed)
    return Model(languages, masks, max(languages, key=lambda x: (sizes[x], x)))


def scores(texts: list[str], model: Model, rate: np.ndarray) -> np.ndarray:
    """Corrected hit rates (texts x languages)."""
    n, hits = np.zeros(len(texts)), np.zeros((len(texts), 8 * model.masks.shape[1]))
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    for codes, own in _windows(texts):
        slots = _slots(codes)
        n += np.bincount(own, minlength=len(texts))
        first = int(own[0]) if len(own) else 0
        span = int(own[-1]) - first + 1 if len(own) else 0
        for w in range(model.masks.shape[1]):
            column = np.ascontiguousarray(model.masks[:, w])
            mask = column[slots[0]] & column[slots[1]] & column[slots[2]]
            hits[first : first + span, 8 * w : 8 * w + 8] += np.bincount((own - first) * 256 + mask, minlength=256 * span).reshape(span, 256) @ bits
    hits = hits[:, : len(model.languages)]
    return np.clip((hits / np.maximum(n, 1)[:, None] - rate) / np.maximum(1e-9, 1 - rate), 0, 1)


def predict(raw: list[str | None], model: Model, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    texts = [t or "" for t in raw]
    names = np.array([*model.languages, "und", model.common], dtype=object)
    und, common = len(model.languages), len(model.languages) + 1
    if not model.languages:
        return names[np.full(len(raw), und)], np.zeros(len(raw))
    s = scores(texts, model, rate)
    letters, hit = np.array([_has_letter(t) for t in texts]), s.max(axis=1) > 0
    best = np.where(letters, np.where(hit, s.argmax(axis=1), common), und)
    return names[best], np.where(letters & hit, s.max(axis=1) / np.maximum(1e-12, s.sum(axis=1)), 0.0)


def _predicted(shared, kept: str):
    """Rows of ``kept`` (column 0), language and score from the text (column 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rate = model.false_positives()
        for batch in slices(batches, 1 << 20):
            language, score = predict(batch.column(1).to_pylist(), model, rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language.tolist(), pa.string()), pa.array(score)], names=[kept, "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # 1 MB for every 8 languages
    predicted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predicted(shared, "doc_id"), "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with all its columns in struct ``own``, and lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    both = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own"), docs["text"].alias("text"))
    schema = both.select("own").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return both.mapInArrow(_predicted(shared, "own"), schema)
