"""What the corpus operators share: written tables, bounded broadcasts, Arrow helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.plans.scratch import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a key table (16 bytes a row or less) up to which it may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a table up to which ``looked_up`` broadcasts it, and rows of a key beyond which the key is hot.
LOOKUP_ROWS, HOT_ROWS = 100_000, 50_000

def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the folder all executors share, in a folder for each value of ``by``, and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, keys: list[str], buckets: int, order: list[str] | None = None) -> DataFrame:
    """As ``written``, dealt by the hash of ``keys`` into buckets that are sorted by them (or by ``order``).

    Joins and groupings of such tables by ``keys`` need no exchange.  Where ``df``
    comes from a grouping by ``keys``, each bucket is one file, so that they need no
    sort either while ``spark.sql.legacy.bucketedTableScan.outputOrdering`` is set.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    database = _database(spark)
    name = f"{database}.{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*(order or keys)).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
    return table


def _database(spark) -> str:
    """A database of this application, for entries that are dropped at once."""
    name = f"resonara_{re.sub(r'[^a-z0-9]', '_', spark.sparkContext.applicationId.lower())}"
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{new_folder(spark, 'catalog')}'")
    return name


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Rows of the Arrow batches that go to Python in what is written meanwhile.

    A batch is held outside the heap, in buffers that double as they grow, and once more
    in Python; 10,000 rows (Spark's default) of texts, sets or chunks are many megabytes.
    """
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)


def _bounded(keys: DataFrame, on: str) -> DataFrame:
    keys = keys.select(on).distinct()
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``.

    ``keys`` is counted first; up to BROADCAST_ROWS it is broadcast, which
    spares ``df`` a shuffle, and beyond that both sides are shuffled.
    """
    return df.join(_bounded(keys, on), on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``keys``; as ``semi_join``."""
    return df.join(_bounded(keys, on), on, "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], size: str, label: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key (64 bytes or less), of which ``size`` counts the key's rows.

    No task gets all rows of a hot key.  The table is written and counted; up to
    LOOKUP_ROWS it is broadcast.  Beyond that only its hot keys are, which the
    number of rows bounds, and the other keys, of a bounded number of rows each,
    meet in a shuffle.
    """
    table = written(table, label)
    if table.count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(table), on)
    many = max(HOT_ROWS, -(-table.agg(F.sum(size)).first()[0] // LOOKUP_ROWS))
    hot, rest = table.where(F.col(size) > many), table.where(F.col(size) <= many)
    if hot.isEmpty():
        return rows.join(rest, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def slices(batches: Iterable[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``limit`` bytes, one row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * min(1.0, limit / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordIndex(dict):
    """Word -> number in order of first sight; ``fresh`` holds those met since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at


class WordRuns:
    """For each word, by its number, a run of ids; texts become ids by looking words up."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.index = WordIndex()
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the words of each text; new words wait in ``index.fresh``."""
        get = self.index.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the fresh words, one after the other."""
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.index.fresh = []

    def spell(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of each text."""
        if not numbers:
            return []
        every = np.concatenate(numbers)
        lengths = self.length[every]
        ends = np.cumsum(lengths)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[every] - (ends - lengths), lengths)]
        cuts = np.cumsum([len(n) for n in numbers])[:-1]
        return np.split(ids, np.concatenate([[0], ends])[cuts])
