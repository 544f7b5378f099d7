"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without the characters 0x20 and 0x09-0x0D at its ends
and with A-Z lower-cased.  Keys of ``min_chars`` code points or more that
``min_docs`` documents or more hold lose all their lines, except in the largest
doc_id that holds them.

``LineRuns`` keeps what is known of line keys as sorted runs in levels, each dealt
into the same buckets by hash and sorted in them.  No key is in two runs.  A new
batch is grouped once and then merge-joined with the runs, bucket by bucket, without
moving or sorting them: the keys that no run has (the anti-join) enter as the batch's
own run; the others wait as updates of the run that holds them.  ``fanout`` runs of a
level are compacted into one run of the next, bucket by bucket as well, and take
their updates in.  What is known of a key is the row of its one run with its updates.

Keys of many documents are looked up by broadcast after being counted, so that no
task gets all rows of one line; each other key has a bounded number of rows.

Null texts count as one empty line.  Every row is a document of its own; rows
that share a doc_id lose the same keys; a null doc_id is smaller than any other.
Keys are told apart by 96 bits of hash.  An empty table gives an empty result.
Further columns are not looked at, or are kept by ``without_repeated_lines``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bucketed, looked_up, written

#: 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\f\r"
BATCHES = 3
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


@dataclass
class Run:
    """Rows (h1, h2, n, last) of a run, and later batches' rows of its keys."""

    rows: DataFrame
    updates: list[DataFrame] = field(default_factory=list)


class LineRuns:
    """Levelled sorted runs with disjoint keys."""

    KEYS = ["h1", "h2"]

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        # as many as a grouping has partitions, so that the batch meets the runs where they are
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _stored(self, rows: DataFrame, level: int) -> DataFrame:
        before = self.spark.conf.get(_ORDERED)
        self.spark.conf.set(_ORDERED, "true")
        try:
            return bucketed(rows, f"line-run-{level}", self.KEYS, self.buckets)
        finally:
            self.spark.conf.set(_ORDERED, before)

    def held(self, batch: DataFrame) -> DataFrame:
        """The batch's rows with the number of the run that holds their key, null for those that the anti-join with all runs leaves."""
        met = batch.withColumn("run", F.lit(None).cast("int"))
        for number, run in enumerate(self.runs):
            keys = run.rows.select(*self.KEYS, F.lit(number).alias("there"))
            met = met.join(keys.hint("merge"), self.KEYS, "left").withColumn("run", F.coalesce("run", "there")).drop("there")
        return met

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n, last), grouped by key: new keys as a run, the others as updates."""
        runs = self.runs
        stored = self._stored(self.held(batch), 0)
        for number, run in enumerate(runs):
            run.updates.append(stored.where(F.col("run") == number).drop("run"))
        self._push(Run(stored.where("run IS NULL").drop("run")), 0)

    def _push(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            together, self.levels[level] = self.levels[level], []
            merged = self.current(together[0])
            for other in together[1:]:
                merged = self._stored(self.merged(merged, self.current(other)), level + 1)
            self._push(Run(merged), level + 1)

    def merged(self, one: DataFrame, other: DataFrame, how: str = "full") -> DataFrame:
        """The rows of both sides, those of one key together, by a merge join of their buckets."""
        side = lambda rows, x: rows.select(*self.KEYS, *(F.col(c).alias(f"{c}{x}") for c in ("n", "last")))
        both = side(one, 0).join(side(other, 1).hint("merge"), self.KEYS, how)
        return both.select(*self.KEYS, (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"), F.greatest("last0", "last1").alias("last"))

    def current(self, run: Run) -> DataFrame:
        """A run's rows with their updates; updates bring no keys."""
        rows = run.rows
        for update in run.updates:
            rows = self.merged(rows, update, "left")
        return rows

    def totals(self) -> DataFrame:
        """h1, h2, n (documents) and largest doc_id (last) over all batches: the runs' own rows, whose keys are disjoint."""
        parts = [self.current(run) for run in self.runs]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every


def _dropped(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """doc_id and the array of key hashes it loses, for documents that lose any."""
    keys = F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.length(k) >= min_chars)
    held = written(
        docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, _hashes))).alias("k")).select(
            "doc_id", "k.h1", "k.h2", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
        ),
        "lines",
        by="batch",
    )
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(held.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
    return (
        looked_up(held, runs.totals().where(F.col("n") >= min_docs), ["h1", "h2"], "n", "frequent-lines")
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    )


def _with_kept(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """Columns own (all of docs' columns), n_lines, n_dropped, kept_text."""
    gone = _dropped(docs.select("doc_id", "text"), min_chars, min_docs, batches).withColumnRenamed("doc_id", "gone_id")
    joined = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own")).join(gone, F.col("own.doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = _lines(F.col("own.text"))

    def stays(line: Column) -> Column:
        return (F.length(line) < min_chars) | ~F.array_contains(F.col("gone"), _hashes(_key(line)))

    return joined.select(
        "own",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, stays)).alias("kept_lines"),
        F.col("gone").isNotNull().alias("touched"),
    ).select(
        "own",
        "touched",
        "n_lines",
        (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"),
        F.when(F.col("touched"), F.array_join("kept_lines", "\n")).otherwise(F.coalesce(F.col("own.text"), F.lit(""))).alias("kept_text"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every document."""
    return _with_kept(docs.select("doc_id", "text"), min_chars, min_docs, batches).select("own.doc_id", "n_lines", "n_dropped", "kept_text")


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``docs`` with its columns and rows, repeated lines gone from ``text``; ``n_chars``, if there, follows.

    A null text stays null.
    """
    kept = _with_kept(docs, min_chars, min_docs, batches)
    text = F.when(F.col("own.text").isNotNull(), F.col("kept_text"))

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(F.col("touched"), F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(F.col("own.n_chars")).alias(name)
        return F.col("own").getField(name).alias(name)

    return kept.select(*(column(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l.line, translate(regexp_replace(l.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) l
), frequent AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.last AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
