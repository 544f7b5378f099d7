"""Incremental builds as Structured Streaming jobs.

A job's state is a table of deltas, one a micro-batch.  ``COMPACT`` deltas become a
run, ``COMPACT`` runs a run of the next level, and so on, so that a row is written
again as often as there are levels; a batch costs what it brings, not what the table
holds.  A batch that runs again writes the same delta again, or nothing if a run
holds it, so that every input counts once.  The checkpoint folder says where to go
on; a start without new input gives the table as it was.  The batches of another
checkpoint folder are numbered after all before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from resonara.operators import statistics
from resonara.plans.scratch import kept

c = F.col

#: Deltas or runs that become a run of the next level.
COMPACT = 8


class State:
    """A table as deltas and levelled runs of them; ``merged`` makes its rows from theirs, which have ``batch`` (the last of a run).

    Run ``level-number`` holds the ``COMPACT ** level`` micro-batches up to ``number``;
    a delta is a run of level 0.
    """

    def __init__(self, spark: SparkSession, path: str, merged: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.merged, self.offset = spark, path, merged, 0

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return str(path), path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        _, path, system = self._folder(name)
        return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []

    def runs(self) -> list[tuple[int, int]]:
        """(level, number) of whole runs that no larger run holds, in order of number."""
        found = sorted((tuple(map(int, n.split("-"))) for n in self._names("runs") if re.fullmatch(r"\d+-\d+", n)), reverse=True)
        whole: list[tuple[int, int]] = []
        for level, number in found:
            _, _, system = self._folder("runs")
            held = any(l > level and n - COMPACT**l < number <= n for l, n in whole)
            if not held and system.exists(self._folder(f"runs/{level}-{number}/_SUCCESS")[1]):
                whole.append((level, number))
        return sorted(whole, key=lambda x: x[1])

    def start(self, checkpoint: str, fresh: bool = False) -> bool:
        """Number the batches of a checkpoint folder after all others, or begin anew; whether the folder is new."""
        _, path, system = self._folder("")
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
        if fresh:
            system.delete(path, True)
            own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
        key = f"from/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
        new = not own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(own)
        said = self._names(key)
        if new or not said:
            name, path, _ = self._folder(key)
            system.delete(path, True)
            top = max((n for _, n in self.runs()), default=-1) + 1
            # whole runs of any level lie on either side
            width = COMPACT
            while width < top:
                width *= COMPACT
            said = [str(-(-top // width) * width)]
            system.mkdirs(self._folder(f"{key}/{said[0]}")[1])
        self.offset = int(said[0])
        return new

    def table(self, before: int | None = None) -> DataFrame | None:
        """The table, or as it was before a micro-batch; None without any."""
        rows = None
        for level, n in self.runs():
            if before is None or n < before:
                part = self.spark.read.parquet(self._folder(f"runs/{level}-{n}")[0]).withColumn("batch", F.lit(n))
                rows = part if rows is None else rows.unionByName(part)
        return None if rows is None else self.merged(rows)

    def add(self, make: Callable[[DataFrame | None], DataFrame], number: int) -> None:
        """Write what ``make`` gives from the table before, as the delta of a micro-batch."""
        number += self.offset
        if any(level and n - COMPACT**level < number <= n for level, n in self.runs()):
            return
        make(self.table(number)).write.mode("overwrite").parquet(self._folder(f"runs/0-{number}")[0])
        level = 1
        while (number + 1) % COMPACT**level == 0:
            parts = [(l, n) for l, n in self.runs() if number - COMPACT**level < n <= number]
            rows = None
            for l, n in parts:
                part = self.spark.read.parquet(self._folder(f"runs/{l}-{n}")[0]).withColumn("batch", F.lit(n))
                rows = part if rows is None else rows.unionByName(part)
            self.merged(rows).write.mode("overwrite").parquet(self._folder(f"runs/{level}-{number}")[0])
            for l, n in parts:
                _, path, system = self._folder(f"runs/{l}-{n}")
                system.delete(path, True)
            level += 1


def _incremental(stream: DataFrame, state: State, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> DataFrame:
    """Run what is there; ``step(batch, number)`` takes each micro-batch in."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(step)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    table = state.table()
    if table is None:
        raise ValueError("no input yet")
    return table


#: What a statistics build counts: inputs read, inputs without an observation, observations.
COUNTERS = ("processed", "failed", "observations")


def _counters(spark: SparkSession, state: str) -> State:
    return State(spark, f"{state}/counters", lambda rows: rows.groupBy().agg(*(F.sum(x).alias(x) for x in COUNTERS)))


def build_counters(spark: SparkSession, state: str) -> DataFrame:
    """One row of COUNTERS of a statistics build, each input counted once however often its batch ran."""
    table = _counters(spark, state).table()
    if table is None:
        raise ValueError("no input yet")
    return table


def _build(stream: DataFrame, state: str, checkpoint: str, fresh: bool, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """A statistics build: ``step(batch)`` gives a batch's statistics and counters."""
    spark = stream.sparkSession
    table, counters = State(spark, f"{state}/table", _summed), _counters(spark, state)
    table.start(checkpoint, fresh)
    counters.start(checkpoint, fresh)

    def take(batch: DataFrame, number: int) -> None:
        stats, counts = step(batch)
        # the counters come first: a batch that the table holds is counted
        counters.add(lambda _: counts, number)
        table.add(lambda _: stats, number)

    return _incremental(stream, table, checkpoint, take)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code", "radius").agg(*(F.sum(x).alias(x) for x in statistics.STATE_COLUMNS))


def build_stats(spark: SparkSession, source: str, schema, state: str, checkpoint: str, files_per_batch: int = 2, fresh: bool = False) -> DataFrame:
    """Statistics table of all observations at ``source``, chunk by chunk.

    An observation without a code, a radius or a shift fails.  ``fresh`` forgets the
    table, the counters and the checkpoint first.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    whole = F.col("code").isNotNull() & F.col("radius").isNotNull() & F.col("shift_c").isNotNull()

    def step(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        fine = F.count_if(whole)
        return statistics.env_state(batch.where(whole)), batch.agg(F.count("*").alias("processed"), (F.count("*") - fine).alias("failed"), fine.alias("observations"))

    return _build(stream, state, checkpoint, fresh, step)


def sdf_observations(records: DataFrame, flavour: str | None, radius: int) -> DataFrame:
    """Observations (code, radius, shift_c, state and counters) of the carbons of raw SD records.

    Records are told apart by themselves, whatever their names.  Hybridisation,
    neighbours, small rings and aromaticity follow from the bond block
    (``graphs.atom_facts``).
    """
    from resonara.operators.graphs import environments

    one = lambda x: F.transform("signals", x)
    own = sdf_carbons(records, flavour).where(F.size("signals") > 0).withColumn("id", F.monotonically_increasing_id())
    rows = own.select("id", "elements", "bonds", one(lambda s: s["pos"]).alias("pos"), one(lambda s: F.lit(1).cast("bigint")).alias("n"), one(lambda s: s["shift_c"]).alias("sum_c"), one(lambda s: F.lit(0).cast("bigint")).alias("sumsq_c"))
    found = environments(rows, radius).withColumnsRenamed({"id": "compound_id", "sum_c": "shift_c"})
    return found.drop("n", "sumsq_c")


def sdf_carbons(records: DataFrame, flavour: str | None) -> DataFrame:
    """(elements, bonds, signals): raw SD records with a spectrum as lists, with the signals (pos, shift_c) of their carbons."""
    from resonara.sources import sdf

    own = sdf.sdf_structures(records.where(F.rlike("record", F.lit(r"\S"))), ["record"])
    parsed = sdf.parse_sdf(own, flavour, ["elements", "bonds"])
    carbons = F.filter("signals", lambda s: s["atom_index"].isNotNull() & (F.get("elements", s["atom_index"].cast("int")) == "C"))
    return parsed.select("elements", "bonds", F.transform(carbons, lambda s: F.struct(s["atom_index"].alias("pos"), F.round(s["shift"] * 100).cast("bigint").alias("shift_c"))).alias("signals"))


def carbon_stats(carbons: DataFrame, radius: int) -> DataFrame:
    """``env_state`` of the observations of ``sdf_carbons``: compounds of one structure are summed up first, and its codes and facts made once."""
    from resonara.operators.graphs import environments

    flat = carbons.select("elements", "bonds", F.inline("signals"))
    sums = flat.groupBy("elements", "bonds", "pos").agg(F.count("*").alias("n"), F.sum("shift_c").alias("sum_c"), F.sum(c("shift_c") * c("shift_c")).alias("sumsq_c"))
    listed = sums.groupBy("elements", "bonds").agg(F.collect_list(F.struct("pos", "n", "sum_c", "sumsq_c")).alias("l"))
    seen = environments(listed.select(F.lit(0).cast("bigint").alias("id"), "elements", "bonds", *(c("l")[x].alias(x) for x in ("pos", "n", "sum_c", "sumsq_c"))), radius)
    of = lambda which: F.sum(F.when(which, c("n")).otherwise(0))
    counters = [of(c("state") == s).alias(s) for s in statistics.STATES] + [of(c(k)).alias(v) for k, v in statistics.COUNTERS.items()]
    return seen.groupBy("code", "radius").agg(*(F.sum(x).alias(x) for x in ("n", "sum_c", "sumsq_c")), *counters)


def build_stats_from_sdf(spark: SparkSession, source: str, flavour: str | None, state: str, checkpoint: str, radius: int = 6, files_per_batch: int = 2, fresh: bool = False) -> DataFrame:
    """Statistics table straight from SD files: atoms, bonds and signals of each chunk make the codes.

    Without a flavour each record has its own.  A record without an observation
    fails: one that can't be read, has no spectrum, or no signal on a carbon.
    """
    from resonara.sources import sdf

    stream = sdf.raw_records(spark.readStream.option("maxFilesPerTrigger", files_per_batch), source)

    def step(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        raw = kept(batch)
        seen = kept(sdf_carbons(raw, flavour))
        counts = raw.groupBy().agg(F.count("*").alias("processed")).join(seen.groupBy().agg(F.coalesce(F.sum(F.size("signals")), F.lit(0)).alias("observations"), F.count_if(F.size("signals") > 0).alias("good")))
        return carbon_stats(seen, radius), counts.select("processed", (c("processed") - c("good")).alias("failed"), "observations")

    return _build(stream, state, checkpoint, fresh, step)


def extract_fragments(spark: SparkSession, source: str, schema, state: str, checkpoint: str, key: str = "smiles", seq: str = "fragment_id", files_per_batch: int = 2) -> DataFrame:
    """First fragment by ``key`` of all at ``source``; insertion comes before the checkpoint and is idempotent.

    A batch's delta holds the keys that the table lacks; the table's rows are cut
    down to the batch's keys before they are compared.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    table = State(spark, state, lambda rows: rows.drop("batch"))
    table.start(checkpoint)

    def make(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        # a first batch is measured against a table without rows
        known = batch.limit(0) if before is None else before.join(batch.select(key).distinct(), key, "left_semi")
        return statistics.insert_ignore(known, batch, [key], seq)[0].select(*batch.columns)

    return _incremental(stream, table, checkpoint, lambda batch, number: table.add(lambda before: make(batch, before), number))


FACTS = "run_id bigint, started bigint, at bigint, last_epoch bigint, phases array<struct<phase: string, start: bigint, ended: boolean>>"
STATUS = f"{FACTS}, state string, iteration bigint, active_phase string, elapsed_s bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_facts(events: DataFrame) -> DataFrame:
    """What a status follows from, for each run: first start, its seq, last epoch, and of each phase its last start and whether it ended (T4, batch).

    Facts of parts of a log, in any order and with repeats, give those of the whole
    by ``merged_facts``.
    """
    epoch, first = c("epoch").try_cast("bigint"), c("event") == "run_start"
    kind = F.when(c("event").isin("phase_start", "phase_end") & (c("phase") != ""), c("phase"))
    phases = events.groupBy("run_id", kind.alias("phase")).agg(
        F.min(F.when(first, c("seq"))).alias("at"), F.min_by(F.when(first, epoch), F.when(first, c("seq"))).alias("started"), F.max(epoch).alias("last_epoch"),
        F.max(F.when(c("event") == "phase_start", c("seq"))).alias("start"), F.coalesce(F.bool_or(c("event") == "phase_end"), F.lit(False)).alias("ended"),
    )
    return _gathered(phases)


def _gathered(phases: DataFrame) -> DataFrame:
    """A row a run of a row for each of its phases, and one for what has none."""
    listed = F.array_sort(F.collect_list(F.when(c("phase").isNotNull(), F.struct("phase", "start", "ended"))))
    return phases.groupBy("run_id").agg(F.min_by("started", "at").alias("started"), F.min("at").alias("at"), F.max("last_epoch").alias("last_epoch"), listed.alias("phases"))


def merged_facts(facts: DataFrame) -> DataFrame:
    """Facts of several parts of the runs' logs as one row a run."""
    flat = facts.select("run_id", "started", "at", "last_epoch", F.explode_outer("phases").alias("p")).select("run_id", "started", "at", "last_epoch", "p.phase", "p.start", "p.ended")
    return _gathered(flat.groupBy("run_id", "phase").agg(F.min_by("started", "at").alias("started"), F.min("at").alias("at"), F.max("last_epoch").alias("last_epoch"), F.max("start").alias("start"), F.bool_or("ended").alias("ended")))


def _number(phase: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(phase, F.lit("")), r"^lsd-iteration-(\d+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def live_status(facts: DataFrame, now: int | None = None) -> DataFrame:
    """(run_id, state, iteration, active_phase, started, last_epoch, elapsed_s) by facts.

    The active phase is the last one started that never ended; its number is the
    iteration.  Elapsed are the seconds from the first start to ``now`` or the run's
    last event, 0 at least.
    """
    open_ = F.filter("phases", lambda p: p["start"].isNotNull() & ~p["ended"])
    active = F.array_max(F.transform(open_, lambda p: F.struct(p["start"], p["phase"])))["phase"]
    until = c("last_epoch") if now is None else F.lit(now).cast("bigint")
    elapsed = F.when(c("started").isNotNull() & until.isNotNull(), F.greatest(until - c("started"), F.lit(0).cast("bigint")))
    return facts.select("run_id", F.lit("running").alias("state"), active.alias("active_phase"), "started", "last_epoch", elapsed.alias("elapsed_s")).select(
        "run_id", "state", _number(c("active_phase")).alias("iteration"), "active_phase", "started", "last_epoch", "elapsed_s"
    )


def tiered_status(facts: DataFrame, finalized: DataFrame | None = None, fallback: DataFrame | None = None, runs: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """Status of each run from the first tier that has it (T4).

    ``finalized`` (run_id, phases: array of names, elapsed_s) makes a run
    ``complete``, with its highest iteration, if any; then come the live facts, then
    ``fallback`` (run_id, iteration, active_phase), then ``waiting`` for those of
    ``runs`` (run_id) that nothing is known of.
    """
    live = live_status(facts, now)
    null = lambda kind: F.lit(None).cast(kind)
    tiers = [live]
    if finalized is not None:
        top = F.array_max(F.transform("phases", _number))
        tiers.insert(0, finalized.select("run_id", F.lit("complete").alias("state"), F.when(top > 0, top).alias("iteration"), null("string").alias("active_phase"), null("bigint").alias("started"), null("bigint").alias("last_epoch"), c("elapsed_s").cast("bigint").alias("elapsed_s")))
    if fallback is not None:
        tiers.append(fallback.select("run_id", F.lit("running").alias("state"), "iteration", "active_phase", *(null("bigint").alias(x) for x in ("started", "last_epoch", "elapsed_s"))))
    if runs is not None:
        tiers.append(runs.select("run_id", F.lit("waiting").alias("state"), null("bigint").alias("iteration"), null("string").alias("active_phase"), *(null("bigint").alias(x) for x in ("started", "last_epoch", "elapsed_s"))))
    # one grouping over all tiers instead of a join for each
    every = None
    for rank, tier in enumerate(tiers):
        part = tier.withColumn("tier", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    rest = [x for x in live.columns if x != "run_id"]
    return every.groupBy("run_id").agg(F.min_by(F.struct(*rest), "tier").alias("r")).select("run_id", "r.*")


def run_status(events: DataFrame, finalized: DataFrame | None = None, fallback: DataFrame | None = None, runs: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """Status of each run from its events, batch (T4)."""
    return tiered_status(run_facts(events), finalized, fallback, runs, now)


class _Runs(StatefulProcessor):
    """Facts of each run as one value, read and written once a batch, and a timer that runs out when the run is idle."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "started bigint, at bigint, last_epoch bigint, due bigint, phases array<struct<phase: string, start: bigint, ended: boolean>>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples():
            whole = [None if pd.isna(x) else int(x) for x in (r.started, r.at, r.last_epoch)]
            phases = {p["phase"]: (None if p["start"] is None or pd.isna(p["start"]) else int(p["start"]), bool(p["ended"])) for p in r.phases}
            self._keep(*whole, self._timer(timerValues.getCurrentWatermarkInMs()), phases)

    def _known(self) -> tuple | None:
        """(started, at, last_epoch, due, phases by name) or None."""
        found = self.facts.get()
        return None if found is None else (*found[:4], {p[0]: (p[1], p[2]) for p in found[4]})

    def _keep(self, started, at, last, due, phases: dict[str, tuple]) -> None:
        self.facts.update((started, at, last, due, [(p, *v) for p, v in phases.items()]))

    def _timer(self, latest: int, before: int | None = None) -> int | None:
        """Let the run's timer run out an idle time after ``latest``."""
        if self.idle_ms is None:
            return None
        due = latest + self.idle_ms
        if before is not None and before >= due:
            return before
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows, timerValues):
        started, at, last, due, phases = self._known() or (None, None, None, None, {})
        latest = timerValues.getCurrentWatermarkInMs() if self.idle_ms is not None else 0
        for batch in rows:
            if self.idle_ms is not None and batch["ts"].notna().any():
                latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            for r in batch.itertuples():
                epoch = int(r.epoch) if re.fullmatch(r"[+-]?\d+", str(r.epoch).strip()) else None
                last = epoch if last is None else last if epoch is None else max(last, epoch)
                if r.event == "run_start" and (at is None or r.seq < at):
                    started, at = epoch, int(r.seq)
                elif r.event in ("phase_start", "phase_end") and r.phase:
                    start, ended = phases.get(r.phase, (None, False))
                    phases[r.phase] = (max(int(r.seq), start or 0), ended) if r.event == "phase_start" else (start, True)
        self._keep(started, at, last, self._timer(latest, due), phases)
        yield self._row(key, started, at, last, phases, "running")

    def _row(self, key, started, at, last, phases, state) -> pd.DataFrame:
        known = sorted((p, *v) for p, v in phases.items())
        open_ = [(start, phase) for phase, start, ended in known if start is not None and not ended]
        active = max(open_)[1] if open_ else None
        number = re.fullmatch(r"lsd-iteration-(\d+)", active or "")
        elapsed = None if started is None or last is None else max(0, last - started)
        long = lambda x: pd.array([x], "Int64")
        return pd.DataFrame({
            "run_id": [key[0]], "started": long(started), "at": long(at), "last_epoch": long(last), "phases": [[{"phase": p, "start": s, "ended": e} for p, s, e in known]],
            "state": [state], "iteration": [int(number[1]) if number else 0], "active_phase": [active], "elapsed_s": long(elapsed),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """An idle run leaves the state; its last facts are given once more, as ``idle``."""
        if known := self._known():
            started, at, last, _, phases = known
            yield self._row(key, started, at, last, phases, "idle")
        self.facts.clear()

    def close(self) -> None:
        pass


def follow_runs(events: DataFrame, idle_minutes: int | None = 10, late_minutes: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Streaming status of runs, with the facts it follows from, from their event log, in update mode (T4).

    ``events``: run_id, seq, event, phase, epoch, ts (timestamp).  A run without
    events for ``idle_minutes`` leaves the state, once the watermark says so; a row
    with state ``idle`` tells.  If it goes on later, its rows hold the facts since
    then, which ``merged_facts`` puts together with the ones before.  The watermark
    is ``late_minutes`` (or the idle time) behind the latest event; what comes later
    than it is dropped.  ``known`` (FACTS) is the state to begin with, at a
    checkpoint's first start.  With None nothing leaves and nothing is dropped; ts
    isn't needed.  Needs the state store ROCKSDB.
    """
    timed = idle_minutes is not None
    marked = events.withWatermark("ts", f"{idle_minutes if late_minutes is None else late_minutes} minutes") if timed else events
    initial = None if known is None else known.select(*(x.split()[0] for x in ("run_id", "started", "at", "last_epoch", "phases"))).groupBy("run_id")
    return marked.groupBy("run_id").transformWithStateInPandas(_Runs(idle_minutes * 60_000 if timed else None), STATUS, "Update", "EventTime" if timed else "None", initial)


def follow_into(events: DataFrame, state: str, checkpoint: str, idle_minutes: int | None = 10, late_minutes: int | None = None, **tiers: DataFrame) -> DataFrame:
    """Latest status of every run, whose facts are kept as a table while events come in (T4).

    Runs that pause for longer than the idle time go on where they were: a batch's
    facts are merged with the table's.  A new checkpoint folder begins with the
    table's facts.  ``tiers`` are those of ``tiered_status``.
    """
    spark = events.sparkSession
    table = State(spark, state, merged_facts)
    known = kept(table.table()) if table.start(checkpoint) and table.runs() else None
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        live = follow_runs(events, idle_minutes, late_minutes, known)
        columns = ["run_id", "started", "at", "last_epoch", "phases"]
        facts = _incremental(live, table, checkpoint, lambda batch, number: table.add(lambda _: merged_facts(batch.select(*columns)), number), "update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return tiered_status(facts, **tiers)


#: Meta keys that keep their first value: fixed values.
PROTECTED = ("bin_size",)


def set_meta(meta: DataFrame, values: DataFrame) -> DataFrame:
    """Key/value table (key, value, seq) after writes; protected keys keep what they have (T5)."""
    kept = meta.where(c("key").isin(*PROTECTED)).select("key")
    return statistics.replace_into(meta, values.join(kept, "key", "left_anti"), ["key"], "seq")


def clear_meta(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without some keys (T5)."""
    return meta.join(keys.where(~c("key").isin(*PROTECTED)), "key", "left_anti")
