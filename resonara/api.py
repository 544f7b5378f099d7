"""What SQL users and callers of several operators start from."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType

from resonara.functions.scoring import experiment_type
from resonara.operators import analysis, joins, peaks, qc
from resonara.plans.scratch import kept
from resonara.sources import jcamp, sdf, text

c = F.col

STATS_COLUMNS = {"code", "radius", "n", "sum_c", "sumsq_c"}


def resolve_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several statistics tables that is there and has the columns of one."""
    for path in paths:
        try:
            found = spark.read.parquet(path)
        except AnalysisException:
            continue
        if STATS_COLUMNS <= set(found.columns):
            return found
    raise ValueError(f"no statistics table among {paths}")


@udtf(returnType="shift: double, h_count: int, atom_index: int")
class ParseSignals:
    """Rows of a measured-flavour signal field, for SQL users."""

    def eval(self, field: str) -> Iterator[tuple]:
        for part in (field or "").split("|"):
            bits = [b.strip() for b in part.split(";")]
            try:
                shift = float(bits[0])
            except ValueError:
                continue
            letter = bits[1][-1:].upper() if len(bits) > 1 else ""
            atom = bits[2] if len(bits) > 2 else ""
            yield shift, "SDTQ".index(letter) if letter and letter in "SDTQ" else None, int(atom) if atom.isdigit() else None


def register(spark: SparkSession) -> None:
    """Make ``parse_signals`` known to Spark SQL."""
    spark.udtf.register("parse_signals", ParseSignals)


#: Corpora by name, each a function of the session and a path that gives compounds (id, formula_norm) and signals.
_LOADERS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {}


def register_loader(name: str, load: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]) -> None:
    """Make a corpus format known by ``name`` (X2); a name is taken once."""
    if _LOADERS.setdefault(name, load) is not load:
        raise ValueError(f"loader {name!r} is registered already")


def load_corpus(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(compounds, signals) of a corpus by the loader of that name."""
    if name not in _LOADERS:
        raise ValueError(f"no loader {name!r}; there are: {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](spark, path)


def get_by_formula(spark: SparkSession, name: str, path: str, formulas: DataFrame) -> DataFrame:
    """Compounds of the asked formulas (formula_norm) with their signals, from any registered corpus."""
    return joins.lookup_by_formula(formulas, *load_corpus(spark, name, path))


def _numbered_compounds(compounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested compounds as (compounds with id, signals)."""
    from resonara.functions.formula import normalize_formula

    named = kept(compounds.withColumns({"id": F.monotonically_increasing_id(), "formula_norm": normalize_formula(c("formula"))}), "corpus")
    flat = named.select(c("id").alias("compound_id"), F.posexplode("signals").alias("pos", "s"))
    signals = flat.select("compound_id", c("pos").cast("bigint").alias("pos"), F.round(c("s.shift") * 100).cast("bigint").alias("shift_c"), c("s.h_count").cast("bigint").alias("h_count"), c("s.atom_index").cast("bigint").alias("atom_index"))
    return named.drop("signals"), signals


register_loader("sdf", lambda spark, path: _numbered_compounds(sdf.read_sdf(spark, path)))


def build_warehouse(spark: SparkSession, sources: dict[str, str], path: str) -> DataFrame:
    """Compounds of several SD folders (source -> path) as one warehouse at ``path``, compounds and signals (S1, S2, S6, U2); gives what ``table_info`` says."""
    every = None
    for source, folder in sources.items():
        part = sdf.read_sdf(spark, folder).withColumn("source", F.lit(source))
        every = part if every is None else every.unionByName(part)
    compounds, signals = _numbered_compounds(every)
    text.write_warehouse(compounds, f"{path}/compounds")
    signals.repartition("compound_id").sortWithinPartitions("compound_id", "pos").write.mode("overwrite").parquet(f"{path}/signals")
    return analysis.warehouse_info(spark.read.parquet(f"{path}/compounds"))[0]


register_loader("warehouse", lambda spark, path: (spark.read.parquet(f"{path}/compounds"), spark.read.parquet(f"{path}/signals")))


def table_info(stats: DataFrame) -> DataFrame:
    """Codes, observations, the fewest and most of a code, for each radius of a statistics table."""
    return stats.groupBy("radius").agg(F.count("*").alias("codes"), F.sum("n").alias("observations"), F.min("n").alias("least"), F.max("n").alias("most"))


def build_fragments(atoms: DataFrame, bonds: DataFrame, signals: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fragments of all compounds, atom-centred and rings, the first of each key.

    Columns: key, kind, compound_id, atom_count, shifts.
    """
    from resonara.operators import graphs

    return first_of_keys(graphs.first_fragments(atoms, bonds, signals, radius))


def first_of_keys(fragments: DataFrame) -> DataFrame:
    """The first fragment of each key and kind by compound and place; what ``build_fragments`` gives, from fragments that were found already."""
    rest = [x for x in fragments.columns if x not in ("key", "kind")]
    return fragments.groupBy("key", "kind").agg(F.min_by(F.struct(*rest), F.struct("compound_id", "place")).alias("r")).select("key", "kind", "r.compound_id", "r.atom_count", "r.shifts")


def fragment_search(queries: DataFrame, fragments: DataFrame, limit: int = 5, bins: int = 1) -> DataFrame:
    """The ``limit`` best fragments of each query.

    ``queries``: query_id, shifts; ``fragments``: fragment_id, atom_count, shifts.
    """
    return joins.fine_search(queries, fragments, bins, limit)


@F.pandas_udf(DoubleType())
def welford_std(values: pd.Series) -> float:
    """Population deviation by running means; a cross-check of the built-in aggregates."""
    n, mean, m2 = 0, 0.0, 0.0
    for x in values.dropna():
        n += 1
        delta = x - mean
        mean += delta / n
        m2 += delta * (x - mean)
    return (m2 / n) ** 0.5 if n else None


#: What is picked: nuclei in one dimension, experiments in two with their nuclei along F1.
ONE_D, TWO_D = ("1H", "13C"), {"HSQC": "13C", "HMBC": "13C", "COSY": "1H"}


@dataclass
class Ingested:
    """Peaks, verdicts, and what was left out."""

    peaks_1d: DataFrame
    peaks_2d: DataFrame
    report: DataFrame
    skipped: DataFrame
    failed: DataFrame


def _settings(thresholds: Sequence[str], snr_floors: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    """For each nucleus and experiment (share of the largest, or None; noise floor); keyed values beat bare ones."""
    share, every_share = text.threshold_options(list(thresholds))
    floor, every_floor = text.threshold_options(list(snr_floors))
    dead = sorted(k for k in floor if share.get(k, every_share) is not None)
    if dead or (every_share is not None and every_floor is not None):
        raise ValueError(f"a threshold leaves the noise floor of {', '.join(dead) or 'all'} without effect")
    return {k: (share.get(k, every_share), floor.get(k, 5.0 if every_floor is None else every_floor)) for k in (*ONE_D, *TWO_D)}


def ingest_jcamp(docs: DataFrame, thresholds: Sequence[str] = (), snr_floors: Sequence[str] = (), config: qc.Config = qc.Config()) -> Ingested:
    """Spectra of many samples read, picked and judged in one go.

    ``docs``: path, content; the files of one folder are a sample, ``list_id`` the
    hash of the folder; each is read once.  Thresholds are ``KEY=value`` (a nucleus
    or an experiment) or a bare value for the others.  Files that can't be decoded or
    have no places in ppm, and second files of a kind in a sample, are ``failed``; kinds that aren't picked are ``skipped``.
    A failed file makes a passing sample fail.
    """
    settings = _settings(thresholds, snr_floors)
    points = kept(jcamp.parse_jcamp(docs), "jcamp")
    kind = F.when(c("two_d"), experiment_type(c("pulse_program"))).otherwise(c("nucleus"))
    heads = kept(jcamp.headers(points).withColumns({"kind": kind, "list_id": F.xxhash64(F.regexp_replace("path", "/?[^/]*$", ""))}), "jcamp-heads")
    picked = F.coalesce(c("kind").isin(*settings), F.lit(False))
    broken = points.where("error IS NOT NULL").select("path", "error").unionByName(heads.where(picked & ~c("placed")).select("path", F.lit("no $OFFSET and $SF").alias("error")))
    wanted = heads.where(picked & c("placed"))
    first = kept(wanted.groupBy("list_id", "kind").agg(F.min("path").alias("path")), "jcamp-files")
    second = wanted.join(first.select("path"), "path", "left_anti").select("path", F.concat(F.lit("a second file of "), "kind").alias("error"))
    failed = broken.unionByName(second)
    skipped = heads.where(~picked).select("path", F.concat(F.coalesce("kind", F.lit("unknown kind")), F.lit(" is not picked")).alias("reason"))
    # one file of a kind a sample: its number is its plane's
    numbered = kept(text.numbered(first, "path").withColumnRenamed("number", "plane_id"), "jcamp-planes")
    cents = lambda ppm: F.round(c(ppm) * 100).cast("bigint")
    one, two = None, None
    for name, (share, floor) in settings.items():
        own = points.join(numbered.where(c("kind") == name), "path")
        if name in ONE_D:
            found = peaks.pick_1d(own.select("path", "i", c("value").alias("y")), ["path"], "y", share=share, snr_floor=floor, negative=True)
            part = found.join(own.select("path", "list_id", "i", cents("x_ppm").alias("pos_c")), ["path", "i"]).select("list_id", F.lit(name).alias("nucleus"), "pos_c", c("y").alias("intensity"), "snr")
            one = part if one is None else one.unionByName(part)
        else:
            grid = own.select("plane_id", c("row").alias("i"), c("i").alias("j"), c("value").alias("z"), cents("y_ppm").alias("f1"), cents("x_ppm").alias("f2"))
            found = peaks.pick_2d(grid, share=share, snr_floor=floor, negative=name != "COSY")
            part = found.join(numbered.select("plane_id", "list_id"), "plane_id").select("list_id", F.lit(name).alias("experiment"), "rank", c("f1").alias("f1_c"), c("f2").alias("f2_c"), c("z").alias("intensity"), "snr")
            two = part if two is None else two.unionByName(part)
    one, two = kept(one, "jcamp-1d"), kept(two, "jcamp-2d")
    order = {k: i for i, k in enumerate(TWO_D)}
    number = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[c("experiment")]
    two = two.withColumn("peak_id", c("rank") * len(order) + number).drop("rank")
    carbons = one.where("nucleus = '13C'").select("list_id", "pos_c", F.row_number().over(W.partitionBy("list_id").orderBy(c("pos_c").desc(), "intensity")).cast("bigint").alias("peak_id"))
    errors = failed.select(F.xxhash64(F.regexp_replace("path", "/?[^/]*$", "")).alias("list_id"))
    report = qc.qc_report(two, carbons, carbons.where("false"), config, errors)
    return Ingested(one, two, report, skipped, failed)
