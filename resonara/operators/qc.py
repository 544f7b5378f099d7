"""Quality checks of peak lists, their verdict and routing.

Every check yields rows (list_id, name, passed, critical, value, threshold); a
list without the data a critical check needs fails it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.functions.scoring import ratio

from .joins import band_join, calibration_offsets, mirror_fraction
from .peaks import gap_clusters

c = F.col


@dataclass(frozen=True)
class Config:
    """Tolerances in hundredths of a ppm and floors of the checks."""

    c13_tol: int = 50
    h1_tol: int = 5
    ridge_fraction_fail: float = 0.5
    coverage_floor: float = 0.8
    sign_tol: int = 50
    symmetry_floor: float = 0.5


#: (experiment, axis column, proton axis) whose modal share is taken.
RIDGE_AXES = (("COSY", "f1_c", True), ("COSY", "f2_c", True), ("HSQC", "f1_c", False), ("HSQC", "f2_c", True), ("HMBC", "f1_c", False), ("HMBC", "f2_c", True))


def bucket(value: str, tolerance: int) -> Column:
    """Number of the nearest multiple of the tolerance, halves to even."""
    return F.rint(c(value).cast("double") / F.lit(float(tolerance))).cast("bigint")


#: Shifts that a user may give in place of DEPT.
OVERRIDE_ROWS = 10_000


def quaternary(carbons: DataFrame, dept: DataFrame, tolerance: int = 50) -> DataFrame:
    """Carbon shifts without a DEPT peak within tolerance."""
    return band_join(carbons, dept.select("list_id", c("pos_c").alias("_at")), "pos_c", "_at", tolerance, ["list_id"], "left_anti")


def resolve_reference(lists: DataFrame, carbons: DataFrame, dept: DataFrame, override: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(list_id, source) and quaternary shifts (list_id, pos_c): from DEPT, else the override, else none."""
    with_dept = dept.select("list_id").distinct().withColumn("_dept", F.lit(True))
    given = lists.join(with_dept, "list_id", "left").withColumn("_dept", F.coalesce("_dept", F.lit(False)))
    fallback = "override" if override is not None else "insufficient_reference_data"
    sources = given.select("list_id", F.when(c("_dept"), "dept").otherwise(fallback).alias("source"))
    found = quaternary(carbons, dept).join(with_dept.drop("_dept"), "list_id", "left_semi").select("list_id", "pos_c")
    if override is not None:
        # a user's own short list; every list without DEPT gets all of it
        if override.count() > OVERRIDE_ROWS:
            raise ValueError(f"an override of more than {OVERRIDE_ROWS} shifts is no reference")
        found = found.unionByName(given.where("NOT _dept").select("list_id").crossJoin(F.broadcast(override.select("pos_c"))))
    return sources, found


def check_exclusion(hsqc: DataFrame, forbidden: DataFrame, tolerance: int = 50) -> DataFrame:
    """Number of HSQC peaks at forbidden shifts of each list."""
    hits = band_join(hsqc, forbidden.select("list_id", c("pos_c").alias("_at")), "f1_c", "_at", tolerance, ["list_id"], "left_semi")
    return hsqc.select("list_id").distinct().join(hits.groupBy("list_id").agg(F.count("*").alias("hits")), "list_id", "left").select("list_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def check_coverage(hsqc: DataFrame, carbons: DataFrame, excluded: DataFrame, tolerance: int = 50) -> DataFrame:
    """Share of each list's deduplicated protonated shifts that an HSQC peak covers."""
    protonated = band_join(carbons, excluded.select("list_id", c("pos_c").alias("_at")), "pos_c", "_at", tolerance, ["list_id"], "left_anti")
    reference = gap_clusters(protonated, ["list_id"], "pos_c", tolerance)
    near = band_join(reference, hsqc.select("list_id", c("f1_c").alias("_at")), "pos_c", "_at", tolerance, ["list_id"], "left_semi").select("list_id", "pos_c", F.lit(1).alias("_hit"))
    return reference.join(near, ["list_id", "pos_c"], "left").groupBy("list_id").agg(ratio(F.count("_hit"), F.count("*")).alias("coverage"))


def ridge_fraction(peaks: DataFrame, config: Config = Config()) -> DataFrame:
    """Worst modal share of a rounded coordinate over six axes, with the axis."""
    rows = None
    for experiment, axis, proton in RIDGE_AXES:
        part = peaks.where(c("experiment") == experiment).select("list_id", F.lit(f"{experiment}.{axis}").alias("axis"), bucket(axis, config.h1_tol if proton else config.c13_tol).alias("b"))
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("list_id", "axis", "b").agg(F.count("*").alias("n"))
    shares = sizes.groupBy("list_id", "axis").agg(ratio(F.max("n"), F.sum("n")).alias("fraction"))
    return shares.groupBy("list_id").agg(F.max("fraction").alias("fraction"), F.min_by("axis", F.struct(-c("fraction"), c("axis"))).alias("axis"))


def sign_consistency(hsqc: DataFrame, tolerance: int = 50) -> DataFrame:
    """Carbons with more than one multiplicity hint."""
    hinted = hsqc.select("list_id", bucket("f1_c", tolerance).alias("bucket"), F.when(c("intensity") >= 0, "CH_or_CH3").otherwise("CH2").alias("hint"))
    return hinted.groupBy("list_id", "bucket").agg(F.countDistinct("hint").alias("hints")).where("hints > 1")


def check_calibration(hsqc: DataFrame, carbons: DataFrame, tolerance: int = 50) -> DataFrame:
    """Mean signed offset against the references; passes without a match, which ``n_matched`` shows."""
    observed = hsqc.select("list_id", c("f1_c").alias("obs_c"), c("peak_id").alias("obs_order"))
    offsets = calibration_offsets(observed, carbons.select("list_id", c("peak_id").alias("ref_id"), c("pos_c").alias("ref_c")), ["list_id"], max(10 * tolerance, 500))
    found = hsqc.select("list_id").distinct().join(offsets, "list_id", "left")
    mean = ratio(c("sum_c"), c("n"))
    return found.select("list_id", F.coalesce(mean, F.lit(0.0)).alias("offset_c"), F.coalesce("n", F.lit(0)).alias("n_matched"), (F.abs(F.coalesce(mean, F.lit(0.0))) <= tolerance).alias("passed"))


def _row(df: DataFrame, name: str, critical: bool, passed: Column, value: Column, threshold: float) -> DataFrame:
    return df.select("list_id", F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(critical).alias("critical"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))


def qc_checks(peaks: DataFrame, carbons: DataFrame, dept: DataFrame, config: Config = Config()) -> DataFrame:
    """The six checks of every list that has a peak."""
    lists = peaks.select("list_id").distinct()
    hsqc, cosy = peaks.where("experiment = 'HSQC'"), peaks.where("experiment = 'COSY'")
    sources, excluded = resolve_reference(lists, carbons, dept)
    known = sources.where("source <> 'insufficient_reference_data'").select("list_id")
    with_reference = lambda df: lists.join(df.join(known, "list_id", "left_semi"), "list_id", "left")
    signs = hsqc.select("list_id").distinct().join(sign_consistency(hsqc, config.sign_tol).groupBy("list_id").agg(F.count("*").alias("bad")), "list_id", "left")
    rows = [
        _row(with_reference(check_exclusion(hsqc, excluded, config.c13_tol)), "quaternary_exclusion", True, c("hits") == 0, c("hits"), 0),
        _row(lists.join(check_calibration(hsqc, carbons, config.c13_tol), "list_id", "left"), "ppm_calibration", True, c("passed"), c("offset_c"), config.c13_tol),
        _row(with_reference(hsqc.select("list_id").distinct().join(check_coverage(hsqc, carbons, excluded, config.c13_tol), "list_id")), "hsqc_coverage", True, c("coverage") >= config.coverage_floor, c("coverage"), config.coverage_floor),
        _row(lists.join(ridge_fraction(peaks, config), "list_id", "left"), "signal_to_ridge", True, c("fraction") <= config.ridge_fraction_fail, c("fraction"), config.ridge_fraction_fail),
        _row(lists.join(signs, "list_id", "left"), "edited_sign_consistency", False, F.coalesce("bad", F.lit(0)) == 0, F.coalesce("bad", F.lit(0)), 0),
        _row(lists.join(mirror_fraction(cosy, config.h1_tol), "list_id", "left"), "cosy_diagonal_symmetry", False, F.coalesce(c("fraction") >= config.symmetry_floor, F.lit(True)), c("fraction"), config.symmetry_floor),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def verdicts(checks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Verdict of each list with its checks: FAIL, PARTIAL or PASS; a load error turns PASS into FAIL."""
    graded = checks.groupBy("list_id").agg(
        F.bool_or(c("critical") & ~c("passed")).alias("_hard"), F.bool_or(~c("critical") & ~c("passed")).alias("_soft"),
        F.sort_array(F.collect_list(F.struct("name", "passed", "critical", "value", "threshold"))).alias("checks"),
    )
    verdict = F.when(c("_hard"), "FAIL").when(c("_soft"), "PARTIAL").otherwise("PASS")
    if errors is not None:
        graded = graded.join(errors.select("list_id").distinct().withColumn("_error", F.lit(True)), "list_id", "left")
        verdict = F.when((verdict == "PASS") & F.coalesce("_error", F.lit(False)), "FAIL").otherwise(verdict)
    violated = F.transform(F.filter("checks", lambda k: ~k["passed"]), lambda k: k["name"])
    return graded.select("list_id", verdict.alias("verdict"), violated.alias("violated"), "checks")


def qc_report(peaks: DataFrame, carbons: DataFrame, dept: DataFrame, config: Config = Config(), errors: DataFrame | None = None) -> DataFrame:
    """Verdict, violated checks, checks and thresholds of every list."""
    used = F.create_map(*(x for f in fields(config) if f.name != "block" for x in (F.lit(f.name), F.lit(float(getattr(config, f.name))))))
    return verdicts(qc_checks(peaks, carbons, dept, config), errors).withColumn("thresholds", used)


def route_by_verdict(peaks: DataFrame, report: DataFrame, out: str, quarantine: str) -> None:
    """Write peaks of passed lists, confidence stamped on, to ``out``; failed reports and peaks to ``quarantine``."""
    from resonara.functions.scoring import verdict_confidence

    judged = peaks.join(report.select("list_id", "verdict", "violated"), "list_id").persist()
    judged.where("verdict <> 'FAIL'").withColumn("confidence", verdict_confidence(c("verdict"))).write.mode("overwrite").parquet(out)
    judged.where("verdict = 'FAIL'").write.mode("overwrite").parquet(quarantine)
    judged.unpersist()


def check_schedule(schedules: DataFrame, parameters: DataFrame) -> DataFrame:
    """Length of each sampling schedule against what its mode implies; unknown modes are errors."""
    from resonara.functions.scoring import expected_samples

    counts = schedules.groupBy("exp_id").agg(F.count("*").alias("samples"), F.countDistinct("point").alias("distinct_points"))
    judged = parameters.join(counts, "exp_id", "left").withColumn("expected", expected_samples(c("mode"), c("td")))
    fault = F.when(c("expected").isNull(), "unknown_mode").when(F.coalesce("samples", F.lit(0)) != c("expected"), "length")
    return judged.select("exp_id", F.coalesce("samples", F.lit(0)).alias("samples"), "expected", fault.alias("fault"))


def latest_run(runs: DataFrame, by: str) -> DataFrame:
    """Latest iteration of each case: by number, then by time."""
    rest = [x for x in runs.columns if x != by]
    return runs.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("iteration", "mtime")).alias("r")).select(by, "r.*")


def tiered(ranked: DataFrame, unranked: DataFrame, by: str, most: int = 10) -> DataFrame:
    """Rows of the ranked source, or of the unranked one for cases that lack it, ``most`` a case."""
    rest = unranked.join(ranked.select(by).distinct(), by, "left_anti")
    both = ranked.withColumn("tier", F.lit("ranked")).unionByName(rest.withColumn("tier", F.lit("unranked")))
    return both.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy("order")).cast("bigint")).where(c("position") <= most)
