"""Noise estimates, thresholds, peak picking and clustering of shifts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.functions.scoring import multiplicity_compatible, ratio
from resonara.plans.scratch import kept

from . import ranges

c = F.col

#: Solvent windows in ppm: fixed values.
SOLVENT_WINDOWS = {
    "CDCl3": [(72.0, 82.0)], "DMSO": [(37.0, 42.0)], "DMSO-d6": [(37.0, 42.0)], "CD3OD": [(46.0, 52.0)], "MeOD": [(46.0, 52.0)],
    "CD3CN": [(1.0, 5.0), (114.0, 120.0)], "acetone": [(27.0, 33.0)], "C6D6": [(125.0, 131.0)],
}


def without_solvent(points: DataFrame, by: Sequence[str], windows: DataFrame) -> DataFrame:
    """Points outside their spectrum's solvent windows; all of them where none is left.

    ``points``: ppm; ``windows``: the ``by`` columns, lo, hi.
    """
    inside = points.join(windows, list(by)).where(c("ppm").between(c("lo"), c("hi"))).select(*by, "i").distinct()
    judged = points.join(inside.withColumn("_in", F.lit(True)), [*by, "i"], "left")
    left = F.count_if(c("_in").isNull()).over(W.partitionBy(*by))
    return judged.withColumn("_left", left).where(c("_in").isNull() | (c("_left") == 0)).drop("_in", "_left")


def above_share_of_max(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """Rows whose absolute value is at least a share of the group's largest."""
    top = F.max(F.abs(value)).over(W.partitionBy(*by))
    return df.withColumn("_top", top).where(F.abs(value).cast("double") >= F.lit(share) * c("_top")).drop("_top")


def threshold(mode: Column, absolute: Column, share: Column, top: Column, sigma: Column, k: float) -> Column:
    """Absolute threshold by mode: absolute, fraction of max, or SNR."""
    return F.when(mode == "absolute", absolute).when(mode == "fraction", share * top).otherwise(F.lit(k) * sigma)


def noise_sigma(points: DataFrame, by: Sequence[str], value: str, k: float = 3.0, approximate: bool = False) -> DataFrame:
    """1.4826 times the median absolute deviation; 5 % of the largest value over k where that is zero.

    ``approximate`` trades exact medians for mergeable sketches, for long spectra.
    """
    top = points.groupBy(*by).agg(F.max(F.abs(value)).alias("_top"))
    if approximate:
        middle = lambda df, x: df.groupBy(*by).agg(F.approx_percentile(x, 0.5, 10_000).alias("median"))
    else:
        middle = lambda df, x: ranges.medians(df, by, x)
    centre = middle(points, value).select(*by, c("median").alias("_m"))
    away = points.join(centre, list(by)).select(*by, F.abs(c(value) - c("_m")).alias("_away"))
    spread = middle(away, "_away").select(*by, c("median").alias("_mad")).join(top, list(by))
    return spread.select(*by, F.when(c("_mad") > 0, F.lit(1.4826) * c("_mad")).otherwise(F.lit(0.05) * c("_top") / F.lit(k)).alias("sigma"))


def corner_noise(grid: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Population deviation of the four corner blocks of each plane (A21); overlapping corners count twice."""
    size = grid.groupBy("plane_id").agg((F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj"))
    edge = lambda n: F.greatest(F.lit(1), F.floor(c(n) * F.lit(fraction)))
    sized = grid.join(size, "plane_id").withColumns({"ci": edge("ni"), "cj": edge("nj")})
    hits = lambda x, n, k: (c(x) < c(k)).cast("int") + (c(x) >= c(n) - c(k)).cast("int")
    weighted = sized.withColumn("w", hits("i", "ni", "ci") * hits("j", "nj", "cj")).where("w > 0")
    sums = weighted.groupBy("plane_id").agg(F.sum("w").alias("n"), F.sum(c("w") * c("z")).alias("s"), F.sum(c("w") * c("z") * c("z")).alias("q"))
    return sums.select("plane_id", (F.sqrt((c("n") * c("q") - c("s") * c("s")).cast("double")) / c("n").cast("double")).alias("noise"))


def negative_signals(points: DataFrame, by: Sequence[str], value: str, share: float = 0.05) -> DataFrame:
    """(edited, negatives): points below minus ``share`` of the largest finite value."""
    v = c(value).cast("double")
    finite = points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    top = finite.groupBy(*by).agg(F.max(F.abs(v)).alias("_top"))
    low = finite.join(top, list(by)).groupBy(*by).agg(F.count_if((c("_top") > 0) & (v < F.lit(-share) * c("_top"))).alias("negatives"))
    return points.select(*by).distinct().join(low, list(by), "left").select(*by, (F.coalesce("negatives", F.lit(0)) > 0).alias("edited"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def local_maxima(points: DataFrame, by: Sequence[str], value: str, least: Column | None = None) -> DataFrame:
    """Rows of local maxima; a plateau counts once, at its middle.

    ``points``: i, consecutive from 0.  Ends of a spectrum are no maxima.  A long
    spectrum is many pieces (``ranges.local_maxima``).
    """
    found = ranges.local_maxima(points, by, value)
    return found if least is None else found.where(least)


def _spaced(at: np.ndarray, height: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the peaks at ``at`` stay when higher ones keep others ``distance`` away; later ones first on ties."""
    stays = np.ones(len(at), dtype=bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if stays[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            stays &= ~near
    return stays


def minimum_spacing(peaks: DataFrame, by: Sequence[str], value: str, distance: int | str) -> DataFrame:
    """Peaks that are left when each keeps lower ones less than ``distance`` points away.

    Chains of peaks closer than that can't affect each other across larger gaps;
    each chain is one group, so a long spectrum is many small groups.
    """
    order = W.partitionBy(*by).orderBy("i")
    spaced = peaks.withColumn("_d", F.lit(distance) if isinstance(distance, int) else c(distance))
    broken = F.when(c("i") - F.lag("i").over(order) < c("_d"), 0).otherwise(1)
    chains = spaced.withColumn("_b", broken).withColumn("_chain", F.sum("_b").over(order)).drop("_b")

    def keep(chain: pd.DataFrame) -> pd.DataFrame:
        chain = chain.sort_values("i")
        return chain[_spaced(chain["i"].to_numpy(), np.abs(chain[value].to_numpy()), int(chain["_d"].iloc[0]))]

    alone = F.count("*").over(W.partitionBy(*by, "_chain"))
    sized = chains.withColumn("_size", alone)
    kept = sized.where("_size > 1").drop("_size")
    return sized.where("_size = 1").drop("_size").unionByName(kept.groupBy(*by, "_chain").applyInPandas(keep, kept.schema)).drop("_chain", "_d")


#: Nodes below one node of the tree of minima.
_FAN = 16


def _minima(points: DataFrame, by: Sequence[str], value: str, mirrored: bool) -> tuple[DataFrame, int]:
    """(by, level, node, parent, low): the points, and smallest values of ever longer stretches of a spectrum; and the number of levels."""
    at = -c("i") if mirrored else c("i")
    level = points.select(*by, at.cast("bigint").alias("node"), c(value).cast("double").alias("low"))
    top = points.agg(F.max(F.abs("i"))).first()[0] or 0
    out, levels = None, 0
    while True:
        rows = level.select(*by, F.lit(levels).alias("level"), "node", F.floor(c("node") / _FAN).alias("parent"), "low")
        out, levels = rows if out is None else out.unionByName(rows), levels + 1
        if top < _FAN:
            break
        # numbers of one sign all come to lie under one node
        level, top = level.groupBy(*by, F.floor(c("node") / _FAN).alias("node")).agg(F.min("low").alias("low")), top // _FAN
    return kept(out), levels


def _crossings(points: DataFrame, tops: DataFrame, by: Sequence[str], value: str, mirrored: bool) -> DataFrame:
    """(by, at, found): the nearest point before each top (or after it) at or below half its height.

    Each top looks at up to ``_FAN`` nodes at a time: at those before it under its
    parent, then under its grandparent and so on up, and from the nearest node that
    is low enough down to the point.  So no top meets its whole spectrum.
    """
    tree, levels = _minima(points, by, value, mirrored)
    start = -c("_at") if mirrored else c("_at")
    asked = tops.select(*by, "_at", (c("_top") / F.lit(2.0)).alias("_half"), F.lit(True).alias("_up"), F.lit(0).alias("_level"), start.cast("bigint").alias("_node"), F.lit(None).cast("bigint").alias("_found"))
    done = None
    for _ in range(2 * levels):
        at_level = F.when(c("_up"), c("_level")).otherwise(c("_level") - 1)
        under = F.when(c("_up"), F.floor(c("_node") / _FAN)).otherwise(c("_node"))
        looking = asked.withColumns({"level": at_level, "parent": under})
        met = looking.join(tree, [*by, "level", "parent"], "left")
        fits = (c("low") <= c("_half")) & (~c("_up") | (c("node") < c("_node")))
        best = met.groupBy(*by, "_at", "_half", "_up", "_level", "_node").agg(F.max(F.when(fits, c("node"))).alias("_best"))
        hit, lowest = c("_best").isNotNull(), F.when(c("_up"), c("_level")).otherwise(c("_level") - 1)
        moved = kept(best.select(
            *by, "_at", "_half", (c("_up") & ~hit).alias("_up"), F.when(hit, lowest).otherwise(c("_level") + 1).alias("_level"), F.when(hit, c("_best")).otherwise(F.floor(c("_node") / _FAN)).alias("_node"),
            F.when(hit & (lowest == 0), c("_best")).alias("_found"),
        ))
        over = c("_found").isNotNull() | (c("_up") & (c("_level") >= levels))
        part = moved.where(over).select(*by, "_at", (-c("_found") if mirrored else c("_found")).alias("found"))
        done = part if done is None else done.unionByName(part)
        asked = moved.where(~over)
        if asked.isEmpty():
            break
    return done


def line_widths(points: DataFrame, peaks: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Width in points at half height of each peak, between the nearest crossings, interpolated.

    Where one side has no crossing, the spectrum's end counts.
    """
    tops = kept(peaks.select(*by, c("i").alias("_at"), c(value).alias("_top")))
    ends = points.groupBy(*by).agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    out = tops.join(ends, list(by))
    for side, step, mirrored in (("_l", 1, False), ("_r", -1, True)):
        crossed = _crossings(points, tops, by, value, mirrored).select(*by, "_at", c("found").alias(side))
        value_at = lambda name, shift, side=side: points.select(*by, (c("i") - shift).alias(side), c(value).cast("double").alias(name))
        out = out.join(crossed, [*by, "_at"], "left").join(value_at(f"{side}v", 0), [*by, side], "left").join(value_at(f"{side}n", step), [*by, side], "left")
    half = c("_top") / F.lit(2.0)
    left = F.coalesce(c("_l") + F.try_divide(half - c("_lv"), c("_ln") - c("_lv")), c("_lo").cast("double"))
    right = F.coalesce(c("_r") - F.try_divide(half - c("_rv"), c("_rn") - c("_rv")), c("_hi").cast("double"))
    return out.select(*by, c("_at").alias("i"), (right - left).alias("width"))


def width_summary(widths: DataFrame, by: Sequence[str], ppm_per_point: float, factor: float = 1.5, widest: float = 1.0) -> DataFrame:
    """Median and range of widths under ``widest`` ppm, and the spacing they call for in ppm."""
    w = c("width") * F.lit(ppm_per_point)
    some = F.count_if(w < widest).over(W.partitionBy(*by))
    used = kept(widths.withColumn("_w", w).withColumn("_some", some).where((c("_some") == 0) | (c("_w") < widest)).select(*by, "_w"))
    ends = used.groupBy(*by).agg(F.min("_w").alias("min"), F.max("_w").alias("max"), F.count("*").alias("n"))
    return ranges.medians(used, by, "_w").drop("n").join(ends, list(by)).select(*by, "median", "min", "max", (c("median") * F.lit(factor)).alias("distance"), "n")


def pick_1d(points: DataFrame, by: Sequence[str], value: str = "y", share: float | None = None, snr_floor: float = 5.0, ppm_per_point: float = 0.01, negative: bool = False) -> DataFrame:
    """Peaks of each spectrum with snr, two passes: widths of loosely picked peaks set the spacing.

    With ``share`` the threshold is a fraction of the largest value and snr null.
    """
    sigma = noise_sigma(points, by, value, k=snr_floor)
    top = points.groupBy(*by).agg(F.max(F.abs(value)).alias("_top"))
    limits = sigma.join(top, list(by)).withColumn("_limit", F.lit(snr_floor) * c("sigma") if share is None else F.lit(share) * c("_top"))

    def one_sign(df: DataFrame) -> DataFrame:
        tops = local_maxima(df, by, value).join(limits, list(by)).where(c(value) >= c("_limit"))
        summary = width_summary(line_widths(df, tops, by, value), by, ppm_per_point)
        spacing = F.greatest(F.lit(1), F.floor(F.coalesce(c("distance"), F.lit(0.05)) / F.lit(ppm_per_point))).cast("bigint")
        spaced = tops.join(summary.select(*by, "distance"), list(by), "left").withColumn("_space", spacing).drop("distance")
        return minimum_spacing(spaced, by, value, "_space").drop("_space")

    found = one_sign(points)
    if negative:
        turned = one_sign(points.withColumn(value, -c(value)))
        found = found.unionByName(turned.withColumn(value, -c(value)))
    snr = F.abs(value) / c("sigma") if share is None else F.lit(None).cast("double")
    return found.select(*by, "i", value, snr.alias("snr"))


def pick_2d(grid: DataFrame, share: float | None = None, snr_floor: float = 5.0, negative: bool = False) -> DataFrame:
    """One apex for each connected region above the threshold, with its snr and its rank in the plane.

    The threshold is ``snr_floor`` times the plane's noise, or with ``share`` that
    share of its largest absolute value; snr is then null.  The first cell wins on
    ties.  Peaks rank by descending shifts: those of columns f1 and f2 if ``grid``
    has them, else by rising indices, along which shifts fall.
    """
    from .graphs import connected_regions

    if share is None:
        limits = noise_sigma(grid, ["plane_id"], "z", k=5.0).select("plane_id", "sigma", (F.lit(snr_floor) * c("sigma")).alias("_limit"))
    else:
        limits = grid.groupBy("plane_id").agg(F.lit(None).cast("double").alias("sigma"), (F.lit(share) * F.max(F.abs("z"))).alias("_limit"))
    shifts = [x for x in ("f1", "f2") if x in grid.columns]
    facts = grid.join(kept(limits), "plane_id")

    def one_sign(sign: int) -> DataFrame:
        above = kept(facts.withColumn("_h", c("z") * sign).where(c("_h").cast("double") >= c("_limit")))
        regions = connected_regions(above.select("plane_id", "i", "j"))
        best = F.min_by(F.struct("i", "j", "z", "sigma", *shifts), F.struct(-c("_h"), c("i"), c("j")))
        return above.join(regions, ["plane_id", "i", "j"]).groupBy("plane_id", "region_i", "region_j").agg(F.count("*").alias("cells"), best.alias("t")).select("plane_id", "cells", "t.*")

    found = one_sign(1).unionByName(one_sign(-1)) if negative else one_sign(1)
    order = [c(x).desc() for x in shifts] if len(shifts) == 2 else [c("i"), c("j")]
    rank = F.row_number().over(W.partitionBy("plane_id").orderBy(*order, "i", "j")).cast("bigint")
    return found.select("plane_id", "cells", "i", "j", "z", *shifts, (F.abs("z").cast("double") / c("sigma")).alias("snr"), rank.alias("rank"))


def threshold_search(peaks: DataFrame, refs: DataFrame, by: Sequence[str], tolerance: int, first: float = 0.10, least: float = 0.005, step: float = 0.5) -> DataFrame:
    """Highest rung of a falling threshold at which every reference has a peak.

    All rungs are judged in one pass: a reference is met at a rung if the largest
    of its near peaks, as a share of the list's largest, reaches it.
    """
    from .joins import band_join

    ladder = []
    while first * step ** len(ladder) >= least:
        ladder.append(first * step ** len(ladder))
    shares = peaks.withColumn("_share", ratio(F.abs("intensity"), F.max(F.abs("intensity")).over(W.partitionBy(*by))))
    hits = band_join(refs.select(*by, c("peak_id").alias("_ref"), "pos_c"), shares.select(*by, c("f1_c").alias("_at"), "_share"), "pos_c", "_at", tolerance, by)
    reach = refs.select(*by, c("peak_id").alias("_ref")).join(hits.groupBy(*by, "_ref").agg(F.max("_share").alias("_reach")), [*by, "_ref"], "left")
    need = reach.groupBy(*by).agg(F.min(F.coalesce("_reach", F.lit(-1.0))).alias("_need"), F.collect_list(F.coalesce("_reach", F.lit(-1.0))).alias("_all"))
    rung = F.coalesce(F.array_min(F.filter(F.transform(F.array(*map(F.lit, ladder)), lambda x, i: F.when(x <= c("_need"), i)), lambda i: i.isNotNull())), F.lit(len(ladder) - 1))
    at = need.withColumn("_rung", rung)
    used = F.element_at(F.array(*map(F.lit, ladder)), (c("_rung") + 1).cast("int"))
    unmatched = F.size(F.filter("_all", lambda r: r < used)).cast("bigint")
    # a search that fails reports a threshold that is one step further down
    reported = F.when(unmatched == 0, used).otherwise(used * step)
    return at.select(*by, (c("_rung") + 1).cast("bigint").alias("iterations"), used.alias("last_tried"), reported.alias("threshold"), unmatched.alias("unmatched"))


def gap_clusters(df: DataFrame, by: Sequence[str], value: str, tolerance: int) -> DataFrame:
    """First value and size of each chain of sorted values no more than ``tolerance`` apart.

    Equal values are counted before they are sorted, so a group of any size is at most
    as many rows as the axis has hundredths of a ppm.  Nulls are one chain.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    order = W.partitionBy(*by).orderBy(value)
    new = F.when(c(value) - F.lag(value).over(order) <= tolerance, 0).otherwise(1)
    marked = counts.withColumn("_new", new).withColumn("_cluster", F.sum("_new").over(order))
    return marked.groupBy(*by, "_cluster").agg(F.min(value).alias(value), F.sum("n").alias("n")).drop("_cluster")


def group_signals(lists: DataFrame, tolerance: int = 25) -> DataFrame:
    """Groups of signals all within ``tolerance`` of each other.

    ``lists`` has array ``signals`` of (shift_c, pos, mult).  A group with a pair
    of incompatible multiplicities dissolves.  Adds ``groups`` (arrays of
    signals, two or more), ``grouped`` and ``warning`` (a group holds over half).
    """
    group_type = "array<array<struct<shift_c:bigint,pos:bigint,mult:string>>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["shift_c"] - last[0]["shift_c"] <= tolerance)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(s))))
        return F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(F.concat(acc, F.array(F.array(s)))).cast(group_type)

    ordered = F.array_sort(F.transform("signals", lambda s: F.struct(s["shift_c"].cast("bigint").alias("shift_c"), s["pos"].cast("bigint").alias("pos"), s["mult"].alias("mult"))))
    clusters = F.aggregate(ordered, F.array().cast(group_type), step)
    fits = lambda g: ~F.exists(g, lambda a: F.exists(g, lambda b: ~multiplicity_compatible(a["mult"], b["mult"])))
    out = lists.withColumn("_groups", clusters).withColumn("groups", F.filter("_groups", lambda g: (F.size(g) > 1) & fits(g))).drop("_groups")
    most = F.array_max(F.transform("groups", lambda g: F.size(g)))
    return out.withColumns({"grouped": F.aggregate("groups", F.lit(0), lambda acc, g: acc + F.size(g)).cast("bigint"), "warning": F.coalesce(most.cast("double") > F.lit(0.5) * F.size("signals"), F.lit(False))})


def aromatic_pairs(grouped: DataFrame, key: str, low: int = 10000, high: int = 16500) -> DataFrame:
    """Cross-group pairs of aromatic groups of one size: ascending with descending members.

    Groups are taken in order; each joins the next one of its size.
    """
    flat = grouped.select(key, F.posexplode("groups").alias("g", "members"))
    aromatic = flat.where(F.forall("members", lambda m: m["shift_c"].between(low, high))).withColumn("size", F.size("members"))
    # of the groups of one size, the first joins the second, the third the fourth
    turn = F.row_number().over(W.partitionBy(key, "size").orderBy("g"))
    turned = aromatic.withColumns({"pair": F.floor((turn + 1) / 2), "second": turn % 2 == 0, "ids": F.sort_array(F.transform("members", lambda m: m["pos"] + 1))})
    a = turned.where(~c("second")).select(key, "size", "pair", F.posexplode("ids").alias("k", "atom1"))
    b = turned.where("second").select(key, "size", "pair", F.posexplode(F.reverse("ids")).alias("k", "atom2"))
    return a.join(b, [key, "size", "pair", "k"]).select(key, "atom1", "atom2")


def number_atoms(peaks: DataFrame) -> DataFrame:
    """Peaks with atom_no by descending shift, from 1."""
    return ranges.numbered(peaks, ["list_id"], [c("pos_c").desc(), c("peak_id")], "atom_no")


def intensity_doubled(peaks: DataFrame, refs: DataFrame, by: Sequence[str], tolerance: int = 100, least: float = 1.6) -> DataFrame:
    """Aromatic reference peaks at least ``least`` times the median aromatic intensity."""
    from .joins import intensity_pairs

    aromatic = peaks.where(c("pos_c").between(10000, 16500))
    middle = ranges.medians(aromatic, by, "intensity").select(*by, c("median").alias("_m"), c("n").alias("_n")).where("_n >= 2 AND _m > 0")
    pairs = intensity_pairs(refs, aromatic, by, tolerance).join(middle, list(by))
    return pairs.withColumn("ratio", c("intensity").cast("double") / c("_m")).where(c("ratio") >= least).select(*by, "peak_id", "pos_c", "ratio", F.rint("ratio").cast("bigint").alias("carbons"))


def decimate(grid: DataFrame, most: int = 512) -> DataFrame:
    """Block maxima of a plane with at most ``most`` blocks an axis."""
    size = grid.groupBy("plane_id").agg(F.ceil((F.max("i") + 1) / most).alias("si"), F.ceil((F.max("j") + 1) / most).alias("sj"))
    return grid.join(size, "plane_id").groupBy("plane_id", F.floor(c("i") / c("si")).alias("bi"), F.floor(c("j") / c("sj")).alias("bj")).agg(F.max("z").alias("z"))
