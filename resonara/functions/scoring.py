"""Columns that grade, classify and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds in ppm below which each tolerance holds, and the tolerance above all: fixed values.
TOLERANCES_C = ((8000, 80), (10000, 100), (16000, 120))
LAST_TOLERANCE_C = 150
#: Plausible ppm ranges by nucleus: fixed values.
AXIS_BOUNDS = {"1H": (-3.0, 15.0), "13C": (-15.0, 250.0), "15N": (-50.0, 900.0), "31P": (-200.0, 250.0)}
WIDE_BOUNDS = (-1e6, 1e6)
#: Acquisition modes with real points, and with complex pairs: fixed values.
REAL_MODES, COMPLEX_MODES = (1, 2), (4, 5, 6)
#: Elements a carbon's neighbours are counted for.
NEIGHBOURS = ("carbon", "oxygen", "nitrogen", "sulfur", "halogen")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision."""
    return a.cast("double") / b.cast("double")


def tolerance_c(shift_c: Column) -> Column:
    """Match tolerance of a shift's region, in hundredths of a ppm."""
    out = None
    for bound, tolerance in TOLERANCES_C:
        out = F.when(shift_c < bound, tolerance) if out is None else out.when(shift_c < bound, tolerance)
    return out.otherwise(LAST_TOLERANCE_C)


def match_score(matched: Column, observed: Column, reference: Column, carbons: Column, same_h: Column | None = None) -> Column:
    """Geometric mean of both coverages; hydrogen counts take up to 20 %."""
    overlap = F.when(carbons > 0, F.least(F.lit(1.0), ratio(observed, carbons))).otherwise(1.0)
    coverage = F.least(F.lit(1.0), matched.cast("double") / (reference.cast("double") * overlap))
    score = F.sqrt(ratio(matched, observed) * coverage)
    if same_h is not None:
        score = F.when(matched > 0, score * (F.lit(0.8) + F.lit(0.2) * ratio(same_h, F.greatest(matched, F.lit(1))))).otherwise(score)
    return F.when((observed == 0) | (reference == 0), 0.0).otherwise(score)


def confidence(radius: Column, n: Column, std: Column, max_radius: int) -> Column:
    """Prediction confidence from radius, matches and spread, unrounded (P10)."""
    by_n = F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.5) * F.log10(F.greatest(n, F.lit(1)).cast("double")) / F.lit(2.0))
    by_std = F.greatest(F.lit(0.5), F.lit(1.0) - std / F.lit(20.0))
    return F.lit(0.5) * (radius.cast("double") / F.lit(float(max_radius))) + F.lit(0.3) * by_n + F.lit(0.2) * by_std


def experiment_type(pulse_program: Column) -> Column:
    """2D experiment of a pulse program, null if it can't be told."""
    low = F.lower(pulse_program)
    has = lambda *words: F.rlike(low, F.lit("|".join(words)))
    return (
        F.when(has("hmbc"), "HMBC").when(has("inv4") & has("lr"), "HMBC").when(has("inv4", "hsqc", "hmqc"), "HSQC").when(has("cosy"), "COSY")
        .when(has("tocsy", "mlev", "dipsi"), "TOCSY").when(has("noesy"), "NOESY").when(has("roesy"), "ROESY")
    )


def nucleus(label: Column) -> Column:
    """Plain nucleus of ``^1H`` or ``<1H>``."""
    return F.regexp_replace(F.regexp_replace(F.trim(label), r"^\^+", ""), "^<(.*)>$", "$1")


def ppm(offset: Column, width_hz: Column, frequency: Column, i: Column, n: Column, last_inclusive: bool = True) -> Column:
    """ppm of point i: ``offset - i * (width / frequency) / (n - 1)``, or ``/ n``."""
    steps = n - 1 if last_inclusive else n
    return offset - i * ((width_hz / frequency) / steps.cast("double"))


def axis_fault(nucleus_: Column, low: Column, high: Column, first: Column, last: Column) -> Column:
    """``implausible``, ``not descending`` or null."""
    bounds = F.create_map(*(x for k, (a, b) in AXIS_BOUNDS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")))))
    wide = F.struct(F.lit(WIDE_BOUNDS[0]).alias("lo"), F.lit(WIDE_BOUNDS[1]).alias("hi"))
    bound = F.coalesce(bounds[nucleus_], wide)
    return F.when((low < bound["lo"]) | (high > bound["hi"]), "implausible").when(~(first > last), "not descending")


def multiplicity_compatible(a: Column, b: Column) -> Column:
    """Null, equal, both ambiguous, or a component of an ambiguous one."""
    slash = lambda c: F.contains(c, F.lit("/"))
    return (
        F.when(a.isNull() | b.isNull() | (a == b), True).when(slash(a) & slash(b), True)
        .when(slash(a), F.array_contains(F.split(a, "/"), b)).when(slash(b), F.array_contains(F.split(b, "/"), a)).otherwise(False)
    )


def dominant_state(sp3: Column, sp2: Column, sp1: Column) -> Column:
    """Most frequent hybridisation; sp3 before sp2 before sp1."""
    top = F.greatest(sp3, sp2, sp1)
    return F.when(top == 0, "unknown").when(sp3 == top, "sp3").when(sp2 == top, "sp2").otherwise("sp1")


def is_definitive(sp3: Column, sp2: Column, sp1: Column) -> Column:
    return F.greatest(sp3, sp2, sp1) > 0.95


def dominant_element(*frequencies: Column) -> Column:
    """First of NEIGHBOURS with the highest frequency; null if all are zero."""
    top = F.greatest(*frequencies)
    out = F.when(top == 0, F.lit(None).cast("string"))
    for name, f in zip(NEIGHBOURS, frequencies, strict=True):
        out = out.when(f == top, name)
    return out


def constraint_class(frequency: Column, forbidden: float = 0.01, mandatory: float = 0.95) -> Column:
    return F.when(frequency < forbidden, "forbidden").when(frequency > mandatory, "mandatory").otherwise("typical")


def shift_region(shift_c: Column) -> Column:
    """Class of a carbon shift."""
    return (
        F.when(shift_c > 16000, "carbonyl/heteroaromatic").when(shift_c >= 10000, "aromatic").when(shift_c >= 5000, "oxygenated aliphatic")
        .when(shift_c >= 2500, "aliphatic CH/CH2").otherwise("aliphatic CH3")
    )


def hydrogens(mult: Column, shift_c: Column, default: int = 2) -> Column:
    """Hydrogens of a multiplicity; CH/CH3 is judged by shift."""
    ambiguous = F.when(shift_c < 3000, 3).when(shift_c > 10000, 1).otherwise(default)
    return F.when(mult == "CH/CH3", ambiguous).when(mult == "CH", 1).when(mult == "CH2", 2).when(mult == "CH3", 3).otherwise(0).cast("bigint")


def mae_label(mae: Column) -> Column:
    """Quality of a mean absolute error in ppm (P20)."""
    return F.when(mae < 2.0, "Excellent").when(mae < 3.5, "Good").when(mae < 5.0, "Moderate").otherwise("Poor")


def signed_hint(intensity: Column, edited: Column) -> Column:
    """(sign, hint) of a signed peak (P25)."""
    sign = F.when(~edited, "ambiguous").when(intensity >= 0, "positive").otherwise("negative")
    hint = F.when(~edited, "CH_or_CH2_or_CH3").when(intensity >= 0, "CH_or_CH3").otherwise("CH2")
    return F.struct(sign.alias("sign"), hint.alias("hint"))


def coupling_label(path: Column) -> Column:
    """Coupling over ``path`` bonds plus one, such as ³J_CH."""
    signs = F.create_map(*(x for k, v in {2: "²", 3: "³", 4: "⁴", 5: "⁵", 6: "⁶"}.items() for x in (F.lit(k).cast("bigint"), F.lit(v))))
    n = path.cast("bigint") + 1
    return F.when(path.isNull(), "?J_CH").otherwise(F.concat(F.coalesce(F.try_element_at(signs, n), n.cast("string")), F.lit("J_CH")))


def expected_samples(mode: Column, points: Column) -> Column:
    """Points of a real mode, half as many of a complex one, null of an unknown one."""
    return F.when(mode.isin(*REAL_MODES), points).when(mode.isin(*COMPLEX_MODES), F.expr("0") + F.floor(points / 2)).cast("bigint")


def rank_verdict(rank: Column, reported: Column) -> Column:
    """Text of an outcome: no result, missed, rank 1, top 10 or found."""
    r = rank.cast("string")
    return F.when(~reported, "no result").when(rank == 0, "missed").when(rank == 1, "**rank 1**").when(rank <= 10, F.concat(F.lit("top 10 (rank "), r, F.lit(")"))).otherwise(F.concat(F.lit("found (rank "), r, F.lit(")")))


def rank_quality(rank: Column, reported: Column) -> Column:
    """Higher is better."""
    return F.when(~reported, 0).when(rank == 0, 1).otherwise(1000 - rank).cast("bigint")


def verdict_confidence(verdict: Column) -> Column:
    """high, low, or pending_qc without a verdict; null for FAIL, which is never consumed."""
    return F.when(verdict.isNull(), "pending_qc").when(verdict == "PASS", "high").when(verdict == "PARTIAL", "low")


def verdict_note(verdict: Column, violated: Column, backend: Column) -> Column:
    """Note on a peak from the verdict and the array of violated checks."""
    start = F.concat(F.lit("reconstructed via "), backend)
    return (
        F.when(verdict.isNull(), F.concat(start, F.lit("; QC verdict not yet available"))).when(verdict == "PASS", F.concat(start, F.lit("; QC verdict PASS")))
        .otherwise(F.concat(start, F.lit("; QC verdict PARTIAL (violated: "), F.array_join(violated, ", "), F.lit(")")))
    )


def verdict_caveat(verdict: Column, violated: Column, backend: Column) -> Column:
    start = F.concat(F.lit("Reconstructed via "), backend, F.lit(". "))
    tail = F.when(F.size(violated) > 0, F.concat(F.lit(" Violated checks: "), F.array_join(violated, ", "), F.lit("."))).otherwise("")
    return F.when(verdict.isNull(), F.concat(start, F.lit("QC verdict not yet available."))).otherwise(F.concat(start, F.lit("QC verdict: "), verdict, F.lit("."), tail))


def levels(floor: Column, count: int = 8, factor: float = 1.4) -> Column:
    """Geometric ladder of ``count`` levels from ``floor``."""
    return F.array(*(floor * F.lit(factor**k) for k in range(count)))


def dept_class(intensity: Column) -> Column:
    """CH/CH3 for positive peaks, CH2 for others."""
    return F.when(intensity > 0, "CH/CH3").otherwise("CH2")
