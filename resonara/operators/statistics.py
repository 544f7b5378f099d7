"""Statistics tables: mergeable moments, counters and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonara.functions import scoring
from resonara.functions.scoring import NEIGHBOURS, ratio

from .joins import band_join

c = F.col

#: Boolean observation columns and the counters they feed.
COUNTERS = {"has_c": "carbon", "has_o": "oxygen", "has_n": "nitrogen", "has_s": "sulfur", "has_x": "halogen", "ring3": "ring3", "ring4": "ring4", "aromatic": "aromatic"}
STATES = ("sp3", "sp2", "sp1")
STATE_COLUMNS = ("n", "sum_c", "sumsq_c", *STATES, *COUNTERS.values())


def _spread_c() -> Column:
    """n * sum of squares - square of the sum, exact."""
    exact = lambda x: c(x).cast("decimal(19,0)")
    return (exact("n") * exact("sumsq_c") - exact("sum_c") * exact("sum_c")).cast("double")


def mean() -> Column:
    """Mean in ppm of a state."""
    return ratio(c("sum_c"), c("n")) / F.lit(100.0)


def population_std() -> Column:
    return F.sqrt(_spread_c()) / c("n").cast("double") / F.lit(100.0)


def sample_std() -> Column:
    """Sample deviation in ppm; 0 for one observation."""
    return F.when(c("n") > 1, F.sqrt(_spread_c() / (c("n").cast("double") * (c("n") - 1).cast("double"))) / F.lit(100.0)).otherwise(0.0)


def env_counters() -> list[Column]:
    """Conditional counters of observations (A3)."""
    return [F.count_if(c("state") == s).alias(s) for s in STATES] + [F.count_if(c(k)).alias(v) for k, v in COUNTERS.items()]


def env_state(obs: DataFrame) -> DataFrame:
    """Mergeable state of each (code, radius): count, exact sums and counters (A2)."""
    return obs.groupBy("code", "radius").agg(F.count("*").alias("n"), F.sum("shift_c").alias("sum_c"), F.sum(c("shift_c") * c("shift_c")).alias("sumsq_c"), *env_counters())


def env_stats(state: DataFrame) -> DataFrame:
    """Mean with sample and population deviation of each state (A1)."""
    return state.select("code", "radius", mean().alias("mean"), sample_std().alias("std_sample"), population_std().alias("std_population"), "n")


def merge_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two states (A2); columns that one side lacks count as zero."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("code", "radius").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in STATE_COLUMNS))


def merge_into(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """The statistics table after a delta (A4)."""
    return merge_state(stats, delta)


def replace_into(table: DataFrame, rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write by ``seq`` wins for each key (A5); rows of the table come first."""
    columns = [x for x in table.columns if x not in key]
    both = table.withColumn("_age", F.lit(0)).unionByName(rows.withColumn("_age", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("_age", seq)).alias("r")).select(*key, "r.*")


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts inserted and skipped): the first by ``seq`` of each key the table lacks."""
    columns = [x for x in rows.columns if x not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(F.col(seq).alias("_seq"), F.struct(*columns).alias("r")))["r"].alias("r"), F.count("*").alias("_n"))
    judged = first.join(table.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left")
    new = c("_there").isNull()
    counts = judged.agg(F.count_if(new).alias("inserted"), F.coalesce(F.sum(c("_n") - F.when(new, 1).otherwise(0)), F.lit(0)).alias("skipped"))
    return judged.where(new).select(*key, "r.*"), counts


def _around(probes: DataFrame, stats: DataFrame, radius: int, window: int, min_count: int) -> DataFrame:
    """Statistics of one radius whose mean is within the window of each probe."""
    near = stats.where((c("radius") == radius) & (c("n") >= min_count)).withColumn("mean_c", ratio(c("sum_c"), c("n")))
    return band_join(probes, near, "shift_c", "mean_c", window)


def detect_state(probes: DataFrame, stats: DataFrame, radius: int = 3, window: int = 200, threshold: float = 0.01, min_count: int = 5) -> DataFrame:
    """Hybridisation shares around each probe (A7): rare ones dropped, the rest renormalised."""
    sums = _around(probes, stats, radius, window, min_count).groupBy("probe_id").agg(*(F.sum(s).alias(s) for s in STATES), F.count("*").alias("codes"))
    total = c("sp3") + c("sp2") + c("sp1")
    raw = {s: F.when(ratio(c(s), c("total")) < threshold, 0.0).otherwise(ratio(c(s), c("total"))) for s in STATES}
    shares = probes.select("probe_id").join(sums.withColumn("total", total), "probe_id", "left").select(
        "probe_id", F.coalesce("codes", F.lit(0)).alias("codes"), F.coalesce("total", F.lit(0)).alias("total"), *(F.when(c("total") > 0, raw[s]).otherwise(0.0).alias(s) for s in STATES)
    )
    kept = c("sp3") + c("sp2") + c("sp1")
    normal = shares.withColumn("kept", kept).select("probe_id", "codes", "total", *(F.when(c("kept") > 0, c(s) / c("kept")).otherwise(0.0).alias(s) for s in STATES))
    three = [c(s) for s in STATES]
    return normal.withColumns({"state": scoring.dominant_state(*three), "definitive": scoring.is_definitive(*three), "has_data": c("total") > 0})


def detect_neighbours(probes: DataFrame, stats: DataFrame, radius: int = 3, window: int = 200, forbidden: float = 0.01, mandatory: float = 0.95, min_count: int = 5) -> DataFrame:
    """Neighbour shares around each probe, a row an element (A8); ``unpopulated`` where all are zero."""
    sums = _around(probes, stats, radius, window, min_count).groupBy("probe_id").agg(F.sum("n").alias("total"), *(F.sum(e).alias(e) for e in NEIGHBOURS))
    rows = sums.select("probe_id", "total", F.greatest(*NEIGHBOURS).alias("top"), F.expr("stack(5, " + ", ".join(f"'{e}', {e}" for e in NEIGHBOURS) + ") AS (element, k)"))
    share = ratio(c("k"), c("total"))
    return rows.select("probe_id", "element", share.alias("frequency"), scoring.constraint_class(share, forbidden, mandatory).alias("class"), "total", (c("top") == 0).alias("unpopulated"))


def pair_stats(atoms: DataFrame, bonds: DataFrame, compounds: DataFrame) -> DataFrame:
    """Compounds with each hetero-hetero pair, by formula, over all compounds of the formula."""
    from .graphs import hetero_pairs

    formulas = compounds.join(atoms.select(c("compound_id").alias("id")).distinct(), "id").select("id", "formula_norm")
    totals = formulas.groupBy("formula_norm").agg(F.count("*").alias("total"))
    pairs = hetero_pairs(atoms, bonds).join(formulas.withColumnRenamed("id", "compound_id"), "compound_id")
    counts = pairs.groupBy("formula_norm", "element1", "element2").agg(F.count("*").alias("n"))
    return counts.join(totals, "formula_norm").withColumn("frequency", ratio(c("n"), c("total")))


def detect_pairs(formulas: DataFrame, stats: DataFrame, compounds: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Pairs of each formula with ``allowed``; formulas without pairs get one row that says why (A10)."""
    known = compounds.groupBy("formula_norm").agg(F.count("*").alias("compounds"))
    hetero = F.rlike("formula_norm", F.lit("N|O|S|F|Cl|Br|I|P|Si"))
    found = formulas.join(known, "formula_norm", "left").join(stats.drop("total"), "formula_norm", "left")
    case = F.when(~hetero, "no_heteroatom").when(c("compounds").isNull(), "unknown_formula").when(c("n").isNull(), "no_pairs").otherwise("pairs")
    return found.select("formula_norm", case.alias("case"), F.coalesce("compounds", F.lit(0)).alias("compounds"), "element1", "element2", "frequency", (c("frequency") >= threshold).alias("allowed"))


def code_stats(obs: DataFrame) -> DataFrame:
    """Median, mean, sample deviation, range and count of each code."""
    from .ranges import medians

    state = obs.groupBy("code", "radius").agg(
        F.count("*").alias("n"), F.sum("shift_c").alias("sum_c"), F.sum(c("shift_c") * c("shift_c")).alias("sumsq_c"), F.min("shift_c").alias("min_c"), F.max("shift_c").alias("max_c")
    ).join(medians(obs, ["code", "radius"], "shift_c").select("code", "radius", c("median").alias("median_c")), ["code", "radius"])
    return state.select("code", "radius", (c("median_c") / F.lit(100.0)).alias("median"), mean().alias("mean"), sample_std().alias("std"), "min_c", "max_c", "n")


def build_code_table(obs: DataFrame, max_radius: int = 6) -> tuple[DataFrame, DataFrame]:
    """(code table with all shifts of a code, counters of molecules, entries and codes)."""
    used = obs.where(c("radius") <= max_radius)
    table = used.groupBy("code", "radius").agg(F.sort_array(F.collect_list("shift_c")).alias("shifts_c"))
    return table, used.agg(F.countDistinct("compound_id").alias("molecules"), F.count("*").alias("entries"), F.countDistinct("code", "radius").alias("codes"))


def prediction_record(max_radius: int = 6) -> Column:
    """Struct of shift, bounds, count, radius and confidence of a state."""
    std = population_std()
    return F.struct(
        mean().alias("shift"), (mean() - std).alias("low"), (mean() + std).alias("high"), c("n"), c("radius"),
        F.round(scoring.confidence(c("radius"), c("n"), std, max_radius), 3).alias("confidence"),
    )
