"""Intensity reports, hydrogen budgets, symmetry, atom completion and problem checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.functions.formula import element_count
from resonara.functions.scoring import hydrogens, ratio

from .joins import band_join

c = F.col

#: Hybridisation and hydrogens of heteroatoms of a formula: fixed values.
HETERO_DEFAULTS = {"N": ("sp3", 1), "S": ("sp3", 0), "P": ("sp3", 0), "Cl": ("sp3", 0), "Br": ("sp3", 0), "F": ("sp3", 0), "I": ("sp3", 0)}


def intensity_report(peaks: DataFrame, mults: DataFrame, limit: float = 1.5, tolerance: int = 100) -> DataFrame:
    """Carbon buckets of 0.1 ppm: summed intensity, mean proton, share of the weakest bucket, flag."""
    bucket = F.rint(c("f1_c").cast("double") / F.lit(10.0)).cast("bigint")
    sums = peaks.withColumn("bucket", bucket).groupBy("list_id", "bucket").agg(F.sum("intensity").alias("total"), ratio(F.sum("f2_c"), F.count("*")).alias("proton_c"))
    least = F.min("total").over(W.partitionBy("list_id"))
    rated = sums.withColumn("relative", ratio(c("total"), F.when(least <= 0, 1).otherwise(least))).withColumn("at_c", c("bucket") * 10)
    hits = band_join(rated.select("list_id", "bucket", "at_c"), mults.select("list_id", c("pos_c").alias("_p"), c("mult").alias("_mult"), c("peak_id").alias("_order")), "at_c", "_p", tolerance, ["list_id"])
    first = hits.groupBy("list_id", "bucket").agg(F.min(F.struct("_order", "_mult")).getField("_mult").alias("mult"))
    return rated.join(first, ["list_id", "bucket"], "left").select("list_id", "bucket", "total", "proton_c", "relative", (c("relative") > limit).alias("doubled"), "mult")


def hydrogen_budget(formulas: DataFrame, mults: DataFrame) -> DataFrame:
    """Hydrogens of the formula against those of carbons and heteroatoms."""
    carbon = mults.groupBy("list_id").agg(F.sum(hydrogens(c("mult"), c("pos_c"))).alias("carbon_h"), F.count("*").alias("signals"))
    o, n = element_count(c("formula_norm"), "O"), element_count(c("formula_norm"), "N")
    hetero = F.when(o == 0, 0).when(o <= 2, 1).otherwise(F.expr("0") + F.floor((o + 1) / 2)) + n
    found = formulas.join(carbon, "list_id").withColumns({"expected_h": element_count(c("formula_norm"), "H"), "hetero_h": hetero.cast("bigint")})
    return found.withColumn("missing_h", c("expected_h") - c("carbon_h") - c("hetero_h"))


def symmetry(formulas: DataFrame, mults: DataFrame, peaks: DataFrame) -> DataFrame:
    """Missing carbons, overcount alarm and hints from budget and intensities."""
    report = intensity_report(peaks, mults)
    at = c("bucket") * 10
    hints = report.where("doubled").groupBy("list_id").agg(
        (F.count_if(at.between(10000, 16000)) == 2).alias("para_hint"), (F.count_if(c("mult").isin("CH3", "CH/CH3") & (at < 4000)) > 0).alias("methyl_hint")
    )
    budget = hydrogen_budget(formulas, mults).withColumn("missing_c", element_count(c("formula_norm"), "C") - c("signals"))
    joined = budget.join(hints, "list_id", "left")
    no = F.lit(False)
    return joined.select(
        "list_id", "signals", "missing_c", "missing_h", (c("missing_c") < 0).alias("overcount_alarm"), F.greatest(F.lit(0), -c("missing_c")).alias("excess"),
        ((c("missing_c") > 0) | (c("missing_h") > 0)).alias("has_symmetry"), ((c("missing_c") > 0) & F.coalesce("para_hint", no)).alias("para_hint"), ((c("missing_c") > 0) & F.coalesce("methyl_hint", no)).alias("methyl_hint"),
    )


def _repeat(df: DataFrame, n: Column) -> DataFrame:
    """Each row as often as ``n`` says, numbered ``k`` from 1."""
    return df.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))


def complete_atoms(carbons: DataFrame, formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms of a problem completed by its formula, and the carbonyl bonds.

    ``carbons``: list_id, atom_no (from 1, by falling shift), pos_c, h_count,
    hybridisation.  Unobserved carbons follow as sp2; each carbonyl carbon gets
    an sp2 oxygen; other oxygens take missing hydrogens one by one; the other
    heteroatoms have defaults.
    """
    carbonyl = (c("h_count") == 0) & (c("pos_c").between(16500, 18500) | c("pos_c").between(19000, 22000))
    seen = carbons.withColumns({"carbonyl": carbonyl, "hybridisation": F.when(carbonyl, "sp2").otherwise(c("hybridisation"))})
    facts = seen.groupBy("list_id").agg(F.count("*").alias("seen"), F.sum("h_count").alias("carbon_h"), F.count_if("carbonyl").alias("carbonyls"))
    count = lambda e: element_count(c("formula_norm"), e)
    facts = formulas.join(facts, "list_id").withColumns({"missing_c": F.greatest(F.lit(0), count("C") - c("seen")), "o": count("O"), "missing_h": count("H") - c("carbon_h")}).withColumn("double_o", F.least("carbonyls", "o"))
    offset = c("seen") + c("missing_c")
    first = seen.select("list_id", "atom_no", F.lit("C").alias("element"), "hybridisation", "h_count")
    unseen = _repeat(facts, c("missing_c")).select("list_id", (c("seen") + c("k")).alias("atom_no"), F.lit("C").alias("element"), F.lit("sp2").alias("hybridisation"), F.lit(0).cast("bigint").alias("h_count"))
    oxygen = _repeat(facts, c("o")).select(
        "list_id", (offset + c("k")).alias("atom_no"), F.lit("O").alias("element"), F.when(c("k") <= c("double_o"), "sp2").otherwise("sp3").alias("hybridisation"),
        F.when((c("k") > c("double_o")) & (c("k") - c("double_o") <= c("missing_h")), 1).otherwise(0).cast("bigint").alias("h_count"),
    )
    out = first.unionByName(unseen).unionByName(oxygen)
    base = offset + c("o")
    for element, (hybridisation, h) in HETERO_DEFAULTS.items():
        n = count(element)
        out = out.unionByName(_repeat(facts.withColumn("_n", n), c("_n")).select("list_id", (base + c("k")).alias("atom_no"), F.lit(element).alias("element"), F.lit(hybridisation).alias("hybridisation"), F.lit(h).cast("bigint").alias("h_count")))
        base = base + n
    turn = F.row_number().over(W.partitionBy("list_id").orderBy("atom_no"))
    ordered = seen.where("carbonyl").withColumn("turn", turn).join(facts.select("list_id", "double_o", offset.alias("_offset")), "list_id").where("turn <= double_o")
    return out, ordered.select("list_id", c("atom_no").alias("atom1"), (c("_offset") + c("turn")).alias("atom2"))


def add_equivalences(correlations: DataFrame, families: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bonds of each parent with its two children; aromatic pairs the correlations lack."""
    bonds = families.select("list_id", c("parent").alias("atom1"), F.explode(F.array("child1", "child2")).alias("atom2"))
    key = lambda df: df.select("list_id", F.least("atom1", "atom2").alias("lo"), F.greatest("atom1", "atom2").alias("hi"))
    there = key(correlations.where("kind = 'COSY'"))
    added = key(pairs).distinct().join(there, ["list_id", "lo", "hi"], "left_anti")
    return bonds, added


def problem_faults(atoms: DataFrame, correlations: DataFrame, formulas: DataFrame) -> DataFrame:
    """Faults of each problem: carbon count, duplicate atoms, dangling references, atoms without correlations."""
    counts = atoms.groupBy("list_id").agg(F.count("*").alias("atoms"), F.countDistinct("atom_no").alias("distinct_atoms"), F.count_if(c("element") == "C").alias("carbons"))
    known = atoms.select("list_id", "atom_no").distinct()
    refs = correlations.select("list_id", c("atom1").alias("atom_no"))
    dangling = refs.join(known, ["list_id", "atom_no"], "left_anti").groupBy("list_id").agg(F.count("*").alias("dangling"))
    lonely = known.join(refs.distinct(), ["list_id", "atom_no"], "left_anti").groupBy("list_id").agg(F.count("*").alias("uncorrelated"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    joined = counts.join(formulas, "list_id").join(dangling, "list_id", "left").join(lonely, "list_id", "left")
    return joined.select(
        "list_id", (element_count(c("formula_norm"), "C") != c("carbons")).alias("carbon_mismatch"), (c("atoms") != c("distinct_atoms")).alias("duplicate_atoms"), zero("dangling").alias("dangling"), zero("uncorrelated").alias("uncorrelated"), "carbons", (c("atoms") - c("carbons")).alias("hetero")
    )


def verify_candidates(candidates: DataFrame, formulas: DataFrame, by: str, top: int = 3, aromatic_atoms: int = 6) -> DataFrame:
    """Whether one of the first candidates has the exact formula and enough aromatic atoms."""
    order = W.partitionBy(by).orderBy("rank")
    first = candidates.withColumn("_n", F.row_number().over(order)).where(c("_n") <= top).join(formulas, by)
    return first.groupBy(by).agg(F.bool_or((c("aromatic_atoms") >= aromatic_atoms) & (c("formula") == c("expected_formula"))).alias("passed"))


def pending(cases: DataFrame, attempts: DataFrame, contaminated: DataFrame, floor: int = 600) -> DataFrame:
    """Cases without a report or a long attempt and not contaminated, in natural order."""
    done = attempts.where(c("has_report") | (F.coalesce("runtime_s", F.lit(0)) >= floor)).select("case")
    return cases.join(done, "case", "left_anti").join(contaminated, "case", "left_anti").orderBy(F.length("case"), "case")


def import_summary(rows: DataFrame, errors: Column, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(counts imported and skipped, the first errors)."""
    judged = rows.withColumn("error", errors)
    counts = judged.agg(F.count_if(c("error").isNull()).alias("imported"), F.count_if(c("error").isNotNull()).alias("skipped"))
    return counts, judged.where("error IS NOT NULL").limit(most)


def warehouse_info(compounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, counts by source, largest first)."""
    totals = compounds.agg(F.count("*").alias("compounds"), F.countDistinct("formula_norm").alias("formulas"), F.max("id").alias("last_id"))
    return totals, compounds.groupBy("source").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "source")


def source_rollup(compounds: DataFrame) -> DataFrame:
    """Counts by source and formula with subtotals (option of S21)."""
    return compounds.rollup("source", "formula_norm").agg(F.count("*").alias("n"))


def first_fragments(fragments: DataFrame) -> DataFrame:
    """Of a compound's fragments with one key, the atom-centred one before the ring-centred."""
    order = W.partitionBy("compound_id", "key").orderBy(F.when(c("kind") == "atom", 0).otherwise(1), "pos", "radius")
    return fragments.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ordered_mentions(reports: DataFrame, by: str) -> DataFrame:
    """Distinct candidates of free-text reports, those of "top" lines first, in order of first mention.

    ``reports``: line_no, line.
    """
    low = F.lower("line")
    top = F.contains(low, F.lit("smiles")) | F.contains(low, F.lit("rank 1")) | F.contains(low, F.lit("top")) | F.rlike("line", F.lit(r"^\s*\|?\s*1\s*\|"))
    tokens = F.transform(F.concat(F.regexp_extract_all("line", F.lit("`([^`]+)`"), 1), F.split("line", r"\|"), F.split("line", r"\s+")), lambda t: F.regexp_replace(F.trim(F.translate(F.trim(t), "`*", "")), "[.,;]+$", ""))
    valid = lambda t: F.rlike(t, F.lit(r"^[A-Za-z0-9@\[\]()=#+\\/.\-]{4,}$")) & F.rlike(t, F.lit("[CNOcno]")) & F.rlike(t, F.lit(r"[()=#\[]"))
    found = reports.select(by, top.alias("top"), "line_no", F.posexplode(tokens).alias("at", "token")).where(valid(c("token")))
    first = found.groupBy(by, "token").agg(F.min(F.struct((~c("top")).alias("later"), c("line_no"), c("at"))).alias("first"))
    return first.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy("first")).cast("bigint")).select(by, "token", "position")
