"""Rankings, score cards and solution merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.functions.scoring import ratio

c = F.col


def _ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))


def rank_matches(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Candidates by score, then mean deviation, then id; none matched comes last."""
    mean_dev = F.when(c("matched") > 0, ratio(c("dev_c"), c("matched"))).otherwise(float("inf"))
    ranked = _ranked(scored, ["formula_norm"], c("score").desc(), mean_dev, c("id")).withColumn("is_match", c("score") >= 0.7)
    return ranked if top is None else ranked.where(c("rank") <= top)


def plausible(candidates: DataFrame, experimental: DataFrame, on: str) -> DataFrame:
    """Candidates with ``is_plausible``: aromatic if four shifts call for it, unsaturation within one.

    ``candidates``: has_aromatic, dbe; ``experimental``: shift_c and expected dbe.
    """
    asked = experimental.groupBy(on).agg(F.count_if(c("shift_c").between(11000, 16000)).alias("aromatic_shifts"), F.first("expected_dbe").alias("expected_dbe"))
    fine = ~((c("aromatic_shifts") >= 4) & ~c("has_aromatic")) & ~(F.abs(c("dbe") - c("expected_dbe")) > 1)
    return candidates.join(asked, on).withColumn("is_plausible", fine)


def rank_candidates(candidates: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Plausible ones by matches and error, the others behind them in input order.

    Candidates without a prediction are skipped and counted.
    """
    usable = candidates.where(c("predicted") > 0)
    ranked = _ranked(
        usable, [by], c("is_plausible").desc(), F.when(c("is_plausible"), -c("matched")), F.when(c("is_plausible"), c("mae")), c("input_order")
    )
    skipped = candidates.groupBy(by).agg(F.count_if(c("predicted") <= 0).alias("skipped"))
    ranked = ranked.join(skipped, by)
    return ranked if top is None else ranked.where(c("rank") <= top)


def rank_fragments(matches: DataFrame, limit: int | None = None, min_atoms: int = 3) -> DataFrame:
    """Fragments of a query by size, then mean deviation; ranked before the limit."""
    ranked = _ranked(matches.where(c("atom_count") >= min_atoms), ["query_id"], c("atom_count").desc(), ratio(c("dev_c"), c("n")), c("fragment_id"))
    return ranked if limit is None else ranked.where(c("rank") <= limit)


def rank_in_carbon(peaks: DataFrame, tolerance: int = 50) -> DataFrame:
    """Rank by intensity among the peaks of one rounded carbon shift."""
    bucket = F.rint(c("f1_c").cast("double") / F.lit(float(tolerance))).cast("bigint")
    return _ranked(peaks.withColumn("bucket", bucket), ["list_id", "bucket"], F.abs("intensity").desc(), c("peak_id"), name="rank_in_carbon")


def relative_intensity(peaks: DataFrame, by: list[str]) -> DataFrame:
    """Share of the list's largest absolute intensity; 0 where all are 0."""
    top = F.max(F.abs("intensity")).over(W.partitionBy(*by))
    return peaks.withColumn("rel_intensity", ratio(F.abs("intensity"), F.when(top == 0, 1).otherwise(top)))


def merge_solutions(runs: DataFrame) -> DataFrame:
    """Distinct solutions by key over runs with ordered provenance.

    ``runs``: problem, cand_key, run, idx, smiles.
    """
    order = F.struct("run", "idx")
    return runs.groupBy("problem", "cand_key").agg(
        F.min_by("smiles", order).alias("smiles"), F.sort_array(F.collect_list(order)).alias("provenance"), F.count("*").alias("raw"), F.min(order).alias("_first")
    )


def grade(candidates: DataFrame, truth: DataFrame, depth: int = 25) -> DataFrame:
    """Rank of the first candidate with the true key among the first ``depth``; 0 if there is none, null without a report."""
    hits = truth.join(candidates.where(c("rank") <= depth), "problem", "left")
    return hits.groupBy("problem", "true_key").agg(
        F.when(F.count("rank") == 0, F.lit(None)).otherwise(F.coalesce(F.min(F.when(c("cand_key") == c("true_key"), c("rank"))), F.lit(0))).cast("bigint").alias("hit_rank"),
        F.min_by("cand_key", "rank").alias("top_key"),
    )


def scorecard(graded: DataFrame, by: str) -> DataFrame:
    """Tallies of an arm: runs, rank 1, top 10, found, missed, no report."""
    r = c("hit_rank")
    return graded.groupBy(by).agg(
        F.count("*").alias("runs"), F.count_if(r == 1).alias("rank1"), F.count_if((r >= 1) & (r <= 10)).alias("top10"), F.count_if(r >= 1).alias("found"), F.count_if(r == 0).alias("missed"), F.count_if(r.isNull()).alias("no_report")
    )


def latest_by_label(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several sources with one label, the later one's row."""
    rest = [x for x in runs.columns if x not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def size_band(heavy: Column) -> Column:
    """Size band of a case."""
    return F.when(heavy <= 15, "<=15").when(heavy <= 20, "16-20").when(heavy <= 25, "21-25").otherwise(">=26")


def mcnemar(wins: Column, losses: Column) -> Column:
    """Exact two-sided McNemar probability of discordant counts."""
    n, k = wins + losses, F.least(wins, losses)

    def term(acc: Column, i: Column) -> Column:
        # running binomial coefficient over 2^n
        p = F.when(i == 0, F.pow(F.lit(0.5), n.cast("double"))).otherwise(acc["p"] * (n - i + 1).cast("double") / i.cast("double"))
        return F.struct(p.alias("p"), (acc["s"] + p).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("s")), term, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail * 2))


def paired_arms(a: DataFrame, b: DataFrame, by: str = "problem") -> DataFrame:
    """Cases in both arms: both, only-a and only-b successes and the McNemar probability."""
    both = a.select(by, (F.coalesce("hit_rank", F.lit(0)) == 1).alias("x")).join(b.select(by, (F.coalesce("hit_rank", F.lit(0)) == 1).alias("y")), by)
    counts = both.agg(F.count("*").alias("n"), F.count_if(c("x")).alias("a_rank1"), F.count_if(c("y")).alias("b_rank1"), F.count_if(c("x") & ~c("y")).alias("wins"), F.count_if(~c("x") & c("y")).alias("losses"))
    return counts.withColumn("p_value", mcnemar(c("wins"), c("losses")))
