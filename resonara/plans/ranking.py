"""Queries over rankings, merges and score cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.functions import scoring
from resonara.operators import analysis, joins, ranking

from .catalog import query

c = F.col

#: Candidates are compounds of a customer's formula; their signals stand for predictions.
_CAND = "SELECT id, cust, formula_norm, cust % 4 = 0 AS has_aromatic, id % 6 AS dbe, CASE WHEN id % 17 = 0 THEN 0 ELSE 1 END AS usable FROM {compound}"
_ERRORS = "SELECT s.compound_id AS id, s.pos, s.shift_c, min(abs(s.shift_c - o.shift_c)) AS e FROM {signal} s JOIN {compound} k ON k.id = s.compound_id JOIN {observed} o ON o.formula_norm = k.formula_norm GROUP BY ALL"
_RANKED = f"""WITH k AS ({_CAND}), e AS (SELECT id, count(*) AS predicted, count(*) FILTER (e <= 300) AS matched, sum(e)::DOUBLE / count(*)::DOUBLE AS mae FROM ({_ERRORS}) x GROUP BY id),
    o AS (SELECT formula_norm, count(*) FILTER (shift_c BETWEEN 11000 AND 16000) AS aromatic FROM {{observed}} GROUP BY formula_norm),
    j AS (SELECT k.*, predicted * usable AS predicted, matched, mae, NOT (aromatic >= 4 AND NOT has_aromatic) AND NOT abs(dbe - 3) > 1 AS is_plausible FROM k JOIN e ON e.id = k.id JOIN o ON o.formula_norm = k.formula_norm)"""


def _candidates(v):
    predicted = v.signal.join(v.compound.select(c("id").alias("compound_id"), "formula_norm"), "compound_id").select("formula_norm", "compound_id", c("pos").alias("atom"), "shift_c")
    errors = joins.nearest_join(predicted, v.observed, ["formula_norm"], ["compound_id", "atom"], 300)
    scored = errors.groupBy(c("compound_id").alias("id")).agg(F.count("*").alias("n"), F.count_if("is_matched").alias("matched"), scoring.ratio(F.sum("error_c"), F.count("*")).alias("mae"))
    joined = v.sql(_CAND).join(scored, "id").withColumn("predicted", c("n") * c("usable")).drop("n")
    return ranking.plausible(joined, v.observed.withColumn("expected_dbe", F.lit(3)), "formula_norm")


@query("F6_plausible", f"{_RANKED} SELECT id, formula_norm, is_plausible FROM j")
def _(v):
    return _candidates(v).select("id", "formula_norm", "is_plausible")


@query(
    "W2_rank_candidates",
    f"{_RANKED} SELECT formula_norm, id, matched, mae, is_plausible, rank, (SELECT count(*) FROM j q WHERE q.formula_norm = r.formula_norm AND predicted = 0) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY formula_norm ORDER BY is_plausible DESC, CASE WHEN is_plausible THEN -matched END, CASE WHEN is_plausible THEN mae END, id) AS rank FROM j WHERE predicted > 0) r WHERE rank <= 20",
)
def _(v):
    ranked = ranking.rank_candidates(_candidates(v).withColumn("input_order", c("id")), "formula_norm", top=20)
    return ranked.select("formula_norm", "id", "matched", "mae", "is_plausible", "rank", "skipped")


@query("U7_ordered_union", f"{_RANKED} SELECT formula_norm, id, is_plausible, row_number() OVER (PARTITION BY formula_norm ORDER BY is_plausible DESC, id) AS place FROM j")
def _(v):
    judged = _candidates(v)
    tiers = judged.where("is_plausible").withColumn("tier", F.lit(0)).unionByName(judged.where("NOT is_plausible").withColumn("tier", F.lit(1)))
    from pyspark.sql import Window as W

    return tiers.select("formula_norm", "id", "is_plausible", F.row_number().over(W.partitionBy("formula_norm").orderBy("tier", "id")).cast("bigint").alias("place"))


_RUNS = "SELECT problem, cand_key, rank % 4 AS run, candidate_id AS idx, 'C' || cast(candidate_id AS string) AS smiles FROM {candidate}"


@query(
    "A25_merge_solutions",
    f"SELECT problem, cand_key, arg_min(smiles, struct_pack(r := run, i := idx)) AS smiles, count(*) AS raw, string_agg(run || ':' || idx, ' ' ORDER BY run, idx) AS provenance FROM ({_RUNS}) r GROUP BY problem, cand_key",
)
def _(v):
    merged = ranking.merge_solutions(v.sql(_RUNS))
    text = F.array_join(F.transform("provenance", lambda p: F.concat_ws(":", p["run"].cast("string"), p["idx"].cast("string"))), " ")
    return merged.select("problem", "cand_key", "smiles", "raw", text.alias("provenance"))


_GRADED = "SELECT t.problem, t.arm, t.heavy, CASE WHEN count(k.rank) = 0 THEN NULL ELSE coalesce(min(k.rank) FILTER (k.cand_key = t.true_key), 0) END AS hit_rank FROM {truth} t LEFT JOIN {candidate} k ON k.problem = t.problem AND k.rank <= 25 GROUP BY ALL"
_TALLY = "count(*) AS runs, count(*) FILTER (hit_rank = 1) AS rank1, count(*) FILTER (hit_rank BETWEEN 1 AND 10) AS top10, count(*) FILTER (hit_rank >= 1) AS found, count(*) FILTER (hit_rank = 0) AS missed, count(*) FILTER (hit_rank IS NULL) AS no_report"


def _graded(v):
    return ranking.grade(v.candidate, v.truth.select("problem", "true_key")).join(v.truth.select("problem", "arm", "heavy"), "problem")


@query("A28_scorecard", f"SELECT arm, {_TALLY} FROM ({_GRADED}) g GROUP BY arm")
def _(v):
    return ranking.scorecard(_graded(v), "arm")


@query("A28_verdicts", f"SELECT problem, arm, CASE WHEN hit_rank IS NULL THEN 'no result' WHEN hit_rank = 0 THEN 'missed' WHEN hit_rank = 1 THEN '**rank 1**' WHEN hit_rank <= 10 THEN 'top 10 (rank ' || hit_rank || ')' ELSE 'found (rank ' || hit_rank || ')' END AS verdict FROM ({_GRADED}) g")
def _(v):
    return _graded(v).select("problem", "arm", scoring.rank_verdict(c("hit_rank"), c("hit_rank").isNotNull()).alias("verdict"))


@query("A28_latest_by_label", "SELECT problem, run % 2 AS label, arg_max(cand_key, ord) AS cand_key FROM (SELECT problem, rank AS run, candidate_id AS ord, cand_key FROM {candidate}) r GROUP BY ALL")
def _(v):
    runs = v.candidate.select("problem", (c("rank") % 2).alias("label"), c("candidate_id").alias("ord"), "cand_key")
    return ranking.latest_by_label(runs, ["problem", "label"], "ord").select("problem", "label", "cand_key")


@query("A29_size_bands", f"SELECT CASE WHEN heavy <= 15 THEN '<=15' WHEN heavy <= 20 THEN '16-20' WHEN heavy <= 25 THEN '21-25' ELSE '>=26' END AS band, {_TALLY} FROM ({_GRADED}) g GROUP BY band")
def _(v):
    return ranking.scorecard(_graded(v).withColumn("band", ranking.size_band(c("heavy"))), "band")


@query(
    "A29_paired_arms",
    f"""WITH RECURSIVE a AS (SELECT problem, coalesce(hit_rank, 0) = 1 AS x, coalesce(hit_rank, 0) BETWEEN 1 AND 2 AND problem % 3 > 0 AS y FROM ({_GRADED}) g),
        n AS (SELECT count(*) AS n, count(*) FILTER (x) AS a_rank1, count(*) FILTER (y) AS b_rank1, count(*) FILTER (x AND NOT y) AS wins, count(*) FILTER (NOT x AND y) AS losses FROM a),
        t AS (SELECT 0::BIGINT AS i, 0.5::DOUBLE ** (wins + losses)::DOUBLE AS p, 0.5::DOUBLE ** (wins + losses)::DOUBLE AS s FROM n UNION ALL SELECT i + 1, p * (wins + losses - i)::DOUBLE / (i + 1)::DOUBLE, s + p * (wins + losses - i)::DOUBLE / (i + 1)::DOUBLE FROM t, n WHERE i < least(wins, losses))
        SELECT n.n, a_rank1, b_rank1, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT max(s) FROM t)) END, 12) AS p_value FROM n""",
)
def _(v):
    graded = _graded(v)
    second = graded.withColumn("hit_rank", F.when(c("hit_rank").between(1, 2) & (c("problem") % 3 > 0), 1).otherwise(0))
    return ranking.paired_arms(graded, second).withColumn("p_value", F.round("p_value", 12))


_REPORT = "CASE line % 4 WHEN 0 THEN '| 1 | `C' || part || '(=O)N` |' WHEN 1 THEN 'Top candidate: C' || part || '(=O)N, see CC' || part || '=O.' WHEN 2 THEN 'prose about NC' || (part % 50) || '=O and nothing else' ELSE 'none' END"


@query("W15_ordered_mentions")
def _(v):
    reports = v.item.select(c("ord").alias("case_id"), c("pos").alias("line_no"), F.expr(_REPORT.replace("|| part ||", "|| cast(part AS string) ||").replace("|| (part % 50) ||", "|| cast(part % 50 AS string) ||")).alias("line"))
    return analysis.ordered_mentions(reports, "case_id")


@query("J29_permutation_report", f"""WITH m AS (SELECT problem, cand_key, min(idx) AS idx, count(*) AS raw FROM ({_RUNS}) r GROUP BY problem, cand_key), e AS (SELECT id, count(*) AS predicted, count(*) FILTER (e <= 300) AS matched, sum(e)::DOUBLE / count(*)::DOUBLE AS mae FROM ({_ERRORS}) x GROUP BY id)
    SELECT problem, cand_key, raw, matched, rank FROM (SELECT m.problem, m.cand_key, m.raw, e.matched, row_number() OVER (PARTITION BY problem ORDER BY e.matched DESC, e.mae, m.idx) AS rank FROM m JOIN e ON e.id = m.idx) q""")
def _(v):
    merged = v.sql(_RUNS).groupBy("problem", "cand_key").agg(F.min("idx").alias("id"), F.count("*").alias("raw"))
    judged = _candidates(v).select("id", "matched", "mae", F.lit(1).alias("predicted"), F.lit(True).alias("is_plausible"))
    ranked = ranking.rank_candidates(merged.join(judged, "id").withColumn("input_order", c("id")), "problem")
    return ranked.select("problem", "cand_key", "raw", "matched", "rank")
