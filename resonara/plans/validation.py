"""Queries over peak cross-validation, quality checks and problem building (J7-J19, A13-A19, A30, A32, A33, F8-F11, S20, S21, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.operators import analysis, joins, peaks, qc

from .catalog import query

c = F.col

_NEAR = "SELECT p.list_id, p.peak_id, min(struct_pack(d := abs(p.f1_c - r.pos_c), i := r.peak_id)) AS b FROM {peak2d} p JOIN {peak1d} r ON r.list_id = p.list_id AND abs(p.f1_c - r.pos_c) <= 50 WHERE p.experiment = 'HSQC' GROUP BY p.list_id, p.peak_id"


def _hsqc(v):
    return v.peak2d.where("experiment = 'HSQC'")


def _numbered(v):
    return peaks.number_atoms(v.peak1d)


@query("J7_validate_f1", f"SELECT p.list_id, p.peak_id, b.i AS ref_id, b.d AS delta_c FROM {{peak2d}} p LEFT JOIN ({_NEAR}) n ON n.list_id = p.list_id AND n.peak_id = p.peak_id WHERE p.experiment = 'HSQC'")
def _(v):
    return joins.validate_f1(_hsqc(v), v.peak1d)[0].select("list_id", "peak_id", "ref_id", "delta_c")


@query("J7_unmatched_1d", f"SELECT list_id, peak_id FROM {{peak1d}} WHERE (list_id, peak_id) NOT IN (SELECT list_id, b.i FROM ({_NEAR}) n)")
def _(v):
    return joins.validate_f1(_hsqc(v), v.peak1d)[1].select("list_id", "peak_id")


@query("J7_match_rate", f"SELECT p.list_id, count(n.peak_id)::DOUBLE / count(*)::DOUBLE AS match_rate FROM {{peak2d}} p LEFT JOIN ({_NEAR}) n ON n.list_id = p.list_id AND n.peak_id = p.peak_id WHERE p.experiment = 'HSQC' GROUP BY p.list_id")
def _(v):
    return joins.validate_f1(_hsqc(v), v.peak1d)[2]


def _exists(refs: str, tolerance: int, peak: str = "p.f1_c", ref: str = "r.pos_c") -> str:
    return f"EXISTS (SELECT 1 FROM {refs} r WHERE r.list_id = p.list_id AND abs({peak} - {ref}) <= {tolerance})"


@query("J8_validate_both", f"SELECT list_id, peak_id, {_exists('{peak1d}', 5, 'p.f1_c', 'r.h_pos_c')} AND {_exists('{peak1d}', 5, 'p.f2_c', 'r.h_pos_c')} AS ok FROM {{peak2d}} p WHERE experiment = 'COSY'")
def _(v):
    return joins.validate_both(v.peak2d.where("experiment = 'COSY'"), v.peak1d).select("list_id", "peak_id", "ok")


@query("J9_filter_validated", f"SELECT list_id, peak_id FROM {{peak2d}} p WHERE experiment = 'HSQC' AND {_exists('{peak1d}', 50)}")
def _(v):
    return joins.filter_validated(_hsqc(v), v.peak1d).select("list_id", "peak_id")


@query(
    "J10_guided_filter",
    f"""SELECT list_id, peak_id, CASE WHEN cm AND hm THEN 'ok' WHEN NOT cm AND NOT hm THEN 'neither' WHEN NOT cm THEN 'no_carbon' ELSE 'no_proton' END AS verdict
        FROM (SELECT list_id, peak_id, {_exists('{peak1d}', 150)} AS cm, {_exists("(SELECT * FROM {peak2d} WHERE experiment = 'HSQC')", 10, 'p.f2_c', 'r.f2_c')} AS hm FROM {{peak2d}} p WHERE experiment = 'HMBC') x""",
)
def _(v):
    protons = _hsqc(v).select("list_id", c("f2_c").alias("pos_c"))
    return joins.guided_filter(v.peak2d.where("experiment = 'HMBC'"), v.peak1d.select("list_id", "pos_c"), protons).select("list_id", "peak_id", "verdict")


@query(
    "J11_merge_refs",
    """WITH RECURSIVE a AS (SELECT compound_id, list(shift_c ORDER BY pos) FILTER (pos % 2 = 0) AS base, list(shift_c ORDER BY pos) FILTER (pos % 2 = 1) AS extra FROM {signal} GROUP BY compound_id),
       f AS (SELECT compound_id, coalesce(base, []) AS acc, coalesce(extra, []) AS extra, 0 AS k FROM a
         UNION ALL SELECT compound_id, CASE WHEN len(list_filter(acc, lambda y: abs(y - extra[k + 1]) <= 1500)) > 0 THEN acc ELSE list_append(acc, extra[k + 1]) END, extra, k + 1 FROM f WHERE k < len(extra))
       SELECT compound_id, len(acc) AS n, list_sum(acc)::BIGINT AS total FROM f WHERE k = len(extra)""",
)
def _(v):
    ordered = v.signal.groupBy("compound_id").agg(F.array_sort(F.collect_list(F.struct("pos", "shift_c"))).alias("s"))
    part = lambda r: F.transform(F.filter("s", lambda x: x["pos"] % 2 == r), lambda x: x["shift_c"])
    merged = ordered.select("compound_id", joins.merge_refs(part(0), part(1), 1500).alias("acc"))
    return merged.select("compound_id", F.size("acc").cast("bigint").alias("n"), F.aggregate("acc", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


_QUATERNARY = "SELECT list_id, peak_id, pos_c FROM {peak1d} p WHERE NOT EXISTS (SELECT 1 FROM {dept} d WHERE d.list_id = p.list_id AND abs(p.pos_c - d.pos_c) <= 50)"


@query("J12_quaternary", _QUATERNARY)
def _(v):
    return qc.quaternary(v.peak1d.select("list_id", "peak_id", "pos_c"), v.dept)


#: Every fifth list has no DEPT, so that all tiers occur.
_EXCLUDED = f"SELECT list_id, pos_c FROM ({_QUATERNARY}) q WHERE list_id % 5 <> 0 AND list_id IN (SELECT list_id FROM {{dept}})"


def _dept(v):
    return v.dept.where("list_id % 5 <> 0")


@query("J12_reference_source", "SELECT DISTINCT list_id, CASE WHEN list_id % 5 <> 0 AND list_id IN (SELECT list_id FROM {dept}) THEN 'dept' ELSE 'override' END AS source FROM {peak2d}")
def _(v):
    override = v.spark.createDataFrame([(3970,), (12955,)], "pos_c bigint")
    return qc.resolve_reference(v.peak2d.select("list_id").distinct(), v.peak1d.select("list_id", "pos_c"), _dept(v), override)[0]


@query("J13_exclusion", f"SELECT p.list_id, count(*) FILTER (EXISTS (SELECT 1 FROM ({_EXCLUDED}) x WHERE x.list_id = p.list_id AND abs(x.pos_c - p.f1_c) <= 50)) AS hits FROM {{peak2d}} p WHERE experiment = 'HSQC' GROUP BY p.list_id")
def _(v):
    excluded = qc.resolve_reference(v.peak2d.select("list_id").distinct(), v.peak1d.select("list_id", "pos_c"), _dept(v))[1]
    return qc.check_exclusion(_hsqc(v), excluded)


_COVERAGE = f"""SELECT list_id, count(*) FILTER (EXISTS (SELECT 1 FROM {{peak2d}} p WHERE p.experiment = 'HSQC' AND p.list_id = k.list_id AND abs(p.f1_c - k.pos_c) <= 50))::DOUBLE / count(*)::DOUBLE AS coverage FROM (
    SELECT list_id, min(pos_c) AS pos_c FROM (SELECT *, sum(new) OVER (PARTITION BY list_id ORDER BY pos_c) AS g FROM (
      SELECT list_id, pos_c, CASE WHEN pos_c - lag(pos_c) OVER (PARTITION BY list_id ORDER BY pos_c) <= 50 THEN 0 ELSE 1 END AS new FROM (SELECT list_id, pos_c FROM {{peak1d}} r WHERE NOT EXISTS (SELECT 1 FROM ({_EXCLUDED}) x WHERE x.list_id = r.list_id AND abs(x.pos_c - r.pos_c) <= 50)) a) b) d GROUP BY list_id, g) k GROUP BY list_id"""


@query("J14_coverage", _COVERAGE)
def _(v):
    excluded = qc.resolve_reference(v.peak2d.select("list_id").distinct(), v.peak1d.select("list_id", "pos_c"), _dept(v))[1]
    return qc.check_coverage(_hsqc(v), v.peak1d.select("list_id", "pos_c"), excluded)


_MIRROR = """SELECT list_id, count(*) FILTER (EXISTS (SELECT 1 FROM {peak2d} o WHERE o.experiment = 'COSY' AND o.list_id = p.list_id AND abs(p.f2_c - o.f1_c) <= {t} AND abs(p.f1_c - o.f2_c) <= {t}))::DOUBLE / count(*)::DOUBLE AS fraction FROM {peak2d} p WHERE experiment = 'COSY' GROUP BY list_id"""


@query("J15_mirror_fraction", _MIRROR.replace("{t}", "60"))
def _(v):
    return joins.mirror_fraction(v.peak2d.where("experiment = 'COSY'"), 60)


_ATOMS = "SELECT list_id, peak_id, pos_c, row_number() OVER (PARTITION BY list_id ORDER BY pos_c DESC, peak_id) AS atom_no FROM {peak1d}"
_FIRST_ATOM = f"(SELECT min(a.atom_no) FROM ({_ATOMS}) a WHERE a.list_id = p.list_id AND abs(a.pos_c - p.f1_c) <= 100)"


@query("J16_assign_atoms", f"SELECT list_id, peak_id, {_FIRST_ATOM} AS atom FROM {{peak2d}} p WHERE experiment <> 'COSY'")
def _(v):
    return joins.assign_atoms(v.peak2d.where("experiment <> 'COSY'"), _numbered(v), "f1_c").select("list_id", "peak_id", "atom")


@query(
    "J17_correlations",
    f"""WITH atm AS MATERIALIZED (SELECT list_id, peak_id, experiment, f1_c, f2_c, CASE WHEN experiment <> 'COSY' THEN {_FIRST_ATOM} END AS atom FROM {{peak2d}} p), h AS (SELECT * FROM atm WHERE experiment = 'HSQC'),
       first AS (SELECT m.list_id, m.peak_id, arg_min(struct_pack(a := h.atom), h.peak_id).a AS h_atom FROM atm m JOIN h ON h.list_id = m.list_id AND abs(h.f2_c - m.f2_c) <= 10 WHERE m.experiment = 'HMBC' GROUP BY ALL),
       l1 AS (SELECT m.list_id, m.peak_id, arg_max(struct_pack(a := h.atom), h.peak_id).a AS a1 FROM atm m JOIN h ON h.list_id = m.list_id AND abs(h.f2_c - m.f1_c) <= 10 WHERE m.experiment = 'COSY' GROUP BY ALL),
       l2 AS (SELECT m.list_id, m.peak_id, arg_max(struct_pack(a := h.atom), h.peak_id).a AS a2 FROM atm m JOIN h ON h.list_id = m.list_id AND abs(h.f2_c - m.f2_c) <= 10 WHERE m.experiment = 'COSY' GROUP BY ALL)
       SELECT DISTINCT list_id, 'HSQC' AS kind, atom AS atom1, atom AS atom2 FROM h WHERE atom IS NOT NULL
       UNION ALL SELECT DISTINCT m.list_id, 'HMBC', m.atom, f.h_atom FROM atm m JOIN first f ON f.list_id = m.list_id AND f.peak_id = m.peak_id WHERE m.atom <> f.h_atom
       UNION ALL SELECT DISTINCT l1.list_id, 'COSY', least(a1, a2), greatest(a1, a2) FROM l1 JOIN l2 ON l1.list_id = l2.list_id AND l1.peak_id = l2.peak_id WHERE a1 <> a2""",
)
def _(v):
    return joins.derive_correlations(v.peak2d, _numbered(v))


_MULT = "(SELECT arg_min(d.mult, d.peak_id) FROM {dept} d WHERE d.list_id = p.list_id AND abs(d.pos_c - p.pos_c) <= 100)"
_ASSIGNED = f"""SELECT list_id, peak_id, pos_c, CASE WHEN mult = 'CH2' THEN 2 WHEN mult = 'CH/CH3' THEN CASE WHEN pos_c < 3000 THEN 3 ELSE 1 END ELSE 0 END::BIGINT AS h_count, CASE WHEN mult = 'CH/CH3' AND pos_c BETWEEN 10000 AND 16000 THEN 'sp2' ELSE 'sp3' END AS hybridisation
    FROM (SELECT list_id, peak_id, pos_c, {_MULT} AS mult FROM {{peak1d}} p) x"""


@query("J18_multiplicity", f"SELECT list_id, peak_id, h_count, hybridisation FROM ({_ASSIGNED}) y")
def _(v):
    return joins.assign_multiplicity(v.peak1d, v.dept).select("list_id", "peak_id", "h_count", "hybridisation")


@query("J19_refine", f"SELECT list_id, peak_id, CASE WHEN mult <> 'CH/CH3' THEN mult WHEN {_exists('(SELECT * FROM {dept} WHERE dept90)', 100, 'p.pos_c')} THEN 'CH' ELSE 'CH3' END AS mult FROM {{dept}} p")
def _(v):
    return joins.refine_multiplicity(v.dept, v.dept.where("dept90").select("list_id", "pos_c")).select("list_id", "peak_id", "mult")


_FORMULA = "SELECT list_id, min(formula_norm) AS formula_norm FROM (SELECT cast((id - id % 32) / 32 AS bigint) AS list_id, formula_norm FROM {compound}) f GROUP BY list_id"
_REPORT = """SELECT list_id, bucket, total, proton_c, total::DOUBLE / (CASE WHEN least_ <= 0 THEN 1 ELSE least_ END)::DOUBLE AS relative, total::DOUBLE / (CASE WHEN least_ <= 0 THEN 1 ELSE least_ END)::DOUBLE > 1.5 AS doubled,
      (SELECT arg_min(d.mult, d.peak_id) FROM {dept} d WHERE d.list_id = s.list_id AND abs(d.pos_c - s.bucket * 10) <= 100) AS mult
    FROM (SELECT *, min(total) OVER (PARTITION BY list_id) AS least_ FROM (SELECT list_id, round_even(f1_c::DOUBLE / 10.0::DOUBLE, 0)::BIGINT AS bucket, sum(intensity)::BIGINT AS total, sum(f2_c)::DOUBLE / count(*)::DOUBLE AS proton_c FROM {peak2d} WHERE experiment = 'HSQC' GROUP BY ALL) q) s"""


@query("A13_intensity_report", _REPORT)
def _(v):
    return analysis.intensity_report(_hsqc(v), v.dept)


_H = "CASE WHEN mult = 'CH2' THEN 2 WHEN pos_c < 3000 THEN 3 WHEN pos_c > 10000 THEN 1 ELSE 2 END"


def _n(element: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(list_zip(regexp_extract_all(formula_norm, '([A-Z][a-z]?)(\\d*)', 1), regexp_extract_all(formula_norm, '([A-Z][a-z]?)(\\d*)', 2)), lambda z: z[1] = '{element}'), lambda z: CASE WHEN z[2] = '' THEN 1 ELSE z[2]::BIGINT END)), 0)::BIGINT"


_BUDGET = f"""SELECT list_id, formula_norm, carbon_h, signals, expected_h, hetero_h, expected_h - carbon_h - hetero_h AS missing_h, c_ - signals AS missing_c FROM (
    SELECT d.list_id, f.formula_norm, carbon_h, signals, {_n('H')} AS expected_h, {_n('C')} AS c_, (CASE WHEN {_n('O')} = 0 THEN 0 WHEN {_n('O')} <= 2 THEN 1 ELSE ({_n('O')} + 1) // 2 END + {_n('N')})::BIGINT AS hetero_h
    FROM (SELECT list_id, sum({_H})::BIGINT AS carbon_h, count(*) AS signals FROM {{dept}} GROUP BY list_id) d JOIN ({_FORMULA}) f ON f.list_id = d.list_id) x"""


def _formulas(v):
    return v.sql(_FORMULA)


@query("A14_hydrogen_budget", f"SELECT list_id, expected_h, carbon_h, hetero_h, missing_h FROM ({_BUDGET}) b")
def _(v):
    return analysis.hydrogen_budget(_formulas(v), v.dept).select("list_id", "expected_h", "carbon_h", "hetero_h", "missing_h")


@query(
    "A15_symmetry",
    f"""SELECT b.list_id, signals, missing_c, missing_h, missing_c < 0 AS overcount_alarm, greatest(0, -missing_c)::BIGINT AS excess, missing_c > 0 OR missing_h > 0 AS has_symmetry, missing_c > 0 AND coalesce(para, false) AS para_hint, missing_c > 0 AND coalesce(methyl, false) AS methyl_hint
        FROM ({_BUDGET}) b LEFT JOIN (SELECT list_id, count(*) FILTER (bucket * 10 BETWEEN 10000 AND 16000) = 2 AS para, count(*) FILTER (mult IN ('CH3', 'CH/CH3') AND bucket * 10 < 4000) > 0 AS methyl FROM ({_REPORT}) r WHERE doubled GROUP BY list_id) h ON h.list_id = b.list_id""",
)
def _(v):
    return analysis.symmetry(_formulas(v), v.dept, _hsqc(v))


_AXES = [("COSY", "f1_c", 5), ("COSY", "f2_c", 5), ("HSQC", "f1_c", 50), ("HSQC", "f2_c", 5), ("HMBC", "f1_c", 50), ("HMBC", "f2_c", 5)]
_RIDGE = "SELECT list_id, max(fraction) AS fraction, arg_min(axis, struct_pack(f := -fraction, a := axis)) AS axis FROM (SELECT list_id, axis, max(n)::DOUBLE / sum(n)::DOUBLE AS fraction FROM (SELECT list_id, axis, b, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT list_id, '{e}.{a}' AS axis, round_even({a}::DOUBLE / {float(t)}::DOUBLE, 0) AS b FROM {{peak2d}} WHERE experiment = '{e}'" for e, a, t in _AXES
) + ") x GROUP BY ALL) y GROUP BY ALL) z GROUP BY list_id"


@query("A16_ridge_fraction", _RIDGE)
def _(v):
    return qc.ridge_fraction(v.peak2d)


_SIGNS = "SELECT list_id, round_even(f1_c::DOUBLE / 50.0::DOUBLE, 0)::BIGINT AS bucket, count(DISTINCT intensity >= 0) AS hints FROM {peak2d} WHERE experiment = 'HSQC' GROUP BY ALL HAVING count(DISTINCT intensity >= 0) > 1"


@query("A17_sign_consistency", _SIGNS)
def _(v):
    return qc.sign_consistency(_hsqc(v))


_CALIBRATION = """SELECT l.list_id, coalesce(sum(o)::DOUBLE / nullif(count(o), 0)::DOUBLE, 0.0::DOUBLE) AS offset_c, count(o) AS n_matched, abs(coalesce(sum(o)::DOUBLE / nullif(count(o), 0)::DOUBLE, 0.0::DOUBLE)) <= 50 AS passed FROM (SELECT DISTINCT list_id FROM {peak2d} WHERE experiment = 'HSQC') l
    LEFT JOIN (SELECT r.list_id, arg_min(p.f1_c - r.pos_c, struct_pack(d := abs(p.f1_c - r.pos_c), i := p.peak_id)) AS o FROM {peak1d} r JOIN {peak2d} p ON p.experiment = 'HSQC' AND p.list_id = r.list_id AND abs(p.f1_c - r.pos_c) <= 500 GROUP BY r.list_id, r.peak_id) x ON x.list_id = l.list_id GROUP BY l.list_id"""


@query("A18_calibration", _CALIBRATION)
def _(v):
    return qc.check_calibration(_hsqc(v), v.peak1d)


_CHECKS = f"""WITH l AS (SELECT DISTINCT list_id FROM {{peak2d}}), hs AS (SELECT DISTINCT list_id FROM {{peak2d}} WHERE experiment = 'HSQC'), known AS (SELECT list_id FROM l WHERE list_id % 5 <> 0 AND list_id IN (SELECT list_id FROM {{dept}})),
    checks AS (
    SELECT l.list_id, 'quaternary_exclusion' AS name, coalesce(h.hits = 0, false) AS passed, true AS critical FROM l LEFT JOIN (SELECT p.list_id, count(*) FILTER (EXISTS (SELECT 1 FROM ({_EXCLUDED}) x WHERE x.list_id = p.list_id AND abs(x.pos_c - p.f1_c) <= 50)) AS hits FROM {{peak2d}} p WHERE experiment = 'HSQC' AND list_id IN (SELECT list_id FROM known) GROUP BY p.list_id) h ON h.list_id = l.list_id
    UNION ALL SELECT l.list_id, 'ppm_calibration', coalesce(k.passed, false), true FROM l LEFT JOIN ({_CALIBRATION}) k ON k.list_id = l.list_id
    UNION ALL SELECT l.list_id, 'hsqc_coverage', coalesce(k.coverage >= 0.8, false), true FROM l LEFT JOIN (SELECT * FROM ({_COVERAGE}) q WHERE list_id IN (SELECT list_id FROM known) AND list_id IN (SELECT list_id FROM hs)) k ON k.list_id = l.list_id
    UNION ALL SELECT l.list_id, 'signal_to_ridge', coalesce(k.fraction <= 0.5, false), true FROM l LEFT JOIN ({_RIDGE}) k ON k.list_id = l.list_id
    UNION ALL SELECT l.list_id, 'edited_sign_consistency', k.n IS NULL, false FROM l LEFT JOIN (SELECT list_id, count(*) AS n FROM ({_SIGNS}) s GROUP BY list_id) k ON k.list_id = l.list_id
    UNION ALL SELECT l.list_id, 'cosy_diagonal_symmetry', coalesce(k.fraction >= 0.5, true), false FROM l LEFT JOIN ({_MIRROR.replace('{t}', '5')}) k ON k.list_id = l.list_id)"""


@query("A19_qc_checks", f"{_CHECKS} SELECT list_id, name, passed, critical FROM checks")
def _(v):
    return qc.qc_checks(v.peak2d, v.peak1d, _dept(v)).select("list_id", "name", "passed", "critical")


_VERDICT = "CASE WHEN bool_or(critical AND NOT passed) THEN 'FAIL' WHEN bool_or(NOT critical AND NOT passed) THEN 'PARTIAL' ELSE 'PASS' END"


@query("A19_qc_report", f"{_CHECKS} SELECT list_id, {_VERDICT} AS verdict, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (NOT passed), '') AS violated FROM checks GROUP BY list_id")
def _(v):
    return qc.qc_report(v.peak2d, v.peak1d, _dept(v)).select("list_id", "verdict", F.array_join("violated", ", ").alias("violated"))


@query("S20_routing", f"{_CHECKS} SELECT verdict, confidence, count(*) AS peaks FROM (SELECT p.peak_id, g.verdict, CASE g.verdict WHEN 'PASS' THEN 'high' WHEN 'PARTIAL' THEN 'low' END AS confidence FROM {{peak2d}} p JOIN (SELECT list_id, {_VERDICT} AS verdict FROM checks GROUP BY list_id) g ON g.list_id = p.list_id) x GROUP BY ALL")
def _(v):
    from .scratch import new_folder

    base = new_folder(v.spark, "routing")
    qc.route_by_verdict(v.peak2d, qc.qc_report(v.peak2d, v.peak1d, _dept(v)), f"{base}/out", f"{base}/quarantine")
    good, bad = v.spark.read.parquet(f"{base}/out"), v.spark.read.parquet(f"{base}/quarantine")
    return good.select("verdict", "confidence").unionByName(bad.select("verdict", F.lit(None).cast("string").alias("confidence"))).groupBy("verdict", "confidence").agg(F.count("*").alias("peaks"))


@query("W10_number_atoms", f"SELECT list_id, peak_id, atom_no FROM ({_ATOMS}) a")
def _(v):
    return _numbered(v).select("list_id", "peak_id", "atom_no")


@query("W7_gap_clusters", "SELECT list_id, min(pos_c) AS pos_c, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY list_id ORDER BY pos_c) AS g FROM (SELECT list_id, pos_c, CASE WHEN pos_c - lag(pos_c) OVER (PARTITION BY list_id ORDER BY pos_c) <= 150 THEN 0 ELSE 1 END AS new FROM {peak1d}) a) b GROUP BY list_id, g")
def _(v):
    return peaks.gap_clusters(v.peak1d, ["list_id"], "pos_c", 150)


_MULT3 = "CASE pos % 4 WHEN 0 THEN 'CH' WHEN 1 THEN 'CH/CH3' WHEN 2 THEN NULL ELSE 'CH2' END"
_GROUPS = f"""WITH RECURSIVE s AS (SELECT compound_id, list(struct_pack(v := shift_c, p := pos, m := {_MULT3}) ORDER BY shift_c, pos) AS l FROM {{signal}} GROUP BY compound_id),
    f AS (SELECT compound_id, l, 1 AS k, [[l[1]]] AS g FROM s UNION ALL
      SELECT compound_id, l, k + 1, CASE WHEN l[k + 1].v - g[len(g)][1].v <= 900 THEN list_append(g[1:len(g) - 1], list_append(g[len(g)], l[k + 1])) ELSE list_append(g, [l[k + 1]]) END FROM f WHERE k < len(l)),
    r AS (SELECT compound_id, len(l) AS n, list_filter(g, lambda x: len(x) > 1 AND len(list_filter(x, lambda a: len(list_filter(x, lambda b: NOT (a.m IS NULL OR b.m IS NULL OR a.m = b.m OR (a.m = 'CH/CH3' AND b.m = 'CH') OR (b.m = 'CH/CH3' AND a.m = 'CH')))) > 0)) = 0) AS g FROM f WHERE k = len(l))"""


def _grouped(v):
    lists = v.signal.withColumn("mult", F.expr(_MULT3)).groupBy("compound_id").agg(F.collect_list(F.struct("shift_c", "pos", "mult")).alias("signals"))
    return peaks.group_signals(lists, 900)


@query("W8_group_signals", f"{_GROUPS} SELECT compound_id, len(g) AS n_groups, coalesce(list_sum(list_transform(g, lambda x: len(x))), 0)::BIGINT AS grouped, coalesce(list_max(list_transform(g, lambda x: len(x)))::DOUBLE > 0.5::DOUBLE * n, false) AS warning FROM r")
def _(v):
    return _grouped(v).select("compound_id", F.size("groups").cast("bigint").alias("n_groups"), "grouped", "warning")


@query("W8_group_rows", f"{_GROUPS} SELECT compound_id, len(x) AS n, x[len(x)].v - x[1].v AS span_c, list_sum(list_transform(x, lambda y: y.v))::DOUBLE / len(x)::DOUBLE AS centroid_c FROM (SELECT compound_id, unnest(g) AS x FROM r) u")
def _(v):
    rows = _grouped(v).select("compound_id", F.explode("groups").alias("x"))
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda acc, y: acc + y["shift_c"])
    return rows.select("compound_id", F.size("x").cast("bigint").alias("n"), (F.element_at("x", -1)["shift_c"] - c("x")[0]["shift_c"]).alias("span_c"), (total.cast("double") / F.size("x").cast("double")).alias("centroid_c"))


@query(
    "W9_aromatic_pairs",
    f"""{_GROUPS}, a AS (SELECT compound_id, i, list_sort(list_transform(x, lambda y: y.p + 1)) AS ids, len(x) AS n FROM (SELECT compound_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM r) u WHERE len(list_filter(x, lambda y: y.v NOT BETWEEN 10000 AND 16500)) = 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY compound_id, n ORDER BY i) AS turn FROM a)
        SELECT compound_id, unnest(x.ids) AS atom1, unnest(list_reverse(y.ids)) AS atom2 FROM t x JOIN t y USING (compound_id, n) WHERE x.turn % 2 = 1 AND y.turn = x.turn + 1""",
)
def _(v):
    return peaks.aromatic_pairs(_grouped(v), "compound_id")


_COMPLETE = f"""WITH s AS (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY pos_c DESC, peak_id) AS atom_no, pos_c, h_count, h_count = 0 AND (pos_c BETWEEN 16500 AND 18500 OR pos_c BETWEEN 19000 AND 22000) AS co FROM ({_ASSIGNED}) y),
    f AS (SELECT s.list_id, {_n('C')} AS nc, {_n('H')} AS nh, {_n('O')} AS no, {_n('N')} AS nn, {_n('Cl')} AS nx, seen, ch, least(cos, {_n('O')}) AS dbl FROM (SELECT list_id, count(*) AS seen, sum(h_count)::BIGINT AS ch, count(*) FILTER (co) AS cos FROM s GROUP BY list_id) s JOIN ({_FORMULA}) q ON q.list_id = s.list_id),
    g AS (SELECT *, greatest(0, nc - seen) AS mc FROM f)"""


@query(
    "A32_complete_atoms",
    f"""{_COMPLETE} SELECT list_id, element, hybridisation, h_count, count(*) AS n, sum(atom_no)::BIGINT AS numbers FROM (
        SELECT s.list_id, atom_no, 'C' AS element, CASE WHEN co THEN 'sp2' ELSE hybridisation END AS hybridisation, s.h_count FROM s JOIN (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY pos_c DESC, peak_id) AS atom_no, hybridisation FROM ({_ASSIGNED}) y) h USING (list_id, atom_no)
        UNION ALL SELECT list_id, seen + k, 'C', 'sp2', 0 FROM (SELECT *, unnest(range(1, mc + 1)) AS k FROM g) a
        UNION ALL SELECT list_id, seen + mc + k, 'O', CASE WHEN k <= dbl THEN 'sp2' ELSE 'sp3' END, CASE WHEN k > dbl AND k - dbl <= nh - ch THEN 1 ELSE 0 END FROM (SELECT *, unnest(range(1, no + 1)) AS k FROM g) a
        UNION ALL SELECT list_id, seen + mc + no + k, 'N', 'sp3', 1 FROM (SELECT *, unnest(range(1, nn + 1)) AS k FROM g) a
        UNION ALL SELECT list_id, seen + mc + no + nn + k, 'Cl', 'sp3', 0 FROM (SELECT *, unnest(range(1, nx + 1)) AS k FROM g) a) z GROUP BY ALL""",
)
def _(v):
    carbons = peaks.number_atoms(joins.assign_multiplicity(v.peak1d, v.dept)).select("list_id", "atom_no", "pos_c", "h_count", "hybridisation")
    atoms = analysis.complete_atoms(carbons, _formulas(v))[0]
    return atoms.groupBy("list_id", "element", "hybridisation", "h_count").agg(F.count("*").alias("n"), F.sum("atom_no").alias("numbers"))


@query("A32_carbonyl_bonds", f"{_COMPLETE} SELECT list_id, atom_no AS atom1, seen + mc + turn AS atom2 FROM (SELECT list_id, atom_no, row_number() OVER (PARTITION BY list_id ORDER BY atom_no) AS turn FROM s WHERE co) t JOIN g USING (list_id) WHERE turn <= dbl")
def _(v):
    carbons = peaks.number_atoms(joins.assign_multiplicity(v.peak1d, v.dept)).select("list_id", "atom_no", "pos_c", "h_count", "hybridisation")
    return analysis.complete_atoms(carbons, _formulas(v))[1]


_CORR = "SELECT ord AS list_id, CASE WHEN line % 2 = 0 THEN 'HMBC' ELSE 'COSY' END AS kind, pos AS atom1, part % 9 AS atom2 FROM {item}"
_PAIR = "SELECT ord AS list_id, supp % 6 AS atom1, part % 9 AS atom2 FROM {item}"


@query("A33_equivalence_pairs", f"SELECT DISTINCT list_id, least(atom1, atom2) AS lo, greatest(atom1, atom2) AS hi FROM ({_PAIR}) p WHERE NOT EXISTS (SELECT 1 FROM ({_CORR}) k WHERE k.kind = 'COSY' AND k.list_id = p.list_id AND least(k.atom1, k.atom2) = least(p.atom1, p.atom2) AND greatest(k.atom1, k.atom2) = greatest(p.atom1, p.atom2))")
def _(v):
    families = v.sql("SELECT ord AS list_id, pos AS parent, pos + 1 AS child1, pos + 2 AS child2 FROM {item}")
    return analysis.add_equivalences(v.sql(_CORR), families, v.sql(_PAIR))[1]


@query("A33_equivalence_bonds", "SELECT ord AS list_id, pos AS atom1, unnest([pos + 1, pos + 2]) AS atom2 FROM {item}")
def _(v):
    families = v.sql("SELECT ord AS list_id, pos AS parent, pos + 1 AS child1, pos + 2 AS child2 FROM {item}")
    return analysis.add_equivalences(v.sql(_CORR), families, v.sql(_PAIR))[0]


_PROBLEM_ATOMS = "SELECT compound_id AS list_id, CASE WHEN part % 23 = 0 THEN 0 ELSE pos END AS atom_no, element FROM {atom}"


@query(
    "F9_problem_faults",
    f"""WITH a AS ({_PROBLEM_ATOMS}), k AS ({_CORR.replace('pos AS atom1', '(pos + part % 3) AS atom1')}), f AS (SELECT id AS list_id, formula_norm FROM {{compound}})
        SELECT a.list_id, any_value({_n('C')}) <> count(*) FILTER (element = 'C') AS carbon_mismatch, count(*) <> count(DISTINCT atom_no) AS duplicate_atoms,
          (SELECT count(*) FROM k WHERE k.list_id = a.list_id AND NOT EXISTS (SELECT 1 FROM a b WHERE b.list_id = k.list_id AND b.atom_no = k.atom1)) AS dangling,
          (SELECT count(DISTINCT b.atom_no) FROM a b WHERE b.list_id = a.list_id AND NOT EXISTS (SELECT 1 FROM k WHERE b.list_id = k.list_id AND b.atom_no = k.atom1)) AS uncorrelated,
          count(*) FILTER (element = 'C') AS carbons, count(*) FILTER (element <> 'C') AS hetero FROM a JOIN f ON f.list_id = a.list_id GROUP BY a.list_id""",
)
def _(v):
    correlations = v.sql(_CORR.replace("pos AS atom1", "(pos + part % 3) AS atom1"))
    return analysis.problem_faults(v.sql(_PROBLEM_ATOMS), correlations, v.compound.select(c("id").alias("list_id"), "formula_norm"))


@query(
    "F10_schedule",
    """SELECT exp_id, coalesce(samples, 0) AS samples, expected, CASE WHEN expected IS NULL THEN 'unknown_mode' WHEN coalesce(samples, 0) <> expected THEN 'length' END AS fault FROM (
       SELECT o_orderkey AS exp_id, CASE o_custkey % 7 WHEN 1 THEN o_custkey % 9 WHEN 2 THEN o_custkey % 9 WHEN 4 THEN o_custkey % 9 // 2 WHEN 5 THEN o_custkey % 9 // 2 WHEN 6 THEN o_custkey % 9 // 2 END AS expected FROM {orders}) p LEFT JOIN (SELECT ord, count(*) AS samples FROM {item} GROUP BY ord) s ON s.ord = p.exp_id""",
)
def _(v):
    parameters = v.sql("SELECT o_orderkey AS exp_id, o_custkey % 7 AS mode, o_custkey % 9 AS td FROM {orders}")
    return qc.check_schedule(v.item.select(c("ord").alias("exp_id"), c("part").alias("point")), parameters)


@query(
    "F11_verify_candidates",
    """SELECT cust, bool_or(id % 9 >= 6 AND formula_norm = expected) AS passed FROM (SELECT cust, id, formula_norm, 'C' || cast(4 + cust % 20 AS string) || 'H' || cast(id % 2 AS string) || substring(formula_norm, 1, 0) AS x, CASE WHEN cust % 2 = 0 THEN formula_norm ELSE 'C1' END AS expected, row_number() OVER (PARTITION BY cust ORDER BY id) AS r FROM {compound}) k WHERE r <= 3 GROUP BY cust""",
)
def _(v):
    candidates = v.compound.select("cust", c("id").alias("rank"), (c("id") % 9).alias("aromatic_atoms"), c("formula_norm").alias("formula"))
    formulas = v.compound.select("cust", F.when(c("cust") % 2 == 0, c("formula_norm")).otherwise("C1").alias("expected_formula")).distinct()
    return analysis.verify_candidates(candidates, formulas, "cust")


@query("F1_formula_equality", "SELECT k.id FROM {compound} k JOIN (SELECT DISTINCT formula_norm FROM {reference}) r ON replace(translate(k.formula, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), ' ', '') = r.formula_norm")
def _(v):
    from resonara.functions.formula import normalize_formula

    return v.compound.withColumn("formula_norm", normalize_formula(c("formula"))).join(v.reference.select("formula_norm").distinct(), "formula_norm", "left_semi").select("id")


@query("F2_usable_compounds", "SELECT id FROM {compound} WHERE smiles <> '' AND id > 100 AND id IN (SELECT compound_id FROM {signal}) ")
def _(v):
    return v.compound.where("smiles <> '' AND id > 100").join(v.signal.select(c("compound_id").alias("id")), "id", "left_semi").select("id")


@query("U1_distinct_formulas", "SELECT DISTINCT formula_norm FROM {compound} ORDER BY formula_norm")
def _(v):
    return v.compound.select("formula_norm").distinct().orderBy("formula_norm")


@query("U2_union_sources", "SELECT 'measured' AS origin, id, name FROM {compound} WHERE id % 4 = 0 UNION ALL SELECT 'predicted', id, name FROM {compound} WHERE id % 4 <> 0")
def _(v):
    measured, predicted = v.compound.where("id % 4 = 0").select("id", "name"), v.compound.where("id % 4 <> 0").select("id", "name")
    return measured.withColumn("origin", F.lit("measured")).unionByName(predicted.withColumn("origin", F.lit("predicted")))


@query("U4_hetero_pairs", "SELECT DISTINCT b.compound_id, least(x.element, y.element) AS element1, greatest(x.element, y.element) AS element2 FROM {edge} b JOIN {atom} x ON x.compound_id = b.compound_id AND x.pos = b.i JOIN {atom} y ON y.compound_id = b.compound_id AND y.pos = b.j WHERE x.element <> 'C' AND y.element <> 'C'")
def _(v):
    from resonara.operators import graphs

    return graphs.hetero_pairs(v.atom, v.bond)


_FRAGS = "SELECT ord AS compound_id, p_type || '/' || p_brand AS key, CASE WHEN supp % 3 = 0 THEN 'ring' ELSE 'atom' END AS kind, pos, line AS radius FROM {item} JOIN {part} ON p_partkey = part"


@query("U5_first_fragments", f"SELECT compound_id, key, kind, pos, radius FROM (SELECT *, row_number() OVER (PARTITION BY compound_id, key ORDER BY CASE WHEN kind = 'atom' THEN 0 ELSE 1 END, pos, radius) AS n FROM ({_FRAGS}) f) g WHERE n = 1")
def _(v):
    return analysis.first_fragments(v.sql(_FRAGS))


_CASES, _TRIES, _TAINTED = "SELECT 'CASE' || cast(c_custkey AS string) AS case FROM {customer}", "SELECT 'CASE' || cast(o_custkey AS string) AS case, o_orderkey % 13 = 0 AS has_report, o_orderkey % 1000 AS runtime_s FROM {orders}", "SELECT 'CASE' || cast(s_suppkey * 7 AS string) AS case FROM {supplier}"


@query("U6_pending", f"SELECT \"case\" FROM ({_CASES.replace('AS case', 'AS ' + chr(34) + 'case' + chr(34))}) c WHERE \"case\" NOT IN (SELECT 'CASE' || cast(o_custkey AS string) FROM {{orders}} WHERE o_orderkey % 13 = 0 OR o_orderkey % 1000 >= 600) AND \"case\" NOT IN (SELECT 'CASE' || cast(s_suppkey * 7 AS string) FROM {{supplier}})")
def _(v):
    return analysis.pending(v.sql(_CASES.replace("AS case", "AS `case`")), v.sql(_TRIES.replace("AS case", "AS `case`")), v.sql(_TAINTED.replace("AS case", "AS `case`")))


@query("A30_import_counts", "SELECT count(*) FILTER (smiles <> '') AS imported, count(*) FILTER (smiles = '') AS skipped FROM {compound}")
def _(v):
    return analysis.import_summary(v.compound, F.when(c("smiles") == "", "no structure"))[0]


@query("S21_info", "SELECT count(*) AS compounds, count(DISTINCT formula_norm) AS formulas, max(id) AS last_id FROM {compound}")
def _(v):
    return analysis.warehouse_info(v.compound)[0]


@query("S21_sources", "SELECT source, count(*) AS n FROM {compound} GROUP BY source ORDER BY n DESC, source")
def _(v):
    return analysis.warehouse_info(v.compound)[1]


@query("S21_rollup", "SELECT source, formula_norm, count(*) AS n FROM {compound} GROUP BY ROLLUP (source, formula_norm)")
def _(v):
    return analysis.source_rollup(v.compound)


@query("W11_latest_run", "SELECT o_custkey AS problem, max(o_orderkey % 5) AS iteration, arg_max(o_orderkey, struct_pack(i := o_orderkey % 5, m := o_orderkey)) AS run FROM {orders} GROUP BY o_custkey")
def _(v):
    return qc.latest_run(v.sql("SELECT o_custkey AS problem, o_orderkey % 5 AS iteration, o_orderkey AS mtime, o_orderkey AS run FROM {orders}"), "problem").select("problem", "iteration", "run")


@query(
    "W11_tiers",
    """SELECT problem, candidate_id, tier, position FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY rank) AS position FROM (SELECT *, 'ranked' AS tier FROM {candidate} WHERE problem % 3 > 0 AND rank % 2 = 0 UNION ALL
       SELECT *, 'unranked' FROM {candidate} WHERE problem NOT IN (SELECT problem FROM {candidate} WHERE problem % 3 > 0 AND rank % 2 = 0)) u) t WHERE position <= 10""",
)
def _(v):
    rows = v.candidate.select("problem", "candidate_id", c("rank").alias("order"))
    return qc.tiered(rows.where("problem % 3 > 0 AND order % 2 = 0"), rows, "problem").select("problem", "candidate_id", "tier", "position")
