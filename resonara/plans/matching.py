"""Queries over lookups and matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.operators import joins, ranking, statistics

from .catalog import query

c = F.col


@query("J1_lookup_by_formula", "SELECT k.formula_norm, k.id, count(*) AS n, min(s.shift_c) AS min_c, max(s.pos) AS last_pos FROM {reference} r JOIN {compound} k ON k.formula_norm = r.formula_norm JOIN {signal} s ON s.compound_id = k.id GROUP BY k.formula_norm, k.id")
def _(v):
    found = joins.lookup_by_formula(v.reference.select("formula_norm"), v.compound.select("id", "formula_norm"), v.signal)
    return found.select("formula_norm", "id", F.size("refs").cast("bigint").alias("n"), F.array_min(F.transform("refs", lambda r: r["shift_c"])).alias("min_c"), F.element_at("refs", -1)["pos"].alias("last_pos"))


@query("J2_lookup_env", "SELECT k.compound_id, k.pos, k.radius, k.code, s.n FROM {env_key} k JOIN {env_state} s ON s.code = k.code AND s.radius = k.radius WHERE NOT k.train")
def _(v):
    return joins.lookup_env(v.env_key.where("NOT train").select("compound_id", "pos", "radius", "code"), v.env_state.select("code", "radius", "n"))


@query("J2_known_env", "SELECT compound_id, pos, radius, code FROM {env_key} k WHERE EXISTS (SELECT 1 FROM {env_state} s WHERE s.code = k.code AND s.radius = k.radius)")
def _(v):
    return joins.known_env(v.env_key.select("compound_id", "pos", "radius", "code"), v.env_state)


_BEST = """SELECT compound_id, pos, max(k.radius) FILTER (s.n IS NOT NULL) AS radius, arg_max(k.code, k.radius) FILTER (s.n IS NOT NULL) AS code, arg_max(s.n, k.radius) FILTER (s.n IS NOT NULL) AS n, arg_max(s.sum_c, k.radius) FILTER (s.n IS NOT NULL) AS sum_c, arg_max(s.sumsq_c, k.radius) FILTER (s.n IS NOT NULL) AS sumsq_c
    FROM {env_key} k LEFT JOIN {env_state} s ON s.code = k.code AND s.radius = k.radius WHERE NOT k.train GROUP BY compound_id, pos"""


@query("J3_predict_fallback", f"SELECT compound_id, pos, radius, code, n, sum_c FROM ({_BEST}) b")
def _(v):
    keys = v.env_key.where("NOT train").select("compound_id", "pos", "radius", "code")
    return joins.predict_fallback(keys, v.env_state.select("code", "radius", "n", "sum_c"), ["compound_id", "pos"]).select("compound_id", "pos", "radius", "code", "n", "sum_c")


@query(
    "predict",
    f"""SELECT compound_id, pos, sum_c::DOUBLE / n::DOUBLE / 100.0::DOUBLE AS shift, radius, n, round((0.5::DOUBLE * (radius::DOUBLE / 3.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * log10(greatest(n, 1)::DOUBLE) / 2.0::DOUBLE)
        + 0.2::DOUBLE * greatest(0.5::DOUBLE, 1.0::DOUBLE - sqrt((n * sumsq_c - sum_c * sum_c)::DOUBLE) / n::DOUBLE / 100.0::DOUBLE / 20.0::DOUBLE)) * 1000)::BIGINT AS confidence_milli FROM ({_BEST}) b WHERE n IS NOT NULL""",
)
def _(v):
    keys = v.env_key.where("NOT train").select("compound_id", "pos", "radius", "code")
    best = joins.predict_fallback(keys, v.env_state.select("code", "radius", "n", "sum_c", "sumsq_c"), ["compound_id", "pos"], max_radius=3).where("n IS NOT NULL")
    record = best.select("compound_id", "pos", statistics.prediction_record(max_radius=3).alias("p"))
    return record.select("compound_id", "pos", "p.shift", "p.radius", "p.n", F.round(c("p.confidence") * 1000).cast("bigint").alias("confidence_milli"))


#: Greedy fold of J5 as a recursion over the ordered observations of each candidate.
_FOLD = """WITH RECURSIVE o AS (SELECT formula_norm, pos, shift_c, h_count, row_number() OVER (PARTITION BY formula_norm ORDER BY shift_c, pos) AS k FROM {observed}),
    r AS (SELECT k.formula_norm, k.id, k.carbon_count, list(struct_pack(pos := s.pos, shift_c := s.shift_c, h := s.h_count)) AS refs FROM {compound} k JOIN {signal} s ON s.compound_id = k.id GROUP BY ALL),
    fold AS (
      SELECT formula_norm, id, carbon_count, len(refs) AS reference, 0::BIGINT AS k, refs AS avail, 0::BIGINT AS matched, 0::BIGINT AS dev_c, 0::BIGINT AS same_h FROM r WHERE formula_norm IN (SELECT formula_norm FROM o)
      UNION ALL
      SELECT formula_norm, id, carbon_count, reference, k, CASE WHEN best IS NULL THEN avail ELSE list_filter(avail, lambda x: x.pos <> best.pos) END, matched + CASE WHEN best IS NULL THEN 0 ELSE 1 END, dev_c + coalesce(best.dev, 0), same_h + CASE WHEN best.h = h_count THEN 1 ELSE 0 END
      FROM (SELECT f.formula_norm, f.id, f.carbon_count, f.reference, o.k, f.avail, f.matched, f.dev_c, f.same_h, o.h_count,
              list_sort(list_transform(list_filter(f.avail, lambda x: abs(x.shift_c - o.shift_c) <= CASE WHEN o.shift_c < 8000 THEN 80 WHEN o.shift_c < 10000 THEN 100 WHEN o.shift_c < 16000 THEN 120 ELSE 150 END), lambda x: struct_pack(dev := abs(x.shift_c - o.shift_c), pos := x.pos, h := x.h)))[1] AS best
            FROM fold f JOIN o ON o.formula_norm = f.formula_norm AND o.k = f.k + 1) s
    ), done AS (SELECT f.formula_norm, f.id, f.carbon_count, f.reference::BIGINT AS reference, f.matched, f.dev_c, f.same_h, n.n AS observed FROM fold f JOIN (SELECT formula_norm, count(*) AS n FROM o GROUP BY formula_norm) n ON n.formula_norm = f.formula_norm AND f.k = n.n)"""
_SCORED = """SELECT *, sqrt(matched::DOUBLE / observed::DOUBLE * least(1.0::DOUBLE, matched::DOUBLE / (reference::DOUBLE * CASE WHEN carbon_count > 0 THEN least(1.0::DOUBLE, observed::DOUBLE / carbon_count::DOUBLE) ELSE 1.0::DOUBLE END)))
    * CASE WHEN matched > 0 THEN 0.8::DOUBLE + 0.2::DOUBLE * (same_h::DOUBLE / greatest(matched, 1)::DOUBLE) ELSE 1.0::DOUBLE END AS score FROM done"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY formula_norm ORDER BY score DESC, CASE WHEN matched > 0 THEN dev_c::DOUBLE / matched::DOUBLE ELSE 'inf'::DOUBLE END, id) AS rank, score >= 0.7 AS is_match FROM ({_SCORED}) s"


@query("J5_greedy_match", f"{_FOLD} SELECT formula_norm, id, matched, observed - matched AS unmatched_obs, reference - matched AS unmatched_ref, dev_c, same_h FROM done")
def _(v):
    queries = v.observed.groupBy("formula_norm").agg(F.collect_list(F.struct("pos", "shift_c", "h_count")).alias("obs"))
    m = joins.greedy_match(joins.lookup_by_formula(queries, v.compound.select("id", "formula_norm"), v.signal))
    n = F.size("pairs").cast("bigint")
    return m.select(
        "formula_norm", "id", n.alias("matched"), (F.size("obs") - n).alias("unmatched_obs"), F.size("left_over").cast("bigint").alias("unmatched_ref"),
        F.aggregate("pairs", F.lit(0).cast("bigint"), lambda acc, p: acc + p["dev_c"]).alias("dev_c"), F.size(F.filter("pairs", lambda p: p["same_h"])).cast("bigint").alias("same_h"),
    )


@query("dereplicate", f"{_FOLD} SELECT formula_norm, id, matched, observed, reference, same_h, score, rank, is_match FROM ({_RANKED}) r WHERE rank <= 10")
def _(v):
    return joins.dereplicate(v.observed, v.compound, v.signal, top=10).select("formula_norm", "id", "matched", "observed", "reference", "same_h", "score", "rank", "is_match")


@query("W1_match_ranking", f"{_FOLD} SELECT formula_norm, count(*) AS candidates, count(*) FILTER (is_match) AS matches, max(score) AS best_score, arg_min(id, rank) AS best_id FROM ({_RANKED}) r GROUP BY formula_norm")
def _(v):
    ranked = joins.dereplicate(v.observed, v.compound, v.signal)
    return ranked.groupBy("formula_norm").agg(F.count("*").alias("candidates"), F.count_if("is_match").alias("matches"), F.max("score").alias("best_score"), F.min_by("id", "rank").alias("best_id"))


@query(
    "U3_unmatched",
    f"{_FOLD} SELECT id, (SELECT count(*) FROM {{signal}} s WHERE s.compound_id = d.id) - matched AS unmatched FROM done d",
)
def _(v):
    queries = v.observed.groupBy("formula_norm").agg(F.collect_list(F.struct("pos", "shift_c", "h_count")).alias("obs"))
    m = joins.greedy_match(joins.lookup_by_formula(queries, v.compound.select("id", "formula_norm"), v.signal)).select("formula_norm", "id", "pairs")
    taken = m.select(c("id").alias("compound_id"), F.explode("pairs").alias("p")).select("compound_id", c("p.ref_pos").alias("pos"))
    asked = v.signal.select("compound_id", "pos").join(m.select(c("id").alias("compound_id")), "compound_id", "left_semi")
    left = asked.exceptAll(taken).groupBy(c("compound_id").alias("id")).agg(F.count("*").alias("unmatched"))
    return m.select("id").join(left, "id", "left").select("id", F.coalesce("unmatched", F.lit(0)).alias("unmatched"))


_NEAREST = """SELECT k.formula_norm, s.compound_id, s.pos, s.shift_c, min(struct_pack(e := abs(s.shift_c - o.shift_c), p := o.pos, x := o.shift_c)) AS b FROM {compound} k JOIN {signal} s ON s.compound_id = k.id JOIN {observed} o ON o.formula_norm = k.formula_norm GROUP BY ALL"""


@query("J6_nearest_join", f"SELECT formula_norm, compound_id, pos, shift_c, b.x AS exp_c, b.e AS error_c, b.e <= 300 AS is_matched FROM ({_NEAREST}) n")
def _(v):
    predicted = v.signal.join(v.compound.select(c("id").alias("compound_id"), "formula_norm"), "compound_id").select("formula_norm", "compound_id", c("pos").alias("atom"), "shift_c")
    return joins.nearest_join(predicted, v.observed, ["formula_norm"], ["compound_id", "atom"], 300).withColumnRenamed("atom", "pos")


@query("J6_nearest_sorted", f"SELECT formula_norm, compound_id, pos, shift_c, b.e AS error_c FROM ({_NEAREST}) n")
def _(v):
    predicted = v.signal.join(v.compound.select(c("id").alias("compound_id"), "formula_norm"), "compound_id").join(v.observed.select("formula_norm").distinct(), "formula_norm", "left_semi")
    return joins.nearest_sorted(predicted.select("formula_norm", "compound_id", "pos", "shift_c"), v.observed, ["formula_norm"], ["compound_id", "pos"]).select("formula_norm", "compound_id", "pos", "shift_c", "error_c")


#: Every compound, or every one whose id is divisible by 100, against all fragments.
_EVERY = "SELECT compound_id AS query_id, pos, shift_c FROM {signal}"
_Q = f"{_EVERY} WHERE compound_id % 100 = 0"
_BINS = "SELECT DISTINCT query_id, least(greatest(shift_c // 200 + d, 0), 255) AS b FROM ({q}) q, (SELECT unnest([{d}]) AS d) e"
_HITS = """SELECT q.query_id, f.fragment_id FROM ({bins}) q JOIN (SELECT fragment_id, unnest(list_distinct([s1 // 200, s2 // 200, s3 // 200])) AS b, len(list_distinct([s1 // 200, s2 // 200, s3 // 200])) AS n FROM {{fragment}}) f ON f.b = q.b GROUP BY q.query_id, f.fragment_id, f.n HAVING count(*) = f.n"""


def _hits(d: str, asked: str = _Q) -> str:
    return _HITS.replace("{bins}", _BINS.replace("{q}", asked).replace("{d}", d)).replace("{{fragment}}", "{fragment}")


def _queries(v, asked: str = _Q):
    return v.sql(asked).groupBy("query_id").agg(F.collect_list("shift_c").alias("shifts"))


def _fragments(v):
    return v.fragment.select("fragment_id", "smiles", c("atom_count").cast("bigint").alias("atom_count"), F.array("s1", "s2", "s3").alias("shifts"))


@query("J20_prescreen", _hits("-1, 0, 1"))
def _(v):
    return joins.prescreen(_queries(v), _fragments(v))


def _fine(asked: str) -> str:
    return f"""WITH RECURSIVE start AS (SELECT h.query_id, h.fragment_id, list_sort([f.s1, f.s2, f.s3]) AS s, q.shifts AS rest FROM ({_hits('-1, 0, 1', asked)}) h JOIN {{fragment}} f ON f.fragment_id = h.fragment_id JOIN (SELECT query_id, list(struct_pack(v := shift_c, p := pos)) AS shifts FROM ({asked}) s GROUP BY query_id) q ON q.query_id = h.query_id),
    step AS (SELECT query_id, fragment_id, s, rest, 0 AS k, 0::BIGINT AS dev_c FROM start
      UNION ALL SELECT query_id, fragment_id, s, list_filter(rest, lambda x: x.p <> best.p), k + 1, dev_c + best.d FROM (
        SELECT *, list_sort(list_transform(rest, lambda x: struct_pack(d := abs(x.v - s[k + 1]), v := x.v, p := x.p)))[1] AS best FROM step WHERE k < 3) t WHERE best IS NOT NULL AND best.d <= 200),
    fine AS (SELECT query_id, fragment_id, dev_c FROM step WHERE k = 3 AND dev_c <= 300)"""


_FINE, _FINE_EVERY = _fine(_Q), _fine(_EVERY)


@query("J21_fine_match", f"{_FINE} SELECT * FROM fine")
def _(v):
    return joins.fine_search(_queries(v), _fragments(v)).select("query_id", "fragment_id", "dev_c")


@query(
    "W3_fragment_search",
    f"{_FINE} SELECT query_id, fragment_id, atom_count, rank FROM (SELECT x.query_id, x.fragment_id, f.atom_count::BIGINT AS atom_count, row_number() OVER (PARTITION BY x.query_id ORDER BY f.atom_count DESC, x.dev_c::DOUBLE / 3.0::DOUBLE, x.fragment_id) AS rank FROM fine x JOIN {{fragment}} f ON f.fragment_id = x.fragment_id WHERE f.atom_count >= 3) r WHERE rank <= 5",
)
def _(v):
    return joins.fine_search(_queries(v), _fragments(v), limit=5).select("query_id", "fragment_id", "atom_count", "rank")


@query(
    "fragment_search",
    f"{_FINE_EVERY} SELECT query_id, count(*) AS n, max(atom_count) AS largest FROM (SELECT x.query_id, f.atom_count::BIGINT AS atom_count, row_number() OVER (PARTITION BY x.query_id ORDER BY f.atom_count DESC, x.dev_c::DOUBLE / 3.0::DOUBLE, x.fragment_id) AS rank FROM fine x JOIN {{fragment}} f ON f.fragment_id = x.fragment_id WHERE f.atom_count >= 3) r WHERE rank <= 5 GROUP BY query_id",
)
def _(v):
    from resonara.api import fragment_search

    found = fragment_search(_queries(v, _EVERY), _fragments(v), limit=5)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("atom_count").alias("largest"))


@query("A27_self_recall", f"SELECT count(DISTINCT h.query_id)::DOUBLE / (SELECT count(DISTINCT query_id) FROM ({_Q}) s)::DOUBLE AS recall FROM ({_hits('0')}) h")
def _(v):
    asked = _queries(v)
    found = joins.prescreen(asked, _fragments(v), bins=0).select("query_id").distinct()
    judged = asked.join(found.withColumn("hit", F.lit(1)), "query_id", "left")
    return judged.agg((F.count("hit").cast("double") / F.count("*").cast("double")).alias("recall"))


@query("J28_fetch_by_id", "SELECT fragment_id, smiles FROM {fragment} WHERE fragment_id IN (SELECT part FROM {item} WHERE line > 6 AND qty > 40)")
def _(v):
    return joins.fetch_by_id(v.item.where("line > 6 AND qty > 40").select(c("part").alias("fragment_id")), v.fragment, "fragment_id").select("fragment_id", "smiles")


@query(
    "J22_identify",
    """SELECT q.query_id, coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(a.source, b.source) AS source, CASE WHEN a.id IS NOT NULL THEN 'key' WHEN b.id IS NOT NULL THEN 'smiles' END AS via
       FROM (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE md5(cast(c_custkey AS string)) END AS inchi_key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'C' || cast(c_custkey AS string) END AS smiles FROM {customer}) q
       LEFT JOIN (SELECT inchi_key, min(id) AS id, arg_min(name, id) AS name, arg_min(source, id) AS source FROM {compound} WHERE inchi_key <> '' GROUP BY inchi_key) a ON a.inchi_key = q.inchi_key
       LEFT JOIN (SELECT smiles, min(id) AS id, arg_min(name, id) AS name, arg_min(source, id) AS source FROM {compound} WHERE smiles <> '' GROUP BY smiles) b ON b.smiles = q.smiles""",
)
def _(v):
    asked = v.sql("SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE md5(cast(c_custkey AS string)) END AS inchi_key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'C' || cast(c_custkey AS string) END AS smiles FROM {customer}")
    return joins.identify(asked, v.compound)


_LEFT, _RIGHT = "SELECT ord AS problem, pos AS a, line AS b FROM {item} WHERE supp % 5 > 0", "SELECT ord AS problem, pos AS a, line AS b FROM {item} WHERE part % 7 > 0"


@query("J23_pair_differences", f"SELECT *, 'left' AS side FROM (({_LEFT}) EXCEPT ALL ({_RIGHT})) x UNION ALL SELECT *, 'right' FROM (({_RIGHT}) EXCEPT ALL ({_LEFT})) y")
def _(v):
    return joins.pair_differences(v.sql(_LEFT), v.sql(_RIGHT))


_PROBLEM = "SELECT ord AS list_id, CASE WHEN line % 2 = 0 THEN 'HMBC' ELSE 'COSY' END AS kind, pos AS atom1, part % 9 AS atom2 FROM {item}"
_SUSPECT = "SELECT ord AS list_id, CASE WHEN line % 2 = 0 THEN 'HMBC' ELSE 'COSY' END AS kind, pos AS atom1, part % 9 AS atom2, pos AS k FROM {item} WHERE pos < 3"
_VARIANTS = f"""WITH p AS ({_PROBLEM}), s AS ({_SUSPECT}), n AS (SELECT list_id, count(*) AS n FROM s GROUP BY list_id), x AS (SELECT list_id, n, unnest(range(1 << n::INT)) AS variant FROM n)
    SELECT p.list_id, p.kind, p.atom1, p.atom2, x.variant, NULL::BIGINT AS max_bonds FROM p JOIN x ON x.list_id = p.list_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.list_id = p.list_id AND s.kind = p.kind AND s.atom1 = p.atom1 AND s.atom2 = p.atom2)
    UNION ALL SELECT s.list_id, s.kind, s.atom1, s.atom2, x.variant, 4::BIGINT FROM s JOIN x ON x.list_id = s.list_id WHERE (x.variant >> (n - 1 - k)::INT) % 2 = 0"""


@query("J24_permute", _VARIANTS)
def _(v):
    return joins.permute(v.sql(_PROBLEM), v.sql(_SUSPECT))


_TRUTH_RANK = """SELECT t.problem, t.true_key, CASE WHEN count(k.rank) = 0 THEN NULL ELSE coalesce(min(k.rank) FILTER (k.cand_key = t.true_key), 0) END AS hit_rank, arg_min(k.cand_key, k.rank) AS top_key FROM {truth} t LEFT JOIN {candidate} k ON k.problem = t.problem AND k.rank <= 25 GROUP BY t.problem, t.true_key"""


@query("J25_grade", _TRUTH_RANK)
def _(v):
    return ranking.grade(v.candidate, v.truth.select("problem", "true_key"))


@query(
    "J26_calibration_offsets",
    """SELECT list_id, sum(offset_c)::BIGINT AS sum_c, count(*) AS n FROM (SELECT r.list_id, r.peak_id, arg_min(o.f1_c - r.pos_c, struct_pack(d := abs(o.f1_c - r.pos_c), p := o.peak_id)) AS offset_c FROM {peak1d} r JOIN {peak2d} o ON o.list_id = r.list_id AND abs(o.f1_c - r.pos_c) <= 500 GROUP BY r.list_id, r.peak_id) x GROUP BY list_id""",
)
def _(v):
    observed = v.peak2d.select("list_id", c("f1_c").alias("obs_c"), c("peak_id").alias("obs_order"))
    return joins.calibration_offsets(observed, v.peak1d.select("list_id", c("peak_id").alias("ref_id"), c("pos_c").alias("ref_c")), ["list_id"], 500)


@query(
    "J27_intensity_pairs",
    """SELECT list_id, peak_id, min(ref_order) AS ref_order, any_value(pos_c) AS pos_c FROM (SELECT r.list_id, r.peak_id AS ref_order, arg_min(p.peak_id, struct_pack(d := abs(p.pos_c - r.f1_c), i := p.peak_id)) AS peak_id, arg_min(p.pos_c, struct_pack(d := abs(p.pos_c - r.f1_c), i := p.peak_id)) AS pos_c
       FROM {peak2d} r JOIN {peak1d} p ON p.list_id = r.list_id AND abs(p.pos_c - r.f1_c) < 100 WHERE r.experiment = 'HSQC' GROUP BY r.list_id, r.peak_id) x GROUP BY list_id, peak_id""",
)
def _(v):
    refs = v.peak2d.where("experiment = 'HSQC'").select("list_id", c("peak_id").alias("ref_order"), c("f1_c").alias("ref_c"))
    return joins.intensity_pairs(refs, v.peak1d.select("list_id", "peak_id", "pos_c", "intensity"), ["list_id"], 100).select("list_id", "peak_id", "ref_order", "pos_c")
