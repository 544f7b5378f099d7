"""Queries over spectra: noise, picking, ladders, planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.functions import scoring
from resonara.operators import peaks, ranking
from resonara.sources import payloads

from .catalog import query

c = F.col

_NOISE = """SELECT spectrum_id, CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE 0.05::DOUBLE * top / 3.0::DOUBLE END AS sigma FROM (SELECT p.spectrum_id, median(abs(y - m))::DOUBLE AS mad, max(abs(y))::DOUBLE AS top FROM {point1d} p JOIN (SELECT spectrum_id, median(y)::DOUBLE AS m FROM {point1d} GROUP BY spectrum_id) q ON q.spectrum_id = p.spectrum_id GROUP BY p.spectrum_id) x"""


@query("A20_noise_1d", _NOISE)
def _(v):
    return peaks.noise_sigma(v.point1d, ["spectrum_id"], "y")


_NOISE_2D = _NOISE.replace("{point1d}", "{grid2d}").replace("spectrum_id", "plane_id").replace("y", "z").replace("3.0::DOUBLE", "5.0::DOUBLE").replace("anz", "any")


@query("A20_noise_2d", _NOISE_2D)
def _(v):
    return peaks.noise_sigma(v.grid2d, ["plane_id"], "z", k=5.0)


@query(
    "A21_corner_noise",
    """SELECT plane_id, sqrt((sum(w) * sum(w * z * z) - sum(w * z) * sum(w * z))::DOUBLE) / sum(w)::DOUBLE AS noise FROM (SELECT g.plane_id, z, ((i < ci)::INT + (i >= ni - ci)::INT) * ((j < cj)::INT + (j >= nj - cj)::INT) AS w FROM {grid2d} g
       JOIN (SELECT plane_id, ni, nj, greatest(1, floor(ni * 0.1::DOUBLE)) AS ci, greatest(1, floor(nj * 0.1::DOUBLE)) AS cj FROM (SELECT plane_id, max(i) + 1 AS ni, max(j) + 1 AS nj FROM {grid2d} GROUP BY plane_id) s) t ON t.plane_id = g.plane_id) x WHERE w > 0 GROUP BY plane_id""",
)
def _(v):
    return peaks.corner_noise(v.grid2d)


_MAXIMA = """SELECT spectrum_id, cast(floor((lo + hi) / 2) AS BIGINT) AS i, y FROM (SELECT *, lag(y) OVER (PARTITION BY spectrum_id ORDER BY run) AS before, lead(y) OVER (PARTITION BY spectrum_id ORDER BY run) AS after FROM (
    SELECT spectrum_id, run, min(i) AS lo, max(i) AS hi, any_value(y) AS y FROM (SELECT *, sum(new) OVER (PARTITION BY spectrum_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY spectrum_id ORDER BY i) = y THEN 0 ELSE 1 END AS new FROM {point1d}) a) b GROUP BY spectrum_id, run) d) e WHERE y > before AND y > after"""


@query("W6_local_maxima", _MAXIMA)
def _(v):
    return peaks.local_maxima(v.point1d, ["spectrum_id"], "y")


@query("W6_pick_1d")
def _(v):
    return peaks.pick_1d(v.point1d, ["spectrum_id"], "y", snr_floor=2.0)


_TOPS = f"SELECT * FROM (SELECT *, max(abs(y)) OVER (PARTITION BY spectrum_id) AS top FROM ({_MAXIMA}) m) t WHERE abs(y)::DOUBLE >= 0.5::DOUBLE * top::DOUBLE"


@query(
    "A22_line_widths",
    f"""WITH t AS MATERIALIZED (SELECT spectrum_id, i AS at_, y::DOUBLE / 2.0::DOUBLE AS half FROM ({_TOPS}) x),
        s AS (SELECT t.spectrum_id, t.at_, any_value(t.half) AS half, max(p.i) FILTER (p.i < t.at_ AND p.y::DOUBLE <= t.half) AS l, min(p.i) FILTER (p.i > t.at_ AND p.y::DOUBLE <= t.half) AS r, min(p.i) AS lo, max(p.i) AS hi FROM t JOIN {{point1d}} p ON p.spectrum_id = t.spectrum_id GROUP BY t.spectrum_id, t.at_),
        w AS (SELECT s.spectrum_id, (coalesce(s.r - (s.half - rv.y) / (rn.y - rv.y)::DOUBLE, s.hi::DOUBLE) - coalesce(s.l + (s.half - lv.y) / (ln_.y - lv.y)::DOUBLE, s.lo::DOUBLE)) * 0.01::DOUBLE AS w FROM s
              LEFT JOIN {{point1d}} lv ON lv.spectrum_id = s.spectrum_id AND lv.i = s.l LEFT JOIN {{point1d}} ln_ ON ln_.spectrum_id = s.spectrum_id AND ln_.i = s.l + 1 LEFT JOIN {{point1d}} rv ON rv.spectrum_id = s.spectrum_id AND rv.i = s.r LEFT JOIN {{point1d}} rn ON rn.spectrum_id = s.spectrum_id AND rn.i = s.r - 1)
        SELECT spectrum_id, median(w) AS "median", min(w) AS "min", max(w) AS "max", median(w) * 1.5::DOUBLE AS distance, count(*) AS n FROM (SELECT *, count(*) FILTER (w < 1.0) OVER (PARTITION BY spectrum_id) AS narrow FROM w) x WHERE narrow = 0 OR w < 1.0 GROUP BY spectrum_id""",
)
def _(v):
    tops = peaks.above_share_of_max(peaks.local_maxima(v.point1d, ["spectrum_id"], "y"), ["spectrum_id"], "y", 0.5)
    return peaks.width_summary(peaks.line_widths(v.point1d, tops, ["spectrum_id"], "y"), ["spectrum_id"], 0.01)


_HSQC_REFS = "SELECT r.list_id, r.peak_id AS ref_order, arg_min(p.peak_id, struct_pack(d := abs(p.pos_c - r.f1_c), i := p.peak_id)) AS peak_id FROM {peak2d} r JOIN {peak1d} p ON p.list_id = r.list_id AND abs(p.pos_c - r.f1_c) < 100 WHERE r.experiment = 'HSQC' AND p.pos_c BETWEEN 10000 AND 16500 GROUP BY ALL"


@query(
    "A23_intensity_doubled",
    f"""SELECT DISTINCT x.list_id, x.peak_id, p.pos_c, p.intensity::DOUBLE / m.m AS ratio, round_even(p.intensity::DOUBLE / m.m, 0)::BIGINT AS carbons FROM ({_HSQC_REFS}) x JOIN {{peak1d}} p ON p.list_id = x.list_id AND p.peak_id = x.peak_id
        JOIN (SELECT list_id, median(intensity)::DOUBLE AS m FROM {{peak1d}} WHERE pos_c BETWEEN 10000 AND 16500 GROUP BY list_id HAVING count(*) >= 2 AND median(intensity) > 0) m ON m.list_id = x.list_id WHERE p.intensity::DOUBLE / m.m >= 1.6::DOUBLE""",
)
def _(v):
    refs = v.peak2d.where("experiment = 'HSQC'").select("list_id", c("peak_id").alias("ref_order"), c("f1_c").alias("ref_c"))
    return peaks.intensity_doubled(v.peak1d.select("list_id", "peak_id", "pos_c", "intensity"), refs, ["list_id"])


@query(
    "F4_solvent_windows",
    """SELECT spectrum_id, count(*) AS points FROM (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY spectrum_id) AS left_ FROM (SELECT spectrum_id, i, i % 22000 BETWEEN 7200 AND 8200 AND spectrum_id % 3 = 0 OR (i * 40 % 22000 BETWEEN 100 AND 500 OR i * 40 % 22000 BETWEEN 11400 AND 12000) AND spectrum_id % 3 = 1 OR spectrum_id % 3 = 2 AS hit
       FROM {point1d}) a) b WHERE NOT hit OR left_ = 0 GROUP BY spectrum_id""",
)
def _(v):
    points = v.point1d.withColumn("ppm", F.when(c("spectrum_id") % 3 == 0, c("i") % 22000).otherwise(c("i") * 40 % 22000) / 100)
    windows = v.point1d.select("spectrum_id").distinct()
    solvent = F.expr("CASE spectrum_id % 3 WHEN 0 THEN 'CDCl3' WHEN 1 THEN 'CD3CN' ELSE 'all' END")
    table = v.spark.createDataFrame([(k, lo, hi) for k, ws in {**peaks.SOLVENT_WINDOWS, "all": [(0.0, 1000.0)]}.items() for lo, hi in ws], "solvent string, lo double, hi double")
    given = windows.withColumn("solvent", solvent).join(F.broadcast(table), "solvent").drop("solvent")
    return peaks.without_solvent(points, ["spectrum_id"], given).groupBy("spectrum_id").agg(F.count("*").alias("points"))


@query(
    "F5_thresholds",
    f"""SELECT p.spectrum_id, count(*) FILTER (abs(y)::DOUBLE >= t.t) AS kept, any_value(t.t) AS threshold FROM {{point1d}} p JOIN (SELECT n.spectrum_id, CASE n.spectrum_id % 3 WHEN 0 THEN 500.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE * m.top::DOUBLE ELSE 3.0::DOUBLE * n.sigma END AS t
        FROM ({_NOISE}) n JOIN (SELECT spectrum_id, max(abs(y)) AS top FROM {{point1d}} GROUP BY spectrum_id) m ON m.spectrum_id = n.spectrum_id) t ON t.spectrum_id = p.spectrum_id GROUP BY p.spectrum_id""",
)
def _(v):
    facts = peaks.noise_sigma(v.point1d, ["spectrum_id"], "y").join(v.point1d.groupBy("spectrum_id").agg(F.max(F.abs("y")).alias("top")), "spectrum_id")
    mode = F.expr("CASE spectrum_id % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'fraction' ELSE 'snr' END")
    limits = facts.select("spectrum_id", peaks.threshold(mode, F.lit(500.0), F.lit(0.5), c("top").cast("double"), c("sigma"), 3.0).alias("threshold"))
    return v.point1d.join(limits, "spectrum_id").groupBy("spectrum_id").agg(F.count_if(F.abs("y").cast("double") >= c("threshold")).alias("kept"), F.first("threshold").alias("threshold"))


@query("F7_negative_signals", "SELECT list_id, count(*) FILTER (top > 0 AND intensity::DOUBLE < -0.05::DOUBLE * top) > 0 AS edited, count(*) FILTER (top > 0 AND intensity::DOUBLE < -0.05::DOUBLE * top) AS negatives FROM (SELECT *, max(abs(intensity))::DOUBLE OVER (PARTITION BY list_id) AS top FROM {peak2d}) p GROUP BY list_id".replace("max(abs(intensity))::DOUBLE OVER (PARTITION BY list_id)", "(max(abs(intensity)) OVER (PARTITION BY list_id))::DOUBLE"))
def _(v):
    return peaks.negative_signals(v.peak2d, ["list_id"], "intensity")


@query("W4_rank_in_carbon", "SELECT list_id, peak_id, row_number() OVER (PARTITION BY list_id, round_even(f1_c::DOUBLE / 50.0::DOUBLE, 0) ORDER BY abs(intensity) DESC, peak_id) AS rank_in_carbon FROM {peak2d} WHERE experiment = 'HMBC'")
def _(v):
    return ranking.rank_in_carbon(v.peak2d.where("experiment = 'HMBC'")).select("list_id", "peak_id", "rank_in_carbon")


@query("W5_relative_intensity", "SELECT list_id, peak_id, abs(intensity)::DOUBLE / (CASE WHEN max(abs(intensity)) OVER (PARTITION BY list_id) = 0 THEN 1 ELSE max(abs(intensity)) OVER (PARTITION BY list_id) END)::DOUBLE AS rel_intensity FROM {peak2d}")
def _(v):
    return ranking.relative_intensity(v.peak2d, ["list_id"]).select("list_id", "peak_id", "rel_intensity")


@query(
    "W12_pick_2d",
    f"""WITH RECURSIVE noise AS MATERIALIZED ({_NOISE_2D}), e AS MATERIALIZED (SELECT g.plane_id, i, j, z, n.sigma, i * 1024 + j AS n FROM {{grid2d}} g JOIN noise n ON n.plane_id = g.plane_id WHERE z::DOUBLE >= 3.0::DOUBLE * n.sigma),
       reach AS (SELECT plane_id, n AS start, n AS node FROM e UNION SELECT r.plane_id, r.start, y.n FROM reach r JOIN e x ON x.plane_id = r.plane_id AND x.n = r.node JOIN e y ON y.plane_id = x.plane_id AND abs(y.i - x.i) <= 1 AND abs(y.j - x.j) <= 1),
       region AS (SELECT plane_id, start, min(node) AS region FROM reach GROUP BY ALL), r AS (SELECT e.*, region FROM e JOIN region g ON g.plane_id = e.plane_id AND g.start = e.n),
       best AS (SELECT plane_id, count(*) AS cells, arg_min(i, struct_pack(z := -z, i := i, j := j)) AS i, arg_min(j, struct_pack(z := -z, i := i, j := j)) AS j, max(z) AS z, any_value(sigma) AS sigma FROM r GROUP BY plane_id, region)
       SELECT plane_id, cells, i, j, z, abs(z)::DOUBLE / sigma AS snr, row_number() OVER (PARTITION BY plane_id ORDER BY i, j) AS rank FROM best""",
)
def _(v):
    return peaks.pick_2d(v.grid2d, snr_floor=3.0)


@query(
    "W13_threshold_search",
    """WITH ladder AS (SELECT k, 0.1::DOUBLE * 0.5::DOUBLE ** k AS t FROM (SELECT unnest(range(5)) AS k) x), s AS (SELECT list_id, peak_id, f1_c, abs(intensity)::DOUBLE / (max(abs(intensity)) OVER (PARTITION BY list_id))::DOUBLE AS share FROM {peak2d} WHERE experiment = 'HSQC'),
       reach AS (SELECT d.list_id, d.peak_id, coalesce(max(s.share), -1.0::DOUBLE) AS reach FROM {dept} d LEFT JOIN s ON s.list_id = d.list_id AND abs(s.f1_c - d.pos_c) <= 100 GROUP BY ALL),
       rung AS (SELECT r.list_id, l.k, l.t, count(*) FILTER (reach < l.t) AS unmatched FROM reach r, ladder l GROUP BY ALL), best AS (SELECT list_id, coalesce(min(k) FILTER (unmatched = 0), 4) AS k FROM rung GROUP BY list_id)
       SELECT g.list_id, (g.k + 1)::BIGINT AS iterations, g.t AS last_tried, CASE WHEN g.unmatched = 0 THEN g.t ELSE g.t * 0.5::DOUBLE END AS threshold, g.unmatched FROM rung g JOIN best b ON b.list_id = g.list_id AND b.k = g.k""",
)
def _(v):
    return peaks.threshold_search(v.peak2d.where("experiment = 'HSQC'"), v.dept, ["list_id"], 100)


@query("A31_decimate", "SELECT g.plane_id, i // si AS bi, j // sj AS bj, max(z) AS z FROM {grid2d} g JOIN (SELECT plane_id, ceil((max(i) + 1)::DOUBLE / 16)::BIGINT AS si, ceil((max(j) + 1)::DOUBLE / 16)::BIGINT AS sj FROM {grid2d} GROUP BY plane_id) s ON s.plane_id = g.plane_id GROUP BY ALL")
def _(v):
    return peaks.decimate(v.grid2d, 16)


@query("W14_sorted_lists", "SELECT list_id, string_agg(cast(pos_c AS string), ',' ORDER BY pos_c DESC) AS shifts FROM {peak1d} GROUP BY list_id")
def _(v):
    return v.peak1d.groupBy("list_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("pos_c"), asc=False), lambda x: x.cast("string")), ",").alias("shifts"))


@query(
    "read_describe_spectra",
    "SELECT spectrum_id, count(*) AS points, min(i)::DOUBLE * 0.4::DOUBLE AS low_ppm, max(i)::DOUBLE * 0.4::DOUBLE AS high_ppm, min(y) AS min_y, max(y) AS max_y FROM {point1d} GROUP BY spectrum_id",
)
def _(v):
    ppm = c("i").cast("double") * F.lit(0.4)
    return v.point1d.groupBy("spectrum_id").agg(F.count("*").alias("points"), F.min(ppm).alias("low_ppm"), F.max(ppm).alias("high_ppm"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


@query(
    "S22_peaklist_payload",
    "SELECT list_id, experiment, count(*) AS n_cross_peaks, string_agg(cast(f1_c AS string), ',' ORDER BY peak_id) AS f1, count(*) FILTER (experiment = 'HSQC' AND intensity < 0 AND low::DOUBLE < -0.05::DOUBLE * top::DOUBLE) AS negatives FROM (SELECT *, min(intensity) OVER (PARTITION BY list_id, experiment) AS low, max(abs(intensity)) OVER (PARTITION BY list_id, experiment) AS top FROM {peak2d}) p GROUP BY list_id, experiment",
)
def _(v):
    written = payloads.peaklist_payload(v.peak2d.withColumns({"verdict": F.lit("PARTIAL"), "violated": F.array(F.lit("ridge"))}), "x")
    read = written.select("list_id", "experiment", F.from_json("payload", payloads.PAYLOAD).alias("p"))
    peak = F.col("p.cross_peaks")
    cents = lambda x: F.round(F.coalesce(x["c13_ppm"], x["h1a_ppm"]) * 100).cast("bigint")
    return read.select(
        "list_id", "experiment", c("p.n_cross_peaks").alias("n_cross_peaks"), F.array_join(F.transform(peak, lambda x: cents(x).cast("string")), ",").alias("f1"),
        F.size(F.filter(peak, lambda x: (c("experiment") == "HSQC") & (x["multiplicity_hint"] == "CH2"))).cast("bigint").alias("negatives"),
    )


@query("S23_peaklist_payload_1d", "SELECT list_id, '13C' AS nucleus, '13C_' || list_id || '.json' AS file_name, count(*) AS n, count(*) FILTER (intensity < 0) > 0 AS negative_detected FROM {peak1d} GROUP BY list_id")
def _(v):
    good, _bad = payloads.peaklist_payload_1d(v.peak1d.select("list_id", F.lit("13C").alias("nucleus"), c("pos_c"), "intensity"), snr_floor=5.0)
    read = good.select("list_id", "nucleus", "file_name", F.from_json("payload", payloads.PAYLOAD_1D).alias("p"))
    return read.select("list_id", "nucleus", "file_name", c("p.count").alias("n"), c("p.negative_detected").alias("negative_detected"))
