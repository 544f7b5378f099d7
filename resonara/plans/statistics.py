"""Queries over the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.functions import bits
from resonara.operators import joins, statistics

from .catalog import query

c = F.col

_STATE = "code, radius, n, sum_c, sumsq_c, sp3, sp2, sp1, carbon, oxygen, nitrogen, sulfur, halogen, ring3, ring4, aromatic"


@query(
    "A1_env_stats",
    """SELECT code, radius, sum_c::DOUBLE / n::DOUBLE / 100.0::DOUBLE AS mean, CASE WHEN n > 1 THEN sqrt((n * sumsq_c - sum_c * sum_c)::DOUBLE / (n::DOUBLE * (n - 1)::DOUBLE)) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS std_sample,
       sqrt((n * sumsq_c - sum_c * sum_c)::DOUBLE) / n::DOUBLE / 100.0::DOUBLE AS std_population, n FROM {env_state}""",
)
def _(v):
    return statistics.env_stats(statistics.env_state(v.env_key.where("train")))


@query("A2_env_state", f"SELECT {_STATE} FROM {{env_state}}")
def _(v):
    return statistics.env_state(v.env_key.where("train"))


@query("A2_merge_state", f"SELECT {_STATE} FROM {{env_state}}")
def _(v):
    train = v.env_key.where("train")
    return statistics.merge_state(statistics.env_state(train.where("pos % 2 = 0")), statistics.env_state(train.where("pos % 2 = 1")))


@query("A3_env_counters", "SELECT code, radius, sp3, sp2, sp1, carbon, oxygen, nitrogen, sulfur, halogen, ring3, ring4, aromatic FROM {env_state}")
def _(v):
    return v.env_key.where("train").groupBy("code", "radius").agg(*statistics.env_counters())


@query("A4_merge_into", f"SELECT {_STATE} FROM {{env_state}}")
def _(v):
    train = v.env_key.where("train")
    old = statistics.env_state(train.where("compound_id % 3 <> 0"))
    return statistics.merge_into(old, statistics.env_state(train.where("compound_id % 3 = 0")))


@query(
    "A5_replace_into",
    "SELECT part, arg_max(ord, struct_pack(age := CASE WHEN line > 3 THEN 1 ELSE 0 END, seq := ord * 32 + pos)) AS ord, arg_max(qty, struct_pack(age := CASE WHEN line > 3 THEN 1 ELSE 0 END, seq := ord * 32 + pos)) AS qty FROM {item} GROUP BY part",
)
def _(v):
    rows = v.item.select("part", "ord", "qty", (c("ord") * 32 + c("pos")).alias("seq"), "line")
    old, new = rows.where("line <= 3").drop("line"), rows.where("line > 3").drop("line")
    return statistics.replace_into(old, new, ["part"], "seq").select("part", "ord", "qty")


@query(
    "A6_insert_ignore",
    "SELECT part, supp, arg_min(ord, ord * 32 + pos) AS ord FROM {item} WHERE line > 5 AND (part, supp) NOT IN (SELECT part, supp FROM {item} WHERE line <= 2) GROUP BY part, supp",
)
def _(v):
    rows = v.item.select("part", "supp", "ord", (c("ord") * 32 + c("pos")).alias("seq"), "line")
    new, _counts = statistics.insert_ignore(rows.where("line <= 2"), rows.where("line > 5").drop("line"), ["part", "supp"], "seq")
    return new.select("part", "supp", "ord")


@query(
    "A6_insert_counts",
    "SELECT count(DISTINCT part) FILTER (NOT there) AS inserted, (count(*) - count(DISTINCT part) FILTER (NOT there))::BIGINT AS skipped FROM (SELECT part, part IN (SELECT part FROM {item} WHERE line <= 2) AS there FROM {item} WHERE line > 5) x",
)
def _(v):
    rows = v.item.select("part", "ord", (c("ord") * 32 + c("pos")).alias("seq"), "line")
    return statistics.insert_ignore(rows.where("line <= 2"), rows.where("line > 5").drop("line"), ["part"], "seq")[1]


_NEAR = "SELECT probe_id, e.* FROM {probe} p JOIN (SELECT *, sum_c::DOUBLE / n::DOUBLE AS mean_c FROM {env_state} WHERE radius = 3 AND n >= 5) e ON abs(p.shift_c - e.mean_c) <= 200"


@query("F3_window_filter", "SELECT code, n FROM (SELECT *, sum_c::DOUBLE / n::DOUBLE AS mean_c FROM {env_state}) e WHERE radius = 3 AND mean_c BETWEEN 12800 AND 13200 AND n >= 5")
def _(v):
    mean_c = c("sum_c").cast("double") / c("n").cast("double")
    return statistics.env_state(v.env_key.where("train")).where((c("radius") == 3) & mean_c.between(12800, 13200) & (c("n") >= 5)).select("code", "n")


@query("J4_band_join", _NEAR.replace("e.*", "e.code, e.n"))
def _(v):
    near = v.env_state.where("radius = 3 AND n >= 5").withColumn("mean_c", c("sum_c").cast("double") / c("n").cast("double"))
    return joins.band_join(v.probe, near, "shift_c", "mean_c", 200).select("probe_id", "code", "n")


@query(
    "A7_detect_state",
    f"""SELECT probe_id, codes, total, sp3, sp2, sp1, CASE WHEN greatest(sp3, sp2, sp1) = 0 THEN 'unknown' WHEN sp3 = greatest(sp3, sp2, sp1) THEN 'sp3' WHEN sp2 = greatest(sp3, sp2, sp1) THEN 'sp2' ELSE 'sp1' END AS state, greatest(sp3, sp2, sp1) > 0.95 AS definitive, total > 0 AS has_data
        FROM (SELECT probe_id, codes, total, CASE WHEN a + b + d > 0 THEN a / (a + b + d) ELSE 0.0 END AS sp3, CASE WHEN a + b + d > 0 THEN b / (a + b + d) ELSE 0.0 END AS sp2, CASE WHEN a + b + d > 0 THEN d / (a + b + d) ELSE 0.0 END AS sp1
          FROM (SELECT probe_id, codes, total, CASE WHEN total = 0 OR s3::DOUBLE / total::DOUBLE < 0.01 THEN 0.0::DOUBLE ELSE s3::DOUBLE / total::DOUBLE END AS a, CASE WHEN total = 0 OR s2::DOUBLE / total::DOUBLE < 0.01 THEN 0.0::DOUBLE ELSE s2::DOUBLE / total::DOUBLE END AS b, CASE WHEN total = 0 OR s1::DOUBLE / total::DOUBLE < 0.01 THEN 0.0::DOUBLE ELSE s1::DOUBLE / total::DOUBLE END AS d
            FROM (SELECT p.probe_id, count(x.code) AS codes, coalesce(sum(sp3), 0)::BIGINT AS s3, coalesce(sum(sp2), 0)::BIGINT AS s2, coalesce(sum(sp1), 0)::BIGINT AS s1, coalesce(sum(sp3 + sp2 + sp1), 0)::BIGINT AS total FROM {{probe}} p LEFT JOIN ({_NEAR}) x ON x.probe_id = p.probe_id GROUP BY p.probe_id) q) r) s""",
)
def _(v):
    return statistics.detect_state(v.probe, v.env_state)


@query(
    "A8_detect_neighbours",
    f"""SELECT probe_id, element, k::DOUBLE / total::DOUBLE AS frequency, CASE WHEN k::DOUBLE / total::DOUBLE < 0.01 THEN 'forbidden' WHEN k::DOUBLE / total::DOUBLE > 0.95 THEN 'mandatory' ELSE 'typical' END AS class, total, top = 0 AS unpopulated
        FROM (SELECT probe_id, total, greatest(a, b, d, e, f) AS top, unnest(['carbon', 'oxygen', 'nitrogen', 'sulfur', 'halogen']) AS element, unnest([a, b, d, e, f]) AS k
          FROM (SELECT probe_id, sum(n)::BIGINT AS total, sum(carbon)::BIGINT AS a, sum(oxygen)::BIGINT AS b, sum(nitrogen)::BIGINT AS d, sum(sulfur)::BIGINT AS e, sum(halogen)::BIGINT AS f FROM ({_NEAR}) x GROUP BY probe_id) y) z""",
)
def _(v):
    return statistics.detect_neighbours(v.probe, v.env_state)


_PAIRS = """SELECT DISTINCT b.compound_id, least(x.element, y.element) AS element1, greatest(x.element, y.element) AS element2 FROM {edge} b JOIN {atom} x ON x.compound_id = b.compound_id AND x.pos = b.i
            JOIN {atom} y ON y.compound_id = b.compound_id AND y.pos = b.j WHERE x.element <> 'C' AND y.element <> 'C'"""
_PAIR_STATS = f"""SELECT p.formula_norm, element1, element2, p.n, t.total, p.n::DOUBLE / t.total::DOUBLE AS frequency FROM (SELECT formula_norm, element1, element2, count(*) AS n FROM ({_PAIRS}) q JOIN {{compound}} k ON k.id = q.compound_id GROUP BY ALL) p
    JOIN (SELECT formula_norm, count(*) AS total FROM {{compound}} WHERE id IN (SELECT compound_id FROM {{atom}}) GROUP BY formula_norm) t ON t.formula_norm = p.formula_norm"""


@query("A9_pair_stats", _PAIR_STATS)
def _(v):
    return statistics.pair_stats(v.atom, v.bond, v.compound)


@query(
    "A10_detect_pairs",
    f"""SELECT f.formula_norm, CASE WHEN NOT regexp_matches(f.formula_norm, 'N|O|S|F|Cl|Br|I|P|Si') THEN 'no_heteroatom' WHEN k.n IS NULL THEN 'unknown_formula' WHEN s.n IS NULL THEN 'no_pairs' ELSE 'pairs' END AS case, coalesce(k.n, 0) AS compounds,
        s.element1, s.element2, s.frequency, s.frequency >= 0.2 AS allowed
        FROM (SELECT DISTINCT formula_norm || CASE WHEN id % 5 = 0 THEN 'Br' ELSE '' END AS formula_norm FROM {{compound}} UNION SELECT 'C' || cast(c_custkey AS string) || 'H8' FROM {{customer}}) f
        LEFT JOIN (SELECT formula_norm, count(*) AS n FROM {{compound}} GROUP BY formula_norm) k ON k.formula_norm = f.formula_norm LEFT JOIN ({_PAIR_STATS}) s ON s.formula_norm = f.formula_norm""",
)
def _(v):
    asked = v.sql("SELECT DISTINCT formula_norm || CASE WHEN id % 5 = 0 THEN 'Br' ELSE '' END AS formula_norm FROM {compound} UNION SELECT 'C' || cast(c_custkey AS string) || 'H8' FROM {customer}")
    return statistics.detect_pairs(asked, statistics.pair_stats(v.atom, v.bond, v.compound), v.compound, 0.2)


@query(
    "A11_code_stats",
    """SELECT code, radius, median(shift_c)::DOUBLE / 100.0::DOUBLE AS median, sum(shift_c)::DOUBLE / count(*)::DOUBLE / 100.0::DOUBLE AS mean,
       CASE WHEN count(*) > 1 THEN sqrt((count(*) * sum(shift_c * shift_c) - sum(shift_c) * sum(shift_c))::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)::DOUBLE)) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS std, min(shift_c) AS min_c, max(shift_c) AS max_c, count(*) AS n FROM {env_key} GROUP BY code, radius""",
)
def _(v):
    return statistics.code_stats(v.env_key)


@query("A12_code_table", "SELECT code, radius, count(*) AS n, min(shift_c) AS first_c, max(shift_c) AS last_c FROM {env_key} GROUP BY code, radius")
def _(v):
    table = statistics.build_code_table(v.env_key)[0]
    return table.select("code", "radius", F.size("shifts_c").cast("bigint").alias("n"), c("shifts_c")[0].alias("first_c"), F.element_at("shifts_c", -1).alias("last_c"))


@query("A12_code_counters", "SELECT count(DISTINCT compound_id) AS molecules, count(*) AS entries, (SELECT count(*) FROM (SELECT DISTINCT code, radius FROM {env_key}) d) AS codes FROM {env_key}")
def _(v):
    return statistics.build_code_table(v.env_key)[1]


@query(
    "A24_fragment_records",
    """SELECT smiles, list_min(s)::BIGINT AS min_c, list_max(s)::BIGINT AS max_c, list_sum(s)::DOUBLE / 3.0::DOUBLE AS avg_c, bit_low::BIGINT AS low_word FROM (
       SELECT smiles, [s1, s2, s3] AS s, list_bit_or(list_transform([s1, s2, s3], lambda x: CASE WHEN x // 200 < 32 THEN 1::BIGINT << (x // 200)::INT ELSE 0::BIGINT END)) AS bit_low FROM {fragment}) f""",
)
def _(v):
    shifts = v.fragment.withColumn("s", F.array("s1", "s2", "s3"))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return shifts.select("smiles", F.array_min("s").alias("min_c"), F.array_max("s").alias("max_c"), (total.cast("double") / F.lit(3.0)).alias("avg_c"), bits.fingerprint(c("s"))[0].alias("low_word"))
