"""Queries over incremental builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.streaming import jobs

from .catalog import query
from .graphs import CODES, CODES_CTE, _ring_sql
from .scratch import kept, new_folder
from .statistics import _STATE

c = F.col


def _folder(v) -> str:
    return new_folder(v.spark, "stream")


#: Most rows of a file that a stream reads; the files are as many as that takes.
FILE_ROWS = 4_000_000


def _files(rows: int, least: int) -> int:
    return max(least, -(-rows // FILE_ROWS))


@query("T1_build_stats", f"SELECT {_STATE} FROM {{env_state}}")
def _(v):
    base, obs = _folder(v), v.env_key.where("train")
    obs.repartition(_files(obs.count(), 4)).write.parquet(f"{base}/in")
    return jobs.build_stats(v.spark, f"{base}/in", obs.schema, f"{base}/state", f"{base}/checkpoint", 2)


@query("T1_build_counters", "SELECT 3 * count(*) AS processed, count(*) AS failed, 2 * count(*) AS observations FROM {env_key} WHERE train")
def _(v):
    # a third of the rows fail, and the build begins anew after a first one
    base, obs = _folder(v), v.env_key.where("train")
    rows = obs.count()
    obs.repartition(_files(rows, 4)).write.parquet(f"{base}/in")
    jobs.build_stats(v.spark, f"{base}/in", obs.schema, f"{base}/state", f"{base}/checkpoint", 4)
    obs.unionByName(obs.withColumn("code", F.lit(None).cast("string"))).repartition(_files(2 * rows, 8)).write.mode("append").parquet(f"{base}/in")
    jobs.build_stats(v.spark, f"{base}/in", obs.schema, f"{base}/state", f"{base}/checkpoint", 4, fresh=True)
    return jobs.build_counters(v.spark, f"{base}/state")


_DOUBLED = "SELECT DISTINCT b.compound_id, b.i AS atom FROM {bond} b JOIN five ON five.compound_id = b.compound_id AND five.atom = b.j WHERE b.bond_order IN (2, 4)"
_FACTS = f"""ring AS MATERIALIZED ({' UNION ALL '.join(_ring_sql(n) for n in (3, 4, 5, 6))}), five AS MATERIALIZED (SELECT DISTINCT compound_id, atom FROM ring WHERE size >= 5), pi AS MATERIALIZED ({_DOUBLED}),
    closed AS (SELECT r.compound_id, r.size, r.ring, count(p.atom) AS n, count(*) FILTER (p.atom IS NULL AND a.element IN ('N', 'O', 'S')) AS lone FROM ring r JOIN {{atom}} a ON a.compound_id = r.compound_id AND a.pos = r.atom LEFT JOIN pi p ON p.compound_id = r.compound_id AND p.atom = r.atom WHERE r.size >= 5 GROUP BY ALL),
    arom AS (SELECT DISTINCT r.compound_id, r.atom FROM ring r JOIN closed k ON k.compound_id = r.compound_id AND k.ring = r.ring WHERE k.size = 6 AND k.n = 6 OR k.size = 5 AND k.n = 4 AND k.lone = 1),
    around AS (SELECT b.compound_id, b.i AS pos, count(*) FILTER (b.bond_order = 3) AS tr, count(*) FILTER (b.bond_order = 2) AS dbl, bool_or(x.element = 'C') AS has_c, bool_or(x.element = 'O') AS has_o, bool_or(x.element = 'N') AS has_n, bool_or(x.element = 'S') AS has_s, bool_or(x.element IN ('F', 'Cl', 'Br', 'I')) AS has_x FROM {{bond}} b JOIN {{atom}} x ON x.compound_id = b.compound_id AND x.pos = b.j GROUP BY ALL),
    fact AS MATERIALIZED (SELECT a.compound_id, a.pos, CASE WHEN coalesce(n.tr, 0) > 0 OR coalesce(n.dbl, 0) > 1 THEN 'sp1' WHEN coalesce(n.dbl, 0) > 0 THEN 'sp2' ELSE 'sp3' END AS state, n.has_c, n.has_o, n.has_n, n.has_s, n.has_x,
       EXISTS (SELECT 1 FROM ring r WHERE r.compound_id = a.compound_id AND r.atom = a.pos AND r.size = 3) AS ring3, EXISTS (SELECT 1 FROM ring r WHERE r.compound_id = a.compound_id AND r.atom = a.pos AND r.size = 4) AS ring4,
       EXISTS (SELECT 1 FROM arom r WHERE r.compound_id = a.compound_id AND r.atom = a.pos) AS aromatic FROM {{atom}} a LEFT JOIN around n ON n.compound_id = a.compound_id AND n.pos = a.pos WHERE a.element = 'C')"""


#: Every third nitrogen as a halogen, so that the counter of halogens has something to count.
_HALIDE = "CASE WHEN element = 'N' AND (compound_id + pos) % 3 = 0 THEN 'Cl' ELSE element END"
_HALIDES = f"(SELECT compound_id, pos, {_HALIDE} AS element FROM {{atom}})"


@query(
    "T2_build_stats_from_sdf",
    f"""{CODES_CTE}, codes AS MATERIALIZED ({CODES}), {_FACTS}
       SELECT k.code, k.radius, count(*) AS n, sum(g.shift_c)::BIGINT AS sum_c, sum(g.shift_c * g.shift_c)::BIGINT AS sumsq_c, count(*) FILTER (f.state = 'sp3') AS sp3, count(*) FILTER (f.state = 'sp2') AS sp2, count(*) FILTER (f.state = 'sp1') AS sp1,
         count(*) FILTER (f.has_c) AS carbon, count(*) FILTER (f.has_o) AS oxygen, count(*) FILTER (f.has_n) AS nitrogen, count(*) FILTER (f.has_s) AS sulfur, count(*) FILTER (f.has_x) AS halogen, count(*) FILTER (f.ring3) AS ring3, count(*) FILTER (f.ring4) AS ring4, count(*) FILTER (f.aromatic) AS aromatic
       FROM codes k JOIN fact f ON f.compound_id = k.compound_id AND f.pos = k.pos JOIN {{signal}} g ON g.compound_id = k.compound_id AND g.atom_index = k.pos GROUP BY k.code, k.radius""".replace("{atom}", _HALIDES),
)
def _(v):
    from .text_sources import write_measured

    base = _folder(v)
    write_measured(v, f"{base}/in", _HALIDE, files=_files(v.compound.count(), 8))
    return jobs.build_stats_from_sdf(v.spark, f"{base}/in", "measured", f"{base}/state", f"{base}/checkpoint", files_per_batch=4)


_ALL_FRAGMENTS = "SELECT p_type || '/' || p_brand AS smiles, ord * 32 + pos AS fragment_id, part FROM {item} JOIN {part} ON p_partkey = part"


@query("T3_extract_fragments", "SELECT smiles, min(fragment_id) AS fragment_id, arg_min(part, fragment_id) AS part FROM (SELECT p_type || '/' || p_brand AS smiles, ord * 32 + pos AS fragment_id, part FROM {item} JOIN {part} ON p_partkey = part) f GROUP BY smiles")
def _(v):
    # made once and sorted by ids, so that each file below reads its own part
    rows = v.sql(_ALL_FRAGMENTS)
    base, rows = _folder(v), kept(rows.repartitionByRange("fragment_id").sortWithinPartitions("fragment_id"), "fragments")
    most, n = rows.agg(F.max("fragment_id"), F.count("*")).first()
    files, most = _files(n, 4), most or 0
    # files one after the other, in order of ids, so that it is known which fragment of a key comes first
    for k in range(files):
        part = rows.where((c("fragment_id") >= -(-k * (most + 1) // files)) & (c("fragment_id") < -(-(k + 1) * (most + 1) // files)))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return jobs.extract_fragments(v.spark, f"{base}/in", rows.schema, f"{base}/state", f"{base}/checkpoint", files_per_batch=1)


_STATUS = """SELECT f.run_id, 'running' AS state, coalesce(try_cast(regexp_extract(coalesce(a.active_phase, ''), '^lsd-iteration-(\\d+)$', 1) AS BIGINT), 0) AS iteration, a.active_phase, f.started, f.last_epoch, CASE WHEN f.started IS NOT NULL THEN greatest(f.last_epoch - f.started, 0) END AS elapsed_s
    FROM (SELECT run_id, arg_min(epoch::BIGINT, seq) FILTER (event = 'run_start') AS started, max(epoch::BIGINT) AS last_epoch FROM {run_event} GROUP BY run_id) f
    LEFT JOIN (SELECT run_id, arg_max(phase, seq) AS active_phase FROM {run_event} e WHERE event = 'phase_start' AND NOT EXISTS (SELECT 1 FROM {run_event} x WHERE x.event = 'phase_end' AND x.run_id = e.run_id AND x.phase = e.phase) GROUP BY run_id) a ON a.run_id = f.run_id"""


@query("T4_run_status", _STATUS)
def _(v):
    return jobs.run_status(v.run_event)


@query(
    "T4_run_status_tiers",
    f"""WITH s AS ({_STATUS}), done AS (SELECT run_id, max(try_cast(regexp_extract(phase, '^lsd-iteration-(\\d+)$', 1) AS BIGINT)) AS top FROM {{run_event}} WHERE run_id % 5 = 0 GROUP BY run_id)
    SELECT s.run_id, 'complete' AS state, CASE WHEN top > 0 THEN top END AS iteration, NULL AS active_phase, 60 + s.run_id % 50 AS elapsed_s FROM s JOIN done ON done.run_id = s.run_id
    UNION ALL SELECT run_id, state, iteration, active_phase, elapsed_s FROM s WHERE run_id % 5 <> 0 UNION ALL SELECT -1 - run_id, 'waiting', NULL, NULL, NULL FROM s""",
)
def _(v):
    runs = v.run_event.select("run_id").distinct()
    done = v.run_event.where("run_id % 5 = 0").groupBy("run_id").agg(F.collect_set("phase").alias("phases")).withColumn("elapsed_s", 60 + c("run_id") % 50)
    every = runs.unionByName(runs.select((-1 - c("run_id")).alias("run_id")))
    return jobs.run_status(v.run_event, done, runs=every).drop("started", "last_epoch")


@query("T4_run_status_stream", _STATUS)
def _(v):
    base = _folder(v)
    # made once: each file below takes its part of it
    timed = kept(v.run_event.withColumn("ts", F.timestamp_seconds(c("epoch").cast("bigint"))), "events")
    low, high = timed.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    # one file after the other in order of time, so that idle runs leave the state and come back
    for k in range(4):
        at = F.floor((F.unix_seconds("ts") - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0) + 1))
        timed.where(at == k).repartition(1).write.mode("append").parquet(f"{base}/in")
    events = v.spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return jobs.follow_into(events, f"{base}/state", f"{base}/checkpoint", idle_minutes=10)


@query("T5_meta", "SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM (SELECT 'k' || cast(ord % 300 AS string) AS key, cast(part AS string) AS value, ord * 32 + pos AS seq FROM {item}) x GROUP BY key UNION ALL SELECT 'bin_size', '2.0', 0::BIGINT")
def _(v):
    rows = v.sql("SELECT 'k' || cast(ord % 300 AS string) AS key, cast(part AS string) AS value, ord * 32 + pos AS seq FROM {item}")
    first = v.spark.createDataFrame([("bin_size", "2.0", 0)], rows.schema)
    bad = v.spark.createDataFrame([("bin_size", "9.9", 1)], rows.schema)
    return jobs.set_meta(first, rows.unionByName(bad))
