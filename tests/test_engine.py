"""Whole operators against brute force: paths, regions, widths, searches, streams, ingest, sinks."""

import random
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from resonara import api
from resonara.functions import records
from resonara.operators import analysis, graphs, joins, peaks, statistics
from resonara.plans import scratch
from resonara.sources import jcamp, sdf, text
from resonara.streaming import jobs

c = F.col
SIGNAL = "pos bigint, shift_c bigint, h_count bigint"


def _bonds(spark, *chains):
    pairs = [(k, a, b) for k, edges in chains for x, y in edges for a, b in ((x, y), (y, x))]
    return spark.createDataFrame([(k, a, b, 1) for k, a, b in pairs], "compound_id bigint, i bigint, j bigint, bond_order int")


def test_paths_have_no_limit(spark):
    bonds = _bonds(spark, (1, [(i, i + 1) for i in range(9)]), (2, [(0, 1), (2, 3)]))
    pairs = spark.createDataFrame([(1, 0, 9), (1, 0, 1), (1, 4, 4), (2, 0, 3), (2, 2, 3)], "compound_id bigint, a bigint, b bigint")
    paths = graphs.path_lengths(bonds, pairs)
    assert {(r.compound_id, r.a, r.b): r.path for r in paths.collect()} == {(1, 0, 9): 9, (1, 0, 1): 1, (1, 4, 4): 0, (2, 0, 3): None, (2, 2, 3): 1}
    got = {r.compound_id: r for r in graphs.j_summary(paths).collect()}
    assert (got[1].max_j, got[1].all_3j, got[1].unreachable) == (10, False, 0)
    assert (got[2].max_j, got[2].all_3j, got[2].unreachable, got[2].j2) == (2, True, 1, 1)


def test_regions_of_wide_planes_stay_apart(spark):
    cells = [(0, 5, 1030, 9), (0, 6, 6, 8), (0, 6, 7, 7), (3, 1023, 2047, 5), (3, 1022, 2046, 6), (3, 0, 0, 4)]
    grid = spark.createDataFrame(cells, "plane_id bigint, i bigint, j bigint, z bigint")
    got = {(r.plane_id, r.i, r.j): (r.region_i, r.region_j) for r in graphs.connected_regions(grid.select("plane_id", "i", "j")).collect()}
    assert got == {(0, 5, 1030): (5, 1030), (0, 6, 6): (6, 6), (0, 6, 7): (6, 6), (3, 1023, 2047): (1022, 2046), (3, 1022, 2046): (1022, 2046), (3, 0, 0): (0, 0)}
    with pytest.raises(ValueError, match="63 bits"):
        graphs.connected_regions(spark.createDataFrame([(1 << 40, 1 << 20, 1 << 20)], "plane_id bigint, i bigint, j bigint"))


def test_pick_2d_has_snr_and_order(spark):
    rng = random.Random(2)
    rows = [(1, i, j, float(rng.randint(-3, 3)), 200.0 - i, 12.0 - j / 10) for i in range(30) for j in range(30)]
    top = {(4, 5): 90.0, (4, 20): 70.0, (25, 3): -80.0}
    rows = [(p, i, j, top.get((i, j), z), a, b) for p, i, j, z, a, b in rows]
    grid = spark.createDataFrame(rows, "plane_id bigint, i bigint, j bigint, z double, f1 double, f2 double")
    sigma = 1.4826 * float(np.median(np.abs(np.array([r[3] for r in rows]) - np.median([r[3] for r in rows]))))
    got = peaks.pick_2d(grid, negative=True).orderBy("rank").collect()
    assert [(r.i, r.j, r.z, r["rank"]) for r in got] == [(4, 5, 90.0, 1), (4, 20, 70.0, 2), (25, 3, -80.0, 3)]
    assert [r.snr for r in got] == pytest.approx([90 / sigma, 70 / sigma, 80 / sigma])
    loose = peaks.pick_2d(grid, share=0.8).collect()
    assert [(r.i, r.j, r.snr) for r in loose] == [(4, 5, None)]


def test_line_widths_equal_a_plain_search(spark):
    rng = random.Random(6)
    rows = [(s, i, rng.randint(0, 30) + (40 if rng.random() < 0.05 else 0)) for s, n in ((1, 700), (2, 17), (3, 3)) for i in range(n)]
    # a spectrum that never falls to half height
    rows += [(4, i, 100 + i % 2) for i in range(60)]
    points = spark.createDataFrame(rows, "s int, i bigint, y bigint").repartition(3)
    tops = peaks.local_maxima(points, ["s"], "y")
    y = defaultdict(dict)
    for s, i, v in rows:
        y[s][i] = float(v)
    wanted = {}
    for r in tops.collect():
        own, half = y[r.s], r.y / 2
        left = max((i for i in own if i < r.i and own[i] <= half), default=None)
        right = min((i for i in own if i > r.i and own[i] <= half), default=None)
        lo = min(own) if left is None else left + (half - own[left]) / (own[left + 1] - own[left])
        hi = max(own) if right is None else right - (half - own[right]) / (own[right - 1] - own[right])
        wanted[r.s, r.i] = hi - lo
    got = {(r.s, r.i): r.width for r in peaks.line_widths(points, tops, ["s"], "y").collect()}
    assert got.keys() == wanted.keys() and len(got) > 150
    assert all(got[k] == pytest.approx(wanted[k]) for k in wanted)


def test_pick_1d_equals_the_rules(spark):
    """Threshold, two passes of spacing by the widths of what passes it, and snr, all in plain Python."""
    rng = random.Random(8)
    n = 400
    y = [rng.gauss(0, 1) for _ in range(n)]
    for at, height in ((50, 60), (56, 30), (150, 80), (155, 75), (300, -90), (306, -40)):
        for d in range(-8, 9):
            y[at + d] += height * np.exp(-((d / 2.5) ** 2))
    points = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "s int, i bigint, y double")
    sigma = 1.4826 * float(np.median(np.abs(np.array(y) - np.median(y))))

    def picked(v, ppm):
        tops = [i for i in range(1, n - 1) if v[i] > v[i - 1] and v[i] > v[i + 1] and v[i] >= 5 * sigma]
        widths = []
        for i in tops:
            half = v[i] / 2
            left = max((k for k in range(i) if v[k] <= half), default=None)
            right = min((k for k in range(i + 1, n) if v[k] <= half), default=None)
            lo = 0 if left is None else left + (half - v[left]) / (v[left + 1] - v[left])
            hi = n - 1 if right is None else right - (half - v[right]) / (v[right - 1] - v[right])
            widths.append((hi - lo) * ppm)
        narrow = [w for w in widths if w < 1] or widths
        apart = max(1, int(np.floor(float(np.median(narrow)) * 1.5 / ppm))) if narrow else 5
        stays = []
        for i in sorted(tops, key=lambda i: (-v[i], -i)):
            if all(abs(i - k) >= apart for k in stays):
                stays.append(i)
        return sorted(stays)

    got = sorted((r.i, round(r.snr, 6)) for r in peaks.pick_1d(points, ["s"], "y", negative=True).collect())
    wanted = sorted(picked(y, 0.01) + picked([-v for v in y], 0.01))
    assert [i for i, _ in got] == wanted == [50, 150, 300]
    assert [x for _, x in got] == pytest.approx([abs(y[i]) / sigma for i in wanted], rel=1e-5)


def test_nearest_index_takes_the_first_on_ties(spark):
    rng = random.Random(4)
    axis = [(s, i, 40 * i) for s in (1, 2) for i in range(50)] + [(3, 0, 7), (3, 1, 7)]
    asked = [(rng.choice((1, 2, 3, 9)), k, rng.choice((20 * rng.randint(-2, 110), rng.randint(0, 2000)))) for k in range(200)]
    got = records.nearest_index(spark.createDataFrame(asked, "spectrum_id int, probe_id int, shift_c bigint"), spark.createDataFrame(axis, "spectrum_id int, i bigint, axis_c bigint"), "shift_c").collect()
    own = defaultdict(list)
    for s, i, at in axis:
        own[s].append((at, i))
    assert Counter((r.spectrum_id, r.probe_id, r.i) for r in got) == Counter((s, k, min((abs(at - x), i) for at, i in own[s])[1]) for s, k, x in asked if s in own)


def test_nearest_index_gives_pairs_of_a_group_without_moving_them(spark):
    rng = random.Random(5)
    # rising, falling and uneven axes; the last one has a single point
    axes = {1: [(i, 40 * i) for i in range(30)], 2: [(i, 2000 - 50 * i) for i in range(30)], 4: [(i, rng.randint(-3000, 3000)) for i in range(40)], 5: [(7, 100)]}
    axis = spark.createDataFrame([(s, s % 3, i, at) for s, points in axes.items() for i, at in points], "spectrum_id int, part int, i bigint, axis_c bigint")
    asked = [(k, k % 3, rng.choice((10 * rng.randint(-400, 400), rng.randint(-30_000, 30_000)))) for k in range(300)]
    found = records.nearest_index(spark.createDataFrame(asked, "probe_id int, part int, shift_c bigint"), axis, "shift_c", "part")
    wanted = Counter((s, k, min((abs(at - x), i) for i, at in points)[1]) for k, part, x in asked for s, points in axes.items() if s % 3 == part)
    assert Counter((r.spectrum_id, r.probe_id, r.i) for r in found.collect()) == wanted
    above = found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert not any(x in above for x in ("Exchange", "Window", "Sort "))


def test_surrogate_ids_do_not_clash(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("src"), c("id") % 28).alias("source"), c("id").alias("key"))
    named = rows.withColumn("id", records.surrogate_id(c("source"), c("key")))
    assert records.clashes(named, "id", "source", "key").count() == 0
    assert named.agg(F.max(F.abs("id"))).first()[0] > 1 << 40
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 2), (2, "a", 2)], "id int, source string, key int")
    assert [tuple(r) for r in records.clashes(twice, "id", "source", "key").collect()] == [(1, 2)]


def test_prescreen_equals_containment(spark):
    rng = random.Random(5)
    queries = [(q, [rng.randrange(0, 22000) for _ in range(rng.randint(1, 40))]) for q in range(25)]
    fragments = [(f, [min(21999, max(0, rng.choice(queries)[1][0] + rng.randint(-300, 300))) for _ in range(rng.randint(1, 3))]) for f in range(300)]
    for bins in (0, 1):
        got = joins.prescreen(spark.createDataFrame(queries, "query_id int, shifts array<bigint>"), spark.createDataFrame(fragments, "fragment_id int, shifts array<bigint>"), bins)
        near = {q: {min(max(s // 200 + d, 0), 255) for s in ss for d in range(-bins, bins + 1)} for q, ss in queries}
        assert Counter(map(tuple, got.collect())) == Counter((q, f) for q in near for f, ss in fragments if {s // 200 for s in ss} <= near[q])


def test_lookup_groups_asked_compounds_only(spark):
    compounds = spark.createDataFrame([(1, "C2"), (2, "C2"), (3, "C9")], "id bigint, formula_norm string")
    signals = spark.createDataFrame([(k, p, 100 * p, 1) for k in (1, 2, 3) for p in range(2)], f"compound_id bigint, {SIGNAL}")
    found = joins.lookup_by_formula(spark.createDataFrame([("C2",)], "formula_norm string"), compounds, signals)
    assert sorted((r.id, len(r.refs)) for r in found.collect()) == [(1, 2), (2, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


# -- incremental builds ------------------------------------------------------------------------


def test_state_compacts_and_forgets_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 2)
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    state = jobs.State(spark, str(tmp_path / "s"), total)
    assert state.table() is None and state.start(str(tmp_path / "cp"))
    one = lambda before: spark.createDataFrame([(1, 1)], "k int, n bigint")
    for number in range(7):
        state.add(one, number)
        state.add(one, number)  # a batch that runs again
    assert state.runs() == [(2, 3), (1, 5), (0, 6)]
    state.add(one, 2)  # long in a run
    assert state.table().first().n == 7 and state.table(6).first().n == 6
    # a new checkpoint folder is numbered after the others; one that is there goes on
    (tmp_path / "cp2").mkdir()
    other = jobs.State(spark, str(tmp_path / "s"), total)
    other.start(str(tmp_path / "cp2"))
    assert other.offset == 8
    other.add(one, 0)
    assert other.table().first().n == 8
    again = jobs.State(spark, str(tmp_path / "s"), total)
    assert not again.start(str(tmp_path / "cp2")) and again.offset == 8
    again.add(one, 0)
    assert again.table().first().n == 8
    assert again.start(str(tmp_path / "cp2"), fresh=True) and again.table() is None and again.offset == 0


def test_builds_count_what_they_read(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    (tmp_path / "in").mkdir()
    good = [_record(f"m{i}", ["C", "Cl" if i % 2 else "O"], [(0, 1, 1)], f"{20 + i}.5;0.0Q;0") for i in range(12)]
    bad = ["broken\n> <Spectrum 13C 0>\n1.0;0.0Q;0\n", _record("none", ["C"], [], "nothing"), _record("hetero", ["O"], [], "9.0;0.0Q;0"), _record("x", ["C"], [], "1.0;0.0Q;0").replace("Spectrum 13C 0", "Other")]
    for k in range(4):
        (tmp_path / "in" / f"{k}.sdf").write_text("".join(r + sdf.SEPARATOR for r in [*good[3 * k : 3 * k + 3], bad[k]]))
    build = lambda **o: jobs.build_stats_from_sdf(spark, source, None, state, checkpoint, radius=1, files_per_batch=1, **o)
    stats = {r.code: r for r in build().collect()}
    assert stats["C;-Cl"].n == 6 and stats["C;-Cl"].halogen == 6 and stats["C;-O"].halogen == 0
    read = lambda: tuple(jobs.build_counters(spark, state).first())
    assert read() == (16, 4, 12)
    build()
    assert read() == (16, 4, 12)
    # the last batch runs again: what it committed is taken away from the checkpoint
    for kind in ("commits", "offsets"):
        for name in (".3.crc", "3"):
            path = tmp_path / "cp" / kind / name
            if kind == "commits" and path.exists():
                path.unlink()
    assert {r.code: r.n for r in build().collect()} == {k: r.n for k, r in stats.items()} and read() == (16, 4, 12)
    observed = Observation("records")
    sdf.records(spark, source).observe(observed, F.count("*").alias("n"), F.count_if(sdf.record_flavour(c("record")).isNull()).alias("plain")).write.format("noop").mode("overwrite").save()
    assert observed.get == {"n": 16, "plain": 1}
    build(fresh=True)
    assert read() == (16, 4, 12)
    # a new checkpoint folder over the same table adds
    jobs.build_stats_from_sdf(spark, source, None, state, str(tmp_path / "other"), radius=1)
    assert read() == (32, 8, 24)


EVENTS = "run_id bigint, seq bigint, event string, phase string, epoch string, ts timestamp"


def _events(spark, rows):
    return spark.createDataFrame([(r, s, e, p, str(t)) for r, s, e, p, t in rows], "run_id bigint, seq bigint, event string, phase string, epoch string").withColumn("ts", F.timestamp_seconds(c("epoch").cast("bigint")))


def test_following_runs_again_without_news(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    _events(spark, [(1, 1, "run_start", "", 1000), (1, 2, "phase_start", "lsd-iteration-03", 1010), (2, 1, "run_start", "", 1005)]).write.parquet(source)
    follow = lambda **k: {r.run_id: r for r in jobs.follow_into(spark.readStream.schema(EVENTS).parquet(source), state, checkpoint, **k).collect()}
    assert follow()[1].iteration == 3
    assert follow()[1].iteration == 3 and set(follow()) == {1, 2}
    _events(spark, [(1, 3, "phase_end", "lsd-iteration-03", 1020)]).write.mode("append").parquet(source)
    again = follow()
    assert again[1].iteration == 0 and again[1].active_phase is None and again[2].started == 1005


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_idle_runs_leave_the_state(spark, tmp_path, rocksdb):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    seen = []

    def run():
        query = jobs.follow_runs(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source), 10).writeStream.outputMode("update")
        query = query.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    _events(spark, [(1, 1, "run_start", "", 1000)]).coalesce(1).write.parquet(source)
    run()
    for k, at in enumerate((10_000, 20_000)):
        _events(spark, [(2, k, "run_start", "", at)]).coalesce(1).write.mode("append").parquet(source)
        run()
    assert {r.run_id for r in seen} == {1, 2} and [(r.run_id, r.started) for r in seen if r.state == "idle"][0] == (1, 1000)


def test_a_run_goes_on_after_a_pause(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    parts = [
        [(1, 1, "run_start", "", 1_700_000_000), (1, 2, "phase_start", "lsd-iteration-2", 1_700_000_010), (1, 3, "phase_end", "lsd-iteration-2", 1_700_000_020), (1, 4, "phase_start", "lsd-iteration-3", 1_700_000_030)],
        [(2, 1, "run_start", "", 1_700_007_200)], [(2, 2, "phase_start", "x", 1_700_014_400)], [(1, 5, "other", "", 1_700_014_500)],
    ]
    for part in parts:
        _events(spark, part).coalesce(1).write.mode("append").parquet(source)
    follow = lambda folder, **k: jobs.follow_into(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source), state, folder, **k)
    batch = lambda: sorted(map(tuple, jobs.run_status(spark.read.schema(EVENTS).parquet(source)).collect()))
    rows = sorted(map(tuple, follow(checkpoint).collect()))
    assert rows == batch() and rows[0] == (1, "running", 3, "lsd-iteration-3", 1_700_000_000, 1_700_014_500, 14_500)
    # a new checkpoint begins with the table's facts, and reads everything again without harm
    _events(spark, [(1, 6, "phase_end", "lsd-iteration-3", 1_700_014_600)]).coalesce(1).write.mode("append").parquet(source)
    assert sorted(map(tuple, follow(str(tmp_path / "cp2")).collect())) == batch()
    done = spark.createDataFrame([(2, ["lsd-iteration-07", "x"], 99)], "run_id bigint, phases array<string>, elapsed_s bigint")
    known = spark.createDataFrame([(1,), (2,), (3,)], "run_id bigint")
    tiers = {r.run_id: (r.state, r.iteration, r.elapsed_s) for r in follow(str(tmp_path / "cp2"), finalized=done, runs=known).collect()}
    assert tiers == {1: ("running", 0, 14_600), 2: ("complete", 7, 99), 3: ("waiting", None, None)}


def test_known_facts_are_the_state_to_begin_with(spark, tmp_path, rocksdb):
    source, seen = str(tmp_path / "in"), []
    known = jobs.run_facts(_events(spark, [(1, 1, "run_start", "", 1000), (1, 2, "phase_start", "lsd-iteration-4", 1010)]))
    _events(spark, [(1, 3, "phase_start", "lsd-iteration-5", 1020), (1, 4, "phase_end", "lsd-iteration-5", 1030)]).write.parquet(source)
    query = jobs.follow_runs(spark.readStream.schema(EVENTS).parquet(source), None, known=known).writeStream.outputMode("update")
    query.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.run_id, r.started, r.iteration, r.active_phase, r.elapsed_s) for r in seen] == [(1, 1000, 4, "lsd-iteration-4", 30)]


def test_facts_of_parts_make_those_of_the_whole(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 4), k, rng.choice(["run_start", "phase_start", "phase_end", "other"]), rng.choice(["", "a", "lsd-iteration-2"]), rng.choice([100 + k, "x"])) for k in range(200)]
    frame = spark.createDataFrame([(*r[:4], str(r[4])) for r in rows], "run_id bigint, seq bigint, event string, phase string, epoch string")
    whole = sorted(map(str, jobs.run_facts(frame).collect()))
    parts = [jobs.run_facts(frame.where(c("seq") % 3 == k)) for k in range(3)]
    assert sorted(map(str, jobs.merged_facts(parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0])).collect())) == whole


def _record(name, atoms, bonds, spectrum):
    lines = [name, "", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"    0.0000    0.0000    0.0000 {a:<3} 0  0" for a in atoms] + [f"{i + 1:3d}{j + 1:3d}{o:3d}  0" for i, j, o in bonds]
    return "\n".join([*lines, "M  END", "> <Spectrum 13C 0>", spectrum, ""])


def test_statistics_of_records_sum_up_structures_first(spark, monkeypatch):
    shapes = [(["C", "O", "C"], [(0, 1, 1), (1, 2, 2)]), (["C", "C"], [(0, 1, 3)])]
    rows = [_record(f"r{k}", *shapes[k % 2], f"{10 + k}.5;0.0S;0|{k}.25;0.0S;{1 + k % 2}") for k in range(30)]
    records = spark.createDataFrame([(r,) for r in rows], "record string")
    given, environments = [], graphs.environments
    monkeypatch.setattr(graphs, "environments", lambda structures, radius: given.append(structures.count()) or environments(structures, radius))
    columns = ("code", "radius", *statistics.STATE_COLUMNS)
    table = lambda df: sorted(df.select(*columns).collect())
    assert table(jobs.carbon_stats(jobs.sdf_carbons(records, None), 3)) == table(statistics.env_state(jobs.sdf_observations(records, None, 3)))
    assert given == [2, 30]


def test_records_of_one_name_stay_apart(spark):
    benzene = [(i, (i + 1) % 6, 1 + i % 2) for i in range(6)]
    furan = [(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 4, 2), (4, 0, 1)]
    rows = [
        _record("same", ["C", "O"], [(0, 1, 1)], "50.0;0.0S;0"), _record("same", ["C", "N"], [(0, 1, 1)], "40.0;0.0S;0"), _record("", ["C", "C", "Cl"], [(0, 1, 3), (1, 2, 1)], "70.0;0.0S;0|80.0;0.0S;1"),
        _record("ring", ["C"] * 6, benzene, "|".join(f"128.5;0.0D;{i}" for i in range(6))), _record("five", ["O", "C", "C", "C", "C"], furan, "143.0;0.0D;1|99.0;0.0D;0"),
        _record("small", ["C"] * 4, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1)], "10.0;0.0T;0|12.0;0.0Q;3"),
    ]
    seen = jobs.sdf_observations(spark.createDataFrame([(r,) for r in rows], "record string"), "measured", 2).where("radius = 1")
    got = {(r.code, r.shift_c): r for r in seen.collect()}
    assert ("C;-O", 5000) in got and ("C;-N", 4000) in got and got["C;-O", 5000].has_o and not got["C;-O", 5000].has_n
    assert got["C;#C", 7000].state == "sp1" and not got["C;#C", 7000].has_x
    [chloride] = [r for k, r in got.items() if k[1] == 8000]
    assert chloride.has_x and chloride.state == "sp1" and set(chloride.code.removeprefix("C;").split(",")) == {"#C", "-Cl"}
    assert all(r.aromatic and r.state == "sp2" for k, r in got.items() if k[1] in (12850, 14300)) and not any(k[1] == 9900 for k in got)
    assert got["C;-C,-C", 1000].ring3 and not got["C;-C", 1200].ring3 and got["C;-C", 1200].state == "sp3"


# -- sources, sinks and surface ----------------------------------------------------------------


def test_tsv_files_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("CASE_Folder\tInChI_Key\nc1\tk1\n\n")
    (tmp_path / "b.tsv").write_text("key\tname\tcase\nk2\tn2\tc2\n")
    got = text.read_tsv(spark, str(tmp_path), {"case": ["case", "case_folder"], "key": ["inchi_key", "key"], "name": ["name"]}).collect()
    assert sorted(map(tuple, got)) == [("c1", "k1", None), ("c2", "k2", "n2")]


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"s{i:04d}",) for i in random.Random(1).sample(range(3000), 700)], "smiles string").repartition(5)
    got = text.numbered(rows, "smiles").orderBy("smiles").collect()
    assert [r.number for r in got] == list(range(1, 701))
    assert text.fragment_files(rows).count() == 700 and text.numbered(rows.limit(0), "smiles").count() == 0


def test_constraints_share_files(spark, tmp_path):
    problems = spark.createDataFrame([(i, f"MULT {i}\nEXIT") for i in range(500)], "list_id bigint, text string")
    text.write_constraints(problems, str(tmp_path / "c"), 3)
    assert len(list((tmp_path / "c").glob("part-*"))) <= 3
    assert sorted(map(tuple, text.constraint_texts(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, problems.collect()))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(type("Session", (), {"sparkContext": Context()})())


_PROGRAM = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from resonara.operators.components import connected_components
from resonara.plans import scratch

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
scratch.kept(spark.range(10))
with scratch.releasing(spark) as keep:
    scratch.kept(spark.range(5), "gone")
    table = scratch.kept(spark.range(7), "stays")
    keep.append(scratch.last_folder())
assert table.count() == 7
import os
assert not [x for x in os.listdir(sys.argv[1]) if x.startswith("gone")] and [x for x in os.listdir(sys.argv[1]) if x.startswith("stays")]
connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count()
spark.stop()
"""


def test_a_stopped_session_leaves_nothing(tmp_path):
    folder = tmp_path / "shared"
    folder.mkdir()
    subprocess.run([sys.executable, "-c", _PROGRAM, str(folder)], check=True, capture_output=True, timeout=300)
    for _ in range(100):  # the JVM ends a little later
        if not [p for p in folder.rglob("*") if p.is_file()]:
            break
        time.sleep(0.3)
    # but for an empty folder that Spark makes itself
    assert not [p for p in folder.rglob("*") if p.is_file()] and len(list(folder.iterdir())) <= 1


def _dx(nucleus, mhz, values, more=""):
    body = "\n".join(f"{i} {' '.join(map(str, values[i : i + 20]))}" for i in range(0, len(values), 20))
    return f"##TITLE= x\n##.OBSERVE NUCLEUS= ^{nucleus}\n##$OFFSET= 100\n##$SF= {mhz}\n{more}##YFACTOR= 1\n##FIRSTX= {100 * mhz}\n##LASTX= 0\n##XYDATA= (X++(Y..Y))  $$ packed\n{body}\n##END=\n"


def _planes(pulse, rows, offsets="##$NUC1= <1H>\n##$OFFSET= 10\n##$SF= 400\n##$NUC1= <13C>\n##$OFFSET= 100\n##$SF= 100\n"):
    head = f"##TITLE= x\n##.OBSERVE NUCLEUS= ^1H\n##NUM DIM= 2\n##.PULSE SEQUENCE= {pulse}\n{offsets}##SYMBOL= F1, F2, Y\n##.NUCLEUS= 13C, 1H\n##VAR_DIM= {len(rows)}, {len(rows[0])}, 0\n##FACTOR= 1, 1, 1\n##FIRST= 10000, 4000, 0\n##LAST= 0, 0, 0\n"
    return head + "".join(f"##PAGE= F1= {10000 - 1000 * i}\n##DATA TABLE= (F2++(Y..Y)), PROFILE\n0 {' '.join(map(str, r))}\n" for i, r in enumerate(rows)) + "##END=\n"


def test_ingest_jcamp(spark):
    rng = random.Random(7)
    carbon = [rng.randint(-2, 2) for _ in range(101)]
    carbon[30] = 400
    plane = [[rng.randint(-2, 2) for _ in range(21)] for _ in range(11)]
    plane[3][10], plane[8][4] = 300, 90
    docs = [("/a/13C.dx", _dx("13C", 100, carbon)), ("/a/hsqc.dx", _planes("hsqcedetgp", plane)), ("/a/noesy.dx", _planes("noesygp", plane)), ("/a/bad.dx", "##TITLE= x\n"), ("/a/hsqc2.dx", _planes("hsqcedetgp", plane)), ("/b/hmbc.dx", _planes("hmbcgp", plane)), ("/c/hmbc.dx", _planes("hmbcgp", plane, ""))]
    frame = spark.createDataFrame(docs, "path string, content string")
    got = api.ingest_jcamp(frame, thresholds=["hsqc=0.5"], snr_floors=["20"])
    lists = {r.path: r.id for r in frame.select("path", F.xxhash64(F.regexp_replace("path", "/?[^/]*$", "")).alias("id")).collect()}
    one, two = got.peaks_1d.collect(), got.peaks_2d.collect()
    assert [(r.list_id, r.nucleus, r.pos_c) for r in one] == [(lists["/a/13C.dx"], "13C", 7000)]
    assert sorted((r.list_id == lists["/a/bad.dx"], r.experiment, r.f1_c, r.f2_c, r.snr is None) for r in two) == sorted([(True, "HSQC", 7000, 500, True), (False, "HMBC", 7000, 500, False), (False, "HMBC", 2000, 800, False)])
    assert sorted(r.path for r in got.failed.collect()) == ["/a/bad.dx", "/a/hsqc2.dx", "/c/hmbc.dx"] and [r.path for r in got.skipped.collect()] == ["/a/noesy.dx"]
    report = {r.list_id: r for r in got.report.collect()}
    assert set(report) >= {lists["/a/bad.dx"], lists["/b/hmbc.dx"]} and report[lists["/a/bad.dx"]].verdict == "FAIL"
    for bad in ({"thresholds": ["0.1"], "snr_floors": ["HSQC=3"]}, {"thresholds": ["0.1"], "snr_floors": ["3"]}, {"thresholds": ["NOESY=1"]}):
        with pytest.raises(ValueError):
            api.ingest_jcamp(frame, **bad)


def test_loaders_and_warehouse(spark, tmp_path):
    rows = [_record("a", ["C", "O"], [(0, 1, 1)], "50.0;0.0S;0"), _record("b", ["C"], [], "20.0;0.0Q;0|30.0;0.0T;0")]
    records_ = [r.replace("> <Spectrum", f"> <Formula>\n{f}\n\n> <Spectrum") for r, f in zip(rows, ("CH4O", "C2H6"), strict=True)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sdf").write_text("".join(r + sdf.SEPARATOR for r in records_))
    info = api.build_warehouse(spark, {"first": str(tmp_path / "in")}, str(tmp_path / "w")).first()
    assert (info.compounds, info.formulas) == (2, 2)
    for name, path in (("sdf", tmp_path / "in"), ("warehouse", tmp_path / "w")):
        found = api.get_by_formula(spark, name, str(path), spark.createDataFrame([("C2H6",)], "formula_norm string")).collect()
        assert [(r.name, [s.shift_c for s in r.refs]) for r in found] == [("b", [2000, 3000])]
    with pytest.raises(ValueError, match="no loader"):
        api.load_corpus(spark, "nothing", "x")
    with pytest.raises(ValueError, match="already"):
        api.register_loader("sdf", lambda spark, path: None)


def test_udtf_says_what_the_expressions_say(spark):
    from resonara.functions.parsing import measured_signals

    fields = ["50.0;0.0S;1|60.1;0.0T;2", "bad;Q;1|7;x", "", None, "1.5;0.0X;9| |2;Q"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "k int, field string")
    rows.createOrReplaceTempView("signal_fields")
    api.register(spark)
    by_row = spark.sql("SELECT k, p.* FROM signal_fields, LATERAL parse_signals(field) p").collect()
    by_column = rows.select("k", F.inline(measured_signals(c("field")))).select("k", "shift", "h_count", "atom_index").collect()
    assert Counter(map(tuple, by_row)) == Counter(map(tuple, by_column)) and len(by_row) >= 5


def test_welford_equals_the_built_in(spark):
    rows = spark.range(200).select((c("id") % 3).alias("k"), (c("id") * 37 % 101).cast("double").alias("x"))
    a = {r.k: r[1] for r in rows.groupBy("k").agg(api.welford_std(c("x"))).collect()}
    b = {r.k: r[1] for r in rows.groupBy("k").agg(F.stddev_pop("x")).collect()}
    assert a == pytest.approx(b)


def test_sdf_flavours(spark, tmp_path):
    for name, field, wanted in (("m", "Spectrum 13C 0", "measured"), ("p", "CNMR_SHIFTS", "predicted"), ("n", "Other", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.sdf").write_text(f"x\n> <{field}>\n1\n\n{sdf.SEPARATOR}")
        assert sdf.detect_sdf_flavour(spark, str(tmp_path / name)) == wanted


def _places(content):
    """Decoded rows of one file."""
    return jcamp.decode("/x.dx", content)


TRIMMED = """##TITLE= edited, trimmed to two pages
##JCAMPDX= 6.0         $$ any version
##NUM DIM= 2
##.OBSERVE NUCLEUS= ^1H
##.PULSE SEQUENCE= hsqcedetgpsp.3
##$NUC1= <1H>
##$SFO1= 499.92164974
##$OFFSET= 7.050608
##$SF= 499.92
##$NUC1= <13C>
##$OFFSET= 174.9902
##$SF= 125.704983984
##SYMBOL=    F1,            F2,              Y
##.NUCLEUS=  13C,           1H
##VAR_DIM=   2, 3, 3
##FACTOR=    11.0470871040723, 1.8310546875, 2
##FIRST=     21997.1407732541, 3748.1689453125, -3615
##LAST=      -616.246528781816, 0,           2771
##PAGE= F1=2830.444647689
##FIRST=     21997.1407732541, 3748.1689453125, -1203
##DATA TABLE= (F2++(Y..Y)), PROFILE
2A0JJ
##PAGE= F1=2819.397560585
##DATA TABLE= (F2++(Y..Y)), PROFILE    $$ the last one
2 -5 6 7 $$ plain
##END=
"""


def test_jcamp_places_worked_out_by_hand():
    got = _places(TRIMMED)
    assert got["value"].tolist() == [20, 22, 24, -10, 12, 14] and got["y_hz"].tolist()[::3] == [2830.444647689, 2819.397560585]
    # 174.9902 - (21997.14077 - 2830.44465) / 125.70498 and 7.050608 - 3748.16895 / 499.92
    assert got["y_ppm"].tolist()[::3] == pytest.approx([22.51658, 22.42870], abs=1e-4) and got["x_ppm"].tolist()[:3] == pytest.approx([7.050608, 3.301839, -0.446930], abs=1e-6)
    assert got[["nucleus", "pulse_program", "two_d"]].iloc[0].tolist() == ["1H", "hsqcedetgpsp.3", True]
    # the same nucleus in both dimensions: the direct one comes first
    both = _places(TRIMMED.replace("<13C>", "<1H>").replace("13C,           1H", "1H, 1H").replace("174.9902", "7.051546").replace("125.704983984", "499.92").replace("21997.1407732541", "2840.444647689"))
    assert both["y_ppm"].tolist()[::3] == pytest.approx([7.051546 - 10 / 499.92, 7.051546 - (10 + 11.047087104) / 499.92]) and both["x_ppm"][0] == pytest.approx(7.050608)


XRI = "##TITLE= x\r\n##DATA CLASS= NTUPLES\r\n##.OBSERVE NUCLEUS= ^13C\r\n##$OFFSET= 200.5\r\n##$SF= 100\r\n##$NUC1= <13C>\r\n##SYMBOL= X, R, I\r\n##VAR_DIM= 3, 3, 3\r\n##FACTOR= 1, 2, 1\r\n##FIRST= 20000, 1, 1\r\n##LAST= 0, 1, 1\r\n##PAGE= N=1\r\n##DATA TABLE= (X++(R..R)), XYDATA\r\n3A0JJ\r\n##PAGE= N=2\r\n##DATA TABLE= (X++(I..I)), XYDATA\r\n3 1 1\r\n##END=\r\n"


def test_jcamp_channels_and_faults():
    got = _places(XRI)
    assert got["value"].tolist() == [20, 22, 24] and got["x_ppm"].tolist() == [200.5, 100.5, 0.5] and not got["two_d"][0] and got["y_ppm"].isna().all()
    faults = {
        "implausible": XRI.replace("$OFFSET= 200.5", "$OFFSET= 900"), "not descending": XRI.replace("FIRST= 20000", "FIRST= 0").replace("LAST= 0", "LAST= 20000").replace("200.5", "10.5"), "found 3": XRI.replace("VAR_DIM= 3", "VAR_DIM= 4"),
        "not among": TRIMMED.replace(".NUCLEUS=  13C", ".NUCLEUS=  15N"), "1 offsets": TRIMMED.replace("##$OFFSET= 174.9902\n", ""), "found 2 x 3": TRIMMED.replace("   2, 3, 3", "   3, 3, 3"), "could not convert": TRIMMED.replace("F1=2830", "F1=x"),
    }
    for fault, content in faults.items():
        row = _places(content)
        assert len(row) == 1 and fault in row["error"][0] and row["value"][0] is None, fault
    bare = _places(XRI.replace("##$SF= 100\r\n", ""))
    assert bare["x_ppm"].isna().all() and bare["x_hz"].tolist() == [20000, 10000, 0]


def test_a_measured_record_by_hand(spark):
    # ethanol: C0 is the methyl carbon, C1 bears the oxygen
    record = _record("ethanol", ["C", "C", "O"], [(0, 1, 1), (1, 2, 1)], "18.3;0.0Q;0|57.8;0.0T;1|9.9;0.0T")
    frame = spark.createDataFrame([(record,)], "record string")
    [row] = sdf.parse_sdf(frame).collect()
    assert row.name == "ethanol" and [tuple(s) for s in row.signals] == [(18.3, 3, 0), (57.8, 2, 1), (9.9, 2, None)]
    seen = {(r.code, r.shift_c) for r in jobs.sdf_observations(frame, None, 1).collect()}
    assert seen == {("C;-C", 1830), ("C;-C,-O", 5780)}


def _sd_files(tmp_path):
    """Records of both flavours, with empty names and without spectra, in LF and CRLF files of one folder."""
    rng, wanted, folder = random.Random(4), [], tmp_path / "sd"
    folder.mkdir()
    for n, (name, end, measured) in enumerate((("a.sdf", "\n", True), ("b.sdf", "\r\n", True), ("c.sdf", "\r\n", False), ("d.sdf", "\n", False))):
        text = ""
        for i in range(60):
            shift = round(rng.uniform(1, 199), 2)
            record = _record("" if i % 7 == 0 else f"{name}{i}", ["C"] * (1 + i % 40), [], f"{shift};0.0Q;0")
            if not measured:
                record = record.replace("Spectrum 13C 0", "CNMR_SHIFTS").replace(f"{shift};0.0Q;0", f"0:1|{shift}")
            if i % 10 == 3:
                record = record.replace("Spectrum 13C 0", "Other").replace("CNMR_SHIFTS", "Other")
            else:
                wanted.append(("" if i % 7 == 0 else f"{name}{i}", shift, 0))
            text += record + ("$$$$  " if i % 9 == 0 else "$$$$") + "\n"
        if n % 2:
            text = text.removesuffix("\n")
        (folder / name).write_bytes(text.replace("\n", end).encode())
    return folder, sorted(wanted)


@pytest.mark.parametrize("split", [128 << 20, 4000, 700])
def test_records_come_once_whatever_the_split(spark, tmp_path, split):
    folder, wanted = _sd_files(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", min(split, 4 << 20))
    try:
        raw = sdf.records(spark, str(folder))
        assert split > 4000 or raw.rdd.getNumPartitions() > 50 or split == 4000
        got = sdf.read_sdf(spark, str(folder)).select("name", F.inline("signals"))
        assert sorted((r.name, r.shift, r.atom_index) for r in got.collect()) == wanted
        assert raw.count() == 240 and not raw.where(F.contains("record", F.lit("\r"))).count()
        atoms = sdf.sdf_atoms(raw).groupBy("name").count()
        assert {r.name: r["count"] for r in atoms.collect() if r.name.startswith("b.sdf")} == {f"b.sdf{i}": 1 + i % 40 for i in range(60) if i % 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sdf.detect_sdf_flavour(spark, str(folder)) == "mixed" and sdf.detect_sdf_flavour(spark, str(folder / "b.sdf")) == "measured"
    assert sdf.read_sdf(spark, str(folder), "predicted").count() == sum(n.startswith(("c", "d")) for n, *_ in wanted) + sum(1 for f in range(2) for i in range(60) if i % 7 == 0 and i % 10 != 3)


def test_jcamp_headers(spark):
    docs = spark.createDataFrame([("/x.dx", _dx("13C", 100, [1])), ("/y.dx", "nothing"), ("/z.dx", _planes("hsqc", [[1, 2], [3, 4]])), ("/w.dx", _planes("hsqc", [[1, 2], [3, 4]], ""))], "path string, content string")
    head = jcamp.headers(jcamp.parse_jcamp(docs)).orderBy("path").collect()
    assert [tuple(r) for r in head] == [("/w.dx", "1H", "hsqc", True, False), ("/x.dx", "13C", None, False, True), ("/z.dx", "1H", "hsqc", True, True)]


def test_ordered_mentions_put_top_lines_first(spark):
    lines = [(1, 1, "we saw `CC(=O)O` and then c1ccccc1, which is no prose"), (1, 2, "| 1 | CC(C)=O | 0.9 |"), (1, 3, "Rank 1: **N#CC(O)**."), (1, 4, "CC(=O)O again"), (2, 1, "nothing of note here")]
    got = analysis.ordered_mentions(spark.createDataFrame(lines, "case_id int, line_no int, line string"), "case_id").orderBy("case_id", "position").collect()
    assert [(r.case_id, r.token, r.position) for r in got] == [(1, "CC(C)=O", 1), (1, "N#CC(O)", 2), (1, "CC(=O)O", 3)]
