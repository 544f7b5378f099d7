"""Files on disk, streaming builds and the data table decoder."""

import json

import pytest
from pyspark.sql import functions as F

from resonara.sources import jcamp, text
from resonara.streaming import jobs

c = F.col


def test_packed_lines_decode_like_plain_ones():
    plain = ["0 1 2 3 3 3", "5 4 2 2 -7"]
    assert jcamp.decode_lines(plain) == [1, 2, 3, 3, 3, 4, 2, 2, -7]
    assert jcamp.decode_lines(["0 A00JJ%T", "5 A02k1"]) == [100, 101, 102, 102, 102, 81]
    assert jcamp.decode_lines(["0 A2B0@c5"]) == [12, 20, 0, -35]
    assert jcamp.decode_lines(["0 ES"]) == [5] and jcamp.decode_lines(["0 EV"]) == [5, 5, 5, 5]
    with pytest.raises(ValueError, match="check value"):
        jcamp.decode_lines(["0 A00J", "2 A05J"])


def test_jcamp_files_and_error_rows(spark, tmp_path):
    (tmp_path / "one.dx").write_text("##TITLE= t\n##YFACTOR= 2\n##FIRSTX= 10\n##LASTX= 0\n##NPOINTS= 3\n##XYDATA= (X++(Y..Y))\n10 A00J%\n##END=\n")
    (tmp_path / "two.dx").write_text(
        "##TITLE= t\n##SYMBOL= F1, F2, Y\n##VAR_DIM= 2, 2, 4\n##FACTOR= 1, 1, 3\n##FIRST= 5, 8, 0\n##LAST= 1, 2, 0\n##PAGE= F1=5\n##DATA TABLE= (F2++(Y..Y)), PROFILE\n8 1 2\n##PAGE= F1=1\n##DATA TABLE= (F2++(Y..Y)), PROFILE\n8 3 4\n##END=\n"
    )
    (tmp_path / "bad.dx").write_text("##TITLE= t\n##NPOINTS= 9\n##XYDATA= (X++(Y..Y))\n0 1 2\n")
    rows = jcamp.read_jcamp(spark, str(tmp_path)).collect()
    by = lambda name: sorted((r.row, r.i, r.value) for r in rows if r.path.endswith(name))
    assert by("one.dx") == [(0, 0, 200.0), (0, 1, 202.0), (0, 2, 202.0)]
    assert by("two.dx") == [(0, 0, 3.0), (0, 1, 6.0), (1, 0, 9.0), (1, 1, 12.0)]
    assert [r.error for r in rows if r.path.endswith("bad.dx")] == ["ValueError: declared 9 points, found 2"]


def test_text_sources_read_files(spark, tmp_path):
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "HSQC_exp3.json").write_text(json.dumps({"cross_peaks": [{"c13_ppm": 1.0, "h1_ppm": 2.0}]}, indent=1))
    (lists / "hmbc.json").write_text('{"cross_peaks": [')
    (lists / "COSY.json").write_text('{"peaks": []}')
    (lists / "1H.json").write_text("{nonsense")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in text.read_peaklists(spark, str(lists)).collect()}
    assert got == {"HSQC_exp3.json": None, "hmbc.json": "corrupt", "COSY.json": "missing cross_peaks"}
    (tmp_path / "a.smi").write_text("# c\nCCO\n\n; x\nC C\nc1ccccc1\n")
    assert [tuple(r)[1:] for r in text.read_smiles(spark, str(tmp_path / "a.smi")).orderBy("index").collect()] == [(1, "CCO"), (2, "c1ccccc1")]
    (tmp_path / "t.tsv").write_text("CASE_Folder\tInChI_Key\nc1\tk1\n")
    assert text.read_tsv(spark, str(tmp_path / "t.tsv"), {"case": ["case", "case_folder"], "key": ["inchi_key"], "name": ["name"]}).collect() == [("c1", "k1", None)]
    exp = tmp_path / "root" / "3"
    exp.mkdir(parents=True)
    (exp / "acqus").write_text("##TITLE= x\n##$NUC1= <13C>\n##$TD= 100\n")
    row = text.read_params(spark, str(tmp_path / "root"), ["acqus.TD", "acqus.SW"]).first()
    assert row.params["acqus.NUC1"] == "13C" and row.missing == ["acqus.SW"]


def test_threshold_options():
    assert text.threshold_options(["0.1", "hsqc=0.2", "0.3"]) == ({"HSQC": 0.2}, 0.3)
    with pytest.raises(ValueError, match="unknown key"):
        text.threshold_options(["XX=1"])


def test_build_resumes_and_counts_every_input_once(spark, tmp_path):
    schema = "code string, radius int, shift_c bigint, state string, has_c boolean, has_o boolean, has_n boolean, has_s boolean, has_x boolean, ring3 boolean, ring4 boolean, aromatic boolean"
    rows = lambda k: spark.createDataFrame([("x", 1, 100 * k, "sp3", *[True] * 8)], schema)
    source, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "cp"))
    rows(1).write.parquet(source)
    build = lambda: jobs.build_stats(spark, source, rows(1).schema, state, checkpoint, 1).first()
    assert build().n == 1
    rows(3).write.mode("append").parquet(source)
    got = build()
    assert (got.n, got.sum_c, got.sp3) == (2, 400, 2)
    assert build().n == 2


def test_run_status_tiers(spark):
    rows = [(1, 1, "run_start", "", "100"), (1, 2, "phase_start", "lsd-iteration-03", "110"), (1, 3, "phase_start", "qc", "x"), (1, 4, "phase_end", "qc", "130"), (2, 1, "other", "", "5")]
    events = spark.createDataFrame(rows, "run_id bigint, seq bigint, event string, phase string, epoch string")
    done = spark.createDataFrame([(2, ["lsd-iteration-4", "qc", "lsd-iteration-x"], 9), (4, [], 3)], "run_id bigint, phases array<string>, elapsed_s bigint")
    fallback = spark.createDataFrame([(1, 9, "a"), (3, 2, "writer")], "run_id bigint, iteration bigint, active_phase string")
    known = spark.createDataFrame([(k,) for k in (1, 2, 3, 5)], "run_id bigint")
    got = {r.run_id: (r.state, r.iteration, r.active_phase, r.elapsed_s) for r in jobs.run_status(events, done, fallback, known).collect()}
    assert got == {1: ("running", 3, "lsd-iteration-03", 30), 2: ("complete", 4, None, 9), 3: ("running", 2, "writer", None), 4: ("complete", None, None, 3), 5: ("waiting", None, None, None)}
    assert {r.run_id: r.elapsed_s for r in jobs.run_status(events, now=90).collect()} == {1: 0, 2: None}


def test_tsv_files_are_split_and_their_headers_taken_apart_once(spark, tmp_path):
    # one long file over many byte ranges, blank lines before the header, and CRLF in another
    (tmp_path / "a.tsv").write_text("\n \nCase\tInChI_Key\n" + "".join(f"c{i}\tk{i}\n" for i in range(40_000)))
    (tmp_path / "b.tsv").write_bytes(b"key\tname\tcase\r\nq\tn\tz\r\n\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = text.read_tsv(spark, str(tmp_path), {"case": ["case"], "key": ["inchi_key", "key"], "name": ["name"]})
        wanted = [(f"c{i}", f"k{i}", None) for i in range(40_000)] + [("z", "q", "n")]
        assert sorted(map(tuple, read.collect()), key=str) == sorted(wanted, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    docs = spark.createDataFrame([("x", "Case\tKey\n" + "c\tk\n" * 40_000)], "path string, content string")
    assert text.parse_tsv(docs, {"case": ["case"], "key": ["key"]}).groupBy("case", "key").count().collect() == [("c", "k", 40_000)]


def test_hydrogen_fields_are_taken_apart_once_a_record(spark):
    from resonara.functions.parsing import multiplicity_map

    fields = spark.createDataFrame([("1\t10.0\n2\t20.0", None, "2\t20.0", "7\t1.0")], "fq string, ft string, fs string, fp string")
    made = fields.select(multiplicity_map(c("fq"), c("ft"), c("fs"), c("fp")).alias("m"))
    assert made.first().m == {1: 0, 2: 2, 7: 3}
    # once where it is read and once where it is used
    assert made._jdf.queryExecution().analyzed().toString().count("fq#") == 2


def test_compounds_are_one_grouping_of_the_items(spark):
    from resonara.plans.text_sources import _compounds
    from resonara.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    made = _compounds(v, "element", "atom_index", "shift_c", "h_count")
    sites = made.select("compound_id", F.inline("sites"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(sites.select("compound_id", "pos", "element", "part")) == rows(v.atom)
    assert rows(sites.select("compound_id", "pos", "atom_index", "shift_c", "h_count")) == rows(v.signal)
    assert rows(made.select("compound_id", F.inline("bonds"))) == rows(v.edge)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_solutions_are_cut_out_of_their_documents(spark):
    atom = lambda e, h, *bonds: " ".join(["1", e, "4", str(h), "3", "3", "0", *map(str, bonds), "0", "0"])
    docs = [
        ("a", "\n".join(["0", "3 9", atom("X", 1), "OUTLSD", atom("Y", 1), "2 1", atom("C", 3, 2, 1), "1 short", "1 C too few", atom("O", 1, 1, 1), "0 0", "99999999999999999999 99999999999999999999", atom("N", 2), "0", "2 5", atom("Z", 1)])),
        ("b", "OUTLSD\r\n1 7\r\n" + atom("C", 4, 2, 2, 3, 1)), ("c", "2 1\n" + atom("C", 1)), ("d", "OUTLSD"),
    ]
    atoms, bonds = text.parse_solutions(spark.createDataFrame(docs, "path string, content string"))
    assert sorted(map(tuple, atoms.collect())) == [("a", 0, 1, "N", 2), ("a", 1, 1, "C", 3), ("a", 1, 3, "O", 1), ("b", 7, 1, "C", 4)]
    assert sorted(map(tuple, bonds.collect())) == [("a", 1, 1, 2, 1), ("a", 1, 3, 1, 1), ("b", 7, 1, 2, 2), ("b", 7, 1, 3, 1)]
    plan = atoms._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_a_stream_gets_more_files_and_not_larger_ones():
    from resonara.plans import incremental

    assert [incremental._files(n, 4) for n in (0, 600_000, 16_000_000, 16_000_001, 216_000_000)] == [4, 4, 4, 5, 54]


def test_a_batch_of_a_run_reads_and_writes_its_state_once():
    import pandas as pd

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    runs = jobs._Runs(None)
    runs.init(Handle())
    events = [(s, "run_start" if s == 0 else ("phase_start", "phase_end")[s % 2], f"lsd-iteration-{s // 4:02d}", str(100 + s)) for s in range(80)]
    feed = lambda part: next(runs.handleInputRows((7,), iter([pd.DataFrame(part, columns=["seq", "event", "phase", "epoch"])]), None))
    feed(events[:50])
    row = feed(events[50:]).iloc[0]
    assert calls == ["get", "update"] * 2
    assert (row.started, row["at"], row.last_epoch, row.elapsed_s) == (100, 0, 179, 79)
    assert len(row.phases) == 20 and all(p["ended"] for p in row.phases) and row.phases[1] == {"phase": "lsd-iteration-01", "start": 6, "ended": True}


def test_parameters_move_a_row_a_file(spark):
    """The last of a file's lines with one key counts, also where a file comes in parts; lines are not moved one by one."""
    files = [
        ("a/acqus", "##TITLE= t\r\n ##$TD= 1\n##$TD= 2\nnothing\n##$NUC1= <13C>"), ("a/acqu2s", "##$TD= 7\n$$ ##$X= 1"),
        ("b/acqus", "no parameter"), ("b/acqu2s", None), ("c/acqus", "##$TD= 4\n##$SW= 1"), ("c/acqus", "##$SW= 2\n\n##$TD= 5"),
    ]
    read = text.parse_params(spark.createDataFrame(files, "path string, content string").repartition(3), ["acqus.TD", "acqus.SW"])
    got = {r.folder: (r.params, list(r.missing)) for r in read.collect()}
    assert got == {
        "a": ({"acqus.TITLE": "t", "acqus.TD": "2", "acqus.NUC1": "13C", "acqu2s.TD": "7"}, ["acqus.SW"]),
        "c": ({"acqus.TD": "5", "acqus.SW": got["c"][0]["acqus.SW"]}, []),
    }
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
