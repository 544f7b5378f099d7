"""Scalar functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from resonara.functions import bits, formula, parsing, records, scoring

c = F.col


def column(spark, values, kind, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(make(c("v")).alias("x")).collect()]


def test_formulas(spark):
    assert column(spark, ["C₁₃H₁₈O₂", "C 2 H6"], "string", formula.normalize_formula) == ["C13H18O2", "C2H6"]
    assert column(spark, ["C13H18O2", "CH4", "Cl2Ca", "CaC2", "", "HCl"], "string", formula.count_carbons) == [13, 1, 0, 2, 0, 0]
    assert column(spark, ["CH3CH2OH", "C2Cl"], "string", formula.parse_formula) == [{"C": 2, "H": 6, "O": 1}, {"C": 2, "Cl": 1}]
    assert column(spark, ["C6H6", "C2H6O", "C6H5NO2", "C6H5Cl"], "string", formula.dbe) == [4.0, 0.0, 5.0, 4.0]
    assert column(spark, ["InChI=1S/C15H22O3/c1", "InChI=1S/p+1", "x/C2", None, "InChI=1S"], "string", formula.formula_from_inchi) == ["C15H22O3", None, None, None, None]


def test_signal_fields(spark):
    got = column(spark, ["17.6;0.0Q;1|22.4;T;|bad;Q;3| |30;x", ""], "string", parsing.measured_signals)
    assert [[tuple(s) for s in row] for row in got] == [[(17.6, 3, 1), (22.4, 2, None), (30.0, None, None)], []]
    got = column(spark, ["0:2|73.89;1:3|101.13;broken;4|x;9|8.5"], "string", parsing.predicted_signals)
    assert [tuple(s) for s in got[0]] == [(73.89, 1), (101.13, 2), (8.5, None)]
    frame = spark.createDataFrame([("5\t154.84\n6\t108.70", "7\t1", None, "6\t2\nx\t3")], "q string, t string, s string, p string")
    assert frame.select(parsing.multiplicity_map(c("q"), c("t"), c("s"), c("p"))).first()[0] == {5: 0, 6: 3, 7: 1}


def test_names_and_identifiers(spark):
    frame = spark.createDataFrame(
        [("in", "indigo"), ("Vitamin C", "CNP12.1; vitamin-c dye"), ("acid, ascorbic", "L-ascorbic acid; x"), ("CNP1", "CNP1"), (None, "a b")], "r string, d string"
    )
    assert [r[0] for r in frame.select(parsing.name_matches(c("r"), c("d"))).collect()] == [False, True, True, False, False]
    got = column(spark, ["10.57992/NMRXIV.P10.S69", "https://doi.org/10.57992/nmrxiv.p3", "https://nmrxiv.org/P7/S2", "p9", "S4", "??"], "string", parsing.project_id)
    assert [tuple(x) for x in got] == [("P10", "S69", None), ("P3", None, None), ("P7", "S2", None), ("P9", None, None), (None, None, "study needs a project"), (None, None, "unrecognized")]


def test_lists_and_labels(spark):
    assert column(spark, ["10:1d-1H;11:1d-13C;12:cosy;14:cosy", "-", None], "string", parsing.condense_experiments) == ["1H, 13C, COSY", "—", "—"]
    assert column(spark, ["0.00, 30.5", '{"2": 1.5}', "a,b", "{bad"], "string", parsing.shift_list) == [{0: 0.0, 1: 30.5}, {2: 1.5}, {}, {}]
    assert [tuple(x) for x in column(spark, ["HMQC:1:2", "XX:1:2", "COSY:1", "HMBC:a:2"], "string", parsing.correlation)] == [("HSQC", 1, 2, None), (None, None, None, "type"), (None, None, None, "format"), (None, None, None, "index")]
    assert [tuple(x) for x in column(spark, ["3 Solutions in 1.5 sec", "no solution", "ERROR"], "string", parsing.solver_summary)] == [(3, 1.5, "success"), (0, None, "no_solution"), (0, None, "error")]
    assert column(spark, ["C-3;=OCO(,,//)", "C-4;CCN(//)", "C"], "string", parsing.sphere1_elements) == [{"O": 2, "C": 1}, {"C": 2, "N": 1}, {}]
    assert column(spark, ["inv4gplplrndqf", "inv4gp", "HMBCgp", "mlevph", "zg"], "string", scoring.experiment_type) == ["HMBC", "HSQC", "HMBC", "TOCSY", None]
    assert column(spark, ["^1H", "<13C>", " 15N"], "string", scoring.nucleus) == ["1H", "13C", "15N"]


def test_scores(spark):
    assert column(spark, [7999, 8000, 10000, 16000], "int", scoring.tolerance_c) == [80, 100, 120, 150]
    frame = spark.createDataFrame([(10, 10, 10, 10, 10), (8, 8, 10, 10, 4), (0, 5, 5, 5, 0), (3, 0, 4, 4, 0)], "m int, o int, r int, n int, h int")
    got = [r[0] for r in frame.select(scoring.match_score(c("m"), c("o"), c("r"), c("n"), c("h"))).collect()]
    assert got == pytest.approx([1.0, 0.9, 0.0, 0.0])
    assert column(spark, [1.9, 2.0, 3.5, 5.0], "double", scoring.mae_label) == ["Excellent", "Good", "Moderate", "Poor"]
    assert [tuple(x) for x in column(spark, [1, 2, 11], "int", lambda p: F.struct(scoring.coupling_label(p)))] == [("²J_CH",), ("³J_CH",), ("12J_CH",)]
    assert column(spark, [1, 4, 9], "int", lambda m: scoring.expected_samples(m, F.lit(100))) == [100, 50, None]
    assert column(spark, [0, 1, 7, 12], "int", lambda r: scoring.rank_verdict(r, F.lit(True))) == ["missed", "**rank 1**", "top 10 (rank 7)", "found (rank 12)"]
    frame = spark.createDataFrame([("CH", None), ("CH", "CH2"), ("CH/CH3", "CH"), ("CH/CH3", "C/CH2"), ("CH", "CH/CH3"), ("CH2", "CH/CH3")], "a string, b string")
    assert [r[0] for r in frame.select(scoring.multiplicity_compatible(c("a"), c("b"))).collect()] == [True, False, True, True, True, False]


def test_fingerprints(spark):
    frame = spark.createDataFrame([([2050, 2060, -5, 51200],), ([0, 51199],)], "s array<int>")
    plain, wide = zip(*frame.select(bits.fingerprint(c("s")), bits.expanded(c("s"))).collect(), strict=True)
    assert plain[0] == [1 << 10, 0, 0, 0, 0, 0, 0, 0] and wide[0][0] == 0b111 << 9
    assert plain[1] == [1, 0, 0, 0, 0, 0, 0, 1 << 31] and wide[1] == [3, 0, 0, 0, 0, 0, 0, 3 << 30]
    assert frame.select(bits.contained(bits.fingerprint(c("s")), bits.expanded(c("s")))).distinct().collect() == [(True,)]


def test_records(spark):
    rows = spark.createDataFrame([("1H", "HSQC", 0), ("9X", "HSQC", 0), (None, "bad", 5)], "nucleus string, experiment string, charge int")
    good, bad = records.split_valid(rows)
    assert good.count() == 1 and sorted((r.nucleus_error, r.experiment_error, r.charge_error) for r in bad.collect() if r.nucleus_error) == [("nucleus", None, None)]
    assert bad.count() == 2
