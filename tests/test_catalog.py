"""Registered queries against DuckDB, and the entry module without the corpus part."""

import os
import shutil
import subprocess
import sys

import pytest

from resonara.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
#: Run by default; RESONARA_ALL=1 runs every query that has an oracle.
SOME = [
    "dereplicate", "predict", "A1_env_stats", "A8_detect_neighbours", "A10_detect_pairs", "A19_qc_report", "A29_paired_arms", "A32_complete_atoms", "J3_predict_fallback", "J4_band_join", "J10_guided_filter", "J21_fine_match", "J24_permute",
    "A22_line_widths", "A26_j_summary", "G3_ego_fragments", "J17_correlations", "S8_jcamp_packed", "S19_fragment_files", "T3_extract_fragments", "W12_pick_2d", "W3_fragment_search",
    "W2_rank_candidates", "W8_group_rows", "W13_threshold_search", "G1_sphere_codes", "S2_read_sdf_predicted", "S12_solution_bonds", "S18_constraint_text", "T1_build_stats",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def _value(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    return repr(round(float(x), 9)) if isinstance(x, (int, float)) else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()) if os.environ.get("RESONARA_ALL") else SOME)
def test_query_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    wanted = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, wanted.fetchall())


def test_entry_works_without_the_corpus_part(tmp_path):
    code = "import sys; sys.modules.update({'resonara.llm': None, 'corpus_pipeline': None}); import __spark_entry__ as e; q = e.queries(); assert 'dereplicate' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 150


def test_a_copy_without_the_corpus_folders_works(tmp_path):
    for name in ("resonara", "__spark_entry__.py"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "resonara" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dereplicate' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert int(found.stdout) > 150


def test_what_the_corpus_part_needs_may_be_missing():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'dereplicate' in q and 'op1_sharding' not in q and 'pipeline' not in q; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 150


def test_confidence_of_codes_seen_often(spark):
    # n times the sum of squares passes 63 bits, as it does for common codes of large tables
    class View:
        env_state = spark.createDataFrame([("a", 1, 600_000, 600_000 * 11_000, 600_000 * 11_000**2), ("b", 1, 2, 3_000, 5_000_000)], "code string, radius int, n bigint, sum_c bigint, sumsq_c bigint")

    catalog.queries()
    got = {r.code: r.confidence_milli for r in catalog._QUERIES["P10_confidence"](View()).collect()}
    assert got == {"a": 583, "b": round((0.5 / 6 + 0.3 * (0.5 + 0.25 * 0.3010299956639812) + 0.2 * 0.75) * 1000)}


def test_fragment_search_asks_with_every_compound(spark, duck):
    got = catalog.queries()["fragment_search"](spark, DATA).collect()
    assert any(r.query_id % 100 for r in got)
    asked = duck.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]
    hits = duck.execute(catalog.oracle_sql()["fragment_search"]).fetchall()
    assert "% 100" not in catalog.oracle_sql()["fragment_search"] and asked > 100 and len(hits) == len(got)
