"""Scans by pieces equal windows over whole groups, and no task holds a large group."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.operators import joins, peaks, ranges

c = F.col


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, where half of them share one value; groups with one row; nulls."""
    rng = random.Random(11)
    rows = [(0, i, 500 if i % 2 else rng.randrange(-3000, 3000)) for i in range(1500)]
    rows += [(1 + i % 700, 1500 + i, rng.randrange(-3000, 3000)) for i in range(2900)]
    rows += [(5, 4400, None), (5, 4401, None), (9999, 4402, None), (None, 4403, 7), (None, 4404, 9)]
    return spark.createDataFrame(rows, "k bigint, id bigint, v bigint").repartition(5)


@pytest.fixture(params=["ranges", "whole"])
def pieces(request, monkeypatch):
    """Every test below runs with groups cut into pieces and with whole groups."""
    monkeypatch.setattr(ranges, "PIECE", 0 if request.param == "ranges" else 1_000_000)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbers_equal_row_numbers(spark, skewed, pieces):
    found = ranges.numbered(skewed, ["k"], [c("v").desc(), c("id")], "no", total="of")
    key = W.partitionBy("k")
    plain = skewed.withColumns({"no": F.row_number().over(key.orderBy(c("v").desc(), "id")).cast("bigint"), "of": F.count("*").over(key)})
    assert _rows(found) == _rows(plain)


def test_ranges_split_a_large_group(spark, skewed):
    largest = ranges.ranged(skewed, ["k"], [c("v"), c("id")]).groupBy("_part").count().agg(F.max("count")).first()[0]
    assert largest < 1.5 * skewed.count() / 4  # four shuffle partitions; one value alone has 750 rows


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_medians_equal_the_function(spark, skewed, pieces, kind):
    df = skewed.withColumn("v", c("v").cast(kind) / (F.lit(7.0) if kind == "double" else F.lit(1)))
    plain = df.groupBy("k").agg(F.median("v").alias("median"), F.count("v").alias("n"))
    assert _rows(ranges.medians(df, ["k"], "v")) == _rows(plain)
    assert ranges.medians(df.limit(0), ["k"], "v").count() == 0


def test_nearest_sorted_equals_all_pairs(spark, skewed, pieces):
    marks = skewed.where("id % 3 = 0").select("k", c("v").alias("shift_c"), c("id").alias("pos"))
    probes = skewed.where("k IS NOT NULL AND v IS NOT NULL").select("k", "id", c("v").alias("shift_c"))
    found = joins.nearest_sorted(probes, marks, ["k"], ["id"])
    best = joins.nearest_join(probes, marks.where("shift_c IS NOT NULL"), ["k"], ["id"], 10).select("k", "id", "error_c")
    plain = probes.join(best, ["k", "id"], "left").select("k", "id", "shift_c", "error_c")
    assert _rows(found) == _rows(plain)


def _chains(df, tolerance):
    order = W.partitionBy("k").orderBy("v")
    new = F.when(c("v") - F.lag("v").over(order) <= tolerance, 0).otherwise(1)
    # nulls come first and are one chain
    marked = df.withColumn("_new", F.when(c("v").isNull(), 0).otherwise(new)).withColumn("_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("k", "_g").agg(F.min("v").alias("v"), F.count("*").alias("n")).drop("_g")


@pytest.mark.parametrize("tolerance", [0, 3, 10, 400])
def test_gap_clusters_equal_the_window(spark, skewed, tolerance):
    assert _rows(peaks.gap_clusters(skewed.select("k", "v"), ["k"], "v", tolerance)) == _rows(_chains(skewed, tolerance))


def _tops(values):
    """Brute force: (middle, value) of plateaus with a lower value on both sides."""
    out, i = [], 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[i] is not None and values[j + 1] == values[i]:
            j += 1
        if i > 0 and j + 1 < len(values) and None not in (values[i - 1], values[i], values[j + 1]) and values[i - 1] < values[i] > values[j + 1]:
            out.append(((i + j) // 2, values[i]))
        i = j + 1
    return out


@pytest.mark.parametrize("slot", [2, 5, 65_536])
def test_local_maxima_equal_brute_force(spark, monkeypatch, pieces, slot):
    monkeypatch.setattr(ranges, "SLOT", slot)
    rng = random.Random(slot)
    spectra = {0: [rng.randrange(3) for _ in range(700)], 1: [1] * 20, 2: [0] + [5] * 17 + [0], 3: [0, 4, None, 4, 0, 3, 0], 4: [7], 5: [0, 1, 1, 2, 2, 1, None]}
    spectra |= {10 + k: [rng.randrange(4) for _ in range(rng.randrange(1, 9))] for k in range(60)}
    points = spark.createDataFrame([(s, i, y) for s, ys in spectra.items() for i, y in enumerate(ys)], "s bigint, i bigint, y bigint").repartition(5)
    found = peaks.local_maxima(points, ["s"], "y")
    assert _rows(found) == sorted(((s, i, y) for s, ys in spectra.items() for i, y in _tops(ys)), key=repr)
