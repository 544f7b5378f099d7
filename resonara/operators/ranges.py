"""Ordered scans over groups of any size.

A window over a group puts all its rows into one task.  Here a group is cut into
pieces that follow each other, by ranges that Spark samples (``ranged``) or by
slots of whole numbers; windows run within a piece, and what crosses from one
piece into the next (a running sum, the last value, an open run) is worked out
from one row a piece and goes into the piece as a row of its own, before the
others.  So no row is joined with anything, and nulls in keys stay groups.

Groups are counted first: where none has more than ``PIECE`` rows, plain windows
over whole groups do the same with fewer steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.plans.scratch import kept

c = F.col

#: Most rows of a group that one task takes whole.
PIECE = 1_000_000

#: Whole numbers in a slot.
SLOT = 65_536


def large(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether some group has more than ``PIECE`` rows."""
    return not df.groupBy(*by).agg(F.count("*").alias("_n")).where(c("_n") > PIECE).isEmpty()


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_part``: ranges of (by, order), as many as there are shuffle partitions.

    It is written once, so that the number of a row's range can't change when a
    task runs again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], number: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """``df`` with ``number``: rows up to and with this one in its group, or the sum of their ``weight``.

    ``order`` must leave no ties, or rows that tie are numbered in any order.
    ``total`` names a column for the sum over the group.
    """
    weighted = df.withColumn("_w", F.lit(1).cast("bigint") if weight is None else c(weight).cast("bigint"))
    if not large(df, by):
        upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        of = [] if total is None else [F.sum("_w").over(W.partitionBy(*by)).alias(total)]
        return weighted.select(*df.columns, F.sum("_w").over(upto).alias(number), *of)
    rows = ranged(weighted, by, order)
    sums = rows.groupBy(*by, "_part").agg(F.sum("_w").alias("_w"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(
        *by, "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w"), F.sum("_w").over(W.partitionBy(*by)).alias("_total"), F.lit(True).alias("_carry"),
    )
    both = rows.withColumn("_carry", F.lit(False)).unionByName(before, allowMissingColumns=True)
    piece = W.partitionBy(*by, "_part").orderBy(c("_carry").desc(), *order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumns({"_number": F.sum("_w").over(piece), "_of": F.first("_total").over(piece)}).where(~c("_carry"))
    return found.select(*df.columns, c("_number").alias(number), *([] if total is None else [c("_of").alias(total)]))


def medians(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median, n): the exact median of each group as ``F.median`` gives it, and how many values it has.

    Equal values are counted before they are sorted, so neither a large group nor a
    frequent value is one task.  Nulls don't count; without values the median is null.
    """
    if not large(df, by):
        return df.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    counts = df.groupBy(*by, c(value).cast("double").alias("_v")).agg(F.count(value).alias("_k"))
    seen = numbered(counts, by, [c("_v").asc()], "_upto", weight="_k", total="_of")
    lower, upper = F.floor((c("_of") + 1) / 2), F.floor((c("_of") + 2) / 2)
    middle = seen.where((c("_upto") - c("_k") < upper) & (c("_upto") >= lower))
    half = F.lit(0.5)
    return middle.groupBy(*by).agg((half * F.min("_v") + half * F.max("_v")).alias("median"), F.first("_of").alias("n"))


def neighbours(probes: DataFrame, marks: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Probes with ``below`` and ``above``: the nearest marks of their group at or on either side of them.

    ``marks``: the ``by`` columns and ``at``.  Null where there is none.
    """
    points = marks.select(*by, at).where(c(at).isNotNull()).distinct()
    both = probes.withColumn("_mark", F.lit(None).cast(marks.schema[at].dataType)).unionByName(points.withColumn("_mark", c(at)), allowMissingColumns=True)
    # the other columns keep a frequent place of a large group from being one range
    rest = [c(x) for x in probes.columns if x not in (*by, at)]
    if not large(both, by):
        whole = lambda order: W.partitionBy(*by).orderBy(order, c("_mark").isNull()).rowsBetween(W.unboundedPreceding, 0)
        near = {"below": F.last("_mark", ignorenulls=True).over(whole(c(at).asc())), "above": F.last("_mark", ignorenulls=True).over(whole(c(at).desc()))}
        return both.withColumns(near).where(c("_mark").isNull()).select(*probes.columns, "below", "above")
    rows = ranged(both, by, [c(at), c("_mark").isNull(), *rest])
    edges = rows.groupBy(*by, "_part").agg(F.max("_mark").alias("_last"), F.min("_mark").alias("_first"))
    side = lambda order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select(
        *by, "_part", F.max("_last").over(side(c("_part").asc())).alias("_from_below"), F.min("_first").over(side(c("_part").desc())).alias("_from_above"), F.lit(True).alias("_carry"),
    )
    all_rows = rows.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    # two running frames, one a direction; a frame up to the end would be computed anew for each row
    piece = lambda order: W.partitionBy(*by, "_part").orderBy(c("_carry").desc(), order, c("_mark").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = all_rows.withColumns({
        "below": F.last(F.coalesce("_mark", "_from_below"), ignorenulls=True).over(piece(c(at).asc())),
        "above": F.last(F.coalesce("_mark", "_from_above"), ignorenulls=True).over(piece(c(at).desc())),
    })
    return found.where(~c("_carry") & c("_mark").isNull()).select(*probes.columns, "below", "above")


def _slot(at: str) -> Column:
    return F.floor(c(at) / F.lit(SLOT)).cast("bigint")


def _whole_maxima(points: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy("i")
    runs = points.withColumn("_new", F.when(F.lag(value).over(order) == c(value), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    plateau = runs.groupBy(*by, "_run").agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"), F.first(value).alias("_v"))
    over = W.partitionBy(*by).orderBy("_run")
    tops = plateau.withColumns({"_before": F.lag("_v").over(over), "_after": F.lead("_v").over(over)}).where((c("_v") > c("_before")) & (c("_v") > c("_after")))
    return tops.select(*by, F.floor((c("_lo") + c("_hi")) / 2).cast("bigint").alias("i"), c("_v").alias(value))


def local_maxima(points: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, i, value) of local maxima over rising whole ``i``; a plateau counts once, at its middle.

    A maximum is a step up that is followed by a step down.  Each slot gets the last
    point of the one before; the first and the last step of each slot meet again.
    """
    if not large(points, by):
        return _whole_maxima(points, by, value)
    rows = points.select(*by, "i", c(value).alias("_v"), _slot("i").alias("_slot"))
    lasts = rows.groupBy(*by, "_slot").agg(F.max(F.struct("i", "_v")).alias("_last"))
    over = W.partitionBy(*by).orderBy("_slot")
    carry = lasts.withColumn("_p", F.lag("_last").over(over)).where(c("_p").isNotNull()).select(*by, c("_p.i").alias("i"), c("_p._v").alias("_v"), "_slot")
    inside = W.partitionBy(*by, "_slot").orderBy("i")
    way = F.when(c("_v") > c("_from"), 1).when(c("_v") < c("_from"), -1).when(c("_v") == c("_from"), 0)
    paired = rows.unionByName(carry).withColumns({"_from": F.lag("_v").over(inside), "_i0": F.lag("i").over(inside)})
    # a step from or to a null is neither up nor down, but ends a plateau
    steps = paired.where(c("_i0").isNotNull()).withColumn("_way", F.coalesce(way, F.lit(2))).where(c("_way") != 0)
    facts = ["_way", "i", "_from", "_i0"]
    met = steps.withColumns({"_b": F.lag(F.struct("_way", "i")).over(inside), "_after": F.lead("_way").over(inside)})
    top = lambda df: df.where((c("_b._way") == 1) & (c("_way") == -1)).select(*by, F.floor((c("_b.i") + c("_i0")) / 2).cast("bigint").alias("i"), c("_from").alias(value))
    borders = met.where(c("_b").isNull() | c("_after").isNull()).select(*by, "_slot", c("_b").isNull().alias("_opens"), *facts)
    across = W.partitionBy(*by).orderBy("i")
    return top(met).unionByName(top(borders.withColumn("_b", F.lag(F.struct("_way", "i")).over(across)).where("_opens")))
