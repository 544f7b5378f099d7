"""Tolerance, nearest and greedy joins over shifts in hundredths of a ppm.

A range predicate alone would make Spark compare all pairs, so both sides of a
band join carry the bin ``floor(value / width)``; one side repeats each row for
the neighbouring bins, the equal bins meet in an ordinary hash or merge join and
the exact predicate filters what meets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonara.functions import bits
from resonara.functions.scoring import match_score, ratio, tolerance_c
from resonara.plans.scratch import kept

c = F.col


def _bin(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(max(1, width))).cast("bigint")


def _spread(df: DataFrame, value: str, width: int, name: str = "_bin") -> DataFrame:
    b = _bin(c(value), width)
    return df.withColumn(name, F.explode(F.array(b - 1, b, b + 1)))


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, window: int, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows with equal ``on`` columns and values at most ``window`` apart.

    ``right`` is repeated for the neighbouring bins.  With ``left_semi`` and
    ``left_anti`` each left row is returned once at most.  Other columns must
    have different names on both sides.
    """
    width = max(1, window)
    a = left.withColumn("_bin", _bin(c(left_value), width)).alias("a")
    b = _spread(right, right_value, width).alias("b")
    condition = (c("a._bin") == c("b._bin")) & (F.abs(c(f"a.{left_value}") - c(f"b.{right_value}")) <= window)
    for key in on:
        condition &= c(f"a.{key}") == c(f"b.{key}")
    joined = a.join(b, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*left.columns)
    return joined.select("a.*", *(c(f"b.{x}") for x in right.columns if x not in on)).drop("_bin")


def lookup_by_formula(queries: DataFrame, compounds: DataFrame, signals: DataFrame) -> DataFrame:
    """Compounds of each asked formula with their signals as an ordered array.

    Signals are grouped only for the compounds that a formula asks for.
    """
    asked = queries.join(compounds, "formula_norm")
    wanted = signals.join(asked.select(c("id").alias("compound_id")), "compound_id", "left_semi")
    lists = wanted.groupBy("compound_id").agg(F.array_sort(F.collect_list(F.struct("pos", "shift_c", "h_count"))).alias("refs"))
    return asked.join(lists.withColumnRenamed("compound_id", "id"), "id")


def lookup_env(keys: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of each (code, radius) that has any."""
    return keys.join(stats, ["code", "radius"])


def known_env(keys: DataFrame, stats: DataFrame) -> DataFrame:
    """Keys that have statistics (J2, exists)."""
    return keys.join(stats, ["code", "radius"], "left_semi")


#: Most rows of statistics that are sent to all tasks; counted before.
BROADCAST_ROWS = 100_000


def predict_fallback(keys: DataFrame, stats: DataFrame, by: Sequence[str], max_radius: int = 6, min_radius: int = 1) -> DataFrame:
    """For each atom, the statistics of the highest radius that has any; nulls where none has.

    ``stats`` has one row a code and radius.  Rounds go from the highest radius
    down and only what missed so far goes on.  The codes of small radii are few and
    each is asked by a large share of all atoms: as many of the lowest radii as
    together have at most ``BROADCAST_ROWS`` rows are looked up without a shuffle.
    """
    radii = range(min_radius, max_radius + 1)
    state = [x for x in stats.columns if x not in ("code", "radius")]
    known = kept(stats.where(c("radius").between(min_radius, max_radius) & c("n").isNotNull()), "fallback")
    sizes = {r.radius: r.n for r in known.groupBy("radius").agg(F.count("*").alias("n")).collect()}  # one row a radius
    code = lambda r: f"_code{r}"
    left = keys.where(c("radius").between(min_radius, max_radius)).groupBy(*by).agg(*(F.max(F.when(c("radius") == r, c("code"))).alias(code(r)) for r in radii))
    hits = lambda r: known.where(c("radius") == r).select(c("code").alias(code(r)), F.struct("code", "radius", *state).alias("_hit"))
    light = {r for r in radii if sum(sizes.get(k, 0) for k in radii if k <= r) <= BROADCAST_ROWS}
    done: list[DataFrame] = []
    for r in sorted(set(radii) - light, reverse=True):
        # atoms without a code here would all meet on null
        met = kept(left.where(c(code(r)).isNotNull()).join(hits(r), code(r), "left"), "fallback")
        done.append(met.where(c("_hit").isNotNull()).select(*by, "_hit"))
        left = met.where(c("_hit").isNull()).drop("_hit").unionByName(left.where(c(code(r)).isNull()))
    for r in light:
        left = left.join(F.broadcast(hits(r).withColumnRenamed("_hit", f"_hit{r}")), code(r), "left")
    found = F.coalesce(*(c(f"_hit{r}") for r in sorted(light, reverse=True))) if light else F.lit(None).cast(known.select(F.struct("code", "radius", *state)).schema[0].dataType)
    best = left.select(*by, found.alias("_hit"))
    for part in done:
        best = best.unionByName(part)
    return best.select(*by, *(c(f"_hit.{x}").alias(x) for x in ("code", "radius", *state)))


def _fold(observed: Column, references: Column, tolerance: Callable[[Column], Column]) -> Column:
    """Greedy one-to-one match of ordered observations, consuming references."""
    avail_type = "array<struct<pos:bigint,shift_c:bigint,h_count:bigint>>"
    pair_type = "array<struct<obs_pos:bigint,obs_c:bigint,ref_pos:bigint,ref_c:bigint,dev_c:bigint,same_h:boolean>>"
    start = F.struct(references.cast(avail_type).alias("avail"), F.array().cast(pair_type).alias("pairs"))

    def step(acc: Column, o: Column) -> Column:
        near = F.filter(acc["avail"], lambda r: F.abs(r["shift_c"] - o["shift_c"]) <= tolerance(o["shift_c"]))
        best = F.array_min(F.transform(near, lambda r: F.struct(F.abs(r["shift_c"] - o["shift_c"]).alias("dev_c"), r["pos"].alias("pos"), r["shift_c"].alias("shift_c"), r["h_count"].alias("h_count"))))
        pair = F.struct(
            o["pos"].alias("obs_pos"), o["shift_c"].alias("obs_c"), best["pos"].alias("ref_pos"), best["shift_c"].alias("ref_c"), best["dev_c"].alias("dev_c"),
            (o["h_count"] == best["h_count"]).alias("same_h"),
        )
        return F.struct(
            F.when(best.isNull(), acc["avail"]).otherwise(F.filter(acc["avail"], lambda r: r["pos"] != best["pos"])).alias("avail"),
            F.when(best.isNull(), acc["pairs"]).otherwise(F.concat(acc["pairs"], F.array(pair).cast(pair_type))).alias("pairs"),
        )

    return F.aggregate(observed, start, step)


def greedy_match(pairs: DataFrame, tolerance: Callable[[Column], Column] = tolerance_c) -> DataFrame:
    """``pairs`` with columns obs and refs (arrays of pos, shift_c, h_count) gains ``pairs`` and ``left_over``.

    Observations are taken in order of shift and then position; each takes the
    nearest reference that is left and within tolerance, the first one on ties.
    """
    by_shift = F.array_sort(
        F.transform("obs", lambda o: F.struct(o["shift_c"].cast("bigint").alias("shift_c"), o["pos"].cast("bigint").alias("pos"), o["h_count"].cast("bigint").alias("h_count")))
    )
    folded = pairs.withColumn("_m", _fold(by_shift, c("refs"), tolerance))
    return folded.select(*pairs.columns, c("_m.pairs").alias("pairs"), c("_m.avail").alias("left_over"))


def dereplicate(observed: DataFrame, compounds: DataFrame, signals: DataFrame, top: int | None = None, use_h: bool = True) -> DataFrame:
    """Candidates of each observed peak list, scored and ranked."""
    queries = observed.groupBy("formula_norm").agg(F.collect_list(F.struct("pos", "shift_c", "h_count")).alias("obs"))
    matched = greedy_match(lookup_by_formula(queries, compounds.select("id", "formula_norm", "carbon_count"), signals))
    scored = matched.select(
        "formula_norm", "id", F.size("pairs").cast("bigint").alias("matched"), F.size("obs").cast("bigint").alias("observed"), F.size("refs").cast("bigint").alias("reference"), "carbon_count",
        F.size(F.filter("pairs", lambda p: p["same_h"])).cast("bigint").alias("same_h"),
        F.aggregate("pairs", F.lit(0).cast("bigint"), lambda acc, p: acc + p["dev_c"]).alias("dev_c"),
    ).withColumn("score", match_score(c("matched"), c("observed"), c("reference"), c("carbon_count"), c("same_h") if use_h else None))
    from .ranking import rank_matches

    return rank_matches(scored, top)


def nearest_join(predicted: DataFrame, experimental: DataFrame, on: Sequence[str], keys: Sequence[str], tolerance: int) -> DataFrame:
    """Nearest experimental shift of each prediction, without a cutoff.

    Many predictions may share one; ``is_matched`` says whether it is within
    tolerance.  Columns: shift_c of both sides, ``exp_c``, ``pos`` of the
    experiment for ties.
    """
    # each prediction looks through its group's list; pairs are neither shuffled nor sorted
    listed = experimental.groupBy(*on).agg(F.collect_list(F.struct(c("shift_c").alias("exp_c"), c("pos").alias("exp_pos"))).alias("_near"))
    error = lambda x: F.struct(F.abs(c("shift_c") - x["exp_c"]).alias("error_c"), x["exp_pos"].alias("exp_pos"), x["exp_c"].alias("exp_c"))
    best = predicted.select(*on, *keys, "shift_c").join(listed, list(on)).select(*on, *keys, "shift_c", F.array_min(F.transform("_near", error)).alias("b"))
    return best.select(*on, *keys, "shift_c", "b.exp_c", "b.error_c", (c("b.error_c") <= tolerance).alias("is_matched")).distinct()


def nearest_sorted(predicted: DataFrame, experimental: DataFrame, on: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """As ``nearest_join`` for long lists: one sort of both sides together, cut into ranges, instead of all pairs of a list."""
    from .ranges import neighbours

    found = neighbours(predicted.select(*on, *keys, "shift_c"), experimental, on, "shift_c")
    return found.select(*on, *keys, "shift_c", F.least(F.abs(c("shift_c") - c("below")), F.abs(c("above") - c("shift_c"))).alias("error_c"))


def nearest_within(peaks: DataFrame, refs: DataFrame, value: str, ref_value: str, tolerance: int, on: Sequence[str], key: str, ref_key: str) -> DataFrame:
    """Each peak with the nearest reference within tolerance, or null (J7); ties go to the smaller reference key."""
    hits = band_join(peaks.select(*on, key, value), refs.select(*on, c(ref_key).alias("_ref"), c(ref_value).alias("_at")), value, "_at", tolerance, on)
    best = hits.groupBy(*on, key).agg(F.min(F.struct(F.abs(c(value) - c("_at")).alias("delta_c"), c("_ref").alias("ref_id"))).alias("_b"))
    return peaks.join(best, [*on, key], "left").select(*(peaks[x] for x in peaks.columns), c("_b.ref_id").alias("ref_id"), c("_b.delta_c").alias("delta_c"))


def validate_f1(peaks: DataFrame, refs: DataFrame, tolerance: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(peaks with ref_id, references no peak uses, match rate by list)."""
    matched = nearest_within(peaks, refs, "f1_c", "pos_c", tolerance, ["list_id"], "peak_id", "peak_id")
    unused = refs.join(matched.select("list_id", c("ref_id").alias("peak_id")), ["list_id", "peak_id"], "left_anti")
    rates = matched.groupBy("list_id").agg(ratio(F.count("ref_id"), F.count("*")).alias("match_rate"))
    return matched, unused, rates


def validate_both(peaks: DataFrame, refs: DataFrame, tolerance: int = 5, ref_value: str = "h_pos_c") -> DataFrame:
    """Peaks with ``ok``: whether both dimensions are near a reference."""
    near = lambda df, value: band_join(df, refs.select("list_id", c(ref_value).alias("_at")), value, "_at", tolerance, ["list_id"], "left_semi")
    good = near(near(peaks, "f1_c"), "f2_c").select("list_id", "peak_id", F.lit(True).alias("ok"))
    return peaks.join(good, ["list_id", "peak_id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def filter_validated(peaks: DataFrame, refs: DataFrame, tolerance: int = 50) -> DataFrame:
    """Peaks whose F1 is near a reference."""
    return band_join(peaks, refs.select("list_id", c("pos_c").alias("_at")), "f1_c", "_at", tolerance, ["list_id"], "left_semi")


def flagged(df: DataFrame, refs: DataFrame, value: str, ref_value: str, tolerance: int, on: Sequence[str], key: Sequence[str], name: str) -> DataFrame:
    """``df`` with boolean ``name``: whether a reference is within tolerance."""
    near = band_join(df, refs.select(*on, c(ref_value).alias("_at")), value, "_at", tolerance, on, "left_semi").select(*on, *key, F.lit(True).alias(name))
    return df.join(near.distinct(), [*on, *key], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def guided_filter(peaks: DataFrame, carbons: DataFrame, protons: DataFrame, carbon_tolerance: int = 150, proton_tolerance: int = 10) -> DataFrame:
    """Peaks with ``verdict``: ok, no_carbon, no_proton or neither."""
    both = flagged(peaks, carbons, "f1_c", "pos_c", carbon_tolerance, ["list_id"], ["peak_id"], "c_ok")
    both = flagged(both, protons, "f2_c", "pos_c", proton_tolerance, ["list_id"], ["peak_id"], "h_ok")
    verdict = F.when(c("c_ok") & c("h_ok"), "ok").when(~c("c_ok") & ~c("h_ok"), "neither").when(~c("c_ok"), "no_carbon").otherwise("no_proton")
    return both.withColumn("verdict", verdict).drop("c_ok", "h_ok")


def merge_refs(base: Column, extra: Column, tolerance: int) -> Column:
    """``base`` and those of ``extra``, in order, that are not near one already there."""
    near = lambda acc, x: F.exists(acc, lambda y: F.abs(x - y) <= tolerance)
    return F.aggregate(extra, base, lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def mirror_fraction(peaks: DataFrame, tolerance: int = 5) -> DataFrame:
    """Share of a list's peaks (a, b) that have one near (b, a)."""
    other = peaks.select("list_id", c("f1_c").alias("_a"), c("f2_c").alias("_b"))
    width = max(1, tolerance)
    left = peaks.withColumns({"_ba": _bin(c("f2_c"), width), "_bb": _bin(c("f1_c"), width)}).alias("l")
    right = _spread(_spread(other, "_a", width, "_ba"), "_b", width, "_bb").alias("r")
    found = left.join(
        right,
        (c("l.list_id") == c("r.list_id")) & (c("l._ba") == c("r._ba")) & (c("l._bb") == c("r._bb")) & (F.abs(c("f2_c") - c("_a")) <= tolerance) & (F.abs(c("f1_c") - c("_b")) <= tolerance),
        "left_semi",
    )
    total = peaks.groupBy("list_id").agg(F.count("*").alias("n"))
    return total.join(found.groupBy("list_id").agg(F.count("*").alias("k")), "list_id", "left").select("list_id", ratio(F.coalesce("k", F.lit(0)), c("n")).alias("fraction"))


def assign_atoms(peaks: DataFrame, atoms: DataFrame, value: str, tolerance: int = 100, name: str = "atom") -> DataFrame:
    """Peaks with the first atom, in order of descending shift, that is within tolerance."""
    hits = band_join(peaks.select("list_id", "peak_id", value), atoms.select("list_id", c("atom_no").alias("_n"), c("pos_c").alias("_at")), value, "_at", tolerance, ["list_id"])
    first = hits.groupBy("list_id", "peak_id").agg(F.min("_n").alias(name))
    return peaks.join(first, ["list_id", "peak_id"], "left")


def derive_correlations(peaks: DataFrame, atoms: DataFrame, tolerance: int = 100, proton_tolerance: int = 10) -> DataFrame:
    """Distinct (list_id, kind, atom1, atom2) from 2D peaks.

    HSQC pairs an atom with itself; HMBC takes the first HSQC peak at the
    proton's place, COSY the last; what pairs an atom with itself is left out.
    Each step carries what the next one needs through its join, so that nothing is
    joined back.
    """
    places = atoms.select("list_id", c("atom_no").alias("_n"), c("pos_c").alias("_at"))

    def met(df: DataFrame, value: str, others: DataFrame, within: int, pick: Column, name: str, carry: Sequence[str], how: str = "inner") -> DataFrame:
        hits = band_join(df.select("list_id", "peak_id", value, *carry), others, value, "_at", within, ["list_id"], how)
        return hits.groupBy("list_id", "peak_id", *carry).agg(pick.alias(name))

    of = lambda kind: peaks.where(c("experiment") == kind)
    hsqc = met(of("HSQC"), "f1_c", places, tolerance, F.min("_n"), "atom", ["f2_c"], "left")
    direct = hsqc.where("atom IS NOT NULL").select("list_id", F.lit("HSQC").alias("kind"), c("atom").alias("atom1"), c("atom").alias("atom2"))
    protons = hsqc.select("list_id", c("f2_c").alias("_at"), c("peak_id").alias("_order"), c("atom").alias("_atom"))
    first, last = (pick(F.struct("_order", "_atom"))["_atom"] for pick in (F.min, F.max))
    carbons = met(of("HMBC"), "f1_c", places, tolerance, F.min("_n"), "atom", ["f2_c"])
    long_range = met(carbons, "f2_c", protons, proton_tolerance, first, "h_atom", ["atom"]).where("atom <> h_atom").select("list_id", F.lit("HMBC").alias("kind"), c("atom").alias("atom1"), c("h_atom").alias("atom2"))
    one = met(of("COSY"), "f1_c", protons, proton_tolerance, last, "a1", ["f2_c"]).where("a1 IS NOT NULL")
    coupled = met(one, "f2_c", protons, proton_tolerance, last, "a2", ["a1"]).where("a1 <> a2").select("list_id", F.lit("COSY").alias("kind"), F.least("a1", "a2").alias("atom1"), F.greatest("a1", "a2").alias("atom2"))
    return direct.unionByName(long_range).unionByName(coupled).distinct()


def assign_multiplicity(carbons: DataFrame, dept: DataFrame, tolerance: int = 100) -> DataFrame:
    """Carbons with hydrogens and hybridisation from the first DEPT peak, in order, within tolerance."""
    hits = band_join(carbons.select("list_id", "peak_id", "pos_c"), dept.select("list_id", c("pos_c").alias("_at"), c("peak_id").alias("_order"), c("mult").alias("_mult")), "pos_c", "_at", tolerance, ["list_id"])
    first = hits.groupBy("list_id", "peak_id").agg(F.min(F.struct("_order", "_mult")).getField("_mult").alias("mult"))
    found = carbons.join(first, ["list_id", "peak_id"], "left")
    aromatic = c("pos_c").between(10000, 16000)
    h = F.when(c("mult") == "CH2", 2).when(c("mult") == "CH", 1).when(c("mult") == "CH3", 3).when(c("mult") == "CH/CH3", F.when(c("pos_c") < 3000, 3).otherwise(1)).otherwise(0)
    sp2 = c("mult").isin("CH", "CH/CH3") & aromatic
    return found.withColumns({"h_count": h.cast("bigint"), "hybridisation": F.when(F.coalesce(sp2, F.lit(False)), "sp2").otherwise("sp3")})


def refine_multiplicity(dept: DataFrame, second: DataFrame, tolerance: int = 100) -> DataFrame:
    """DEPT peaks with CH/CH3 resolved: CH if the second list has it, else CH3."""
    seen = flagged(dept, second, "pos_c", "pos_c", tolerance, ["list_id"], ["peak_id"], "_seen")
    return seen.withColumn("mult", F.when(c("mult") != "CH/CH3", c("mult")).when(c("_seen"), "CH").otherwise("CH3")).drop("_seen")


def _classed(df: DataFrame, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the class of its value instead of the value, each value once with its class); rows without a value have none."""
    classes = kept(df.where(c(value).isNotNull()).select(value).distinct().withColumn(name, F.monotonically_increasing_id()), "classes")
    return df.join(classes, value).drop(value), classes


def prescreen(queries: DataFrame, fragments: DataFrame, bins: int = 1) -> DataFrame:
    """Pairs (query_id, fragment_id) whose fragment bits are all in the (expanded) query bits.

    Queries and fragments of equal bits are compared once, as classes; a pair of
    classes becomes the pairs of its members in the end.  A fragment can only be
    contained where the query has all of its bits, so classes meet on two of them:
    the two that the fewest classes of queries have.  A query asks for pairs of its
    bits that some fragment has as its key, of which there are at most 32,896.  The
    eight ANDs decide.  A fragment of one bit has it twice; one without any is
    contained in every query, and meets all of them in salted parts.
    """
    near = lambda s: F.transform(F.sequence(F.lit(-bins), F.lit(bins)), lambda d: F.least(F.greatest(bits.bin_of(s) + d, F.lit(0)), F.lit(bits.BITS - 1)))
    sorted_bins = lambda b: F.array_sort(F.array_distinct(F.filter(b, lambda x: x.isNotNull())))
    wanted = queries.select("query_id", sorted_bins(F.flatten(F.transform("shifts", near))).alias("qbins"))
    stored = fragments.select("fragment_id", sorted_bins(F.transform("shifts", bits.bin_of)).alias("bins"))
    bare = F.coalesce(F.size("bins"), F.lit(0)) < 1
    asking, q_classes = _classed(wanted, "qbins", "q_class")
    members, f_classes = _classed(stored.where(~bare), "bins", "f_class")
    # a count for each of the 256 bits
    held = {r["bit"]: r["n"] for r in q_classes.select(F.explode("qbins").alias("bit")).groupBy("bit").agg(F.count("*").alias("n")).collect()}
    counts = F.array(*(F.lit(held.get(b, 0)).cast("bigint") for b in range(bits.BITS)))
    rarest = F.array_sort(F.transform("bins", lambda b: F.struct(F.get(counts, b).alias("n"), b.alias("bit"))))
    keyed = f_classes.select("f_class", bits.words(c("bins")).alias("fp"), rarest.alias("r")).select(
        "f_class", "fp", F.get("r", F.lit(0))["bit"].alias("first"), F.coalesce(F.get("r", F.lit(1))["bit"], F.get("r", F.lit(0))["bit"]).alias("second")
    )
    # a row for each of the 256 bits at most
    seconds = F.broadcast(keyed.groupBy("first").agg(F.collect_set("second").alias("seconds")))
    asked = q_classes.withColumn("qfp", bits.words(c("qbins"))).withColumn("first", F.explode("qbins")).join(seconds, "first").withColumn("second", F.explode(F.array_intersect("seconds", "qbins")))
    met = asked.join(keyed, ["first", "second"]).where(bits.contained(c("fp"), c("qfp"))).select("q_class", "f_class")
    # members of the queries' classes first: the pairs themselves are not shuffled
    pairs = met.join(asking, "q_class").select("query_id", "f_class").join(members, "f_class").select("query_id", "fragment_id")
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    empty = stored.where(bare).select("fragment_id", F.explode(salts).alias("salt"))
    all_ = wanted.select("query_id", F.pmod(F.xxhash64("query_id"), F.lit(_SALTS)).cast("int").alias("salt")).join(empty, "salt").select("query_id", "fragment_id")
    return pairs.unionByName(all_)


#: Parts of the queries that a fragment without bits meets.
_SALTS = 64


def fine_match(pairs: DataFrame, max_dev: int = 200, max_avg: int = 100) -> DataFrame:
    """Pairs whose fragment shifts, ascending, each find a near query shift of their own.

    ``pairs`` has arrays ``query`` and ``shifts``; gains ``n`` and ``dev_c``.
    """
    start = F.struct(F.sort_array("query").alias("left"), F.lit(0).cast("bigint").alias("dev_c"), F.lit(True).alias("alive"))

    def step(acc: Column, s: Column) -> Column:
        best = F.array_min(F.transform(acc["left"], lambda q, i: F.struct(F.abs(q - s).alias("d"), i.alias("i"))))
        # deviations only add up, so a pair ends with the first shift that is too far, or too far together with those before
        near = lambda b: (b["d"] <= max_dev) & (acc["dev_c"] + b["d"] <= c("n") * max_avg)
        taken = lambda b: F.struct(F.filter(acc["left"], lambda _, i: i != b["i"]).alias("left"), (acc["dev_c"] + b["d"]).cast("bigint").alias("dev_c"), F.lit(True).alias("alive"))
        dead = F.struct(F.slice(acc["left"], 1, 0).alias("left"), acc["dev_c"].alias("dev_c"), F.lit(False).alias("alive"))
        # bound as a variable: the nearest shift is looked for once a step, not once for each use and each shift left
        return F.when(acc["alive"], F.get(F.transform(F.array(best), lambda b: F.when(near(b), taken(b)).otherwise(dead)), F.lit(0))).otherwise(acc)

    # a generator's column, so that no filter on it makes the fold again
    folded = pairs.withColumn("n", F.size("shifts").cast("bigint")).withColumn("_m", F.explode(F.array(F.aggregate(F.sort_array("shifts"), start, step))))
    kept = folded.where((c("n") > 0) & c("_m.alive") & (c("_m.dev_c") <= c("n") * max_avg))
    return kept.select(*pairs.columns, "n", c("_m.dev_c").alias("dev_c"))


def fine_search(queries: DataFrame, fragments: DataFrame, bins: int = 1, limit: int | None = None) -> DataFrame:
    """Fragments that match each query finely, (query_id, n, dev_c and the fragment's columns but its shifts) (J20, J21), or the ``limit`` best with their rank.

    Lists of equal shifts are compared once, as classes, and what was found is
    handed to the members in the end.  Members of a class deviate by the same, so
    with a limit only that many of a class, the best by size and id, can be among
    the best of a query.
    """
    from .ranking import rank_fragments

    ordered = lambda df: df.withColumn("shifts", F.array_sort("shifts"))
    asking, q_lists = _classed(ordered(queries.select("query_id", "shifts")), "shifts", "q_list")
    members, f_lists = _classed(ordered(fragments), "shifts", "f_list")
    pairs = prescreen(q_lists.withColumnRenamed("q_list", "query_id"), f_lists.withColumnRenamed("f_list", "fragment_id"), bins).toDF("q_list", "f_list")
    # pairs are few bytes and much work, so their number of parts doesn't follow from their size
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q_list", "f_list")
    met = fine_match(spread.join(q_lists.withColumnRenamed("shifts", "query"), "q_list").join(f_lists, "f_list")).select("q_list", "f_list", "n", "dev_c")
    if limit is not None:
        # within a class only size and id differ
        alike = members.withColumns({"query_id": c("f_list"), "n": F.lit(1), "dev_c": F.lit(0)})
        best = rank_fragments(alike, limit).drop("query_id", "n", "dev_c", "rank")
        met = rank_fragments(met.join(best, "f_list").withColumnRenamed("q_list", "query_id"), limit).withColumnRenamed("query_id", "q_list").drop("f_list")
        return met.join(asking, "q_list").drop("q_list")
    return met.join(asking, "q_list").drop("q_list").join(members, "f_list").drop("f_list")


def identify(queries: DataFrame, compounds: DataFrame) -> DataFrame:
    """Queries (query_id, inchi_key, smiles) with the compound found by key, or else by SMILES.

    Blank keys match nothing; of several hits the smallest id counts.
    """
    by = lambda key: compounds.where(c(key) != "").groupBy(key).agg(F.min_by(F.struct("id", "name", "source"), "id").alias(f"hit_{key}"))
    found = queries.join(by("inchi_key"), "inchi_key", "left").join(by("smiles"), "smiles", "left")
    hit = F.coalesce("hit_inchi_key", "hit_smiles")
    via = F.when(c("hit_inchi_key").isNotNull(), "key").when(c("hit_smiles").isNotNull(), "smiles")
    return found.select("query_id", hit.getField("id").alias("id"), hit.getField("name").alias("name"), hit.getField("source").alias("source"), via.alias("via"))


def pair_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that only one side has, with ``side`` (J23); none if both sets are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def permute(problem: DataFrame, suspects: DataFrame) -> DataFrame:
    """Variants of each problem's correlations over all subsets of its (at most three) suspects.

    ``problem`` and ``suspects`` have list_id, kind, atom1, atom2; ``suspects``
    also k, from 0.  Variant 0 includes all; an included suspect may span four
    bonds.
    """
    keys = ["list_id", "kind", "atom1", "atom2"]
    counts = problem.select("list_id").distinct().join(suspects.groupBy("list_id").agg(F.count("*").alias("n")), "list_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    checked = counts.withColumn("n", F.when(c("n") <= 3, c("n")).otherwise(F.raise_error(F.lit("more than three suspects")).cast("bigint")))
    variants = checked.withColumn("variant", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), c("n")).cast("bigint") - 1)))
    base = problem.join(suspects, keys, "left_anti").join(variants, "list_id").select(*keys, "variant", F.lit(None).cast("bigint").alias("max_bonds"))
    flag = F.floor(c("variant") / F.pow(F.lit(2.0), c("n") - 1 - c("k"))) % 2 == 0
    added = suspects.join(variants, "list_id").where(flag).select(*keys, "variant", F.lit(4).cast("bigint").alias("max_bonds"))
    return base.unionByName(added)


def calibration_offsets(observed: DataFrame, refs: DataFrame, on: Sequence[str], tolerance: int) -> DataFrame:
    """Mean signed offset of the nearest observation of each reference within tolerance, and their number."""
    hits = band_join(refs, observed, "ref_c", "obs_c", tolerance, on)
    signed = c("obs_c") - c("ref_c")
    best = hits.groupBy(*on, "ref_id", "ref_c").agg(F.min_by(signed, F.struct(F.abs(signed), "obs_order")).alias("offset"))
    return best.groupBy(*on).agg(F.sum("offset").alias("sum_c"), F.count("*").alias("n"))


def intensity_pairs(refs: DataFrame, peaks: DataFrame, on: Sequence[str], tolerance: int) -> DataFrame:
    """Nearest peak of each reference, each peak only for the first reference that takes it.

    ``refs``: ref_order, ref_c; ``peaks``: peak_id, pos_c, intensity.
    """
    hits = band_join(refs, peaks, "ref_c", "pos_c", tolerance - 1, on)
    best = hits.groupBy(*on, "ref_order").agg(F.min_by(F.struct("peak_id", "pos_c", "intensity"), F.struct(F.abs(c("pos_c") - c("ref_c")), c("peak_id"))).alias("b"))
    return best.groupBy(*on, "b.peak_id").agg(F.min("ref_order").alias("ref_order"), F.first("b.pos_c").alias("pos_c"), F.first("b.intensity").alias("intensity"))


def fetch_by_id(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is asked for."""
    return table.join(ids, key, "left_semi")
