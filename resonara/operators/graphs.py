"""Neighbourhoods, paths and rings over atom and bond tables.

``atoms``: compound_id, pos, element; ``bonds``: compound_id, i, j, bond_order,
both directions of each bond.  Every operator works on all compounds at once:
small ones as rows with lists of their atoms and bonds, larger ones in rounds of
joins, which are bounded by a radius, a ring size or a path length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonara.functions.scoring import coupling_label
from resonara.plans.scratch import kept

from .components import connected_components

c = F.col
BOND_SIGNS = {1: "-", 2: "=", 3: "#"}


#: Most rows of a compound (atoms, bonds, signals together) that are gathered into lists; counted before.
LIST_ROWS = 512


def _by_size(lists: Callable[..., DataFrame], rounds: Callable[..., DataFrame], *frames: DataFrame) -> DataFrame:
    """``lists`` of the compounds with at most LIST_ROWS rows in all ``frames``, ``rounds`` of the larger ones."""
    counted = reduce(DataFrame.unionAll, (x.select("compound_id") for x in frames))
    large = kept(counted.groupBy("compound_id").agg(F.count("*").alias("n")).where(c("n") > LIST_ROWS).select("compound_id"), "large")
    if large.isEmpty():
        return lists(*frames)
    pick = lambda how: (x.join(large, "compound_id", how) for x in frames)
    return lists(*pick("left_anti")).unionByName(rounds(*pick("left_semi")))


def _edges(bonds: DataFrame, *carry: str) -> DataFrame:
    """(compound_id, edges): the bonds of each compound as one list."""
    return bonds.groupBy("compound_id").agg(F.collect_list(F.struct("i", "j", *carry)).alias("edges"))


def _named_edges(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(compound_id, nodes, edges): atoms and bonds of each compound as lists; bonds with the elements x and y of their ends."""
    nodes = atoms.groupBy("compound_id").agg(F.collect_list(F.struct("pos", "element")).alias("nodes"))
    element = lambda p: F.get(F.filter("nodes", lambda n: n["pos"] == p), F.lit(0))["element"]
    edges = F.transform("edges", lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"), e["bond_order"].alias("bond_order"), element(e["i"]).alias("x"), element(e["j"]).alias("y")))
    return nodes.join(_edges(bonds, "bond_order"), "compound_id", "left").select("compound_id", "nodes", F.coalesce(edges, F.array().cast("array<struct<i:bigint,j:bigint,bond_order:int,x:string,y:string>>")).alias("edges"))


def _onward(edges: Column, front: Column, seen: Column) -> Column:
    """Bonds from ``front`` to what is not in ``seen``."""
    return F.filter(edges, lambda e: F.array_contains(front, e["i"]) & ~F.array_contains(seen, e["j"]))


_ATOMS = "array<bigint>"


def shells(atoms: DataFrame, bonds: DataFrame, radius: int | None) -> DataFrame:
    """(compound_id, pos, atom, distance) of all atoms within ``radius`` bonds, the centre included.

    Without a radius the search goes on until no atom is new, so that whatever an
    atom can reach is found, however far.  Small compounds are searched list by
    list, without a shuffle a round; the others in rounds of joins.
    """
    return _by_size(lambda a, b: _shells_in_lists(a, b, radius), lambda a, b: _shells_in_rounds(a, b, radius), atoms.select("compound_id", "pos"), bonds)


def _shells_in_lists(atoms: DataFrame, bonds: DataFrame, radius: int | None) -> DataFrame:
    rows = atoms.join(_edges(bonds), "compound_id", "left").where("pos IS NOT NULL").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<i:bigint,j:bigint>>")))
    most = F.size("edges") if radius is None else F.lit(radius)
    start = F.struct(F.array("pos").cast(_ATOMS).alias("seen"), F.array("pos").cast(_ATOMS).alias("front"), F.array(F.struct(c("pos").alias("atom"), F.lit(0).cast("bigint").alias("distance"))).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        front = F.array_distinct(F.transform(_onward(c("edges"), acc["front"], acc["seen"]), lambda e: e["j"]))
        # all in one struct, so that the search of a round is made once
        return F.transform(F.array(front), lambda f: F.struct(F.concat(acc["seen"], f).alias("seen"), f.alias("front"), F.concat(acc["out"], F.transform(f, lambda x: F.struct(x.alias("atom"), d.cast("bigint").alias("distance")))).alias("out")))[0]

    rounds = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    found = F.aggregate(rounds, start, lambda acc, d: F.when((F.size(acc["front"]) == 0) | (d > most), acc).otherwise(step(acc, d)))
    return rows.select("compound_id", "pos", found["out"].alias("_out")).select("compound_id", "pos", F.inline("_out"))


def _shells_in_rounds(atoms: DataFrame, bonds: DataFrame, radius: int | None) -> DataFrame:
    step = bonds.select("compound_id", c("i").alias("atom"), c("j").alias("_to"))
    reached = atoms.select("compound_id", "pos", c("pos").alias("atom"), F.lit(0).cast("bigint").alias("distance"))
    frontier, d = reached, 0
    while radius is None or d < radius:
        d += 1
        new = frontier.join(step, ["compound_id", "atom"]).select("compound_id", "pos", c("_to").alias("atom")).distinct()
        frontier = kept(new.join(reached.select("compound_id", "pos", "atom"), ["compound_id", "pos", "atom"], "left_anti").withColumn("distance", F.lit(d).cast("bigint")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if d % 8 == 0:
            reached = kept(reached)
    return reached


def sphere_codes(atoms: DataFrame, bonds: DataFrame, radius: int = 6) -> DataFrame:
    """(compound_id, pos, radius, code): equal neighbourhoods have equal codes (G1).

    Sphere k is the sorted list of bond sign and element of the atoms k bonds
    away, by their bonds to sphere k - 1; the code of a radius extends that of
    the one before.
    """
    return _by_size(lambda a, b: _codes_in_lists(a, b, radius), lambda a, b: _codes_in_rounds(a, b, radius), atoms.select("compound_id", "pos", "element"), bonds)


def _codes_in_lists(atoms: DataFrame, bonds: DataFrame, radius: int) -> DataFrame:
    signs = F.create_map(*(x for k, v in BOND_SIGNS.items() for x in (F.lit(k), F.lit(v))))
    labelled = F.transform("edges", lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"), F.concat(signs[e["bond_order"].cast("int")], e["y"]).alias("label")))
    rows = _named_edges(atoms, bonds).select("nodes", "compound_id", labelled.alias("edges")).select("compound_id", F.explode("nodes").alias("_n"), "edges").select("compound_id", "_n.pos", "_n.element", "edges")
    start = F.struct(F.array("pos").cast(_ATOMS).alias("seen"), F.array("pos").cast(_ATOMS).alias("front"), F.array().cast("array<string>").alias("texts"))

    def step(acc: Column, _: Column) -> Column:
        text = lambda met: F.concat_ws(",", F.sort_array(F.filter(F.transform(met, lambda e: e["label"]), lambda x: x.isNotNull())))
        front = lambda met: F.array_distinct(F.transform(met, lambda e: e["j"]))
        return F.transform(F.array(_onward(c("edges"), acc["front"], acc["seen"])), lambda met: F.struct(F.concat(acc["seen"], front(met)).alias("seen"), front(met).alias("front"), F.concat(acc["texts"], F.array(text(met))).alias("texts")))[0]

    texts = F.aggregate(F.sequence(F.lit(1), F.lit(radius)), start, step)["texts"]
    every = rows.select("compound_id", "pos", "element", texts.alias("_texts"))
    upto = lambda r: F.array_join(F.slice("_texts", 1, r), "/")
    codes = every.select("compound_id", "pos", F.explode(F.array(*(F.struct(F.lit(r).cast("bigint").alias("radius"), F.concat(c("element"), F.lit(";"), upto(r)).alias("code")) for r in range(1, radius + 1)))).alias("_c"))
    return codes.select("compound_id", "pos", "_c.radius", "_c.code")


def _codes_in_rounds(atoms: DataFrame, bonds: DataFrame, radius: int) -> DataFrame:
    from pyspark.sql import Window as W

    reach = kept(_shells_in_rounds(atoms, bonds, radius))
    signs = F.create_map(*(x for k, v in BOND_SIGNS.items() for x in (F.lit(k), F.lit(v))))
    inner = reach.select("compound_id", "pos", c("atom").alias("i"), c("distance").alias("d"))
    outer = reach.select("compound_id", "pos", c("atom").alias("j"), c("distance").alias("e"))
    edges = bonds.join(inner, ["compound_id", "i"]).join(outer, ["compound_id", "pos", "j"]).where("e = d + 1")
    labelled = edges.join(atoms.select("compound_id", c("pos").alias("j"), "element"), ["compound_id", "j"])
    spheres = labelled.groupBy("compound_id", "pos", c("e").alias("sphere")).agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat(signs[c("bond_order").cast("int")], c("element"))))).alias("text"))
    every = atoms.select("compound_id", "pos", "element", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(radius).cast("bigint"))).alias("sphere")).join(spheres, ["compound_id", "pos", "sphere"], "left")
    upto = F.sort_array(F.collect_list(F.struct("sphere", F.coalesce("text", F.lit("")).alias("text"))).over(W.partitionBy("compound_id", "pos").orderBy("sphere")))
    return every.select("compound_id", "pos", c("sphere").alias("radius"), F.concat(c("element"), F.lit(";"), F.array_join(F.transform(upto, lambda s: s["text"]), "/")).alias("code"))


def path_lengths(bonds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (compound_id, a, b) with their shortest path in bonds, of any length; null if unreachable."""
    return _by_size(_paths_in_lists, _paths_in_rounds, bonds, pairs)


def _paths_in_lists(bonds: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = pairs.join(_edges(bonds), "compound_id", "left")
    none = F.lit(None).cast("bigint")
    start = F.struct(F.array("a").cast(_ATOMS).alias("seen"), F.array("a").cast(_ATOMS).alias("front"), F.when(c("a") == c("b"), F.lit(0).cast("bigint")).alias("path"))

    def step(acc: Column, d: Column) -> Column:
        front = F.array_distinct(F.transform(_onward(c("edges"), acc["front"], acc["seen"]), lambda e: e["j"]))
        return F.transform(F.array(front), lambda f: F.struct(F.concat(acc["seen"], f).alias("seen"), f.alias("front"), F.when(F.array_contains(f, c("b")), d.cast("bigint")).otherwise(none).alias("path")))[0]

    rounds = F.sequence(F.lit(1), F.greatest(F.size("edges"), F.lit(1)))
    # a round without new atoms, or after the other end was found, costs two tests
    over = lambda acc: acc["path"].isNotNull() | (F.size(acc["front"]) == 0)
    path = F.when(c("a").isNull() | c("b").isNull(), none).when(c("edges").isNull(), F.when(c("a") == c("b"), F.lit(0).cast("bigint"))).otherwise(F.aggregate(rounds, start, lambda acc, d: F.when(over(acc), acc).otherwise(step(acc, d)))["path"])
    return rows.withColumn("path", path).drop("edges")


def _paths_in_rounds(bonds: DataFrame, pairs: DataFrame) -> DataFrame:
    starts = pairs.select("compound_id", c("a").alias("pos")).distinct()
    reach = _shells_in_rounds(starts, bonds, None).select("compound_id", c("pos").alias("a"), c("atom").alias("b"), c("distance").alias("path"))
    return pairs.join(reach, ["compound_id", "a", "b"], "left").select(*pairs.columns, "path")


def j_summary(paths: DataFrame) -> DataFrame:
    """Histogram of couplings per compound, the longest, whether all of pairs that are connected are at most three bonds."""
    j = c("path") + 1
    return paths.groupBy("compound_id").agg(
        *(F.count_if(j == k).alias(f"j{k}") for k in (2, 3, 4)), F.count_if(c("path").isNull()).alias("unreachable"), F.max(j).alias("max_j"), F.coalesce(F.every(j <= 3), F.lit(True)).alias("all_3j")
    )


def path_report(bonds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with path and coupling label."""
    return path_lengths(bonds, pairs).withColumn("label", coupling_label(c("path")))


def _keyed(members: DataFrame, atoms: DataFrame, bonds: DataFrame, by: list[str]) -> DataFrame:
    """Canonical key of an atom set: its sorted edge labels; sizes come along."""
    inside = members.select(*by, "compound_id", "atom").distinct()
    named = inside.join(atoms.select("compound_id", c("pos").alias("atom"), "element"), ["compound_id", "atom"])
    left = named.select(*by, "compound_id", c("atom").alias("i"), c("element").alias("_x"))
    right = named.select(*by, "compound_id", c("atom").alias("j"), c("element").alias("_y"))
    edges = bonds.where("i < j").join(left, ["compound_id", "i"]).join(right, ["compound_id", *by, "j"])
    label = F.concat(F.least("_x", "_y"), c("bond_order").cast("string"), F.greatest("_x", "_y"))
    keys = edges.groupBy("compound_id", *by).agg(F.concat_ws(",", F.sort_array(F.collect_list(label))).alias("key"))
    return inside.groupBy("compound_id", *by).agg(F.count("*").alias("atom_count")).join(keys, ["compound_id", *by])


def ego_fragments(atoms: DataFrame, bonds: DataFrame, signals: DataFrame, radius: int = 3) -> DataFrame:
    """Atom-centred fragments of radius 1 to ``radius`` with the known shifts inside."""
    known = signals.where("atom_index IS NOT NULL").select("compound_id", c("atom_index").alias("atom"), "shift_c")
    return _by_size(lambda a, b, k: _egos_in_lists(a, b, k, radius), lambda a, b, k: _egos_in_rounds(a, b, k, radius), atoms.select("compound_id", "pos", "element"), bonds, known)


def _fragment(edges: Column, inside: Column, known: Column) -> Column:
    """atom_count, key and shifts of the atoms ``inside``: the row-wise twin of ``_keyed``.

    A generator, so that a filter on its columns doesn't make them twice.
    """
    within = F.filter(edges, lambda e: (e["i"] < e["j"]) & F.array_contains(inside, e["i"]) & F.array_contains(inside, e["j"]) & e["x"].isNotNull() & e["y"].isNotNull())
    labels = F.transform(within, lambda e: F.concat(F.least(e["x"], e["y"]), e["bond_order"].cast("string"), F.greatest(e["x"], e["y"])))
    shifts = F.transform(F.filter(known, lambda k: F.array_contains(inside, k["atom"])), lambda k: k["shift_c"])
    return F.inline(F.array(F.struct(F.size(inside).cast("bigint").alias("atom_count"), F.sort_array(labels).alias("_labels"), F.size(shifts).alias("_known"), F.sort_array(F.array_compact(shifts)).alias("shifts"))))


def _finished(found: DataFrame, *by: str) -> DataFrame:
    """Fragments that have a bond and a known atom."""
    return found.where((F.size("_labels") > 0) & (c("_known") > 0)).select("compound_id", *by, "atom_count", F.concat_ws(",", "_labels").alias("key"), "shifts")


def _known_lists(known: DataFrame) -> DataFrame:
    return known.groupBy("compound_id").agg(F.collect_list(F.struct("atom", "shift_c")).alias("known"))


def _egos_in_lists(atoms: DataFrame, bonds: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    whole = _named_edges(atoms, bonds).join(_known_lists(known), "compound_id")
    rows = whole.select("compound_id", "edges", "known", F.array_intersect(F.transform("nodes", lambda n: n["pos"]), F.transform("known", lambda k: k["atom"])).alias("_centres")).select("compound_id", "edges", "known", F.explode("_centres").alias("pos"))
    start = F.struct(F.array("pos").cast(_ATOMS).alias("seen"), F.array("pos").cast(_ATOMS).alias("front"), F.array().cast(f"array<{_ATOMS}>").alias("balls"))

    def step(acc: Column, _: Column) -> Column:
        front = F.array_distinct(F.transform(_onward(c("edges"), acc["front"], acc["seen"]), lambda e: e["j"]))
        return F.transform(F.array(front), lambda f: F.struct(F.concat(acc["seen"], f).alias("seen"), f.alias("front"), F.concat(acc["balls"], F.array(F.concat(acc["seen"], f))).alias("balls")))[0]

    balls = F.aggregate(F.sequence(F.lit(1), F.lit(radius)), start, step)["balls"]
    of = rows.select("compound_id", "pos", "edges", "known", balls.alias("_balls")).select("compound_id", "pos", "edges", "known", F.posexplode("_balls").alias("_r", "_inside"))
    return _finished(of.select("compound_id", "pos", (c("_r") + 1).cast("bigint").alias("radius"), _fragment(c("edges"), c("_inside"), c("known"))), "pos", "radius")


def _egos_in_rounds(atoms: DataFrame, bonds: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    centres = atoms.join(known.select("compound_id", c("atom").alias("pos")), ["compound_id", "pos"], "left_semi")
    reach = _shells_in_rounds(centres, bonds, radius)
    members = kept(reach.withColumn("radius", F.explode(F.sequence(F.greatest("distance", F.lit(1)), F.lit(radius).cast("bigint")))))
    shifts = members.join(known, ["compound_id", "atom"]).groupBy("compound_id", "pos", "radius").agg(F.sort_array(F.collect_list("shift_c")).alias("shifts"))
    return _keyed(members, atoms, bonds, ["pos", "radius"]).join(shifts, ["compound_id", "pos", "radius"])


def ring_members(bonds: DataFrame, sizes: range = range(3, 7)) -> DataFrame:
    """(compound_id, size, ring, atom): simple cycles, each once, named by its sorted atoms.

    Paths start at a ring's smallest atom and turn towards the smaller of its
    two neighbours there, so that no ring is found twice.  In small compounds a
    path grows beside the list of its compound's bonds, row by row.
    """
    members = lambda paths: paths.select("compound_id", F.size("path").cast("bigint").alias("size"), F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("ring"), F.explode("path").alias("atom"))
    return _by_size(lambda b: members(_rings_in_lists(_edges(b), sizes)), lambda b: _rings_in_rounds(b, sizes), bonds)


def _rings_in_lists(lists: DataFrame, sizes: range) -> DataFrame:
    """``lists`` (compound_id, edges and others) with a row for each ``path`` that is a ring."""
    start = F.transform(F.filter("edges", lambda e: e["i"] < e["j"]), lambda e: F.array(e["i"], e["j"]).cast(_ATOMS))
    rows = lists.select(*lists.columns, start.alias("_paths"), F.array().cast(f"array<{_ATOMS}>").alias("_rings"))
    # all paths of a length stand in one row: none is copied together with the lists of its compound
    onward = lambda p, fits: F.filter("edges", lambda e: (e["i"] == F.element_at(p, -1)) & fits(e))
    longer = F.flatten(F.transform("_paths", lambda p: F.transform(onward(p, lambda e: (e["j"] > p[0]) & ~F.array_contains(p, e["j"])), lambda e: F.concat(p, F.array(e["j"])).cast(_ATOMS))))
    closed = F.flatten(F.transform(F.filter("_paths", lambda p: p[1] < F.element_at(p, -1)), lambda p: F.transform(onward(p, lambda e: e["j"] == p[0]), lambda _: p)))
    for length in range(3, max(sizes) + 1):
        rows = rows.select(*lists.columns, longer.alias("_paths"), "_rings")
        if length in sizes:
            rows = rows.select(*lists.columns, "_paths", F.concat("_rings", closed).alias("_rings"))
    return rows.select(*lists.columns, F.explode("_rings").alias("path"))


def _rings_in_rounds(bonds: DataFrame, sizes: range) -> DataFrame:
    out = None
    step = bonds.select("compound_id", c("i").alias("_end"), c("j").alias("_next"))
    path = bonds.where("i < j").select("compound_id", F.array("i", "j").alias("path"))
    for size in range(3, max(sizes) + 1):
        longer = path.withColumn("_end", F.element_at("path", -1)).join(step, ["compound_id", "_end"])
        path = longer.where((c("_next") > c("path")[0]) & ~F.array_contains("path", c("_next"))).select("compound_id", F.concat("path", F.array("_next")).alias("path"))
        if size in sizes:
            closed = path.withColumn("_end", F.element_at("path", -1)).join(step, ["compound_id", "_end"]).where((c("_next") == c("path")[0]) & (c("path")[1] < c("_end")))
            rings = closed.select("compound_id", F.lit(size).cast("bigint").alias("size"), F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("ring"), F.explode("path").alias("atom"))
            out = rings if out is None else out.unionByName(rings)
    return out


#: Elements that make a neighbour of a kind.
HALOGENS = ("F", "Cl", "Br", "I")
#: Bond orders of the bond block that count as double; 4 is an aromatic bond.
DOUBLE = (2, 4)
#: Elements that each fact about neighbours asks for.
KINDS = {"has_c": ("C",), "has_o": ("O",), "has_n": ("N",), "has_s": ("S",), "has_x": HALOGENS}


def atom_facts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(compound_id, pos, element, state, has_c, has_o, has_n, has_s, has_x, ring3, ring4, aromatic) of every atom.

    ``state`` is sp1 with a triple bond or two double ones, sp2 with one double
    bond or an aromatic one, else sp3.  Aromatic are the members of rings of six
    whose atoms all have a double bond to a ring's atom, and of rings of five where
    four have and the fifth is N, O or S.
    """
    order = c("bond_order")
    other = atoms.select("compound_id", c("pos").alias("j"), c("element").alias("_e"))
    around = bonds.join(other, ["compound_id", "j"]).groupBy("compound_id", c("i").alias("pos")).agg(
        F.count_if(order == 3).alias("_triple"), F.count_if(order == 2).alias("_double"), F.count_if(order == 4).alias("_shared"), *(F.bool_or(c("_e").isin(*es)).alias(k) for k, es in KINDS.items())
    )
    rings = kept(ring_members(bonds, range(3, 7)))
    small = rings.groupBy("compound_id", c("atom").alias("pos")).agg(F.bool_or(c("size") == 3).alias("ring3"), F.bool_or(c("size") == 4).alias("ring4"))
    cyclic = rings.where("size >= 5").select("compound_id", c("atom").alias("j")).distinct()
    unsaturated = bonds.where(order.isin(*DOUBLE)).join(cyclic, ["compound_id", "j"], "left_semi").select("compound_id", c("i").alias("atom"), F.lit(True).alias("_pi")).distinct()
    members = rings.where("size >= 5").join(unsaturated, ["compound_id", "atom"], "left").join(atoms.select("compound_id", c("pos").alias("atom"), "element"), ["compound_id", "atom"])
    closed = members.groupBy("compound_id", "size", "ring").agg(F.count("_pi").alias("_n"), F.count_if(c("_pi").isNull() & c("element").isin("N", "O", "S")).alias("_lone"))
    good = closed.where("size = 6 AND _n = 6 OR size = 5 AND _n = 4 AND _lone = 1").select("compound_id", "ring")
    aromatic = rings.join(good, ["compound_id", "ring"], "left_semi").select("compound_id", c("atom").alias("pos"), F.lit(True).alias("aromatic")).distinct()
    found = atoms.select("compound_id", "pos", "element").join(around, ["compound_id", "pos"], "left").join(small, ["compound_id", "pos"], "left").join(aromatic, ["compound_id", "pos"], "left")
    n = lambda x: F.coalesce(x, F.lit(0))
    state = F.when((n("_triple") > 0) | (n("_double") > 1), "sp1").when((n("_double") > 0) | (n("_shared") > 0), "sp2").otherwise("sp3")
    return found.select("compound_id", "pos", "element", state.alias("state"), *(F.coalesce(x, F.lit(False)).alias(x) for x in (*KINDS, "ring3", "ring4", "aromatic")))


_ENVIRONMENT = "id bigint, pos bigint, radius bigint, code string, n bigint, sum_c bigint, sumsq_c bigint, state string, " + ", ".join(f"{x} boolean" for x in (*KINDS, "ring3", "ring4", "aromatic"))


def environments(structures: DataFrame, radius: int = 6) -> DataFrame:
    """``sphere_codes`` and ``atom_facts`` of the atoms ``pos`` of structures as rows of lists, without a join.

    ``structures``: id, elements, bonds (i, j and order after each other, one
    direction), and lists of equal length pos, n, sum_c, sumsq_c, which come along.
    """
    return structures.select("id", "elements", "bonds", "pos", "n", "sum_c", "sumsq_c").mapInArrow(lambda batches: _environments(batches, radius), _ENVIRONMENT)


def _environments(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in _ENVIRONMENT.split(", ")]
    for batch in batches:
        out = []
        for id_, elements, bonds, *own in zip(*(x.to_pylist() for x in batch.columns)):
            found = _environments_of(elements, bonds, set(own[0]), radius)
            out += [(id_, pos, r, code, *sums, *facts) for pos, *sums in zip(*own) for codes, facts in [found[pos]] for r, code in enumerate(codes, 1)]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*out), fields)], names=[f for f, _ in fields])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*out), fields)], names=[f for f, _ in fields])


def _environments_of(elements: list, bonds: list, asked: set, radius: int) -> dict[int, tuple[list, tuple]]:
    """pos -> (codes by radius, facts) of the atoms asked for: the row-wise twin of ``sphere_codes`` and ``atom_facts``."""
    n = len(elements)
    element = lambda p: elements[p] if 0 <= p < n else None
    near: dict[int, list[tuple]] = {}
    for i, j, order in zip(bonds[::3], bonds[1::3], bonds[2::3]):
        if i is not None and j is not None:
            near.setdefault(i, []).append((j, order))
            near.setdefault(j, []).append((i, order))
    rings: dict[tuple, int] = {}  # how often each is found: parallel bonds count
    paths = [(p, q) for p in near for q, _ in near[p] if p < q]
    for _ in range(3, 7):
        paths = [(*path, q) for path in paths for q, _ in near[path[-1]] if q > path[0] and q not in path]
        for path in paths:
            if path[1] < path[-1] and (times := sum(q == path[0] for q, _ in near[path[-1]])):
                rings[path] = rings.get(path, 0) + times
    cyclic = {p for path in rings if len(path) > 4 for p in path}
    pi = {i for i, others in near.items() if any(order in DOUBLE and j in cyclic for j, order in others)}
    aromatic: set[int] = set()
    for path, times in rings.items():
        if len(path) > 4:
            have = times * sum(p in pi for p in path if 0 <= p < n)
            lone = times * sum(p not in pi and element(p) in ("N", "O", "S") for p in path)
            if len(path) == 6 == have or len(path) == 5 and have == 4 and lone == 1:
                aromatic.update(path)
    found = {}
    for pos in asked:
        seen, front, texts, codes = {pos}, [pos], [], []
        for _ in range(radius):
            met = [(j, order) for p in front for j, order in near.get(p, ()) if j not in seen]
            texts.append(",".join(sorted(BOND_SIGNS[order] + element(j) for j, order in met if order in BOND_SIGNS and element(j) is not None)))
            front = list(dict.fromkeys(j for j, _ in met))
            seen.update(front)
            codes.append(f"{elements[pos]};{'/'.join(texts)}")
        around = [(element(j), order) for j, order in near.get(pos, ()) if 0 <= j < n]
        triple, double, shared = (sum(order == k for _, order in around) for k in (3, 2, 4))
        state = "sp1" if triple > 0 or double > 1 else "sp2" if double > 0 or shared > 0 else "sp3"
        small = [any(len(path) == k and pos in path for path in rings) for k in (3, 4)]
        found[pos] = codes, (state, *(any(e in names for e, _ in around) for names in KINDS.values()), *small, pos in aromatic)
    return found


def ring_fragments(atoms: DataFrame, bonds: DataFrame, signals: DataFrame, largest: int = 6) -> DataFrame:
    """Rings with their direct neighbours and the known shifts inside."""
    known = signals.where("atom_index IS NOT NULL").select("compound_id", c("atom_index").alias("atom"), "shift_c")
    return _by_size(lambda a, b, k: _ring_fragments_in_lists(a, b, k, largest), lambda a, b, k: _ring_fragments_in_rounds(a, b, k, largest), atoms.select("compound_id", "pos", "element"), bonds, known)


def _ring_fragments_in_lists(atoms: DataFrame, bonds: DataFrame, known: DataFrame, largest: int) -> DataFrame:
    rings = _rings_in_lists(_named_edges(atoms, bonds).join(_known_lists(known), "compound_id").select("compound_id", "edges", "known"), range(3, largest + 1))
    around = F.transform(F.filter("edges", lambda e: F.array_contains("path", e["i"])), lambda e: e["j"])
    rows = rings.select("compound_id", "edges", "known", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("ring"), F.array_distinct(F.concat("path", around)).alias("_inside"))
    return _finished(rows.select("compound_id", "ring", _fragment(c("edges"), c("_inside"), c("known"))), "ring")


def _ring_fragments_in_rounds(atoms: DataFrame, bonds: DataFrame, known: DataFrame, largest: int) -> DataFrame:
    rings = kept(_rings_in_rounds(bonds, range(3, largest + 1)))
    around = rings.join(bonds.select("compound_id", c("i").alias("atom"), "j"), ["compound_id", "atom"]).select("compound_id", "ring", c("j").alias("atom"))
    members = rings.select("compound_id", "ring", "atom").unionByName(around).distinct()
    shifts = members.join(known, ["compound_id", "atom"]).groupBy("compound_id", "ring").agg(F.sort_array(F.collect_list("shift_c")).alias("shifts"))
    return _keyed(members, atoms, bonds, ["ring"]).join(shifts, ["compound_id", "ring"])


def first_fragments(atoms: DataFrame, bonds: DataFrame, signals: DataFrame, radius: int = 3, largest: int = 6) -> DataFrame:
    """(kind, compound_id, place, key, atom_count, shifts): the fragments, atom-centred (``ego``) and rings, that can be the first of their key by compound and place."""
    known = signals.where("atom_index IS NOT NULL").select("compound_id", c("atom_index").alias("atom"), "shift_c")

    def lists(a: DataFrame, b: DataFrame, k: DataFrame) -> DataFrame:
        nodes = a.groupBy("compound_id").agg(F.collect_list(F.struct("pos", "element")).alias("nodes"))
        return fragments_of_lists(nodes.join(_edges(b, "bond_order"), "compound_id").join(_known_lists(k), "compound_id"), radius, largest)

    return _by_size(lists, lambda a, b, k: _fragments_in_rounds(a, b, k, radius, largest), atoms.select("compound_id", "pos", "element"), bonds, known)


def fragments_of_lists(lists: DataFrame, radius: int = 3, largest: int = 6) -> DataFrame:
    """``first_fragments`` of compounds as rows of lists: compound_id, nodes (pos, element), edges (i, j, bond_order, both directions), known (atom, shift_c).

    Compounds of equal atoms and bonds, with signals of the same atoms, have the same
    fragments at the same places, so of these only the one with the smallest id is
    searched.
    """
    whole = kept(lists.select("compound_id", *(F.sort_array(x).alias(x) for x in ("nodes", "edges", "known"))).where((F.size("edges") > 0) & (F.size("known") > 0)), "compounds")
    large = F.size("nodes") + F.size("edges") + F.size("known") > LIST_ROWS
    small = whole.where(~large)
    each = {
        "_pos": F.transform("nodes", lambda n: n["pos"]), "_element": F.transform("nodes", lambda n: n["element"]), "_known": F.transform("known", lambda k: k["atom"]),
        "_bonds": F.flatten(F.transform("edges", lambda e: F.array(e["i"].cast("bigint"), e["j"].cast("bigint"), e["bond_order"].cast("bigint")))),
    }
    alone = small.select("compound_id", *(x.alias(k) for k, x in each.items())).groupBy(*each).agg(F.min("compound_id").alias("compound_id")).select("compound_id")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = small.join(alone, "compound_id", "left_semi").select("compound_id", *(x.alias(k) for k, x in each.items()), F.transform("known", lambda k: k["shift_c"]).alias("_shifts"))
    # few bytes and much work, so their number of parts doesn't follow from their size
    found = first.repartition(parts, "compound_id").mapInArrow(lambda batches: _search(batches, radius, largest), _FRAGMENT)
    huge = whole.where(large)
    if huge.isEmpty():
        return found
    flat = (huge.select("compound_id", F.inline(x)) for x in ("nodes", "edges", "known"))
    return found.unionByName(_fragments_in_rounds(*flat, radius, largest))


_FRAGMENT = "kind string, compound_id bigint, place string, key string, atom_count bigint, shifts array<bigint>"


def _search(batches: Iterator[pa.RecordBatch], radius: int, largest: int) -> Iterator[pa.RecordBatch]:
    """Fragments of compounds, the first by place of each key; sets of atoms are bits of whole numbers."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        ids, *lists = (batch.column(x).to_pylist() for x in ("compound_id", "_pos", "_element", "_bonds", "_known", "_shifts"))
        out = [(kind, id_, *row) for id_, *own in zip(ids, *lists) for kind, row in _fragments_of(*own, radius, largest)]
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[x.split()[0] for x in _FRAGMENT.split(", ")])


def _fragments_of(pos: list, element: list, bonds: list, known: list, shifts: list, radius: int, largest: int) -> Iterator[tuple]:
    """(kind, (place, key, atom_count, shifts)) of one compound: the row-wise twin of ``_keyed``."""
    places = dict.fromkeys([*pos, *(x for k in (0, 1) for x in bonds[k::3])])
    at = {p: k for k, p in enumerate(places)}
    names, places = dict(zip(pos, element)), list(places)
    near: list[list[int]] = [[] for _ in places]
    labels, balls = [], [1 << k for k in range(len(places))]
    for i, j, order in zip(bonds[::3], bonds[1::3], bonds[2::3]):
        near[at[i]].append(at[j])
        x, y = names.get(i), names.get(j)
        if i < j and x is not None and y is not None:
            labels.append(("" if order is None else f"{min(x, y)}{order}{max(x, y)}", 1 << at[i] | 1 << at[j]))
    labels.sort()
    marked = 0
    for p in known:
        marked |= 1 << at[p] if p in at else 0
    centres = [at[p] for p in names if marked >> at[p] & 1]
    found: dict[str, dict[int, str]] = {"ego": {}, "ring": {}}

    def take(kind: str, inside: int, place: str) -> None:
        before = found[kind].get(inside)
        if before is None or place < before:
            found[kind][inside] = place

    around = balls
    for _ in range(radius):
        # what is within a bond more is what the neighbours reach
        around = [reduce(int.__or__, (around[m] for m in near[k]), around[k]) for k in range(len(places))]
        for k in centres:
            take("ego", around[k], str(places[k]))
    paths = [[p, q] for p in range(len(places)) for q in near[p] if places[p] < places[q]]
    for _ in range(3, largest + 1):
        paths = [[*path, q] for path in paths for q in near[path[-1]] if places[q] > places[path[0]] and q not in path]
        for path in paths:
            if places[path[1]] < places[path[-1]] and path[0] in near[path[-1]]:
                inside = reduce(int.__or__, (balls[q] for p in path for q in (p, *near[p])))
                take("ring", inside, ",".join(str(places[p]) for p in path))
    for kind, sets in found.items():
        best: dict[str, tuple[str, int]] = {}
        for inside, place in sets.items():
            within = [label for label, ends in labels if ends & inside == ends]
            if within and inside & marked:
                key = ",".join(x for x in within if x)
                best[key] = min(best.get(key, (place, inside)), (place, inside))
        for key, (place, inside) in best.items():
            own = sorted(s for p, s in zip(known, shifts) if s is not None and p in at and inside >> at[p] & 1)
            yield kind, (place, key, inside.bit_count(), own)


def _of_kinds(egos: DataFrame, rings: DataFrame) -> DataFrame:
    """Fragments of both kinds with their ``place``."""
    rest = ("key", "atom_count", "shifts")
    ego = egos.select(F.lit("ego").alias("kind"), "compound_id", c("pos").cast("string").alias("place"), *rest)
    return ego.unionByName(rings.select(F.lit("ring").alias("kind"), "compound_id", c("ring").alias("place"), *rest))


def _fragments_in_rounds(atoms: DataFrame, bonds: DataFrame, known: DataFrame, radius: int, largest: int) -> DataFrame:
    return _of_kinds(_egos_in_rounds(atoms, bonds, known, radius), _ring_fragments_in_rounds(atoms, bonds, known, largest))


def connected_regions(cells: DataFrame) -> DataFrame:
    """(plane_id, i, j, region_i, region_j) of grid cells that touch, corners included (G5); a region's cell is its first one.

    A plane and its cell are one number, so that one run of connected components
    does for all planes; its digits follow from the largest indices there are.
    """
    most = cells.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.max("plane_id").alias("plane"), F.min(F.least("i", "j", "plane_id")).alias("least")).first()
    width, height = (most["j"] or 0) + 1, (most["i"] or 0) + 1
    if (most["least"] or 0) < 0 or ((most["plane"] or 0) + 1) * width * height >= 1 << 63:
        raise ValueError("plane and cell indices must not be negative, nor too many for 63 bits")
    own = cells.select("plane_id", "i", "j", ((c("plane_id").cast("bigint") * height + c("i")) * width + c("j")).alias("a"))
    near = own.select("a", F.explode(F.array(*(F.struct((c("plane_id")).alias("p"), (c("i") + di).alias("i"), (c("j") + dj).alias("j")) for di, dj in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("n")).select(
        "a", c("n.p").alias("plane_id"), c("n.i").alias("i"), c("n.j").alias("j")
    )
    edges = near.join(own.select("plane_id", "i", "j", c("a").alias("b")), ["plane_id", "i", "j"]).select("a", "b")
    first = F.coalesce("component", "a")
    found = own.join(connected_components(edges), own.a == c("node"), "left")
    return found.select("plane_id", "i", "j", F.call_function("mod", F.call_function("div", first, F.lit(width).cast("bigint")), F.lit(height)).cast("bigint").alias("region_i"), (first % F.lit(width)).alias("region_j"))


def hetero_pairs(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Distinct sorted element pairs of bonds between atoms that are neither carbon nor hydrogen."""
    hetero = atoms.where(~c("element").isin("C", "H")).select("compound_id", "pos", "element")
    x = hetero.select("compound_id", c("pos").alias("i"), c("element").alias("_x"))
    y = hetero.select("compound_id", c("pos").alias("j"), c("element").alias("_y"))
    return bonds.where("i < j").join(x, ["compound_id", "i"]).join(y, ["compound_id", "j"]).select("compound_id", F.least("_x", "_y").alias("element1"), F.greatest("_x", "_y").alias("element2")).distinct()
