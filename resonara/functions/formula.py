"""Columns over molecular formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUBSCRIPTS, _DIGITS = "₀₁₂₃₄₅₆₇₈₉", "0123456789"


def normalize_formula(formula: Column) -> Column:
    """Subscript digits as ASCII digits, no blanks."""
    return F.replace(F.translate(formula, _SUBSCRIPTS, _DIGITS), F.lit(" "), F.lit(""))


def count_carbons(formula: Column) -> Column:
    """Carbons of a formula: a C that starts no other element; a bare C is one."""
    found = F.regexp_extract(formula, r"(C(?![laroudsefgmnptb])\d*)", 1)
    digits = F.substring(found, 2, 10)
    return F.when(found == "", 0).when(digits == "", 1).otherwise(F.expr("0") + digits.try_cast("int")).cast("bigint")


def formula_parts(formula: Column) -> Column:
    """Array of (element, n), one for each mention in a formula."""
    elements = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d*)"), 1)
    counts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d*)"), 2)
    return F.transform(
        F.arrays_zip(elements.alias("e"), counts.alias("k")),
        lambda p: F.struct(p["e"].alias("element"), F.when(p["k"] == "", 1).otherwise(p["k"].try_cast("bigint")).cast("bigint").alias("n")),
    )


def parse_formula(formula: Column) -> Column:
    """MAP element -> count; repeated elements add up."""
    parts = formula_parts(formula)
    elements = F.array_distinct(F.transform(parts, lambda p: p["element"]))
    return F.map_from_entries(F.transform(elements, lambda e: F.struct(e, element_count(formula, e))))


def element_count(formula: Column, element: Column | str) -> Column:
    """Atoms of one element in a formula."""
    wanted = F.lit(element) if isinstance(element, str) else element
    return F.aggregate(formula_parts(formula), F.lit(0).cast("bigint"), lambda acc, p: acc + F.when(p["element"] == wanted, p["n"]).otherwise(0))


def formula_from_inchi(inchi: Column) -> Column:
    """Second layer of an InChI, if it starts like a formula."""
    second = F.get(F.split(inchi, "/"), F.lit(1))
    return F.when(F.startswith(inchi, F.lit("InChI=")) & F.rlike(second, F.lit("^[A-Z]")), second)


def dbe(formula: Column) -> Column:
    """Degree of unsaturation, (2C + 2 + N - H - X) / 2 (P5)."""
    n = lambda *es: sum((element_count(formula, e) for e in es[1:]), element_count(formula, es[0]))
    return (2 * n("C") + 2 + n("N") - n("H") - n("F", "Cl", "Br", "I")).cast("double") / F.lit(2.0)
