"""Columns that parse the text fields of spectra, reports and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler words of chemical names: fixed values.
FILLERS = ["dye", "the", "a", "an", "of"]
#: Correlation types by name; HMQC counts as HSQC: fixed values.
CORRELATION_TYPES = {"HMBC": "HMBC", "HSQC": "HSQC", "HMQC": "HSQC", "COSY": "COSY", "NOESY": "NOESY", "ROESY": "ROESY"}


def _part(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def measured_signals(field: Column) -> Column:
    """Signals (shift, h_count, atom_index) of ``shift;mult;atom|...``; S, D, T, Q carry 0 to 3 hydrogens."""

    # each step binds what the next one uses several times, so that a signal is split and searched once
    parts = F.transform(F.split(F.trim(field), r"\|"), lambda p: F.split(F.trim(p), ";"))
    read = F.transform(parts, lambda p: F.struct(F.trim(_part(p, 0)).try_cast("double").alias("shift"), F.regexp_extract(F.upper(F.coalesce(_part(p, 1), F.lit(""))), "([SDTQ])$", 1).alias("letter"), F.trim(_part(p, 2)).try_cast("bigint").alias("atom_index")))
    hydrogens = lambda letter: F.when(letter != "", F.instr(F.lit("SDTQ"), letter) - 1).cast("bigint")
    return F.transform(F.filter(read, lambda s: s["shift"].isNotNull()), lambda s: F.struct(s["shift"].alias("shift"), hydrogens(s["letter"]).alias("h_count"), s["atom_index"].alias("atom_index")))


def predicted_signals(field: Column, base: int = 1) -> Column:
    """Signals (shift, atom_index) of ``sig:atom|shift;...``; atom indices of ``base`` become 0-based."""

    def signal(text: Column) -> Column:
        halves = F.split(text, r"\|")
        atom = F.trim(_part(F.split(_part(halves, 0), ":"), 1)).try_cast("bigint")
        return F.struct(
            F.when(F.size(halves) == 2, F.trim(_part(halves, 1)).try_cast("double")).alias("shift"),
            (atom - base).alias("atom_index"),
        )

    return F.filter(F.transform(F.split(F.trim(field), ";"), lambda p: signal(F.trim(p))), lambda s: s["shift"].isNotNull())


def multiplicity_map(quaternaries: Column, tertiaries: Column, secondaries: Column, primaries: Column) -> Column:
    """MAP atom -> hydrogens (0 to 3) from four fields of ``atom<TAB>shift`` lines; later fields win."""

    def entries(field: Column, hydrogens: int) -> Column:
        atoms = F.transform(F.split(F.coalesce(field, F.lit("")), "\n"), lambda line: F.trim(_part(F.split(F.trim(line), "\t"), 0)).try_cast("bigint"))
        return F.transform(F.filter(atoms, lambda a: a.isNotNull()), lambda a: F.struct(a.alias("atom"), F.lit(hydrogens).alias("h")))

    def largest(every: Column) -> Column:
        atoms = F.array_distinct(F.transform(every, lambda e: e["atom"]))
        # fields come in order of hydrogens, so the last one is the largest
        return F.map_from_entries(F.transform(atoms, lambda a: F.struct(a, F.array_max(F.transform(F.filter(every, lambda e: e["atom"] == a), lambda e: e["h"])))))

    every = F.concat(*(entries(f, h) for h, f in enumerate((quaternaries, tertiaries, secondaries, primaries))))
    # bound as a variable: the fields are taken apart once and not once an atom
    return F.get(F.transform(F.array(every), largest), F.lit(0))


def sphere1_elements(code: Column) -> Column:
    """MAP element -> count of the first sphere of an environment code ``PREFIX;SPHERE1(...)``."""
    rest = F.when(F.contains(code, F.lit(";")), F.substring_index(F.substr(code, F.instr(code, ";") + 1), "(", 1)).otherwise("")
    elements = F.regexp_extract_all(rest, F.lit("[A-Z][a-z]?"), 0)
    return F.map_from_entries(F.transform(F.array_distinct(elements), lambda e: F.struct(e, F.size(F.filter(elements, lambda x: x == e)).cast("bigint"))))


def is_accession(name: Column) -> Column:
    """Whether a name is a database accession such as CNP0220816.1."""
    return F.rlike(F.trim(name), F.lit(r"(?i)^CNP\d+(\.\d+)?$"))


def name_token_sets(name: Column) -> Column:
    """One array of tokens for each ``;``-separated synonym that is no accession."""

    def tokens(synonym: Column) -> Column:
        clean = F.regexp_replace(F.lower(synonym), r"[,()'\-–—.]", " ")
        return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda t: (t != "") & ~t.isin(FILLERS)))

    synonyms = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: (s != "") & ~is_accession(s))
    return F.filter(F.transform(synonyms, tokens), lambda t: F.size(t) > 0)


def name_matches(reported: Column, derived: Column) -> Column:
    """Whether all tokens of the reported name are in one synonym of the derived name."""
    wanted = F.array_distinct(F.flatten(name_token_sets(reported)))
    return (F.size(wanted) > 0) & F.exists(name_token_sets(derived), lambda s: F.size(F.array_except(wanted, s)) == 0)


def project_id(identifier: Column) -> Column:
    """(project, study, error) of a DOI, a URL or a project id."""
    text = F.trim(identifier)
    doi, url = r"(?i)^(?:https?://doi\.org/)?10\.57992/NMRXIV\.P(\d+)(?:\.S(\d+))?", r"(?i)^https?://(?:www\.)?nmrxiv\.org/P(\d+)(?:/S(\d+))?"
    nonempty = lambda c: F.when(c != "", c)
    first = lambda group: F.coalesce(nonempty(F.regexp_extract(text, doi, group)), nonempty(F.regexp_extract(text, url, group)))
    direct = nonempty(F.regexp_extract(text, r"(?i)^P(\d+)$", 1))
    project = F.coalesce(first(1), direct)
    return F.struct(
        F.concat(F.lit("P"), project).alias("project"),
        F.concat(F.lit("S"), F.when(first(1).isNotNull(), first(2))).alias("study"),
        F.when(project.isNull(), F.when(F.rlike(text, F.lit(r"(?i)^S\d+$")), "study needs a project").otherwise("unrecognized")).alias("error"),
    )


def condense_experiments(text: Column) -> Column:
    """``10:1d-1H;11:cosy`` as an ordered list of distinct labels, ``1H, COSY``."""

    def label(part: Column) -> Column:
        token = F.regexp_replace(F.trim(F.when(F.contains(part, F.lit(":")), F.substr(part, F.instr(part, ":") + 1)).otherwise(part)), "^1d-", "")
        return F.when(F.lower(token) == "1h", "1H").when(F.lower(token) == "13c", "13C").otherwise(F.upper(token))

    labels = F.array_distinct(F.filter(F.transform(F.split(text, ";"), label), lambda t: t != ""))
    empty = text.isNull() | F.trim(text).isin("-", "")
    return F.when(empty | (F.size(labels) == 0), "—").otherwise(F.array_join(labels, ", "))


def key_prefix(key: Column) -> Column:
    """First block of a hashed identity."""
    return F.substring_index(F.coalesce(key, F.lit("")), "-", 1)


def solver_summary(text: Column) -> Column:
    """(solutions, seconds, status) of a solver's text output."""
    low = F.lower(text)
    count = F.coalesce(F.regexp_extract(low, r"(\d+)\s+solution", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(
        count.alias("solutions"),
        F.regexp_extract(low, r"(\d+\.?\d*)\s*(?:sec|second|ms)", 1).try_cast("double").alias("seconds"),
        F.when(F.contains(low, F.lit("error")), "error").when(F.contains(low, F.lit("no solution")), "no_solution").when(count > 0, "success").otherwise("unknown").alias("status"),
    )


def page_hz(page: Column) -> Column:
    """Frequency of a page label ``F1=<hz>``; null if malformed."""
    return F.when(F.contains(page, F.lit("=")), F.trim(F.substr(page, F.instr(page, "=") + 1)).try_cast("double"))


def shift_list(text: Column) -> Column:
    """MAP index -> shift of a JSON object or a comma-separated list; empty if malformed."""
    listed = F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")
    values = F.transform(listed, lambda v: v.try_cast("double"))
    from_list = F.when(~F.exists(values, lambda v: v.isNull()), F.map_from_entries(F.transform(values, lambda v, i: F.struct(i.cast("bigint"), v))))
    loaded = F.from_json(text, "map<string,double>")
    keys = F.transform(F.map_keys(loaded), lambda k: k.try_cast("bigint"))
    from_object = F.when(~F.exists(keys, lambda k: k.isNull()), F.map_from_arrays(keys, F.map_values(loaded)))
    empty = F.create_map().cast("map<bigint,double>")
    return F.coalesce(F.when(F.startswith(F.trim(text), F.lit("{")), from_object).otherwise(from_list), empty)


def correlation(text: Column) -> Column:
    """(kind, source, target, error) of ``TYPE:source:target``."""
    parts = F.split(text, ":")
    kinds = F.create_map(*(F.lit(x) for kv in CORRELATION_TYPES.items() for x in kv))
    kind, source, target = kinds[F.upper(_part(parts, 0))], _part(parts, 1).try_cast("bigint"), _part(parts, 2).try_cast("bigint")
    error = F.when(F.size(parts) != 3, "format").when(kind.isNull(), "type").when(source.isNull() | target.isNull(), "index")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(kind).alias("kind"), good(source).alias("source"), good(target).alias("target"), error.alias("error"))


def constraint_line(kind: str, *values: Column) -> Column:
    """Text of a FORM comment, an ELIM or a SHIH line."""
    if kind == "FORM":
        return F.concat(F.lit("; FORM "), values[0])
    if kind == "SHIH":
        return F.format_string("SHIH %d %.2f", values[0], values[1])
    return F.concat_ws(" ", F.lit(kind), *(v.cast("string") for v in values))
