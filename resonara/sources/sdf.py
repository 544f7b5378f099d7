"""SD-file source: records, signals, atoms and bonds of V2000 blocks.

Files are read as text with the record separator as line separator, so that Spark
splits large files between tasks by byte ranges; everything else is column
expressions.  Line ends may be LF or CRLF, in one folder or file.  Each record has
its own flavour: ``measured`` if it has MEASURED_FIELD, whose atoms count from 0,
or ``predicted`` if it has PREDICTED_FIELD, whose atoms count from 1; of both, the
predicted one.  Any line that begins with four dollar signs ends a record.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions.formula import count_carbons, formula_from_inchi
from resonara.functions.parsing import measured_signals, multiplicity_map, predicted_signals

c = F.col

SEPARATOR = "$$$$\n"
#: What ends a record whatever the line ends are; the rest of the separator's line stays with the record after it.
SPLIT = "\n$$$$"
MEASURED_FIELD, PREDICTED_FIELD = "Spectrum 13C 0", "CNMR_SHIFTS"


def sdf_property(record: Column, name: str) -> Column:
    """Value of a property, over all its lines up to the next blank one; null if the record lacks it."""
    found = F.regexp_extract(record, rf"(?i)>\s*<{name}>[^\n]*\n((?:[^\n]+\n?)*)", 1)
    # only an empty value needs the second search
    return F.when(found != "", F.rtrim(F.rtrim(found, F.lit("\n")))).when(F.rlike(record, F.lit(rf"(?i)>\s*<{name}>")), "")


def clean_record(record: Column) -> Column:
    """A record between two separators, with LF and from its name line on."""
    lines = F.regexp_replace(record, r"\r\n|\r$", "\n")
    # counts stand on the fourth line; names may be empty, so only that tells what is left of a separator
    whole = F.regexp_extract(lines, r"(?s)\A(?:(?:\$\$\$\$)?[^\S\n]*\n)?((?:[^\n]*\n){3}(?:[ \d]{5}\d|[^\n]*V[23]000).*)", 1)
    return F.when(whole != "", whole).otherwise(F.regexp_replace(lines, r"\A(?:\$\$\$\$)?[^\S\n]*\n", ""))


def raw_records(read, path: str) -> DataFrame:
    """(record) of all SD files at ``path`` by a text reader, batch or streaming."""
    # a generator's column, so that what filters records doesn't clean them again
    return _between(read, path).select(F.explode(F.array(clean_record(c("value")))).alias("record"))


def _between(read, path: str) -> DataFrame:
    """(value) between two separators, blank ones left out."""
    return read.format("text").option("lineSep", SPLIT).load(path).where(F.rlike("value", F.lit(r"\S")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of all SD files at ``path``."""
    return raw_records(spark.read, path)


def record_flavour(record: Column) -> Column:
    """``measured``, ``predicted`` or null by a record's property names."""
    return F.when(F.contains(record, F.lit(f"<{PREDICTED_FIELD}>")), "predicted").when(F.contains(record, F.lit(f"<{MEASURED_FIELD}>")), "measured")


def sdf_flavours(spark: SparkSession, path: str) -> DataFrame:
    """(flavour, records) of all SD files at ``path``; records without a spectrum have none."""
    # property names are the same before a record is cleaned
    return _between(spark.read, path).groupBy(record_flavour(c("value")).alias("flavour")).agg(F.count("*").alias("records"))


def folder_flavour(counted: Iterable[str | None]) -> str | None:
    """``measured``, ``predicted``, ``mixed`` or None, by the flavours that records have."""
    found = [x for x in counted if x]
    return "mixed" if len(found) > 1 else found[0] if found else None


def detect_sdf_flavour(spark: SparkSession, path: str) -> str | None:
    """``measured``, ``predicted``, ``mixed`` or None, by all records."""
    return folder_flavour(r.flavour for r in sdf_flavours(spark, path).collect())  # three rows at most


def parse_sdf(df: DataFrame, flavour: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Compounds with nested signals of raw records (S1, S2); of one flavour, or each by its own.

    Records without a spectrum, or of the other flavour, are dropped.  Columns:
    those of ``keep``, name, formula, inchi, inchi_key, carbon_count, signals
    (shift, h_count, atom_index; 0-based in both flavours).
    """
    if flavour not in (None, "measured", "predicted"):
        raise ValueError(f"unknown flavour {flavour!r}")
    # the cheap test of the field comes before anything is parsed
    asked = df.select(*keep, "record", record_flavour(c("record")).alias("_flavour")).where(c("_flavour").isNotNull() if flavour is None else c("_flavour") == flavour)
    inchi = F.coalesce(sdf_property(c("record"), "InChI"), F.lit(""))
    common = asked.select(*keep, "record", "_flavour", F.trim(F.substring_index("record", "\n", 1)).alias("name"), inchi.alias("inchi"), F.coalesce(sdf_property(c("record"), "InChI key"), F.lit("")).alias("inchi_key"))
    formula = sdf_property(c("record"), "Formula")
    measured = F.transform(measured_signals(sdf_property(c("record"), MEASURED_FIELD)), lambda s: F.struct(s["shift"], s["h_count"], s["atom_index"]))
    hydrogens = multiplicity_map(*(sdf_property(c("record"), f) for f in ("Quaternaries", "Tertiaries", "Secondaries", "Primaries")))
    # one element that holds both, so that the map is made once a record and not once a signal
    both = F.array(F.struct(hydrogens.alias("h"), predicted_signals(sdf_property(c("record"), PREDICTED_FIELD)).alias("s")))
    counted = lambda b: F.transform(b["s"], lambda s: F.struct(s["shift"], F.try_element_at(b["h"], s["atom_index"] + 1).cast("bigint").alias("h_count"), s["atom_index"]))
    predicted = F.get(F.transform(both, counted), F.lit(0))
    is_measured = c("_flavour") == "measured"
    signals = {"measured": measured, "predicted": predicted, None: F.when(is_measured, measured).otherwise(predicted)}[flavour]
    rows = common.withColumn("formula", F.when(is_measured, F.coalesce(formula_from_inchi(c("inchi")), formula)).otherwise(formula))
    # a generator's column, so that no filter on it, here or in a caller, takes the record apart again
    made = rows.select(*keep, "name", "formula", "inchi", "inchi_key", F.explode(F.array(signals)).alias("signals")).where(F.size("signals") > 0)
    return made.select(*keep, "name", "formula", "inchi", "inchi_key", count_carbons(F.coalesce("formula", F.lit(""))).alias("carbon_count"), "signals")


def read_sdf(spark: SparkSession, path: str, flavour: str | None = None) -> DataFrame:
    """Compounds of SD files, each by its record's flavour, or those of one flavour."""
    return parse_sdf(records(spark, path), flavour)


def _block(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    lines = F.split("record", "\n")
    counts = F.get(lines, F.lit(3))
    return df.select(
        *keep, F.trim(F.substring_index("record", "\n", 1)).alias("name"), lines.alias("_lines"),
        F.trim(F.substring(counts, 1, 3)).try_cast("int").alias("_atoms"), F.trim(F.substring(counts, 4, 3)).try_cast("int").alias("_bonds"),
    ).where("_atoms IS NOT NULL AND _bonds IS NOT NULL")


def sdf_atoms(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(columns of ``keep``, name, pos, element, x, y, z) of the atom block, by the fixed columns of V2000 (S3)."""
    rows = _block(df, keep).select(*keep, "name", F.posexplode(F.slice("_lines", F.lit(5), c("_atoms"))).alias("pos", "line"))
    at = lambda start, n: F.trim(F.substring("line", start, n))
    return rows.select(*keep, "name", c("pos").cast("bigint").alias("pos"), at(32, 3).alias("element"), *(at(s, 10).try_cast("double").alias(a) for a, s in (("x", 1), ("y", 11), ("z", 21))))


def sdf_bonds(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(columns of ``keep``, name, i, j, bond_order) of the bond block, 0-based atoms (S3)."""
    rows = _block(df, keep).select(*keep, "name", F.explode(F.slice("_lines", c("_atoms") + 5, c("_bonds"))).alias("line"))
    at = lambda start: F.trim(F.substring("line", start, 3)).try_cast("bigint")
    return rows.select(*keep, "name", (at(1) - 1).alias("i"), (at(4) - 1).alias("j"), at(7).alias("bond_order"))


def sdf_structures(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(columns of ``keep``, elements, bonds) of each record that has both blocks: ``sdf_atoms`` and ``sdf_bonds`` as lists; of bonds i, j and order after each other."""
    rows = _block(df, keep)
    at = lambda line, start: F.trim(F.substring(line, start, 3))
    bond = lambda line: F.array(at(line, 1).try_cast("bigint") - 1, at(line, 4).try_cast("bigint") - 1, at(line, 7).try_cast("bigint"))
    atoms = F.transform(F.slice("_lines", F.lit(5), c("_atoms")), lambda line: at(line, 32))
    return rows.select(*keep, atoms.alias("elements"), F.flatten(F.transform(F.slice("_lines", c("_atoms") + 5, c("_bonds")), bond)).alias("bonds"))


def write_sdf(df: DataFrame, path: str, end: str = "\n") -> None:
    """Write rows (name, atoms, bonds, properties) as SD files with LF or other line ends.

    ``atoms``: array of element; ``bonds``: array of (i, j, bond_order), 0-based;
    ``properties``: map.
    """
    number = lambda x: F.lpad(x.cast("string"), 3, " ")
    zero = "    0.0000"
    atom_lines = F.transform("atoms", lambda a: F.concat(F.lit(zero * 3 + " "), F.rpad(a, 3, " "), F.lit(" 0  0")))
    bond_lines = F.transform("bonds", lambda b: F.concat(number(b["i"] + 1), number(b["j"] + 1), number(b["bond_order"]), F.lit("  0")))
    head = F.concat(c("name"), F.lit("\n\n\n"), number(F.size("atoms")), number(F.size("bonds")), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    props = F.transform(F.map_entries("properties"), lambda p: F.concat(F.lit("> <"), p["key"], F.lit(">\n"), p["value"], F.lit("\n")))
    text = F.concat(head, F.lit("\n"), F.array_join(F.concat(atom_lines, bond_lines, F.array(F.lit("M  END")), props), "\n"), F.lit("\n"))
    whole = text if end == "\n" else F.replace(text, F.lit("\n"), F.lit(end))
    df.select(whole.alias("value")).write.mode("overwrite").text(path, lineSep=SEPARATOR.replace("\n", end))
