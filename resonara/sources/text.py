"""Text and JSON sources and sinks.

Readers take a path; each has a ``parse_`` twin over documents (path, content),
which is where the work is, as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonara.plans.scratch import kept

c = F.col

#: Experiments by keyword of a file name, and the marks around inventories: fixed values.
KEYWORDS = {"hsqc": "HSQC", "hmbc": "HMBC", "cosy": "COSY"}
INVENTORY_START, INVENTORY_END, INVENTORY_V1 = "=== CONSTRAINT INVENTORY v2 ===", "=== END CONSTRAINT INVENTORY ===", "=== CONSTRAINT INVENTORY v1 ==="
#: Characters of the notation: letters, digits, brackets, bonds, charges, stereo marks and the dot; fixed values.
SMILES = r"^[A-Za-z0-9@\[\]\(\)=#\-\+\\/\.]+$"


def documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of whole files."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.option("recursiveFileLookup", "true").text(path, wholetext=True).select(c("_metadata.file_path").alias("path"), c("value").alias("content"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


# -- sources -----------------------------------------------------------------------------------


FORMULA_JSON = "map<string,array<struct<smiles:string,source:string,id:string,signals:array<array<double>>>>>"


def parse_formula_json(docs: DataFrame) -> DataFrame:
    """Entries of formula-indexed JSON: formula, source, source_id, smiles, signals (shift, h_count)."""
    entries = docs.select(F.explode(F.from_json("content", FORMULA_JSON)).alias("formula", "entries")).select("formula", F.explode("entries").alias("e"))
    signals = F.transform(F.coalesce("e.signals", F.array().cast("array<array<double>>")), lambda s: F.struct(s[0].alias("shift"), F.get(s, F.lit(1)).cast("bigint").alias("h_count")))
    return entries.select("formula", F.coalesce("e.source", F.lit("unknown")).alias("source"), F.coalesce("e.id", F.lit("")).alias("source_id"), F.coalesce("e.smiles", F.lit("")).alias("smiles"), signals.alias("signals"))


def read_formula_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_formula_json(documents(spark, path))


def parse_params(docs: DataFrame, required: list[str]) -> DataFrame:
    """Parameters of ``##$KEY= value`` files as a MAP per experiment folder, with required keys that are missing."""
    texts = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("line_no"))), lambda x: F.rlike(x["line"], F.lit(r"^##\$?[^=]+=")))
    key = lambda x: F.regexp_extract(x["line"], r"^##\$?([^=]+?)\s*=", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x["line"], r"^##\$?[^=]+=(.*)$", 1)), "^<(.*)>$", "$1")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    # a row a file, not a line, is moved and sorted; of a file's lines with one key the last counts
    read = docs.select(folder.alias("folder"), file_name(c("path")).alias("file"), F.transform(texts, lambda x: F.struct(key(x).alias("key"), x["line_no"].alias("line_no"), value(x).alias("value"))).alias("lines"))
    files = read.where(F.size("lines") > 0).groupBy("folder").agg(F.collect_list(F.struct("file", "lines")).alias("files"))
    every = F.flatten(F.transform("files", lambda f: F.transform(f["lines"], lambda x: F.struct(f["file"].alias("file"), x["key"].alias("key"), x["line_no"].alias("line_no"), x["value"].alias("value")))))
    follows = lambda x, y: x["file"].eqNullSafe(y["file"]) & x["key"].eqNullSafe(y["key"])
    last = F.filter("every", lambda x, i: ~follows(F.get("every", i + 1), x))
    maps = files.select("folder", F.array_sort(every).alias("every")).select("folder", F.map_from_entries(F.transform(last, lambda x: F.struct(F.concat_ws(".", x["file"], x["key"]), x["value"]))).alias("params"))
    return maps.withColumn("missing", F.filter(F.array(*map(F.lit, required)), lambda k: ~F.map_contains_key("params", k)))


def read_params(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    return parse_params(documents(spark, root), required)


PEAK_JSON = (
    "peaks array<struct<ppm:double,intensity:double,snr:double>>, cross_peaks array<struct<c13_ppm:double,h1_ppm:double,h1a_ppm:double,h1b_ppm:double,multiplicity_hint:string>>"
)


def parse_peaklists(docs: DataFrame) -> DataFrame:
    """Peak-list files: path, experiment by file name, peaks and an error for corrupt or incomplete 2D files.

    1D files that can't be read are skipped; for 2D ones the error says why.
    """
    low = F.lower(file_name(c("path")))
    experiment = F.coalesce(*(F.when(F.contains(low, F.lit(k)), v) for k, v in KEYWORDS.items()))
    one_d = F.when(F.contains(low, F.lit("13c")), "13C").when(F.contains(low, F.lit("1h")), "1H").when(F.contains(low, F.lit("dept")), "DEPT")
    loaded = docs.select("path", F.coalesce(experiment, one_d).alias("experiment"), experiment.isNotNull().alias("is_2d"), F.from_json("content", PEAK_JSON + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    corrupt = c("j._corrupt").isNotNull() | c("j").isNull()
    error = F.when(c("is_2d") & corrupt, "corrupt").when(c("is_2d") & c("j.cross_peaks").isNull(), "missing cross_peaks")
    return loaded.where(c("experiment").isNotNull() & (c("is_2d") | ~corrupt)).select("path", "experiment", "is_2d", c("j.peaks").alias("peaks"), c("j.cross_peaks").alias("cross_peaks"), error.alias("error"))


def read_peaklists(spark: SparkSession, folder: str) -> DataFrame:
    return parse_peaklists(documents(spark, folder, "*.json"))


def parse_smiles(docs: DataFrame) -> DataFrame:
    """(path, index, smiles) of candidate lists: comments, blanks and other text skipped, numbered from 1."""
    good = _lines(docs).where(F.rlike("line", F.lit(SMILES)) & ~F.rlike("line", F.lit("^[#;]")))
    return good.select("path", F.row_number().over(W.partitionBy("path").orderBy("line_no")).cast("bigint").alias("index"), c("line").alias("smiles"))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    return parse_smiles(documents(spark, path))


def parse_solutions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of the OUTLSD section of solution files.

    atoms: path, solution, atom (from 1), element, h_count; bonds: path, solution,
    atom, neighbour, bond_order, in both directions as written.
    """
    # a document is a row, and its solutions are cut out of it: nothing is sorted or shuffled
    header = lambda x: F.rlike(x, F.lit(r"^\d+\s+\d+$"))
    lines = docs.select("path", F.explode(F.array(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)))).alias("_all"))
    after = lines.where(F.array_contains("_all", "OUTLSD")).select("path", F.explode(F.array(F.slice("_all", F.array_position("_all", "OUTLSD") + 1, F.size("_all")))).alias("_open"))
    end = F.array_position("_open", "0")
    open_ = after.select("path", F.explode(F.array(F.when(end > 0, F.slice("_open", F.lit(1), end.cast("int") - 1)).otherwise(c("_open")))).alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(header(x), F.struct((i + 1).alias("at"), F.regexp_extract(x, r"(\d+)$", 1).try_cast("bigint").alias("n")))), lambda h: h.isNotNull())
    segments = open_.select("path", "_lines", F.explode(F.array(heads)).alias("_heads")).select("path", "_lines", "_heads", F.posexplode("_heads").alias("_k", "_head"))
    until = F.coalesce(F.get("_heads", c("_k") + 1)["at"], F.size("_lines") + 1)
    # a number that is none carries on the one before
    number = F.coalesce("_head.n", F.get(F.reverse(F.filter(F.slice("_heads", F.lit(1), c("_k")), lambda h: h["n"].isNotNull())), F.lit(0))["n"])
    kept_lines = F.filter(F.slice("_lines", c("_head.at") + 1, until - c("_head.at") - 1), lambda x: F.rlike(x, F.lit(r"^1\s+[A-Z]")))
    rows = segments.select("path", number.alias("_solution"), F.posexplode(kept_lines).alias("_at", "line")).select("path", "_solution", (c("_at") + 1).cast("bigint").alias("_n"), F.split("line", r"\s+").alias("p")).where(F.size("p") >= 8)
    atoms = rows.select("path", c("_solution").alias("solution"), c("_n").alias("atom"), c("p")[1].alias("element"), c("p")[3].try_cast("bigint").alias("h_count"))
    pairs = F.transform(F.sequence(F.lit(7), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.get("p", i).try_cast("bigint").alias("neighbour"), F.get("p", i + 1).try_cast("bigint").alias("bond_order")))
    bonds = rows.where(F.size("p") >= 9).select("path", c("_solution").alias("solution"), c("_n").alias("atom"), F.inline(pairs)).where("neighbour > 0")
    return atoms, bonds


def read_solutions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_solutions(documents(spark, path))


def parse_constraints(docs: DataFrame) -> DataFrame:
    """(path, line_no, kind, atom1, atom2, element, hybridisation, h_count, charge, shift, min_bonds, max_bonds) of constraint text; bad lines are skipped."""
    lines = _lines(docs).where(~F.startswith("line", F.lit(";")) & (c("line") != "")).withColumn("p", F.split("line", r"\s+")).withColumn("kind", F.upper(c("p")[0]))
    number = lambda i: F.get("p", F.lit(i)).try_cast("bigint")
    pair = c("kind").isin("HSQC", "HMQC", "HMBC", "COSY") & number(1).isNotNull() & number(2).isNotNull()
    charge = F.when(F.size("p") > 5, number(5)).otherwise(0)
    mult = (c("kind") == "MULT") & (F.size("p") >= 5) & number(1).isNotNull() & number(3).isNotNull() & number(4).isNotNull() & charge.isNotNull()
    shix = (c("kind") == "SHIX") & number(1).isNotNull() & F.get("p", F.lit(2)).try_cast("double").isNotNull()
    return lines.where(pair | mult | shix).select(
        "path", "line_no", F.when(c("kind") == "HMQC", "HSQC").otherwise(c("kind")).alias("kind"), number(1).alias("atom1"), F.when(pair, number(2)).alias("atom2"),
        F.when(mult, c("p")[2]).alias("element"), F.when(mult, F.when(number(3) == 1, "sp").when(number(3) == 2, "sp2").otherwise("sp3")).alias("hybridisation"), F.when(mult, number(4)).alias("h_count"), F.when(mult, charge).alias("charge"),
        F.when(shix, F.get("p", F.lit(2)).try_cast("double")).alias("shift"), F.when(c("kind") == "HMBC", number(3)).alias("min_bonds"), F.when(c("kind") == "HMBC", number(4)).alias("max_bonds"),
    )


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    return parse_constraints(documents(spark, path))


INVENTORY = (
    "version bigint, iteration bigint, formula string, timestamp string, mult_count bigint, hsqc_count bigint, hmbc_total bigint, hmbc_batches array<struct<batch:bigint,count:bigint,correlations:array<string>>>, pylsd_mode boolean, "
    "elim_annotated boolean, elim_value bigint, elim_budget bigint, deferred_4j array<struct<atom1:bigint,atom2:bigint,shift1:double,shift2:double,correlation_type:string,annotation:string>>"
)
REQUIRED = ["version", "iteration", "formula", "timestamp", "mult_count", "hsqc_count", "hmbc_batches", "hmbc_total"]


def parse_inventory(docs: DataFrame) -> DataFrame:
    """(path, state, inventory) of commented JSON blocks: ok, absent, malformed, legacy or bad_json."""
    quoted = lambda s: "\\Q" + s + "\\E"
    block = F.regexp_extract("content", rf"(?s){quoted(INVENTORY_START)}[^\n]*\n(.*?)\n[^\n]*{quoted(INVENTORY_END)}", 1)
    text = F.array_join(F.transform(F.filter(F.split(block, "\n"), lambda x: F.startswith(x, F.lit("; ")) | (x == ";")), lambda x: F.substr(x, F.lit(3))), "\n")
    has = lambda s: F.contains("content", F.lit(s))
    loaded = docs.withColumns({"_text": text, "inventory": F.from_json(text, INVENTORY + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})})
    state = F.when(has(INVENTORY_V1), "legacy").when(F.trim("_text") != "", F.when(c("inventory._corrupt").isNotNull(), "bad_json").otherwise("ok")).when(has(INVENTORY_START), "malformed").otherwise("absent")
    return loaded.select("path", state.alias("state"), F.when(state == "ok", c("inventory")).alias("inventory"), F.when(state == "ok", c("_text")).alias("text"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return parse_inventory(documents(spark, path))


def validate_inventory(inventories: DataFrame) -> DataFrame:
    """(path, errors): missing keys, minimums and the two invariants of each inventory (F8)."""
    i = lambda name: c(f"inventory.{name}")
    rules = {f"missing {k}": i(k).isNull() for k in REQUIRED}
    rules |= {"version": i("version") != 2, "iteration": i("iteration") < 1, "mult_count": i("mult_count") < 0, "hsqc_count": i("hsqc_count") < 0, "hmbc_total": i("hmbc_total") < 0, "elim_budget": i("elim_budget") < 0}
    rules["batch"] = F.exists(i("hmbc_batches"), lambda b: b["batch"].isNull() | b["count"].isNull() | b["correlations"].isNull() | (b["batch"] < 1))
    rules["deferred_4j"] = F.exists(i("deferred_4j"), lambda d: d["atom1"].isNull() | d["atom2"].isNull() | (d["atom1"] < 1) | (d["atom2"] < 1) | (d["correlation_type"] != "HMBC") | (d["annotation"] != "; ELIM"))
    rules["bare ELIM in permutation mode"] = i("pylsd_mode") & i("elim_value").isNotNull()
    annotated = F.coalesce(i("elim_annotated"), F.lit(False))
    rules["annotations without permutation mode"] = annotated & (~F.coalesce(i("pylsd_mode"), F.lit(False)) | (F.coalesce(F.size(i("deferred_4j")), F.lit(0)) < 1))
    errors = F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items())))
    return inventories.where("state = 'ok'").select("path", errors.alias("errors"))


PROJECT = (
    "name string, title string, description string, doi string, owner struct<username:string,name:string>, "
    "studies array<struct<identifier:string,id:string,name:string,description:string,datasets:array<struct<identifier:string,id:string,name:string,type:string>>>>"
)


def flatten_projects(df: DataFrame) -> DataFrame:
    """(project_id, project, owner, study_id, study, dataset_id, dataset, type) of metadata JSON, a row a dataset."""
    p = df.select("project_id", F.from_json("content", PROJECT).alias("p"))
    studies = p.select("project_id", F.coalesce("p.name", "p.title", F.lit("")).alias("project"), F.coalesce("p.owner.username", "p.owner.name", F.lit("")).alias("owner"), F.explode_outer("p.studies").alias("s"))
    sets = studies.select("project_id", "project", "owner", F.coalesce("s.identifier", "s.id", F.lit("")).alias("study_id"), F.coalesce("s.name", F.lit("")).alias("study"), F.explode_outer("s.datasets").alias("d"))
    return sets.select("project_id", "project", "owner", "study_id", "study", F.coalesce("d.identifier", "d.id", F.lit("")).alias("dataset_id"), F.coalesce("d.name", F.lit("")).alias("dataset"), c("d.type").alias("type"))


def parse_tsv(docs: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows of TSV documents (path, content), each with its own header, with each wanted column under any of its names.

    Names are compared without case; a column that a file lacks is null.
    """
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
    # the header is taken apart below the explode: once a document and not once a line
    split = docs.select(lines.alias("_lines")).select(_header(F.get("_lines", F.lit(0))).alias("_names"), "_lines")
    return _cells(split.select("_names", F.explode(F.slice("_lines", F.lit(2), F.size("_lines") + 1)).alias("_line")), aliases)


def _header(line: Column) -> Column:
    return F.transform(F.split(line, "\t"), lambda x: F.lower(F.trim(x)))


def _cells(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The wanted columns of rows (_names, _line)."""
    cells = df.withColumn("_cells", F.split("_line", "\t"))
    places = lambda names: F.array_min(F.filter(F.array(*(F.nullif(F.array_position("_names", n.lower()), F.lit(0)) for n in names)), lambda x: x.isNotNull()))
    return cells.select(*(F.get(c("_cells"), (places(names) - 1).cast("int")).alias(k) for k, names in aliases.items()))


#: Parts in which the lines of a file meet its header.
_SALTS = 64


def read_tsv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """As ``parse_tsv``, of the files at ``path``, which are split between tasks by byte ranges.

    A file's header is the first line, by byte range and order in it, that is not blank.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    at = F.struct(c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = read.select(c("_metadata.file_path").alias("path"), at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("_line")).where(F.trim("_line") != "")
    first = lines.groupBy("path").agg(F.min(F.struct("at", "_line")).alias("h"))
    headers = first.select("path", c("h.at").alias("_first"), _header(c("h._line")).alias("_names"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    rows = lines.withColumn("_salt", F.pmod(F.xxhash64("_line"), F.lit(_SALTS)).cast("int")).join(headers, ["path", "_salt"]).where("at <> _first")
    return _cells(rows.select("_names", "_line"), aliases)


def select_experiment(catalog: DataFrame, kind: str) -> DataFrame:
    """Lowest experiment number of each sample that fits ``kind``.

    ``catalog``: sample, exp_no, is_2d, nucleus, experiment, pulse_program.  1D
    kinds are nuclei and leave out 2D and DEPT experiments; 2D kinds are types.
    """
    dept = F.contains(F.lower(F.coalesce("pulse_program", F.lit(""))), F.lit("dept"))
    if kind in ("HSQC", "HMBC", "COSY", "TOCSY", "NOESY", "ROESY"):
        fits = c("is_2d") & (c("experiment") == kind)
    else:
        fits = ~c("is_2d") & (c("nucleus") == kind) & ~dept
    return catalog.where(fits).groupBy("sample").agg(F.min("exp_no").alias("exp_no"))


def resolve_dim(meta: DataFrame, hint: int | None = None) -> DataFrame:
    """(id, nucleus, offset, sf, error) from co-indexed lists.

    The entry of the wanted nucleus counts; where it is there more than once,
    ``hint`` picks among them; otherwise ``error`` says why there is none.
    """
    from resonara.functions.scoring import nucleus

    clean = F.transform("nuclei", nucleus)
    zipped = F.arrays_zip(clean.alias("n"), c("offsets").alias("o"), c("sfs").alias("s"))
    hits = F.filter(zipped, lambda z: z["n"] == c("nucleus"))
    picked = F.when(F.size(hits) == 1, hits[0])
    if hint is not None:
        picked = picked.otherwise(F.get(hits, F.lit(hint)))
    lengths = (F.size("nuclei") != F.size("offsets")) | (F.size("nuclei") != F.size("sfs"))
    error = F.when(lengths, "length").when(F.size(hits) == 0, "not_found").when(picked.isNull(), "ambiguous")
    return meta.select("id", "nucleus", F.when(~lengths, picked["o"]).alias("offset"), F.when(~lengths, picked["s"]).alias("sf"), error.alias("error"))


RUN_TABLES = ("carbon_signals", "hsqc", "hmbc", "cosy", "manifest")


def parse_run_tables(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, table, state, note, count) for every expected table of every run; ``waiting`` where it can't be read.

    ``docs``: run, table, content; ``runs``: run.
    """
    schema = "note string, count bigint, signals array<string>, peaks array<string>, _corrupt string"
    read = docs.withColumn("j", F.from_json("content", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = F.coalesce(F.size("j.signals"), F.size("j.peaks"), F.lit(0))
    good = read.where("j IS NOT NULL AND j._corrupt IS NULL").select("run", "table", c("j.note").alias("note"), F.coalesce("j.count", rows).cast("bigint").alias("count"), F.lit("ok").alias("state"))
    expected = runs.select("run", F.explode(F.array(*map(F.lit, RUN_TABLES))).alias("table"))
    return expected.join(good, ["run", "table"], "left").select("run", "table", F.coalesce("state", F.lit("waiting")).alias("state"), "note", F.coalesce("count", F.lit(0)).alias("count"))


def threshold_options(items: list[str], accepted: tuple[str, ...] = ("HSQC", "HMBC", "COSY", "1H", "13C")) -> tuple[dict[str, float], float | None]:
    """Keyed thresholds and the last bare one of ``KEY=value`` and ``value`` items; unknown keys are errors."""
    keyed, bare = {}, None
    for item in items:
        key, sep, value = item.rpartition("=")
        if sep and key.strip().upper() not in accepted:
            raise ValueError(f"unknown key {key!r} in {item!r}; accepted: {', '.join(accepted)}")
        if sep:
            keyed[key.strip().upper()] = float(value)
        else:
            bare = float(value)
    return keyed, bare


# -- sinks and tables --------------------------------------------------------------------------


def write_warehouse(df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """Compounds as Parquet, clustered by formula so that a formula's rows share few row groups."""
    dealt = df.repartition(partitions, "formula_norm") if partitions else df.repartition("formula_norm")
    dealt.sortWithinPartitions("formula_norm").write.mode(mode).parquet(path)


def save_warehouse_table(df: DataFrame, name: str, buckets: int, mode: str = "overwrite") -> None:
    """Compounds as a table bucketed by formula, for joins without a shuffle."""
    df.write.mode(mode).bucketBy(buckets, "formula_norm").sortBy("formula_norm").format("parquet").saveAsTable(name)


def save_code_table(table: DataFrame, path: str, compress: bool = True) -> None:
    """Code table as JSON lines, gzipped or not."""
    table.write.mode("overwrite").json(path, compression="gzip" if compress else "none")


def load_code_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("code string, radius bigint, shifts_c array<bigint>").json(path)


def constraint_text(atoms: DataFrame, correlations: DataFrame) -> DataFrame:
    """(list_id, text) of constraint problems: atoms, shifts, correlations by kind, EXIT.

    ``atoms``: list_id, atom_no, element, hybridisation, h_count, pos_c;
    ``correlations``: list_id, kind, atom1, atom2.
    """
    hyb = F.when(c("hybridisation") == "sp", "1").when(c("hybridisation") == "sp2", "2").otherwise("3")
    mult = atoms.select("list_id", F.lit(1).alias("part"), c("atom_no").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.concat_ws(" ", F.lit("MULT"), "atom_no", "element", hyb, "h_count").alias("line"))
    shix = atoms.where("pos_c IS NOT NULL").select("list_id", F.lit(2).alias("part"), c("atom_no").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.format_string("SHIX %d %.2f", c("atom_no"), c("pos_c") / F.lit(100.0)).alias("line"))
    part = F.when(c("kind") == "HSQC", 3).when(c("kind") == "HMBC", 4).otherwise(5)
    corr = correlations.select("list_id", part.alias("part"), c("atom1").alias("k1"), c("atom2").alias("k2"), F.concat_ws(" ", "kind", "atom1", "atom2").alias("line"))
    titles = F.create_map(*(F.lit(x) for kv in {1: "; Atom definitions", 2: "; Chemical shifts", 3: "; Direct C-H correlations (HSQC)", 4: "; Long-range C-H correlations (HMBC)", 5: "; H-H correlations (COSY)"}.items() for x in kv))
    lines = mult.unionByName(shix).unionByName(corr)
    sections = lines.groupBy("list_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k1", "k2", "line"))), lambda x: x["line"]), "\n").alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda s: F.concat(titles[s["part"]], F.lit("\n"), s["body"], F.lit("\n"))), "\n")
    return sections.groupBy("list_id").agg(F.concat(text, F.lit("\nEXIT")).alias("text"))


def write_constraints(problems: DataFrame, path: str, files: int | None = None) -> None:
    """Problems (list_id, text) as a text folder: one line of JSON a problem, in files of many problems, sorted by list.

    ``constraint_texts`` reads them back; a solver's front end takes the texts it
    wants from there.
    """
    rows = problems.repartitionByRange(files, "list_id") if files else problems.repartitionByRange("list_id")
    rows.sortWithinPartitions("list_id").select(F.to_json(F.struct("list_id", "text")).alias("value")).write.mode("overwrite").text(path)


def constraint_texts(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, text) of a folder of ``write_constraints``."""
    return spark.read.text(path).select(F.from_json("value", "list_id bigint, text string").alias("p")).select("p.*")


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``number``, from 1 in order of ``by``: a sort over ranges, and an offset for each range.

    Every range is numbered by itself; only one count a range comes to the driver.
    """
    ranges = kept(df.repartitionByRange(by).sortWithinPartitions(by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    counts = {r["_part"]: r["n"] for r in ranges.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 1, []
    for part in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(part, 0)
    offset = F.get(F.array(*(F.lit(x).cast("bigint") for x in offsets)), c("_part")) if offsets else F.lit(1).cast("bigint")
    return ranges.withColumn("number", c("_at") + offset).drop("_part", "_at")


def fragment_files(fragments: DataFrame) -> DataFrame:
    """(smiles, file_name, deff, fexp) of fragments: the name is the first 12 hex digits of a SHA-256."""
    name = F.concat(F.lit("fragment_"), F.substring(F.sha2("smiles", 256), 1, 12), F.lit(".lsd"))
    rows = fragments if "number" in fragments.columns else numbered(fragments, "smiles")
    number = c("number").cast("string")
    return rows.select("smiles", name.alias("file_name"), F.concat(F.lit("DEFF F"), number, F.lit(' "'), name, F.lit('"')).alias("deff"), F.concat(F.lit('FEXP "F'), number, F.lit('"')).alias("fexp"))
