"""Queries over the scalar functions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonara.functions import bits, formula, parsing, records, scoring
from resonara.operators.statistics import population_std

from .catalog import query

c = F.col


@query("P1_normalize_formula", "SELECT id, replace(translate(formula, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), ' ', '') AS normalized FROM {compound}")
def _(v):
    return v.compound.select("id", formula.normalize_formula(c("formula")).alias("normalized"))


_PARTS = "(SELECT id, unnest(regexp_extract_all(formula_norm, '([A-Z][a-z]?)(\\d*)', 1)) AS element, unnest(regexp_extract_all(formula_norm, '([A-Z][a-z]?)(\\d*)', 2)) AS k FROM {compound}) p"
_COUNT = "cast(coalesce(sum(CASE WHEN k = '' THEN 1 ELSE cast(k AS bigint) END){}, 0) AS bigint)"


@query("P2_count_carbons", f"SELECT id, {_COUNT.format(chr(32) + 'FILTER (element = ' + chr(39) + 'C' + chr(39) + ')')} AS carbons FROM {_PARTS} GROUP BY id")
def _(v):
    return v.compound.select("id", formula.count_carbons(c("formula_norm")).alias("carbons"))


@query("P3_parse_formula", f"SELECT id, element, {_COUNT.format('')} AS n FROM {_PARTS} GROUP BY id, element")
def _(v):
    return v.compound.select("id", F.explode(formula.parse_formula(c("formula_norm"))).alias("element", "n"))


@query("P4_formula_from_inchi", "SELECT id, CASE WHEN inchi LIKE 'InChI=%' AND regexp_matches(string_split(inchi, '/')[2], '^[A-Z]') THEN string_split(inchi, '/')[2] END AS formula FROM {compound}")
def _(v):
    return v.compound.select("id", formula.formula_from_inchi(c("inchi")).alias("formula"))


@query(
    "P5_dbe",
    f"""SELECT id, (2 * {_COUNT.format(" FILTER (element = 'C')")} + 2 + {_COUNT.format(" FILTER (element = 'N')")} - {_COUNT.format(" FILTER (element = 'H')")}
        - {_COUNT.format(" FILTER (element IN ('F', 'Cl', 'Br', 'I'))")})::DOUBLE / 2.0::DOUBLE AS dbe FROM {_PARTS} GROUP BY id""",
)
def _(v):
    return v.compound.select("id", formula.dbe(c("formula_norm")).alias("dbe"))


@query(
    "P6_measured_signals",
    r"""SELECT compound_id, pos, try_cast(trim(string_split(s, ';')[1]) AS DOUBLE) AS shift,
        CASE regexp_extract(upper(coalesce(string_split(s, ';')[2], '')), '([SDTQ])$', 1) WHEN 'S' THEN 0 WHEN 'D' THEN 1 WHEN 'T' THEN 2 WHEN 'Q' THEN 3 END::BIGINT AS h_count,
        try_cast(trim(string_split(s, ';')[3]) AS BIGINT) AS atom_index
        FROM (SELECT compound_id, pos, trim(unnest(string_split(trim(measured), '|'))) AS s FROM {signal_text}) x WHERE try_cast(trim(string_split(s, ';')[1]) AS DOUBLE) IS NOT NULL""",
)
def _(v):
    return v.signal_text.select("compound_id", "pos", F.inline(parsing.measured_signals(c("measured"))))


@query(
    "P7_predicted_signals",
    r"""SELECT compound_id, pos, try_cast(trim(string_split(s, '|')[2]) AS DOUBLE) AS shift, try_cast(trim(string_split(string_split(s, '|')[1], ':')[2]) AS BIGINT) - 1 AS atom_index
        FROM (SELECT compound_id, pos, trim(unnest(string_split(trim(predicted), ';'))) AS s FROM {signal_text}) x
        WHERE len(string_split(s, '|')) = 2 AND try_cast(trim(string_split(s, '|')[2]) AS DOUBLE) IS NOT NULL""",
)
def _(v):
    return v.signal_text.select("compound_id", "pos", F.inline(parsing.predicted_signals(c("predicted"))))


_TOL = "CASE WHEN shift_c < 8000 THEN 80 WHEN shift_c < 10000 THEN 100 WHEN shift_c < 16000 THEN 120 ELSE 150 END"


@query("P8_tolerance", f"SELECT compound_id, pos, ({_TOL})::BIGINT AS tolerance_c FROM {{signal}}")
def _(v):
    return v.signal.select("compound_id", "pos", scoring.tolerance_c(c("shift_c")).cast("bigint").alias("tolerance_c"))


@query(
    "P9_match_score",
    """SELECT ord, pos, CASE WHEN qty = 0 OR line = 0 THEN 0.0::DOUBLE ELSE
        sqrt(least(line, qty)::DOUBLE / qty::DOUBLE * least(1.0::DOUBLE, least(line, qty)::DOUBLE / (line::DOUBLE * CASE WHEN supp % 40 > 0 THEN least(1.0::DOUBLE, qty::DOUBLE / (supp % 40)::DOUBLE) ELSE 1.0::DOUBLE END)))
        * CASE WHEN least(line, qty) > 0 THEN 0.8::DOUBLE + 0.2::DOUBLE * ((least(line, qty) * 1 - least(line, qty) % 2)::DOUBLE / greatest(least(line, qty), 1)::DOUBLE) ELSE 1.0::DOUBLE END END AS score FROM {item}""",
)
def _(v):
    matched = F.least("line", "qty")
    return v.item.select("ord", "pos", scoring.match_score(matched, c("qty"), c("line"), c("supp") % 40, matched - matched % 2).alias("score"))


@query(
    "P10_confidence",
    """SELECT code, radius, round((0.5::DOUBLE * (radius::DOUBLE / 6.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * log10(greatest(n, 1)::DOUBLE) / 2.0::DOUBLE)
        + 0.2::DOUBLE * greatest(0.5::DOUBLE, 1.0::DOUBLE - sqrt((n * sumsq_c - sum_c * sum_c)::DOUBLE) / n::DOUBLE / 100.0::DOUBLE / 20.0::DOUBLE)) * 1000)::BIGINT AS confidence_milli FROM {env_state}""",
)
def _(v):
    return v.env_state.select("code", "radius", F.round(scoring.confidence(c("radius"), c("n"), population_std(), 6) * 1000).cast("bigint").alias("confidence_milli")).withColumn("radius", c("radius"))


_CODE = "'C-' || cast(supp % 4 AS string) || ';' || CASE supp % 3 WHEN 0 THEN '=OCO' WHEN 1 THEN '*C*C' ELSE 'ClCCBr' END || CASE WHEN part % 5 = 0 THEN '' ELSE '(CC,,//)' END"


@query(
    "P11_sphere1_elements",
    f"SELECT ord, pos, element, count(*) AS n FROM (SELECT ord, pos, unnest(regexp_extract_all(string_split(string_split({_CODE}, ';')[2], '(')[1], '[A-Z][a-z]?')) AS element FROM {{item}}) x GROUP BY ALL",
)
def _(v):
    return v.item.select("ord", "pos", F.explode(parsing.sphere1_elements(F.expr(_CODE))).alias("element", "n"))


_PULSE = "CASE supp % 10 WHEN 0 THEN 'hsqcedetgp' WHEN 1 THEN 'HMBCgp' WHEN 2 THEN 'inv4gplplrndqf' WHEN 3 THEN 'inv4gp' WHEN 4 THEN 'cosygpqf' WHEN 5 THEN 'mlevph' WHEN 6 THEN 'noesygp' WHEN 7 THEN 'roesyph' WHEN 8 THEN 'hmqc' ELSE 'zg30' END"


@query(
    "P12_experiment_type",
    f"""SELECT ord, pos, CASE WHEN p LIKE '%hmbc%' OR p LIKE '%inv4%lr%' THEN 'HMBC' WHEN p LIKE '%inv4%' OR p LIKE '%hsqc%' OR p LIKE '%hmqc%' THEN 'HSQC' WHEN p LIKE '%cosy%' THEN 'COSY'
        WHEN p LIKE '%tocsy%' OR p LIKE '%mlev%' OR p LIKE '%dipsi%' THEN 'TOCSY' WHEN p LIKE '%noesy%' THEN 'NOESY' WHEN p LIKE '%roesy%' THEN 'ROESY' END AS experiment
        FROM (SELECT ord, pos, lower({_PULSE}) AS p FROM {{item}}) x""",
)
def _(v):
    return v.item.select("ord", "pos", scoring.experiment_type(F.expr(_PULSE)).alias("experiment"))


_NUCLEUS = "CASE supp % 5 WHEN 0 THEN ' ^1H' WHEN 1 THEN '<13C>' WHEN 2 THEN '15N' WHEN 3 THEN '^^31P' ELSE '<1H>' END"


@query("P13_nucleus", f"SELECT ord, pos, replace(replace(ltrim(trim({_NUCLEUS}), '^'), '<', ''), '>', '') AS nucleus FROM {{item}}")
def _(v):
    return v.item.select("ord", "pos", scoring.nucleus(F.expr(_NUCLEUS)).alias("nucleus"))


_AXIS = "SELECT ord, cast(max(part % 300) AS double) AS off, cast(sum(supp) AS double) * 100 AS width, cast(400 + min(line) AS double) AS freq, cast(count(*) AS bigint) + 1 AS n, min(supp) % 5 AS kind FROM {item} GROUP BY ord"


@query(
    "P14_ppm_axis",
    f"SELECT ord, i, off - i * ((width / freq) / (n - 1)::DOUBLE) AS ppm, off - i * ((width / freq) / n::DOUBLE) AS ppm_open FROM (SELECT *, unnest(range(n)) AS i FROM ({_AXIS}) a) b",
)
def _(v):
    axis = v.sql(_AXIS).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), c("n") - 1)).alias("i"))
    return axis.select("ord", "i", scoring.ppm(c("off"), c("width"), c("freq"), c("i"), c("n")).alias("ppm"), scoring.ppm(c("off"), c("width"), c("freq"), c("i"), c("n"), False).alias("ppm_open"))


@query(
    "P15_axis_fault",
    f"""SELECT ord, CASE WHEN off - width / freq < lo OR off > hi THEN 'implausible' WHEN NOT off > off - width / freq THEN 'not descending' END AS fault
        FROM (SELECT *, CASE kind WHEN 0 THEN -3.0 WHEN 1 THEN -15.0 WHEN 2 THEN -50.0 WHEN 3 THEN -200.0 ELSE -1e6 END AS lo, CASE kind WHEN 0 THEN 15.0 WHEN 1 THEN 250.0 WHEN 2 THEN 900.0 WHEN 3 THEN 250.0 ELSE 1e6 END AS hi FROM ({_AXIS}) a) b""",
)
def _(v):
    kind = F.expr("CASE kind WHEN 0 THEN '1H' WHEN 1 THEN '13C' WHEN 2 THEN '15N' WHEN 3 THEN '31P' ELSE '19F' END")
    last = c("off") - c("width") / c("freq")
    return v.sql(_AXIS).select("ord", scoring.axis_fault(kind, last, c("off"), c("off"), last).alias("fault"))


@query(
    "P16_nearest_index",
    """SELECT spectrum_id, probe_id, arg_min(i, abs(i * 40 - shift_c) * 100000 + i) AS i FROM (SELECT DISTINCT user_id AS spectrum_id FROM {events}) s
       JOIN {probe} ON probe_id % 97 = spectrum_id % 97 JOIN {point1d} USING (spectrum_id) GROUP BY spectrum_id, probe_id""",
)
def _(v):
    # the axis of a spectrum is i * 0.4 ppm; every probe asks the spectra of its residue class
    asked = v.probe.withColumn("residue", F.expr("probe_id % 97"))
    axis = v.point1d.select("spectrum_id", F.expr("spectrum_id % 97").alias("residue"), "i", (c("i") * 40).alias("axis_c"))
    return records.nearest_index(asked, axis, "shift_c", "residue").select("spectrum_id", "probe_id", "i")


_MULTS = "CASE supp % 5 WHEN 0 THEN 'CH' WHEN 1 THEN 'CH2' WHEN 2 THEN 'CH/CH3' WHEN 3 THEN NULL ELSE 'C/CH2' END AS a, CASE part % 5 WHEN 0 THEN 'CH' WHEN 1 THEN 'CH3' WHEN 2 THEN 'CH/CH3' WHEN 3 THEN NULL ELSE 'CH2' END AS b"


@query(
    "P17_multiplicity_compatible",
    f"""SELECT ord, pos, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN true WHEN a LIKE '%/%' AND b LIKE '%/%' THEN true WHEN a LIKE '%/%' THEN list_contains(string_split(a, '/'), b)
        WHEN b LIKE '%/%' THEN list_contains(string_split(b, '/'), a) ELSE false END AS compatible FROM (SELECT ord, pos, {_MULTS} FROM {{item}}) x""",
)
def _(v):
    return v.item.selectExpr("ord", "pos", *_MULTS.split(", CASE part")[:1], "CASE part" + _MULTS.split(", CASE part")[1]).select("ord", "pos", scoring.multiplicity_compatible(c("a"), c("b")).alias("compatible"))


@query(
    "P18_dominant",
    """SELECT code, radius, CASE WHEN greatest(sp3, sp2, sp1) = 0 THEN 'unknown' WHEN sp3 = greatest(sp3, sp2, sp1) THEN 'sp3' WHEN sp2 = greatest(sp3, sp2, sp1) THEN 'sp2' ELSE 'sp1' END AS state,
        greatest(sp3, sp2, sp1)::DOUBLE / n::DOUBLE > 0.95 AS definitive,
        CASE WHEN greatest(carbon, oxygen, nitrogen, sulfur, halogen) = 0 THEN NULL WHEN carbon = greatest(carbon, oxygen, nitrogen, sulfur, halogen) THEN 'carbon' WHEN oxygen = greatest(carbon, oxygen, nitrogen, sulfur, halogen) THEN 'oxygen'
             WHEN nitrogen = greatest(carbon, oxygen, nitrogen, sulfur, halogen) THEN 'nitrogen' WHEN sulfur = greatest(carbon, oxygen, nitrogen, sulfur, halogen) THEN 'sulfur' ELSE 'halogen' END AS element,
        CASE WHEN nitrogen::DOUBLE / n::DOUBLE < 0.01 THEN 'forbidden' WHEN nitrogen::DOUBLE / n::DOUBLE > 0.95 THEN 'mandatory' ELSE 'typical' END AS nitrogen_class FROM {env_state}""",
)
def _(v):
    share = lambda name: scoring.ratio(c(name), c("n"))
    states = [share(s) for s in ("sp3", "sp2", "sp1")]
    return v.env_state.select(
        "code", "radius", scoring.dominant_state(*states).alias("state"), scoring.is_definitive(*states).alias("definitive"),
        scoring.dominant_element(*(share(e) for e in scoring.NEIGHBOURS)).alias("element"), scoring.constraint_class(share("nitrogen")).alias("nitrogen_class"),
    )


@query(
    "P19_regions",
    """SELECT list_id, peak_id, CASE WHEN pos_c > 16000 THEN 'carbonyl/heteroaromatic' WHEN pos_c >= 10000 THEN 'aromatic' WHEN pos_c >= 5000 THEN 'oxygenated aliphatic' WHEN pos_c >= 2500 THEN 'aliphatic CH/CH2' ELSE 'aliphatic CH3' END AS region,
        CASE WHEN mult = 'CH2' THEN 2 WHEN pos_c < 3000 THEN 3 WHEN pos_c > 10000 THEN 1 ELSE 2 END::BIGINT AS hydrogens FROM {dept}""",
)
def _(v):
    return v.dept.select("list_id", "peak_id", scoring.shift_region(c("pos_c")).alias("region"), scoring.hydrogens(c("mult"), c("pos_c")).alias("hydrogens"))


@query(
    "P20_error_grades",
    """SELECT compound_id, CASE WHEN mae < 2.0 THEN 'Excellent' WHEN mae < 3.5 THEN 'Good' WHEN mae < 5.0 THEN 'Moderate' ELSE 'Poor' END AS label, within3, within5, within3::DOUBLE / n::DOUBLE AS rate, worst::DOUBLE / 100.0::DOUBLE AS worst
        FROM (SELECT compound_id, sum(shift_c % 700)::DOUBLE / count(*)::DOUBLE / 100.0::DOUBLE AS mae, count(*) FILTER (shift_c % 700 <= 300) AS within3, count(*) FILTER (shift_c % 700 <= 500) AS within5, count(*) AS n, max(shift_c % 700) AS worst
              FROM {signal} GROUP BY compound_id) x""",
)
def _(v):
    errors = v.signal.groupBy("compound_id").agg(F.collect_list(c("shift_c") % 700).alias("errors_c"))
    return errors.select("compound_id", records.error_grades(c("errors_c")).alias("g")).select("compound_id", "g.*")


_NAMES = "CASE id % 6 WHEN 0 THEN 'CNP0220816.1; Ascorbic-acid dye; vitamin c' WHEN 1 THEN 'The Indigo' WHEN 2 THEN 'CNP12' WHEN 3 THEN '' WHEN 4 THEN 'beta-Carotene (all)' ELSE 'vitamin C; L-ascorbic acid' END"
_REPORTED = "CASE cust % 5 WHEN 0 THEN 'Vitamin C' WHEN 1 THEN 'indigo dye' WHEN 2 THEN 'in' WHEN 3 THEN 'acid, ascorbic' ELSE NULL END"


def _token_sets(name: str) -> str:
    synonyms = f"list_filter(list_transform(string_split(coalesce({name}, ''), ';'), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^CNP\\d+(\\.\\d+)?$'))"
    tokens = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(s), '[,()''\\-–—.]', ' ', 'g'), '\\s+'), lambda t: t NOT IN ('', 'dye', 'the', 'a', 'an', 'of')))"
    return f"list_filter(list_transform({synonyms}, lambda s: {tokens}), lambda x: len(x) > 0)"


@query(
    "P21_name_match",
    f"""SELECT id, len(flatten(d)) AS n_tokens, len(flatten(r)) > 0 AND len(list_filter(d, lambda x: list_has_all(x, flatten(r)))) > 0 AS matches
        FROM (SELECT id, {_token_sets(_NAMES)} AS d, {_token_sets(_REPORTED)} AS r FROM {{compound}}) x""",
)
def _(v):
    derived, reported = F.expr(_NAMES), F.expr(_REPORTED)
    return v.compound.select("id", F.size(F.flatten(parsing.name_token_sets(derived))).cast("bigint").alias("n_tokens"), parsing.name_matches(reported, derived).alias("matches"))


_IDENT = "CASE id % 7 WHEN 0 THEN '10.57992/nmrxiv.p' || cast(id AS string) || '.s' || cast(cust AS string) WHEN 1 THEN 'https://doi.org/10.57992/NMRXIV.P' || cast(id AS string) WHEN 2 THEN 'https://nmrxiv.org/P' || cast(id AS string) || '/S3' WHEN 3 THEN ' p' || cast(id AS string) WHEN 4 THEN 'S12' WHEN 5 THEN 'http://www.nmrxiv.org/p9' ELSE 'X1' END"


@query(
    "P22_project_id",
    f"""SELECT id, 'P' || coalesce(nullif(d1, ''), nullif(u1, ''), nullif(p1, '')) AS project, 'S' || coalesce(nullif(d2, ''), nullif(u2, '')) AS study,
        CASE WHEN coalesce(nullif(d1, ''), nullif(u1, ''), nullif(p1, '')) IS NULL THEN CASE WHEN regexp_matches(t, '(?i)^S\\d+$') THEN 'study needs a project' ELSE 'unrecognized' END END AS error
        FROM (SELECT id, t, regexp_extract(t, '(?i)^(?:https?://doi\\.org/)?10\\.57992/NMRXIV\\.P(\\d+)(?:\\.S(\\d+))?', 1) AS d1, regexp_extract(t, '(?i)^(?:https?://doi\\.org/)?10\\.57992/NMRXIV\\.P(\\d+)(?:\\.S(\\d+))?', 2) AS d2,
              regexp_extract(t, '(?i)^https?://(?:www\\.)?nmrxiv\\.org/P(\\d+)(?:/S(\\d+))?', 1) AS u1, regexp_extract(t, '(?i)^https?://(?:www\\.)?nmrxiv\\.org/P(\\d+)(?:/S(\\d+))?', 2) AS u2, regexp_extract(t, '(?i)^P(\\d+)$', 1) AS p1
              FROM (SELECT id, trim({_IDENT}) AS t FROM {{compound}}) a) b""",
)
def _(v):
    return v.compound.select("id", parsing.project_id(F.expr(_IDENT)).alias("p")).select("id", "p.*")


def _words(bins: str) -> str:
    return ", ".join(f"coalesce(bit_or(CASE WHEN b // 32 = {w} THEN 1::BIGINT << (b % 32)::INT END) FILTER (b // 32 = {w}), 0)::BIGINT AS w{w}" for w in range(8)) + f" FROM ({bins}) x GROUP BY compound_id"


def _split_words(df, column):
    return df.select("compound_id", *(c(column)[w].alias(f"w{w}") for w in range(8)))


@query("P23_fingerprint", "SELECT compound_id, " + _words("SELECT compound_id, shift_c // 200 AS b FROM {signal}"))
def _(v):
    shifts = v.signal.groupBy("compound_id").agg(F.collect_list("shift_c").alias("s"))
    return _split_words(shifts.select("compound_id", bits.fingerprint(c("s")).alias("fp")), "fp")


@query("P24_expanded_fingerprint", "SELECT compound_id, " + _words("SELECT compound_id, least(greatest(shift_c // 200 + d, 0), 255) AS b FROM {signal}, (SELECT unnest([-1, 0, 1]) AS d) e"))
def _(v):
    shifts = v.signal.groupBy("compound_id").agg(F.collect_list("shift_c").alias("s"))
    return _split_words(shifts.select("compound_id", bits.expanded(c("s")).alias("fp")), "fp")


@query(
    "P25_signed_hint",
    "SELECT list_id, peak_id, CASE WHEN experiment <> 'HSQC' THEN 'ambiguous' WHEN intensity >= 0 THEN 'positive' ELSE 'negative' END AS sign, CASE WHEN experiment <> 'HSQC' THEN 'CH_or_CH2_or_CH3' WHEN intensity >= 0 THEN 'CH_or_CH3' ELSE 'CH2' END AS hint FROM {peak2d}",
)
def _(v):
    return v.peak2d.select("list_id", "peak_id", scoring.signed_hint(c("intensity"), c("experiment") == "HSQC").alias("s")).select("list_id", "peak_id", "s.*")


@query(
    "P26_coupling_label",
    "SELECT ord, pos, CASE WHEN line = 3 THEN '?J_CH' ELSE CASE line + 1 WHEN 2 THEN '²' WHEN 3 THEN '³' WHEN 4 THEN '⁴' WHEN 5 THEN '⁵' WHEN 6 THEN '⁶' ELSE cast(line + 1 AS string) END || 'J_CH' END AS label FROM {item}",
)
def _(v):
    return v.item.select("ord", "pos", scoring.coupling_label(F.when(c("line") != 3, c("line"))).alias("label"))


@query("P27_expected_samples", "SELECT ord, pos, CASE WHEN line IN (1, 2) THEN qty WHEN line IN (4, 5, 6) THEN qty // 2 END AS samples, line NOT IN (1, 2, 4, 5, 6) AS unknown_mode FROM {item}")
def _(v):
    samples = scoring.expected_samples(c("line"), c("qty"))
    return v.item.select("ord", "pos", samples.alias("samples"), samples.isNull().alias("unknown_mode"))


_EXPERIMENTS = "CASE id % 5 WHEN 0 THEN '10:1d-1H;11:1d-13C;12:cosy;14:hsqc(ed);15:cosy' WHEN 1 THEN '-' WHEN 2 THEN 'hmbc;;1d-13c' WHEN 3 THEN NULL ELSE cast(cust AS string) || ':hsqc;7: dept135' END"


@query(
    "P28_condense_experiments",
    f"""SELECT id, CASE WHEN t IS NULL OR trim(t) IN ('-', '') OR len(l) = 0 THEN '—' ELSE array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') END AS labels FROM (
        SELECT id, t, list_filter(list_transform(string_split(t, ';'), lambda p: CASE lower(regexp_replace(trim(regexp_replace(p, '^[^:]*:', '')), '^1d-', '')) WHEN '1h' THEN '1H' WHEN '13c' THEN '13C' ELSE upper(regexp_replace(trim(regexp_replace(p, '^[^:]*:', '')), '^1d-', '')) END), lambda x: x <> '') AS l
        FROM (SELECT id, {_EXPERIMENTS} AS t FROM {{compound}}) a) b""",
)
def _(v):
    return v.compound.select("id", parsing.condense_experiments(F.expr(_EXPERIMENTS)).alias("labels"))


@query(
    "P29_rank_verdict",
    """SELECT ord, pos, CASE WHEN NOT reported THEN 'no result' WHEN rank = 0 THEN 'missed' WHEN rank = 1 THEN '**rank 1**' WHEN rank <= 10 THEN 'top 10 (rank ' || rank || ')' ELSE 'found (rank ' || rank || ')' END AS verdict,
        (CASE WHEN NOT reported THEN 0 WHEN rank = 0 THEN 1 ELSE 1000 - rank END)::BIGINT AS quality FROM (SELECT ord, pos, supp % 25 AS rank, part % 6 <> 0 AS reported FROM {item}) x""",
)
def _(v):
    rank, reported = c("supp") % 25, c("part") % 6 != 0
    return v.item.select("ord", "pos", scoring.rank_verdict(rank, reported).alias("verdict"), scoring.rank_quality(rank, reported).alias("quality"))


@query("P30_key_prefix", "SELECT id, string_split(inchi_key || '-UHFFF-N', '-')[1] AS prefix FROM {compound}")
def _(v):
    return v.compound.select("id", parsing.key_prefix(F.concat("inchi_key", F.lit("-UHFFF-N"))).alias("prefix"))


_SUMMARY = "CASE id % 5 WHEN 0 THEN cast(cust AS string) || ' Solutions found in 1.25 sec' WHEN 1 THEN 'No solution; 12 seconds' WHEN 2 THEN 'ERROR 102: 3 solutions' WHEN 3 THEN 'idle' ELSE '0 solution(s) 7ms' END"


@query(
    "P31_solver_summary",
    f"""SELECT id, solutions, seconds, CASE WHEN t LIKE '%error%' THEN 'error' WHEN t LIKE '%no solution%' THEN 'no_solution' WHEN solutions > 0 THEN 'success' ELSE 'unknown' END AS status FROM (
        SELECT id, t, coalesce(try_cast(regexp_extract(t, '(\\d+)\\s+solution', 1) AS BIGINT), 0) AS solutions, try_cast(regexp_extract(t, '(\\d+\\.?\\d*)\\s*(?:sec|second|ms)', 1) AS DOUBLE) AS seconds FROM (SELECT id, lower({_SUMMARY}) AS t FROM {{compound}}) a) b""",
)
def _(v):
    return v.compound.select("id", parsing.solver_summary(F.expr(_SUMMARY)).alias("summary")).select("id", "summary.*")


_VERDICT = "CASE id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAIL' ELSE NULL END"


@query(
    "P32_verdict_texts",
    f"""SELECT id, CASE WHEN q IS NULL THEN 'pending_qc' WHEN q = 'PASS' THEN 'high' WHEN q = 'PARTIAL' THEN 'low' END AS confidence,
        CASE WHEN q IS NULL THEN 'reconstructed via x; QC verdict not yet available' WHEN q = 'PASS' THEN 'reconstructed via x; QC verdict PASS' ELSE 'reconstructed via x; QC verdict PARTIAL (violated: ridge, ' || source || ')' END AS note,
        CASE WHEN q IS NULL THEN 'Reconstructed via x. QC verdict not yet available.' ELSE 'Reconstructed via x. QC verdict: ' || q || '.' || CASE WHEN q <> 'PASS' THEN ' Violated checks: ridge, ' || source || '.' ELSE '' END END AS caveat
        FROM (SELECT id, source, {_VERDICT} AS q FROM {{compound}}) a""",
)
def _(v):
    q, backend = F.expr(_VERDICT), F.lit("x")
    violated = F.when(q == "PASS", F.array().cast("array<string>")).otherwise(F.array(F.lit("ridge"), c("source")))
    return v.compound.select("id", scoring.verdict_confidence(q).alias("confidence"), scoring.verdict_note(q, violated, backend).alias("note"), scoring.verdict_caveat(q, violated, backend).alias("caveat"))


@query("P33_levels", "SELECT plane_id, k AS level, floor_ * 1.4::DOUBLE ** k::DOUBLE AS height FROM (SELECT plane_id, avg(z)::DOUBLE AS floor_ FROM {grid2d} GROUP BY plane_id) p, (SELECT unnest(range(8)) AS k) l")
def _(v):
    floors = v.grid2d.groupBy("plane_id").agg(F.avg("z").alias("f"))
    return floors.select("plane_id", F.posexplode(scoring.levels(c("f"))).alias("level", "height")).withColumn("level", c("level").cast("bigint"))


@query(
    "P34_page_hz",
    "SELECT compound_id, pos, try_cast(trim(CASE pos % 4 WHEN 0 THEN t WHEN 1 THEN ' ' || t WHEN 2 THEN 'x' END) AS DOUBLE) AS hz, CASE WHEN pos % 4 < 2 THEN try_cast(t AS DOUBLE) * 4.0::DOUBLE END AS scaled FROM {signal_text}",
)
def _(v):
    page = F.expr("CASE pos % 4 WHEN 0 THEN 'F1=' || t WHEN 1 THEN 'F1= ' || t WHEN 2 THEN 'F1=x' ELSE 'F1' END")
    return v.signal_text.select("compound_id", "pos", parsing.page_hz(page).alias("hz"), records.scaled(parsing.page_hz(page), F.lit(4.0)).alias("scaled"))


@query("P35_nest_unnest", "SELECT s.compound_id, s.shift_c, s.h_count, s.atom_index, c.name FROM {signal} s JOIN {compound} c ON c.id = s.compound_id")
def _(v):
    return records.flat(records.nested(v.compound, v.signal))


@query(
    "P36_validate",
    "SELECT ord, pos, CASE WHEN supp % 5 = 4 THEN 'nucleus' END AS nucleus_error, CASE WHEN line > 6 THEN 'experiment' END AS experiment_error, CASE WHEN qty % 7 > 3 THEN 'charge' END AS charge_error FROM {item}",
)
def _(v):
    named = v.item.select(
        "ord", "pos", F.expr("CASE supp % 5 WHEN 0 THEN '1H' WHEN 1 THEN '13C' WHEN 2 THEN '15N' WHEN 3 THEN '31P' ELSE '2Q' END").alias("nucleus"),
        F.expr("element_at(array('HSQC','HMBC','COSY','TOCSY','NOESY','ROESY','XXXX'), least(line, 7))").alias("experiment"), (c("qty") % 7).alias("charge"),
    )
    return records.validated(named).select("ord", "pos", "nucleus_error", "experiment_error", "charge_error")


@query("P37_dept_class", "SELECT list_id, peak_id, CASE WHEN intensity > 0 THEN 'CH/CH3' ELSE 'CH2' END AS mult FROM (SELECT *, max(abs(intensity)) OVER (PARTITION BY list_id) AS top FROM {peak1d}) p WHERE abs(intensity)::DOUBLE >= 0.02::DOUBLE * top")
def _(v):
    from resonara.operators import peaks

    kept = peaks.above_share_of_max(v.peak1d, ["list_id"], "intensity", 0.02)
    return kept.select("list_id", "peak_id", scoring.dept_class(c("intensity")).alias("mult"))


@query(
    "P38_user_lists",
    """SELECT compound_id, pos, i, value FROM (SELECT compound_id, pos, unnest([0, 1])::BIGINT AS i, unnest([t::DOUBLE, 30.5::DOUBLE]) AS value FROM {signal_text} WHERE pos % 3 = 0
       UNION ALL SELECT compound_id, pos, 4, t::DOUBLE FROM {signal_text} WHERE pos % 3 = 1) x""",
)
def _(v):
    text = F.expr("CASE pos % 3 WHEN 0 THEN t || ', 30.5' WHEN 1 THEN '{\"4\": ' || t || '}' ELSE 'a,' || t END")
    return v.signal_text.select("compound_id", "pos", F.explode(parsing.shift_list(text)).alias("i", "value"))


_TRIPLE = "CASE supp % 6 WHEN 0 THEN 'HMBC:' || cast(part AS string) || ':5' WHEN 1 THEN 'hmqc:1:2' WHEN 2 THEN 'XXXX:1:2' WHEN 3 THEN 'COSY:1' WHEN 4 THEN 'NOESY:a:2' ELSE 'HSQC:3:' || cast(line AS string) END"


@query(
    "P38_correlation_triples",
    """SELECT ord, pos, CASE supp % 6 WHEN 0 THEN 'HMBC' WHEN 1 THEN 'HSQC' WHEN 5 THEN 'HSQC' END AS kind, CASE supp % 6 WHEN 0 THEN part WHEN 1 THEN 1 WHEN 5 THEN 3 END::BIGINT AS source,
       CASE supp % 6 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 5 THEN line END::BIGINT AS target, CASE supp % 6 WHEN 2 THEN 'type' WHEN 3 THEN 'format' WHEN 4 THEN 'index' END AS error FROM {item}""",
)
def _(v):
    return v.item.select("ord", "pos", parsing.correlation(F.expr(_TRIPLE)).alias("c")).select("ord", "pos", "c.*")


@query("P39_zip_shifts", "SELECT compound_id, count(*) = count(h_count) AS same_length, sum(CASE WHEN h_count IS NOT NULL THEN shift_c * 10 + h_count ELSE 0 END)::BIGINT AS checksum FROM {signal} GROUP BY compound_id HAVING count(*) = count(h_count)")
def _(v):
    lists = v.signal.groupBy("compound_id").agg(F.collect_list(F.struct("pos", "shift_c", "h_count")).alias("s"))
    shifts, hs = F.transform("s", lambda x: x["shift_c"]), F.filter(F.transform("s", lambda x: x["h_count"]), lambda h: h.isNotNull())
    zipped = lists.select("compound_id", records.zipped(shifts, hs).alias("z")).where("z IS NOT NULL")
    return zipped.select("compound_id", F.lit(True).alias("same_length"), F.aggregate("z", F.lit(0).cast("bigint"), lambda acc, x: acc + x["shift"] * 10 + x["h_count"]).alias("checksum"))


@query("P40_surrogate_id")
def _(v):
    return v.compound.select("id", records.surrogate_id(c("source"), c("id")).alias("surrogate"))


@query(
    "P41_prediction_record",
    """SELECT code, radius, sum_c::DOUBLE / n::DOUBLE / 100.0::DOUBLE AS shift, sum_c::DOUBLE / n::DOUBLE / 100.0::DOUBLE - sd AS low, sum_c::DOUBLE / n::DOUBLE / 100.0::DOUBLE + sd AS high, n
       FROM (SELECT *, sqrt((n * sumsq_c - sum_c * sum_c)::DOUBLE) / n::DOUBLE / 100.0::DOUBLE AS sd FROM {env_state}) x""",
)
def _(v):
    from resonara.operators import statistics

    return v.env_state.select("code", "radius", statistics.prediction_record(max_radius=3).alias("p")).select("code", "radius", "p.shift", "p.low", "p.high", "p.n")


@query(
    "P42_constraint_lines",
    "SELECT compound_id, pos, '; FORM C' || pos AS form, 'ELIM ' || pos || ' 4' AS elim, 'SHIH ' || pos || ' ' || t AS shih FROM {signal_text}",
)
def _(v):
    return v.signal_text.select(
        "compound_id", "pos", parsing.constraint_line("FORM", F.concat(F.lit("C"), c("pos").cast("string"))).alias("form"),
        parsing.constraint_line("ELIM", c("pos"), F.lit(4)).alias("elim"), parsing.constraint_line("SHIH", c("pos"), c("t").cast("double")).alias("shih"),
    )
