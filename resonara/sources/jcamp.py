"""JCAMP-DX source as a bulk job: one task decodes the files of its partition.

Data tables come as plain numbers (AFFN, PAC) or packed (SQZ, DIF, DUP), in one
dimension as XYDATA or as NTUPLES pages of a real and an imaginary channel (X, R,
I; the real one counts), in two as NTUPLES pages along F1.  Comments (``$$``) are
taken out first.  A file that can't be decoded becomes an error row; it never stops
the job.

Places: a page's own Hz is its place along F1, so trimmed files keep theirs.  In
ppm a point at ``hz`` lies at ``$OFFSET - (FIRST - hz) / $SF`` of its dimension, with
FIRST of the whole spectrum; both are null where the file has no such labels.
``$NUC1``, ``$OFFSET`` and ``$SF`` are listed by dimension, the direct one first;
the entry of a dimension's nucleus counts, or the dimension's place where both have
the same.  An axis outside its nucleus' bounds or not falling is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions.scoring import AXIS_BOUNDS, WIDE_BOUNDS

from .text import documents

c = F.col

#: Pseudo-digits by their first character: value of "@" and "A-I", "%" and "J-R", "S-Z" and "s": fixed values of the format.
SQZ = {"@": 0} | {x: i for i, x in enumerate("ABCDEFGHI", 1)} | {x: -i for i, x in enumerate("abcdefghi", 1)}
DIF = {"%": 0} | {x: i for i, x in enumerate("JKLMNOPQR", 1)} | {x: -i for i, x in enumerate("jklmnopqr", 1)}
DUP = {x: i for i, x in enumerate("STUVWXYZs", 1)}
_PACKED = re.compile(r"([@A-IJ-RS-Za-ij-rs%])(\d*)|([+-]?\d+(?:\.\d*)?)")
_PLAIN = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_X = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)")
#: A first abscissa, with an exponent or not, and what follows it.
_START = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*(.?)")
SCHEMA = "path string, row bigint, i bigint, x_hz double, y_hz double, x_ppm double, y_ppm double, value double, nucleus string, pulse_program string, two_d boolean, error string"


def decode_lines(lines: list[str]) -> list[float]:
    """Ordinates of the lines of one data table, without each line's leading abscissa.

    A line that follows a difference begins with a check value, the last
    ordinate of the line before; it must agree and is left out.
    """
    out: list[float] = []
    by_difference = False
    start = _START.match(next((line for line in lines if line.strip()), ""))
    packed = bool(start) and start[1] in (SQZ.keys() | DIF.keys() | DUP.keys())
    for line in lines:
        head = _X.match(line)
        if not head:
            if line.strip():
                raise ValueError(f"no abscissa in {line!r}")
            continue
        if not packed:
            out += [float(x) for x in _PLAIN.findall(line)[1:]]
            continue
        body = line[head.end() :]
        values, last, step = [], out[-1] if out else 0.0, None
        for sign, digits, plain in _PACKED.findall(body):
            if plain:
                last, step = float(plain), None
                values.append(last)
            elif sign in SQZ:
                d = SQZ[sign]
                last, step = float(f"{'-' if d < 0 else ''}{abs(d)}{digits}"), None
                values.append(last)
            elif sign in DIF:
                d = DIF[sign]
                step = float(f"{'-' if d < 0 else ''}{abs(d)}{digits}")
                last += step
                values.append(last)
            else:
                if not values:
                    raise ValueError("a repeat without a value")
                for _ in range(int(f"{DUP[sign]}{digits}") - 1):
                    last += step or 0.0
                    values.append(last)
        if by_difference and values and out:
            if abs(values[0] - out[-1]) > 1e-6 * max(1.0, abs(out[-1])):
                raise ValueError(f"check value {values[0]:g} differs from {out[-1]:g}")
            values = values[1:]
        out += values
        by_difference = step is not None
    return out


def labels(content: str) -> list[tuple[str, str]]:
    """Labelled data records of a file, in order; names without blanks and in upper case, no comments."""
    records = re.split(r"(?m)^##", re.sub(r"\$\$.*", "", content))[1:]
    pairs = (r.partition("=") for r in records)
    return [(re.sub(r"[\s_]", "", name).upper(), value.strip()) for name, _, value in pairs]


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def _nucleus(label: str) -> str:
    """Plain nucleus of ``^1H`` or ``<1H>``."""
    return re.sub("^<(.*)>$", r"\1", label.strip().lstrip("^"))


def _axis(pairs: list[tuple[str, str]], kind: str, place: int) -> tuple[float, float] | None:
    """(``$OFFSET``, ``$SF``) of a dimension by its nucleus, or by its place (0 is the direct one) where that is there twice."""
    nuclei, offsets, fields = ([v for k, v in pairs if k == name] for name in ("$NUC1", "$OFFSET", "$SF"))
    if not offsets or not fields:
        return None
    if not nuclei and len(offsets) == len(fields) == 1:
        nuclei = [kind]
    if not len(nuclei) == len(offsets) == len(fields):
        raise ValueError(f"{len(nuclei)} nuclei, {len(offsets)} offsets and {len(fields)} frequencies")
    hits = [i for i, n in enumerate(nuclei) if _nucleus(n) == kind]
    if not hits:
        raise ValueError(f"nucleus {kind} is not among {nuclei}")
    if len(hits) > 1 and place >= len(hits):
        raise ValueError(f"{len(hits)} entries of {kind}, none at {place}")
    at = hits[0] if len(hits) == 1 else hits[place]
    return float(offsets[at]), float(fields[at])


def _places(hz: np.ndarray, first: float, axis: tuple[float, float] | None, kind: str) -> np.ndarray:
    """ppm of points by their Hz; the axis must be plausible for its nucleus and fall."""
    if axis is None:
        return np.full(len(hz), np.nan)
    ppm = axis[0] - (first - hz) / axis[1]
    low, high = AXIS_BOUNDS.get(kind, WIDE_BOUNDS)
    if not (low <= ppm.min() and ppm.max() <= high):
        raise ValueError(f"implausible {kind} axis from {ppm[0]:.6g} to {ppm[-1]:.6g} ppm")
    if len(ppm) > 1 and not ppm[0] > ppm[-1]:
        raise ValueError(f"{kind} axis is not descending")
    return ppm


def _channel(tables: list[str]) -> str:
    """The real channel's table, by its form (X++(R..R)), or else the first."""
    return next((t for t in tables if re.search(r"\(R\.\.R\)", t.split("\n", 1)[0].upper())), tables[0])


def decode(path: str, content: str) -> pd.DataFrame:
    """Points of one file (SCHEMA): row (0 in 1D), index, places in Hz and ppm (null where there are none), value; or one error row."""
    try:
        pairs = labels(content)
        first = {k: v for k, v in reversed(pairs)}
        tables = [v for k, v in pairs if k in ("XYDATA", "DATATABLE")]
        pages = [v for k, v in pairs if k == "PAGE"]
        if not tables:
            raise ValueError("no data table")
        names = [n.strip().upper() for n in first.get("SYMBOL", "").split(",")]
        two_d = bool(pages) and ("F1" in names or first.get("NUMDIM", "1") != "1")
        channels = bool(pages) and not two_d and {"X", "R"} <= set(names)
        if pages and not channels and len(pages) != len(tables):
            raise ValueError(f"{len(pages)} pages and {len(tables)} tables")
        rows = [decode_lines(t.split("\n")[1:]) for t in ([_channel(tables)] if channels else tables)]
        lengths = {len(r) for r in rows}
        if len(lengths) != 1:
            raise ValueError(f"rows of different lengths: {sorted(lengths)}")
        n = lengths.pop()
        at = lambda label, name: _numbers(first[label])[names.index(name)]
        observed = _nucleus(first.get(".OBSERVENUCLEUS", "")) or None
        hz, ppm, kinds = np.full(len(rows), np.nan), np.full(len(rows), np.nan), [observed, observed]
        if two_d:
            sizes = [int(at("VARDIM", f)) for f in ("F1", "F2")]
            if sizes != [len(pages), n]:
                raise ValueError(f"declared {sizes}, found {len(pages)} x {n}")
            factor, start, stop = at("FACTOR", "Y"), at("FIRST", "F2"), at("LAST", "F2")
            hz = np.array([float(p.partition("=")[2]) for p in pages])
            if ".NUCLEUS" in first:
                kinds = [_nucleus(k) for k in first[".NUCLEUS"].split(",")]
                if len(kinds) != 2:
                    raise ValueError(f"{len(kinds)} nuclei for two dimensions")
            axis = _axis(pairs, kinds[0], 1)
            ppm = _places(hz, at("FIRST", "F1") if axis else 0.0, axis, kinds[0])
        elif channels:
            if int(at("VARDIM", "X")) != n:
                raise ValueError(f"declared {first['VARDIM']} points, found {n}")
            factor, start, stop = at("FACTOR", "R"), at("FIRST", "X"), at("LAST", "X")
        else:
            if "NPOINTS" in first and int(_numbers(first["NPOINTS"])[0]) != n:
                raise ValueError(f"declared {first['NPOINTS']} points, found {n}")
            factor = float(first.get("YFACTOR", "1"))
            start, stop = _numbers(first.get("FIRSTX", first.get("FIRST", "0")))[0], _numbers(first.get("LASTX", first.get("LAST", "0")))[0]
        x = np.linspace(start, stop, n)
        across = _places(x, start, _axis(pairs, kinds[1], 0), kinds[1])
        values = np.asarray(rows, dtype=np.float64) * factor
        columns = {"row": np.repeat(np.arange(len(rows)), n), "i": np.tile(np.arange(n), len(rows)), "x_hz": np.tile(x, len(rows)), "y_hz": np.repeat(hz, n), "x_ppm": np.tile(across, len(rows)), "y_ppm": np.repeat(ppm, n), "value": values.ravel()}
        return pd.DataFrame({"path": path, **columns, "nucleus": observed, "pulse_program": first.get(".PULSESEQUENCE") or None, "two_d": two_d, "error": None})
    except (KeyError, ValueError, IndexError) as e:
        return pd.DataFrame([{x.split()[0]: None for x in SCHEMA.split(", ")} | {"path": path, "error": f"{type(e).__name__}: {e}"}])


def parse_jcamp(docs: DataFrame) -> DataFrame:
    """Points and error rows of JCAMP-DX documents (path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = decode(path, content or "")
                yield out.astype({"row": "Int64", "i": "Int64"} | dict.fromkeys(("x_hz", "y_hz", "x_ppm", "y_ppm", "value"), "float64"))

    return docs.select("path", "content").mapInPandas(run, SCHEMA)


def read_jcamp(spark: SparkSession, path: str) -> DataFrame:
    """All JCAMP-DX files at ``path``, which any of Spark's file systems may hold."""
    return parse_jcamp(documents(spark, path, "*.dx"))


def headers(points: DataFrame) -> DataFrame:
    """(path, nucleus, pulse_program, two_d, placed) of decoded files; ``placed`` if all their axes have places in ppm."""
    placed = F.isnotnull(F.nanvl("x_ppm", F.lit(None))) & (~c("two_d") | F.isnotnull(F.nanvl("y_ppm", F.lit(None))))
    return points.where("row = 0 AND i = 0").select("path", "nucleus", "pulse_program", "two_d", placed.alias("placed"))
