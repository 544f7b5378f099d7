"""JSON payloads of peak lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonara.functions import scoring
from resonara.operators.peaks import negative_signals
from resonara.operators.ranking import rank_in_carbon, relative_intensity

c = F.col

#: What a 2D payload is read back as; columns an experiment lacks are null.
PAYLOAD = (
    "experiment string, caveat string, n_cross_peaks bigint, cross_peaks array<struct<c13_ppm:double,h1_ppm:double,h1a_ppm:double,h1b_ppm:double,edited_sign:string,"
    "multiplicity_hint:string,rel_intensity:double,rank_in_carbon:bigint,suspected_1J_artifact:boolean,confidence:string,note:string>>, reconstruction struct<backend:string,qc_verdict:string,violated_checks:array<string>>"
)
PAYLOAD_1D = "count bigint, nucleus string, negative_detected boolean, snr_floor_used double, peaks array<struct<ppm:double,intensity:double>>"
NUCLEI = ("13C", "1H")


def _ppm(cents: str) -> Column:
    return c(cents).cast("double") / F.lit(100.0)


def peaklist_payload(peaks: DataFrame, backend: str) -> DataFrame:
    """One JSON payload for each list and experiment: HSQC, HMBC or COSY columns, caveat and metadata.

    ``peaks``: list_id, peak_id, experiment, f1_c, f2_c, intensity, verdict,
    violated.
    """
    edited = negative_signals(peaks.where("experiment = 'HSQC'"), ["list_id"], "intensity").select("list_id", "edited")
    ranked = rank_in_carbon(peaks.where("experiment = 'HMBC'")).select("list_id", "peak_id", "rank_in_carbon")
    full = relative_intensity(peaks, ["list_id", "experiment"]).join(edited, "list_id", "left").join(ranked, ["list_id", "peak_id"], "left")
    hint = scoring.signed_hint(c("intensity"), F.coalesce("edited", F.lit(False)))
    only = lambda e, col: F.when(c("experiment") == e, col)
    cosy = c("experiment") == "COSY"
    peak = F.struct(
        F.when(~cosy, _ppm("f1_c")).alias("c13_ppm"), F.when(~cosy, _ppm("f2_c")).alias("h1_ppm"), F.when(cosy, _ppm("f1_c")).alias("h1a_ppm"), F.when(cosy, _ppm("f2_c")).alias("h1b_ppm"),
        only("HSQC", F.concat(hint["sign"], F.lit("("), hint["hint"], F.lit(")"))).alias("edited_sign"), only("HSQC", hint["hint"]).alias("multiplicity_hint"),
        F.when(c("experiment") != "HSQC", c("rel_intensity")).alias("rel_intensity"), c("rank_in_carbon"), only("HMBC", F.lit(False)).alias("suspected_1J_artifact"),
        scoring.verdict_confidence(c("verdict")).alias("confidence"), scoring.verdict_note(c("verdict"), c("violated"), F.lit(backend)).alias("note"),
    )
    lists = full.groupBy("list_id", "experiment", "verdict", "violated").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("peak_id", peak.alias("peak")))).alias("p"))
    meta = F.struct(F.lit(backend).alias("backend"), F.coalesce("verdict", F.lit("UNKNOWN")).alias("qc_verdict"), c("violated").alias("violated_checks"))
    payload = F.struct("experiment", scoring.verdict_caveat(c("verdict"), c("violated"), F.lit(backend)).alias("caveat"), c("n").alias("n_cross_peaks"), F.transform("p", lambda x: x["peak"]).alias("cross_peaks"), meta.alias("reconstruction"))
    return lists.select("list_id", "experiment", F.to_json(payload).alias("payload"))


def peaklist_payload_1d(peaks: DataFrame, snr_floor: float) -> tuple[DataFrame, DataFrame]:
    """(payloads with file names, rows of other nuclei) of 1D lists."""
    good, bad = peaks.where(c("nucleus").isin(*NUCLEI)), peaks.where(~c("nucleus").isin(*NUCLEI))
    lists = good.groupBy("list_id", "nucleus").agg(F.count("*").alias("count"), (F.count_if(c("intensity") < 0) > 0).alias("negative_detected"), F.sort_array(F.collect_list(F.struct(_ppm("pos_c").alias("ppm"), c("intensity").cast("double").alias("intensity"))), asc=False).alias("peaks"))
    payload = F.to_json(F.struct("count", "nucleus", "negative_detected", F.lit(snr_floor).alias("snr_floor_used"), "peaks"))
    return lists.select("list_id", "nucleus", F.concat(c("nucleus"), F.lit("_"), c("list_id").cast("string"), F.lit(".json")).alias("file_name"), payload.alias("payload")), bad
