"""Splitting rows that can be processed from those that can't, with every reason and counts of both.

A fault is a name and a condition. A row with faults goes to the quarantine with
all their names; nothing is dropped and nothing stops the job. Both counts are
observed while the rows pass, without a job of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

METHODS = ["contour", "text_cluster", "merged", "full_image"]
#: What a document looks like as JSON text.
DOCUMENT = "doc_id BIGINT, lines ARRAY<STRUCT<text STRING, confidence DOUBLE>>"


def _out_of(c: str, low: float, high: float) -> Column:
    """Missing, not a number, or outside low to high."""
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | ~F.col(c).between(low, high)


def region_faults() -> dict[str, Column]:
    """Faults of regions: confidence, area_ratio, method, x, y, w, h."""
    return {
        "confidence": _out_of("confidence", 0, 1),
        "area_ratio": _out_of("area_ratio", 0, 1),
        "method": F.col("method").isNull() | ~F.col("method").isin(METHODS),
        "box": F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull() | (F.col("w") < 0) | (F.col("h") < 0),
    }


def document_faults() -> dict[str, Column]:
    """Faults of documents as from parsed_documents(): text that is no record, no id, no lines, only empty lines, a confidence that isn't from 0 to 100."""
    worded = F.exists("lines", lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) != "")
    odd = F.exists("lines", lambda x: x["confidence"].isNull() | F.isnan(x["confidence"]) | ~x["confidence"].between(0, 100))
    empty = F.col("lines").isNull() | (F.size("lines") == 0)
    readable = F.col("_corrupt_record").isNull()
    return {"unreadable": ~readable, "no id": readable & F.col("doc_id").isNull(), "no lines": readable & empty, "no text": readable & ~empty & ~worded, "confidence": readable & ~empty & odd}


def parsed_documents(texts: DataFrame, json: str = "json", schema: str = DOCUMENT) -> DataFrame:
    """The columns of texts and of its JSON texts; a text that doesn't fit the schema keeps its other values and is in _corrupt_record whole."""
    record = F.from_json(json, f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return texts.withColumn("_r", record).select("*", "_r.*").drop("_r")


def judged(rows: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """rows with `reasons`, the names of their faults in the given order; a condition that is null is a fault."""
    each = [F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in faults.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*each)))


def split(rows: DataFrame, faults: dict[str, Column], observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with the columns of rows, faulty rows with `reasons` too). observation: counts good and faulty rows and each reason while whichever of the two is read first passes; streams take observe() by name instead."""
    marked = judged(rows, faults)
    if observation is not None:
        counts = [F.count_if(F.array_contains("reasons", n)).alias(f"reason_{n.replace(' ', '_')}") for n in faults]
        marked = marked.observe(observation, F.count_if(F.size("reasons") == 0).alias("good"), F.count_if(F.size("reasons") > 0).alias("faulty"), *counts)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def error_results(faulty: DataFrame) -> DataFrame:
    """Results of documents that can't be processed: decision 'error', score 0, hard rejection, the reasons named."""
    said = F.concat(F.lit("Processing error: "), F.array_join("reasons", ", "))
    return faulty.select("doc_id", F.lit(None).cast("string").alias("doc_type"), F.lit("error").alias("decision"), F.lit(0.0).alias("final_score"), F.lit(True).alias("hard_rejection"), said.alias("reasons"))
