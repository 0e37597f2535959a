"""Boxes (x, y, w, h) and the overlaps of a document's regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 where boxes only touch."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h)).otherwise(0.0)


def box(of: Column | None = None) -> dict[str, Column]:
    return {k: (of[k] if of is not None else F.col(k)) for k in ("x", "y", "w", "h")}


def region_overlaps(regions: DataFrame, least: float) -> DataFrame:
    """doc_id, a, b, iou: pairs of a document's regions. Overlapping boxes share a band of BAND pixels in height, which makes it an equi-join."""
    band = 64
    banded = regions.select("doc_id", "region_id", "x", "y", "w", "h", F.explode(F.sequence(F.expr(f"y DIV {band}"), F.expr(f"(y + h) DIV {band}"))).alias("band"))
    a, b = (banded.select("doc_id", "band", F.struct("region_id", "x", "y", "w", "h").alias(n)) for n in "ab")
    met = a.hint("merge").join(b, ["doc_id", "band"]).where(F.col("a.region_id") < F.col("b.region_id"))
    first = F.greatest(F.col("a.y"), F.col("b.y"))
    met = met.where(F.col("band") == F.floor(first / band))
    v = iou(box(F.col("a")), box(F.col("b")))
    return met.select("doc_id", F.col("a.region_id").alias("a"), F.col("b.region_id").alias("b"), v.alias("iou")).where((F.col("iou") >= least) & (F.col("iou") > 0))
