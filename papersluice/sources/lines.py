"""Reading recognised lines, routing files, writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "doc_id BIGINT, line_num INT, text STRING, score DOUBLE, polygon ARRAY<ARRAY<DOUBLE>>"


def read_ocr_lines(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A recogniser's output as lines: text trimmed, empty lines dropped, confidence to 100, the polygon's bounding box."""
    raw = spark.read.schema(RAW).format(form).load(path)
    side = lambda i: F.transform("polygon", lambda p: F.get(p, F.lit(i)))
    x, y = F.array_min(side(0)), F.array_min(side(1))
    cut = lambda c: c.cast("int")
    return raw.where(F.trim("text") != "").select("doc_id", "line_num", F.trim("text").alias("text"), (F.col("score") * 100).alias("confidence"), cut(x).alias("x"), cut(y).alias("y"), cut(F.array_max(side(0)) - x).alias("w"), cut(F.array_max(side(1)) - y).alias("h"))


def route_files(spark: SparkSession, path: str) -> DataFrame:
    """name, path, kind: pdf by extension or by the first bytes; else jpg, png or webp by extension, jpg by default."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    files = spark.read.format("binaryFile").load(path)
    kind = F.when(name.endswith(".pdf") | (F.substring("content", 1, 4) == F.lit(b"%PDF")), "pdf").when(name.endswith(".png"), "png").when(name.endswith(".webp"), "webp").otherwise("jpg")
    return files.select(name.alias("name"), "path", kind.alias("kind"))


def write_results(results: DataFrame, path: str, form: str = "json") -> None:
    """A nested record per document."""
    results.write.format(form).mode("overwrite").save(path)
