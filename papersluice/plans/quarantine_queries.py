"""Queries over rows that can't be processed. Their SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.operators import layout, quarantine
from papersluice.plans.layout_queries import _regions_sql
from papersluice.session import read_table, spread
from papersluice.sources import fixtures


def quarantined_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of documents with every kind of fault planted in some, and their reasons; sound ones have none."""
    r = layout.regions_of(fixtures.document_lines(spark, sf_dir), fixtures.PAGE_W, fixtures.PAGE_H)
    k = F.col("doc_id") + F.col("region_id") * 7
    planted = r.withColumns({
        "confidence": F.when(k % 17 == 3, F.col("confidence") + 1).when(k % 29 == 4, F.lit(float("nan"))).otherwise(F.col("confidence")), "area_ratio": F.when(k % 19 == 5, -F.col("area_ratio")).when(k % 31 == 6, F.lit(None)).otherwise(F.col("area_ratio")),
        "method": F.when(k % 23 == 7, "ocr").otherwise(F.col("method")), "w": F.when(k % 37 == 8, -F.col("w")).otherwise(F.col("w")),
    })
    good, bad = quarantine.split(planted, quarantine.region_faults())
    columns = ["doc_id", "region_id"]
    return good.select(*columns, F.lit("").alias("reasons")).unionByName(bad.select(*columns, F.array_join("reasons", ", ").alias("reasons")))


#: JSON texts of documents from orders, the same in both engines: most are sound; some are cut off, lack the id, have no lines or none with text, or a confidence that can't be.
_JSON = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 1 THEN concat('{{"doc_id": ', o_orderkey, ', "lines": [{{"text": "cut o') WHEN o_orderkey % 11 = 2 THEN '{{"lines": [{{"text": "no id", "confidence": 90.0}}]}}'
  WHEN o_orderkey % 7 = 3 THEN concat('{{"doc_id": ', o_orderkey, '}}') WHEN o_orderkey % 9 = 4 THEN concat('{{"doc_id": ', o_orderkey, ', "lines": [{{"text": "  ", "confidence": 50.0}}]}}')
  WHEN o_orderkey % 17 = 5 THEN concat('{{"doc_id": ', o_orderkey, ', "lines": [{{"text": "a", "confidence": 50.0}}, {{"text": "b", "confidence": ', 101 + o_custkey, '.0}}]}}')
  WHEN o_orderkey % 19 = 6 THEN '{{"doc_id": "x", "lines": []}}'
  ELSE concat('{{"doc_id": ', o_orderkey, ', "lines": [{{"text": "', o_orderpriority, '", "confidence": 80.0}}]}}') END AS json FROM {orders}"""


def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from JSON texts: sound ones with their number of lines, the others as error results with their reasons."""
    texts = spark.sql(_JSON, orders=spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")))
    good, bad = quarantine.split(quarantine.parsed_documents(texts), quarantine.document_faults())
    errors = quarantine.error_results(bad.drop("doc_id").withColumnRenamed("k", "doc_id")).withColumnRenamed("doc_id", "k")
    fine = good.select("k", F.lit("").alias("decision"), F.size("lines").alias("n_lines"), F.lit("").alias("reasons"))
    return fine.unionByName(errors.select("k", "decision", F.lit(0).alias("n_lines"), "reasons"))


QUERIES = {f.__name__: f for f in (quarantined_regions, quarantined_documents)}
_K = "(doc_id + 7 * region_id)"
SQL = {
    "quarantined_regions": f"""SELECT doc_id, region_id, concat_ws(', ', CASE WHEN {_K} % 17 = 3 AND confidence > 0 OR {_K} % 17 <> 3 AND {_K} % 29 = 4 THEN 'confidence' END, CASE WHEN {_K} % 19 = 5 AND area_ratio > 0 OR {_K} % 19 <> 5 AND {_K} % 31 = 6 THEN 'area_ratio' END,
      CASE WHEN {_K} % 23 = 7 THEN 'method' END, CASE WHEN {_K} % 37 = 8 THEN 'box' END) AS reasons FROM {_regions_sql(fixtures.DOCUMENT_LINES)} r""",
    "quarantined_documents": """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 1 THEN 'unreadable' WHEN o_orderkey % 11 = 2 THEN 'no id' WHEN o_orderkey % 7 = 3 THEN 'no lines' WHEN o_orderkey % 9 = 4 THEN 'no text'
      WHEN o_orderkey % 17 = 5 THEN 'confidence' WHEN o_orderkey % 19 = 6 THEN 'unreadable' ELSE '' END AS why FROM orders)
      SELECT k, CASE WHEN why = '' THEN '' ELSE 'error' END AS decision, CASE WHEN why = '' THEN 1 ELSE 0 END AS n_lines, CASE WHEN why = '' THEN '' ELSE 'Processing error: ' || why END AS reasons FROM r""",
}
