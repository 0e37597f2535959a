"""Queries over card texts: extraction of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.operators import extract
from papersluice.sources import fixtures


def _extract(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract.wide(fixtures.cards(spark, sf_dir).where(F.col("true_type") == kind), kind).drop("true_type", "full_text")

    return query


QUERIES = {"extract_aadhaar": _extract("aadhaar"), "extract_pan": _extract("pan"), "extract_rc": _extract("vehicle_rc")}
#: What the cards say, straight from the customers that they are rendered from, and what of it can be read: nothing here comes from the extractors.
_SAYS = """says AS (SELECT c_custkey AS doc_id, translate(lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '0123456789', 'ABCDEFGHIJ') AS l3, translate(CAST(c_custkey % 10 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS l1,
  lpad(CAST(37 * c_custkey % 10000 AS VARCHAR), 4, '0') AS d4, lpad(CAST(7919 * c_custkey % 10000 AS VARCHAR), 4, '0') AS e4, lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS dd, lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS mm, 1950 + c_custkey % 80 AS yyyy,
  c_custkey % 7 = 0 AS confused, c_custkey % 11 = 0 AS twice, c_custkey % 13 = 0 AS no_name FROM customer WHERE c_custkey % 20 <> 19 AND c_custkey % 3 = {rest}),
  d AS (SELECT *, CASE WHEN yyyy <= 2024 THEN concat(dd, '/', mm, '/', yyyy) END AS day FROM says)"""
_NULL = "CAST(NULL AS VARCHAR)"
SQL = {
    # a number that starts with 0 or 1, or stands without blanks, loses to the first twelve digits of the VID; without a name line the address is the first run of capitalised words
    "extract_aadhaar": f"""WITH {_SAYS.format(rest=0)} SELECT doc_id, concat(CASE WHEN NOT confused AND d4 >= '2' THEN d4 ELSE '9' || d4[2:4] END, e4, d4) AS aadhaar_number, concat('9', d4[2:4], e4, d4, e4) AS vid,
      CASE WHEN no_name THEN 'Main Street Sector' ELSE concat('Ra', lower(l3), ' Ku', lower(l1), 'ar') END AS name, day AS date_of_birth, CASE WHEN doc_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
      concat(d4, ' Main Street, Sector ', dd, ', Delhi 11', d4) AS address, concat('11', d4) AS pin_code, {_NULL} AS enrollment_id FROM d""",
    # two sound numbers are one too many; a misread number is repaired unless a sound one stands beside it
    "extract_pan": f"""WITH {_SAYS.format(rest=1)}, n AS (SELECT *, confused AND regexp_matches(d4, '[018]') AS misread FROM d)
      SELECT doc_id, CASE WHEN NOT twice THEN concat(l3, 'P', l1, d4, l1) WHEN misread THEN concat(l3, 'C', l1, e4, l1) END AS pan_number, CASE WHEN NOT no_name THEN concat('RA', l3, ' KU', l1, 'AR') END AS name,
      concat('SA', l3, ' KU', l1, 'AR') AS father_name, day AS date_of_birth, 'true' AS signature_present FROM n""",
    # XX is no state; the class LMV ends in MV, a label of the model, so the next line is taken for one
    "extract_rc": f"""WITH {_SAYS.format(rest=2)} SELECT doc_id, CASE WHEN twice AND confused THEN concat('MH-', mm, '-B', l1, '-', e4) WHEN NOT twice AND NOT confused THEN concat('DL-', dd, '-A', l1, '-', d4) END AS registration_number,
      CASE WHEN NOT no_name THEN concat('RA', l3, ' KU', l1, 'AR') END AS owner_name, 'SEATING CAP' AS vehicle_make_model, concat('E', l3, d4) AS engine_number, concat('MA3', l3, d4, e4) AS chassis_number, day AS registration_date, 'LMV' AS vehicle_class,
      'PETROL' AS fuel_type, '5' AS seating_capacity, {_NULL} AS wheelbase, {_NULL} AS unladen_weight, {_NULL} AS vehicle_color, {_NULL} AS hypothecation, {_NULL} AS fitness_validity_date, concat(dd, '/', mm, '/2030') AS insurance_validity_date, concat(mm, '/', yyyy) AS manufacturing_date FROM d""",
}
