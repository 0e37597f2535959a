"""Queries over texts and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions import sql, text
from papersluice.operators import classify as cl
from papersluice.operators import words as wo
from papersluice.session import read_table, spread
from papersluice.sources import fixtures, rules

AS_OF = "2001-08-01"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, over all cores: many expressions look at every text."""
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.classify(_documents(spark, sf_dir), "text").drop("text")


def documents_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_documents(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("n_docs"), F.sum("score_vehicle_rc").alias("rc_score"))


def full_text_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wo.full_text(fixtures.document_lines(spark, sf_dir))


def explode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wo.line_words(fixtures.document_lines(spark, sf_dir))


def word_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wo.numeric_words(wo.by_confidence(wo.line_words(fixtures.document_lines(spark, sf_dir)), 80.0))


def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wo.ocr_stats(wo.plain_words(fixtures.document_lines(spark, sf_dir)))


def digit_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wo.digit_runs(wo.line_words(fixtures.card_lines(spark, sf_dir)))


def token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cl.classify(_documents(spark, sf_dir), "text")
    t = F.col("text")
    return docs.select("doc_id", "doc_type", text.digit_ratio(t).alias("digit_ratio"), text.special_ratio(t).alias("special_ratio"), text.distribution_score(t, F.col("doc_type")).alias("distribution_score"))


def kv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", *[text.kv_score(t, k).alias(f"kv_{k}") for k in ("invoice", "id_document", "aadhaar")])


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        text.collapse_ws(t).alias("collapsed"),
        text.clean_ocr_noise(t).alias("cleaned"),
        text.numeric_confusions(t).alias("numeric"),
        text.devanagari_digits(t).alias("digits"),
        text.squeeze_layout(t).alias("squeezed"),
        text.split_camel(t).alias("camel"),
    )


def business_rules_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, as_of = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    shown = F.date_format(day, "yyyy-MM-dd")
    orders = read_table(spark, sf_dir, "orders")
    reasons = F.array(text.date_reason(day, shown, "invoice_date", as_of), text.date_reason(day, shown, "date_of_birth", as_of), text.date_reason(day, shown, "expiry_date", as_of), text.amount_reason(F.col("o_totalprice"), "total_amount", 0.0, 400_000.0))
    kept = F.filter(reasons, lambda r: r.isNotNull())
    return orders.select("o_orderkey", F.array_join(kept, "; ").alias("reasons"), (F.size(kept) == 0).alias("passed"))


def _ratio(t: str, p: str) -> str:
    return f"CASE WHEN length({t}) > 0 THEN length(regexp_replace({t}, '{p}', '', 'g'))::DOUBLE / length({t}) ELSE 0.0 END"


_DIST = "CASE WHEN length(text) = 0 OR text IS NULL THEN 0.0 " + "".join(
    f"WHEN doc_type = '{k}' THEN greatest(0.0::DOUBLE, 1.0 - (CASE WHEN digit_ratio < {a} THEN ({a}::DOUBLE - digit_ratio) / {a}::DOUBLE * 0.5 ELSE 0 END) - (CASE WHEN special_ratio > {b} THEN (special_ratio - {b}::DOUBLE) / (1.0::DOUBLE - {b}::DOUBLE) * 0.8 ELSE 0 END)) "
    for k, (a, b, _, _) in rules.PROFILES.items()
) + "ELSE 1.0 END::DOUBLE"

QUERIES = {f.__name__: f for f in (classify_documents, documents_per_type, full_text_rebuild, explode_words, word_filters, ocr_confidence, digit_triples, token_distribution, kv_scores, normalise_text, business_rules_orders)}
_CLASSIFIED = sql.classified("documents", "coalesce(text, '')")
_WORDS = sql.words(fixtures.DOCUMENT_LINES)
SQL = {
    "classify_documents": f"SELECT * FROM {_CLASSIFIED} c",
    "documents_per_type": f"SELECT doc_type, count(*) AS n_docs, sum(score_vehicle_rc) AS rc_score FROM {_CLASSIFIED} c GROUP BY doc_type",
    "full_text_rebuild": f"SELECT doc_id, string_agg(text, chr(10) ORDER BY line_num) AS full_text FROM {fixtures.DOCUMENT_LINES} l GROUP BY doc_id",
    "explode_words": f"SELECT * FROM {_WORDS} w",
    "word_filters": f"SELECT * FROM {_WORDS} w WHERE confidence >= 80 AND is_numeric",
    "ocr_confidence": f"SELECT * FROM {sql.stats(_WORDS)} s",
    "digit_triples": f"""SELECT * FROM (SELECT doc_id, line_num, word_num, s || lead(s, 1) OVER o || lead(s, 2) OVER o AS value
        FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS s FROM {sql.words(fixtures.CARD_LINES)} w0) w WHERE length(s) = 4 WINDOW o AS (PARTITION BY doc_id ORDER BY line_num, word_num)) t WHERE value IS NOT NULL""",
    "token_distribution": f"""SELECT doc_id, doc_type, digit_ratio, special_ratio, {_DIST} AS distribution_score FROM (SELECT doc_id, doc_type, text,
        {_ratio("text", "[^0-9]")} AS digit_ratio, {_ratio("text", "[\\pL\\pN\\s]")} AS special_ratio FROM {sql.classified("documents", "coalesce(text, '')", "doc_id, text")} c) d""",
    "kv_scores": """SELECT doc_id, least(1.0, 0.5 + CASE WHEN contains(lower(text), 'total') AND regexp_matches(text, '[0-9]') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text), 'invoice') THEN 0.2 ELSE 0 END)::DOUBLE AS kv_invoice,
        least(1.0, 0.5 + CASE WHEN contains(lower(text), 'dob') OR contains(lower(text), 'birth') THEN 0.25 ELSE 0 END
          + CASE WHEN contains(lower(text), 'id') OR contains(lower(text), 'no.') OR contains(lower(text), 'number') THEN 0.25 ELSE 0 END)::DOUBLE AS kv_id_document, 0.5::DOUBLE AS kv_aadhaar FROM documents""",
    "normalise_text": r"""SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS collapsed,
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[।॥|]+', '', 'g'), '\s+[-–—]\s+', ' ', 'g'), '[^\pL\pN_\s\x{0900}-\x{097F}.,/:()\-]', '', 'g'), '\s+', ' ', 'g')) AS cleaned,
        regexp_replace(translate(t, 'OoIliSsBGZz', '00111558622'), '[^0-9.,-]', '', 'g') AS numeric, translate(t, '०१२३४५६७८९', '0123456789') AS digits,
        regexp_replace(regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), '\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS squeezed,
        trim(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS camel FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d""",
    "business_rules_orders": f"""SELECT o_orderkey, array_to_string(r, '; ') AS reasons, len(r) = 0 AS passed FROM (SELECT o_orderkey, list_filter([
          CASE WHEN d > a + 1 THEN 'Future date detected in invoice_date: ' || s WHEN a - d > 365 THEN 'Date too old in invoice_date: ' || s || ' (> 365 days)' END,
          CASE WHEN d > a THEN 'Future DOB detected: ' || s WHEN a - d > 43800 THEN 'DOB unreasonably old: ' || s END,
          CASE WHEN o_totalprice <= 0 THEN 'Amount too small in total_amount' WHEN o_totalprice > 400000 THEN 'Amount too large in total_amount' END], lambda x: x IS NOT NULL) AS r
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS s, DATE '{AS_OF}' AS a FROM orders) o) p""",
}
