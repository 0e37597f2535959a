"""Queries over the full triage of cards, and over quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions.dialect import DUCK, SPARK, Dialect, staged
from papersluice.plans import triage as tr
from papersluice.session import read_table
from papersluice.sources import fixtures, rules

METRIC_EXPRS = [
    "CAST(200 + abs(c_acctbal) / 10 AS DOUBLE) AS blur_score", "CAST(15 + doc_id % 220 AS DOUBLE) AS brightness_score", "CAST(100000 * (1 + doc_id % 25) AS DOUBLE) AS resolution_score",
    "CAST((doc_id % 19 + 3) / CAST(20 AS DOUBLE) AS DOUBLE) AS contrast_score", "CAST(0.01 AS DOUBLE) AS edge_density", "CAST((doc_id % 12) / CAST(230 AS DOUBLE) AS DOUBLE) AS glare_ratio",
]
_METRICS = ", ".join(METRIC_EXPRS)


#: What else is known of a document; planted flags for the query that shows every arm of the decision.
_FLAGS = "false AS conflicting_schemas, false AS multi_document, '' AS rule_failures, CAST(1 AS DOUBLE) AS spatial_score"
_PLANTED = """doc_id % 23 = 5 AS conflicting_schemas, doc_id % 11 = 4 AS multi_document,
  CASE WHEN c_acctbal > 6000 THEN 'Amount too large in total_amount' ELSE '' END AS rule_failures, CAST(1 AS DOUBLE) AS spatial_score"""


def input_sql(d: Dialect, customer: str, clean: bool = False, flags: str = _FLAGS) -> str:
    """Card texts as documents with lines, image metrics and flags, all from one scan."""
    lines = d.split("full_text", "chr(10)")
    each = d.map(d.range("0", d.size(lines)), lambda i: d.struct(text=d.at("ls", i), confidence=f"CAST(50 + (doc_id * 31 + {i} * 17) % 50 AS DOUBLE)"), "i")
    cards = fixtures.cards_sql(customer, clean, ", c_acctbal")
    return f"""(SELECT doc_id, {each.replace(d.size(lines), d.size("ls"))} AS lines, {_METRICS}, {flags}
  FROM (SELECT doc_id, c_acctbal, {lines} AS ls FROM ({cards}) c0) c)"""


def card_input(spark: SparkSession, sf_dir: str, clean: bool = False, flags: str = _FLAGS) -> DataFrame:
    return tr.settled(spark.sql(f"SELECT * FROM {input_sql(SPARK, '_customers', clean, flags)}".replace("{", "{{").replace("}", "}}").replace("_customers", "{customer}"), customer=fixtures.customers(spark, sf_dir)))


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.triage(card_input(spark, sf_dir))


def full_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triaged(spark, sf_dir)
    return out.select("doc_id", "doc_type", "decision", F.round("final_score", 9).alias("final_score"), "hard_rejection", F.array_join("reasons", "; ").alias("reasons"), F.size("fields").alias("n_fields"), "total_words")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on cards of which some have conflicting schemas, several documents or failed business rules."""
    out = tr.triage(card_input(spark, sf_dir, flags=_PLANTED))
    return out.select("doc_id", "decision", "hard_rejection", F.round("final_score", 9).alias("final_score"), F.array_join("reasons", "; ").alias("reasons"))


def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for c in tr.RESULT if c.endswith("_score")]
    return triaged(spark, sf_dir).select("doc_id", *[F.round(c, 9).alias(c) for c in names])


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tr.run_stages(fixtures.image_metrics(spark, sf_dir), [tr.quality_gate(SPARK), tr.quality_parts(SPARK), tr.quality_score(SPARK)])
    return m.select("doc_id", "quality_passed", F.array_join("quality_reasons", "; ").alias("reasons"), F.round("image_quality_score", 9).alias("score"), F.col("blur_score"))


def api_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triaged(spark, sf_dir)
    pairs = F.map_from_entries("fields")
    return out.select("doc_id", "decision", F.round("final_score", 3).alias("score"), F.coalesce(F.get("reasons", F.lit(0)), F.lit("-")).alias("reason"), F.coalesce(pairs["name"], pairs["owner_name"]).alias("name"), F.coalesce(pairs["aadhaar_number"], pairs["pan_number"], pairs["registration_number"]).alias("id_number"))


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(spark, sf_dir).rollup("doc_type", "decision").agg(F.count("*").alias("n_docs"), F.round(F.avg("final_score"), 6).alias("mean_score"), F.grouping_id().cast("int").alias("level"))


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records' own confidence (mean over present fields) and decision, by the defaults of each field."""
    out = triaged(spark, sf_dir)
    conf = F.lit(None).cast("map<string,double>")
    for k, fields in rules.DEFAULT_CONFIDENCE.items():
        conf = F.when(F.col("doc_type") == k, F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])).otherwise(conf)
    key = F.create_map(*[F.lit(x) for k, fields in rules.DEFAULT_CONFIDENCE.items() for x in (k, next(iter(fields)))])
    one = out.withColumns({"conf": conf, "key": key[F.col("doc_type")]})
    values = F.filter(F.transform("fields", lambda f: F.struct(f["field_name"].alias("field_name"), f["value"].alias("value"), F.try_element_at("conf", f["field_name"]).alias("confidence"))), lambda f: f["confidence"].isNotNull())
    two = one.withColumn("typed", values)
    mean = F.when(F.size("typed") > 0, F.aggregate("typed", F.lit(0.0), lambda a, f: a + f["confidence"]) / F.size("typed")).otherwise(0.0)
    three = two.withColumn("overall", F.round(mean, 9))
    present = F.exists("typed", lambda f: f["field_name"] == F.col("key"))
    return three.select("doc_id", "doc_type", F.size("typed").alias("n_fields"), "overall", F.when(~present, "REJECT").when(F.col("overall") > 0.85, "ACCEPT").when(F.col("overall") > 0.6, "REVIEW").otherwise("REJECT").alias("typed_decision"))


def split_errors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that can be processed, error rows): a document needs an id and lines; others don't stop the job but give a row of decision 'error'."""
    good = F.col("doc_id").isNotNull() & F.col("lines").isNotNull() & (F.size("lines") > 0) & ~F.exists("lines", lambda x: x["text"].rlike("^###"))
    bad = docs.where(~F.coalesce(good, F.lit(False)))
    errors = bad.select("doc_id", F.lit(None).cast("string").alias("doc_type"), F.lit("error").alias("decision"), F.lit(0.0).alias("final_score"), F.lit(True).alias("hard_rejection"), F.lit("Processing error: unreadable lines").alias("reasons"))
    return docs.where(good), errors


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of any type in one job; unreadable ones (noise) become error rows."""
    good, errors = split_errors(card_input(spark, sf_dir))
    done = tr.triage(good).select("doc_id", "doc_type", "decision", F.round("final_score", 9).alias("final_score"), "hard_rejection", F.array_join("reasons", "; ").alias("reasons"))
    return done.unionByName(errors)


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_errors(card_input(spark, sf_dir))[1]


def threshold_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on either side of the decision thresholds."""
    t = rules.THRESHOLDS
    out = triaged(spark, sf_dir)
    return out.select(F.lit(t["accept"]).alias("accept"), F.lit(t["review"]).alias("review"), (F.col("final_score") >= t["accept"]).alias("above_accept"), (F.col("final_score") >= t["review"]).alias("above_review")).groupBy("accept", "review", "above_accept", "above_review").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (full_triage, decisions, document_confidence, quality_gate, api_view, decision_summary, typed_documents, batch, error_rows, threshold_info)}
_BRANCHES, _BASE = tr.triage_sql(DUCK, input_sql(DUCK, "customer"))
_WITH = f"WITH base AS (SELECT * FROM {_BASE} b), tri AS (SELECT * FROM {_BRANCHES} t)"
_VALUE = lambda *names: "coalesce(" + ", ".join(f"list_filter(fields, lambda x: x.field_name = '{n}')[1].value" for n in names) + ")"
_CONF = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN CASE x.field_name " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in fs.items()) + " END" for k, fs in rules.DEFAULT_CONFIDENCE.items()) + " END"
_KEY = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{next(iter(fs))}'" for k, fs in rules.DEFAULT_CONFIDENCE.items()) + " END"
_ROW = "doc_id, doc_type, decision, round(final_score, 9) AS final_score, hard_rejection, array_to_string(reasons, '; ') AS reasons"
_NOISE = "len(list_filter(lines, lambda x: regexp_matches(x.text, '^###'))) > 0"
_ERROR = f"SELECT doc_id, CAST(NULL AS VARCHAR) AS doc_type, 'error' AS decision, 0.0::DOUBLE AS final_score, true AS hard_rejection, 'Processing error: unreadable lines' AS reasons FROM {input_sql(DUCK, 'customer')} n WHERE {_NOISE}"
#: The chain of decisions, written apart from the stages; only the scores come from there.
_D_BRANCHES, _D_BASE = tr.triage_sql(DUCK, input_sql(DUCK, "customer", flags=_PLANTED))
_SCORE = "printf('%.2f', floor(weighted_score * 100 + 0.5) / 100)"
_DECISIONS = f"""WITH base AS (SELECT * FROM {_D_BASE} b), tri AS (SELECT * FROM {_D_BRANCHES.replace("SELECT " + ", ".join(tr.RESULT), "SELECT *").replace("UNION ALL", "UNION ALL BY NAME")} t),
  a AS (SELECT *, CASE WHEN total_words = 0 THEN 1 WHEN NOT quality_passed THEN 2 WHEN NOT mandatory_present THEN 3 WHEN special_share > 0.85 THEN 4 WHEN conflicting_schemas THEN 5
      WHEN multi_document THEN 6 WHEN weighted_score >= 0.85 THEN 7 WHEN weighted_score >= 0.6 THEN 8 ELSE 9 END AS step,
      CASE WHEN missing_critical <> '' THEN 'Missing critical field(s): ' || missing_critical END AS gap, rule_failures <> '' OR missing_critical <> '' AS failed FROM tri)
SELECT doc_id, CASE WHEN step <= 5 OR step = 9 THEN 'reject' WHEN step = 7 AND NOT failed THEN 'accept' ELSE 'review' END AS decision, step <= 5 AS hard_rejection, CASE WHEN step = 1 THEN 0 ELSE round(weighted_score, 9) END AS final_score,
  concat_ws('; ', nullif(rule_failures, ''), gap, CASE step WHEN 1 THEN 'No text detected in image' WHEN 2 THEN 'Image failed quality gate' WHEN 3 THEN 'Mandatory fields are missing'
      WHEN 4 THEN 'Excessive non-alphanumeric content (' || printf('%.1f', special_share * 100) || '%)' WHEN 5 THEN 'Conflicting document schemas detected (multiple documents in image)'
      WHEN 6 THEN 'Multiple documents detected without clear best candidate'
      WHEN 7 THEN CASE WHEN failed THEN 'Downgraded to REVIEW due to business rule failures' ELSE 'Confidence score ' || {_SCORE} || ' exceeds accept threshold 0.85' END
      WHEN 8 THEN 'Confidence score ' || {_SCORE} || ' in review range [0.6, 0.85)' ELSE 'Confidence score ' || {_SCORE} || ' below review threshold 0.6' END,
    CASE WHEN step = 7 AND image_quality_score > 0.8 THEN 'High image quality' END, CASE WHEN step = 7 AND schema_score > 0.9 THEN 'Strong schema completeness' END,
    CASE WHEN step = 7 AND regex_score > 0.9 THEN 'Strong regex matches' END, CASE WHEN step = 7 AND consistency_score > 0.9 THEN 'Excellent consistency checks' END,
    CASE WHEN step = 8 AND image_quality_score < 0.6 THEN 'Low image quality' END, CASE WHEN step = 8 AND ocr_confidence_score < 0.7 THEN 'Low OCR confidence' END,
    CASE WHEN step = 8 AND schema_score < 0.7 THEN 'Incomplete schema' END, CASE WHEN step = 8 AND regex_score < 0.7 THEN 'Weak regex matches' END,
    CASE WHEN step = 8 AND layout_score < 0.5 THEN 'Poor layout match' END, CASE WHEN step = 8 AND consistency_score < 0.7 THEN 'Consistency issues detected' END,
    CASE WHEN step = 9 AND image_quality_score < 0.5 THEN 'Very poor image quality' END, CASE WHEN step = 9 AND ocr_confidence_score < 0.5 THEN 'Very low OCR confidence' END,
    CASE WHEN step = 9 AND schema_score < 0.5 THEN 'Failed schema validation' END, CASE WHEN step = 9 AND regex_score < 0.5 THEN 'Failed regex validation' END,
    CASE WHEN step = 9 AND layout_score < 0.3 THEN 'Layout does not match expected template' END, CASE WHEN step = 9 AND consistency_score < 0.5 THEN 'Failed consistency checks' END) AS reasons
FROM a"""
_SHOWN = "printf('%.{2}f', floor({0} * {1} + 0.5) / {1})"
SQL = {
    "decisions": _DECISIONS,
    "full_triage": f"{_WITH} SELECT {_ROW}, len(fields) AS n_fields, total_words FROM tri",
    "document_confidence": f"{_WITH} SELECT doc_id, {', '.join(f'round({c}, 9) AS {c}' for c in tr.RESULT if c.endswith('_score'))} FROM tri",
    "quality_gate": f"""WITH m AS ({fixtures.METRICS.format(table="lineitem")}), r AS (SELECT *, concat_ws('; ', CASE WHEN NOT blur_score >= 50 THEN 'Blur score ' || {_SHOWN.format("blur_score", 100, 2)} || ' below threshold 50.0' END,
          CASE WHEN NOT brightness_score BETWEEN 20 AND 240 THEN 'Brightness ' || {_SHOWN.format("brightness_score", 100, 2)} || ' outside range' END, CASE WHEN contrast_score < 0.2 THEN 'Contrast ratio ' || {_SHOWN.format("contrast_score", 100, 2)} || ' below threshold 0.2' END,
          CASE WHEN edge_density < 0.005 THEN 'Edge density ' || {_SHOWN.format("edge_density", 10000, 4)} || ' below threshold 0.005' END, CASE WHEN glare_ratio > 0.05 THEN 'Glare ratio ' || {_SHOWN.format("(glare_ratio * 100)", 10, 1)} || '% exceeds threshold' END) AS reasons FROM m)
      SELECT doc_id, reasons = '' AS quality_passed, reasons, round(0.3 * least(blur_score / 1000, 1) + CASE WHEN brightness_score BETWEEN 20 AND 240 THEN 0.2 - 0.1 * abs(brightness_score - 127.5) / 127.5 ELSE 0 END
        + 0.2 * CASE WHEN resolution_score >= 1920 * 1080 THEN 1 WHEN resolution_score >= 640 * 480 THEN 0.5 + (resolution_score - 640 * 480) / (2.0 * (1920 * 1080 - 640 * 480)) ELSE resolution_score / (640 * 480) END
        + 0.2 * CASE WHEN contrast_score < 0.1 THEN 0 ELSE least(1, 2 * contrast_score) END + 0.1 * CASE WHEN glare_ratio > 0.05 THEN greatest(0, 1 - 20 * glare_ratio) ELSE 1 - 10 * glare_ratio END, 9) AS score, blur_score FROM r""",
    "api_view": f"{_WITH} SELECT doc_id, decision, round(final_score, 3) AS score, coalesce(reasons[1], '-') AS reason, {_VALUE('name', 'owner_name')} AS name, {_VALUE('aadhaar_number', 'pan_number', 'registration_number')} AS id_number FROM tri",
    "decision_summary": f"{_WITH} SELECT doc_type, decision, count(*) AS n_docs, round(avg(final_score), 6) AS mean_score, CAST(grouping(doc_type, decision) AS INT) AS level FROM tri GROUP BY ROLLUP (doc_type, decision)",
    "typed_documents": f"""{_WITH}, c AS (SELECT doc_id, doc_type, {_KEY} AS key, list_filter(list_transform(fields, lambda x: {{'f': x.field_name, 'c': CAST({_CONF} AS DOUBLE)}}), lambda x: x.c IS NOT NULL) AS typed FROM tri),
      o AS (SELECT *, round(CASE WHEN len(typed) > 0 THEN list_sum(list_transform(typed, lambda x: x.c)) / len(typed) ELSE 0 END, 9) AS overall FROM c)
      SELECT doc_id, doc_type, len(typed) AS n_fields, overall, CASE WHEN len(list_filter(typed, lambda x: x.f = key)) = 0 THEN 'REJECT' WHEN overall > 0.85 THEN 'ACCEPT' WHEN overall > 0.6 THEN 'REVIEW' ELSE 'REJECT' END AS typed_decision FROM o""",
    "batch": f"{_WITH} SELECT {_ROW} FROM tri WHERE doc_id NOT IN (SELECT doc_id FROM ({_ERROR}) e) UNION ALL {_ERROR}",
    "error_rows": _ERROR,
    "threshold_info": f"{_WITH} SELECT {rules.THRESHOLDS['accept']}::DOUBLE AS accept, {rules.THRESHOLDS['review']}::DOUBLE AS review, final_score >= {rules.THRESHOLDS['accept']} AS above_accept, final_score >= {rules.THRESHOLDS['review']} AS above_review, count(*) AS n_docs FROM tri GROUP BY ALL",
}
