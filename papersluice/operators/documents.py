"""Structured documents: one VARIANT record per triaged document, whatever its type.

Fields come with their own composite confidence, the record with the triage's
overall confidence and decision. A VARIANT column holds records of any number
of types side by side, can be read by path, and serialises as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.operators.records import field_value
from papersluice.sources import rules

#: Scores of a result under the names that its record has them by.
SCORES = {
    "image_quality_score": "image_quality_score", "ocr_confidence_score": "ocr_confidence_score", "regex_score": "regex_score", "fuzzy_score": "fuzzy_score", "layout_score": "layout_score", "kv_score": "kv_score",
    "consistency_score": "consistency_score", "schema_score": "schema_score", "distribution_score": "distribution_score", "spatial_compactness_score": "spatial_score", "final_score": "final_score",
}
METRICS = ["blur_score", "brightness_score", "resolution_score", "contrast_score", "edge_density", "glare_ratio"]


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, confidence: the words of documents with arrays of lines (text, confidence)."""
    line = docs.select("doc_id", F.explode("lines").alias("l"))
    word = line.select("doc_id", F.explode(F.split(F.trim(F.regexp_replace("l.text", r"\s+", " ")), " ")).alias("text"), F.col("l.confidence").alias("confidence"))
    return word.where("text <> ''")


def fields_of(results: DataFrame) -> DataFrame:
    """doc_id, doc_type, field_name, value: the long table of the fields of results (triage.RESULT)."""
    return results.select("doc_id", "doc_type", F.explode("fields").alias("f")).select("doc_id", "doc_type", "f.field_name", "f.value")


def _document(kind: str, values: Column, confidences: Column) -> Column:
    """A type's fields with their confidences, and the pipeline's verdict; a field without a confidence of its own has the default."""
    parts = []
    for name, default in rules.DEFAULT_CONFIDENCE[kind].items():
        held = F.coalesce(F.try_element_at(confidences, F.lit(name)), F.lit(default))
        plain = field_value(values, name, 1.0)
        parts.append(F.struct(plain["value"].alias("value"), (plain["confidence"] * held).alias("confidence")).alias(name))
    if kind == "pan":
        parts.append(F.coalesce(F.try_element_at(values, F.lit("signature_present")) == "true", F.lit(False)).alias("signature_present"))
    meta = [F.lit(None).cast("string").alias("template_used"), F.lit(0.0).alias("template_confidence"), F.col("final_score").alias("overall_confidence"), F.col("decision").alias("decision")]
    return F.to_variant_object(F.struct(*meta, *parts))


def attach_documents(results: DataFrame, confidences: DataFrame) -> DataFrame:
    """results (triage.RESULT) with `document`, a VARIANT: its type's fields with value and confidence, overall_confidence and decision.

    confidences: doc_id, field_name, ocr, semantic, confidence (as from
    fields.field_confidence(); at most one row a field). Documents without
    any have the default confidences; absent fields have a null value and
    confidence 0; types without fields of their own have a null document.
    `scored` holds the confidences as a map by field name.
    """
    entry = F.struct(
        F.col("field_name"),
        F.struct(F.col("field_name"), F.col("ocr").alias("ocr_confidence"), F.col("semantic").cast("double").alias("semantic_validity"), F.lit(1.0).alias("positional_validity"), F.col("confidence").alias("composite_score")),
    )
    scored = confidences.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("scored"))
    rows = results.hint("merge").join(scored, "doc_id", "left").withColumn("v", F.map_from_entries("fields"))
    composite = F.transform_values("scored", lambda _, s: s["composite_score"])
    composite = F.coalesce(composite, F.create_map().cast("map<string,double>"))
    document = F.lit(None).cast("variant")
    for kind in rules.TYPES:
        document = F.when(F.col("doc_type") == kind, _document(kind, F.col("v"), composite)).otherwise(document)
    return rows.withColumn("document", document).drop("v")


def quality_dict() -> Column:
    """The image metrics of a row (METRICS, image_quality_score, quality_passed, quality_reasons) as a VARIANT."""
    return F.to_variant_object(F.struct(*METRICS, F.col("image_quality_score").alias("composite_score"), F.col("quality_passed").alias("passed"), F.col("quality_reasons").alias("failure_reasons")))


def region_dict(region: Column) -> Column:
    """A region (x, y, w, h, confidence, method, area_ratio) as a VARIANT; no height has aspect 0."""
    aspect = F.when(region["h"] == 0, 0.0).otherwise(region["w"] / region["h"])
    shown = F.struct(F.array(*[region[c] for c in "xywh"]).alias("bbox"), region["confidence"].alias("confidence"), region["method"].alias("detection_method"), region["area_ratio"].alias("area_ratio"), aspect.alias("aspect_ratio"))
    return F.to_variant_object(shown)


def result_records(attached: DataFrame) -> DataFrame:
    """doc_id and `record`, a VARIANT with everything known of a document: type, decision and its details, scores, fields, structured document. attached: as from attach_documents()."""
    scores = F.struct(*[F.col(c).alias(n) for n, c in SCORES.items()], F.coalesce("scored", F.create_map()).alias("field_confidences"))
    details = F.struct(F.col("decision"), F.col("final_score").alias("confidence_score"), F.col("reasons"), F.col("hard_rejection"))
    parts = {"document_type": F.col("doc_type"), "decision": F.col("decision"), "confidence_scores": scores, "decision_details": details, "extracted_fields": F.map_from_entries("fields")}
    stats = F.struct(F.col("total_words"), F.col("ocr_confidence_score").alias("confidence_score"))
    return attached.select("doc_id", F.to_variant_object(F.struct(*[c.alias(n) for n, c in parts.items()], stats.alias("ocr_stats"))).alias("record"), "document")


def read_documents(json: DataFrame) -> DataFrame:
    """doc_id, document_type, decision, hard_rejection, n_reasons, overall_confidence, field_name, value, confidence: every field read back out of JSON texts (doc_id, record, document)."""
    parsed = json.select("doc_id", F.parse_json("record").alias("r"), F.parse_json("document").alias("d"))
    get = lambda c, path, kind: F.variant_get(c, path, kind)
    each = json.sparkSession.tvf.variant_explode(F.col("d").outer())
    return parsed.lateralJoin(each).where(F.try_variant_get("value", "$.confidence", "double").isNotNull()).select(
        "doc_id",
        get("r", "$.document_type", "string").alias("document_type"),
        get("d", "$.decision", "string").alias("decision"),
        get("r", "$.decision_details.hard_rejection", "boolean").alias("hard_rejection"),
        F.size(get("r", "$.decision_details.reasons", "array<string>")).alias("n_reasons"),
        get("d", "$.overall_confidence", "double").alias("overall_confidence"),
        F.col("key").alias("field_name"),
        F.variant_get("value", "$.value", "string").alias("value"),
        F.variant_get("value", "$.confidence", "double").alias("confidence"),
    )
