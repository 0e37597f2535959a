"""Joins and aggregates over the long table of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.functions import text
from papersluice.operators.containment import containments
from papersluice.session import written
from papersluice.sources import rules


def _cases(kind: str, pick: dict[str, list[str]]) -> Column:
    """Whether field_name is in its type's list."""
    out = F.lit(False)
    for k, names in pick.items():
        out = out | ((F.col(kind) == k) & F.col("field_name").isin(names))
    return out


def merge_passes(one: DataFrame, two: DataFrame) -> DataFrame:
    """Fields of two recognition passes: the second wins on a type's priority fields; elsewhere the first wins and the second fills gaps. The second's Aadhaar number is the id_number too."""
    a = one.select("doc_id", "doc_type", "field_name", F.col("value").alias("v1"))
    b = two.select("doc_id", F.col("doc_type").alias("t2"), "field_name", F.col("value").alias("v2"))
    both = a.hint("merge").join(b, ["doc_id", "field_name"], "full_outer").withColumn("doc_type", F.coalesce("doc_type", "t2"))
    value = F.when(_cases("doc_type", rules.PRIORITY), F.coalesce("v2", "v1")).otherwise(F.coalesce("v1", "v2"))
    numbers = two.where("doc_type = 'aadhaar' AND field_name = 'aadhaar_number'").select("doc_id", "doc_type", F.lit("id_number").alias("field_name"), "value")
    return both.select("doc_id", "doc_type", "field_name", value.alias("value")).unionByName(numbers)


def schema_scores(docs: DataFrame, fields: DataFrame, weights: DataFrame, required: DataFrame) -> DataFrame:
    """Per document: weight of the present fields over all, missing required fields, missing critical fields. docs: doc_id, doc_type. The rule tables are sent to the workers: their size is unknown to the planner, and a type is no key to deal documents by."""
    have = fields.select("doc_id", "field_name").distinct().withColumn("has", F.lit(True))
    wanted = docs.join(F.broadcast(weights.withColumnRenamed("type", "doc_type")), "doc_type").hint("merge").join(have, ["doc_id", "field_name"], "left")
    present = F.coalesce(F.col("has"), F.lit(False))
    score = wanted.groupBy("doc_id", "doc_type").agg(
        (F.sum(F.when(present, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("schema_score"),
        F.array_sort(F.collect_list(F.when(~present & (F.col("weight") >= rules.CRITICAL_WEIGHT), F.col("field_name")))).alias("missing_critical"),
    )
    missing = docs.join(F.broadcast(required.withColumnRenamed("type", "doc_type")), "doc_type").hint("merge").join(have, ["doc_id", "field_name"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list("field_name")).alias("missing_required"))
    return score.hint("merge").join(missing, "doc_id", "left").withColumn("missing_required", F.coalesce("missing_required", F.array().cast("array<string>")))


def field_confidence(fields: DataFrame, words: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, doc_type, field_name, n_words, ocr, semantic, confidence of every text field (signature_present is a flag and has none).

    ocr: the mean confidence of the document's words that the value holds or
    that hold it, blanks and case aside; n_words of them, as containments()
    finds them. Without such words the document's recognition score
    counts (scores: doc_id, ocr_score; 0 if it has none). confidence: 0.4 ocr,
    0.4 whether the value makes sense, 0.2 for a good position. Null values
    make no row.
    """
    v, t = F.lower(F.replace("value", F.lit(" "), F.lit(""))), F.lower(F.trim("text"))
    rows = fields.where("value IS NOT NULL AND field_name <> 'signature_present'").withColumn("v", v)
    share = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    w = written(words.select("doc_id", t.alias("t"), share.alias("c")).where("t <> ''").groupBy("doc_id", "t").agg(F.sum("c").alias("c"), F.count("*").alias("n")), "shown")
    met = containments(written(rows.select("doc_id", "v").distinct(), "asked"), w)
    known = met.groupBy("doc_id", "v").agg((F.sum("c") / F.sum("n")).alias("ocr"), F.sum("n").alias("n_words"))
    out = rows.hint("merge").join(known, ["doc_id", "v"], "left").hint("merge").join(scores.select("doc_id", "ocr_score"), "doc_id", "left").withColumn("ocr", F.coalesce("ocr", "ocr_score", F.lit(0.0)))
    out = out.withColumn("semantic", semantic_valid(F.col("doc_type"), F.col("field_name"), F.col("value")).cast("int"))
    composite = 0.4 * F.col("ocr") + 0.4 * F.col("semantic") + 0.2
    return out.select("doc_id", "doc_type", "field_name", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.round("ocr", 9).alias("ocr"), "semantic", F.round(composite, 9).alias("confidence"))


def semantic_valid(kind: Column, field: Column, v: Column) -> Column:
    """Whether a value is meaningful for its field; fields without a rule are."""
    day = v.rlike(r"[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}")
    letters, digits = F.regexp_count(v, F.lit(r"[\p{L} ,.\-/]")), F.regexp_count(v, F.lit("[0-9]"))
    address = (F.length(v) >= 20) & (letters / F.greatest(F.length(v), F.lit(1)) > 0.5) & ~v.rlike(r"(?i)\b(VID|MALE|FEMALE)\b|पुरुष|महिला") & (digits / F.greatest(F.length(v), F.lit(1)) < 0.5)
    tests = {
        "aadhaar": {"aadhaar_number": F.regexp_replace(v, r"[\s.-]+", "").rlike(r"^[2-9][0-9]{11}\z"), "date_of_birth": day, "gender": F.upper(v).isin("MALE", "FEMALE", "TRANSGENDER", "पुरुष", "महिला"), "pin_code": F.trim(v).rlike(r"^[0-9]{6}\z"), "vid": F.regexp_replace(v, r"\s+", "").rlike(r"^[0-9]{16}\z"), "address": address},
        "pan": {"pan_number": F.upper(F.trim(v)).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z"), "date_of_birth": day},
        "vehicle_rc": {"registration_number": F.upper(F.trim(v)).rlike(r"^[A-Z]{2}\s*[0-9]{1,2}\s*[A-Z]{0,3}\s*[0-9]{1,4}\z"), "engine_number": F.length(F.trim(v)) >= 5, "chassis_number": F.length(F.trim(v)) >= 5, "registration_date": day, "fuel_type": F.upper(v).isin("PETROL", "DIESEL", "CNG", "LPG", "ELECTRIC", "HYBRID")},
    }
    out = F.lit(True)
    for k, fields in tests.items():
        for f, ok in fields.items():
            out = F.when((kind == k) & (field == f), ok).otherwise(out)
    return out


def pattern_scores(fields: DataFrame) -> DataFrame:
    """Per document: share of its fields with a configured pattern that match it."""
    checks = F.lit(None).cast("boolean")
    for k, patterns in rules.FIELD_PATTERNS.items():
        for f, p in patterns.items():
            checks = F.when((F.col("doc_type") == k) & (F.col("field_name") == f), F.col("value").rlike(f"^({p})\\z")).otherwise(checks)
    judged = fields.withColumn("ok", checks).where("ok IS NOT NULL")
    return judged.groupBy("doc_id", "doc_type").agg(F.count("*").alias("n_fields"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("pattern_score"))


def consistency(fields: DataFrame, as_of: str) -> DataFrame:
    """Per document: birth in the past and an age to 150; registration not before manufacturing; fitness and insurance not before registration. Absent or unreadable dates pass."""
    day = lambda f: F.max(F.when(F.col("field_name") == f, F.try_to_timestamp(F.regexp_replace("value", "[.-]", "/"), F.lit("d/M/yyyy")).cast("date")))
    made = F.max(F.when(F.col("field_name") == "manufacturing_date", F.regexp_extract("value", r"([0-9]{4})\z", 1).try_cast("int")))
    d = fields.groupBy("doc_id").agg(day("date_of_birth").alias("dob"), day("registration_date").alias("reg"), day("fitness_validity_date").alias("fit"), day("insurance_validity_date").alias("ins"), made.alias("made"))
    now = F.lit(as_of).cast("date")
    ok = lambda c: F.coalesce(c, F.lit(True))
    return d.select("doc_id", ok((F.col("dob") <= now) & (F.year(now) - F.year("dob") <= 150)).alias("dob_ok"), ok(F.year("reg") >= F.col("made")).alias("registration_ok"), ok(F.col("fit") >= F.col("reg")).alias("fitness_ok"), ok(F.col("ins") >= F.col("reg")).alias("insurance_ok"))


def field_boxes(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Per field: the first line that holds its value or is held by it, and that line's box. Both tables, and the distinct values, are stored once: they are read several times."""
    held = written(fields.select("doc_id", "field_name", F.lower(F.trim("value")).alias("v")), "held")
    shown = lines.select("doc_id", "line_num", F.lower(F.trim("text")).alias("t"), "x", "y", "w", "h")
    first = written(shown.groupBy("doc_id", "t").agg(F.min(F.struct("line_num", "x", "y", "w", "h")).alias("b")), "shown")
    met = containments(written(held.select("doc_id", "v").distinct(), "asked"), first)
    best = met.groupBy("doc_id", "v").agg(F.min("b").alias("b"))
    return held.hint("merge").join(best, ["doc_id", "v"]).select("doc_id", "field_name", "b.*")


#: Fields that business rules look at: dates that shouldn't lie in the future or too far back, and amounts. Identity documents have dates of their own.
DATE_FIELDS, ID_DATE_FIELDS = ["date", "invoice_date", "bill_date", "due_date"], ["date_of_birth", "dob", "issue_date"]
AMOUNT_FIELDS = ["total_amount", "amount", "grand_total", "net_amount"]


def business_rules(fields: DataFrame, as_of: str, dates: list[str] = DATE_FIELDS, amounts: list[str] = AMOUNT_FIELDS, max_age: int = 365, least: float = 0.0, most: float = 1_000_000.0) -> DataFrame:
    """doc_id, rule_failures (reasons joined by '; ') of documents with fields that fail a rule: dates first, in the order of the lists. fields: doc_id, field_name, value; values that can't be read pass."""
    asked = fields.where(F.col("field_name").isin(dates + amounts) & F.col("value").isNotNull())
    bare = F.regexp_replace("value", "[.-]", "/")
    day = F.coalesce(F.try_to_timestamp(bare, F.lit("d/M/yyyy")), F.try_to_timestamp(bare, F.lit("yyyy/M/d"))).cast("date")
    why, now = F.lit(None).cast("string"), F.lit(as_of).cast("date")
    for name in dates:
        why = F.when(F.col("field_name") == name, text.date_reason(day, F.col("value"), name, now, max_age)).otherwise(why)
    for name in amounts:
        why = F.when(F.col("field_name") == name, text.amount_reason(F.col("value"), name, least, most)).otherwise(why)
    failed = asked.select("doc_id", F.array_position(F.array(*[F.lit(n) for n in dates + amounts]), F.col("field_name")).alias("place"), why.alias("why")).where("why IS NOT NULL")
    listed = failed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "why"))).alias("r"))
    return listed.select("doc_id", F.array_join(F.transform("r", lambda x: x["why"]), "; ").alias("rule_failures"))
