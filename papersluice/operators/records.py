"""Missing fields, choice of recognition passes, typed records, values beside labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.functions import text
from papersluice.sources import rules

#: How far below a label its value may stand, in pixels.
BELOW = 60


def _lists(kind: Column, lists: dict[str, list[str]], otherwise: list[str]) -> Column:
    literal = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return reduce(lambda out, k: F.when(kind == k, literal(lists[k])).otherwise(out), lists, literal(otherwise))


def missing_fields(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, doc_type): required and critical fields that it lacks. Types without rules need the general fields."""
    have = fields.groupBy("doc_id").agg(F.collect_set("field_name").alias("have"))
    critical = {k: [f for f, w in ws.items() if w >= rules.CRITICAL_WEIGHT] for k, ws in rules.FIELD_WEIGHTS.items()}
    joined = docs.hint("merge").join(have, "doc_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    lacks = lambda lists, other: F.array_sort(F.array_except(_lists(F.col("doc_type"), lists, other), "have"))
    two = joined.withColumns({"required": lacks(rules.REQUIRED, rules.REQUIRED_ELSE), "critical": lacks(critical, [])})
    return two.select("doc_id", "doc_type", F.array_join("required", ", ").alias("missing_required"), F.array_join("critical", ", ").alias("missing_critical"), (F.size("required") == 0).alias("all_required"))


def two_passes(one: DataFrame, two: DataFrame, missing: DataFrame, scores: DataFrame) -> DataFrame:
    """Per document of scores (doc_id, top_score): whether it needs a second pass, whether the first is too weak to be typed, and which pass is primary.

    one, two: statistics of words of either pass; missing: as from missing_fields() of the first.
    """
    a = one.select("doc_id", F.col("ocr_score").alias("score"), F.col("total_words").alias("n1"))
    b = two.select("doc_id", F.col("total_words").alias("n2"))
    rows = scores.hint("merge").join(a, "doc_id", "left").hint("merge").join(b, "doc_id", "left").hint("merge").join(missing.select("doc_id", "all_required"), "doc_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    needs = ~((F.coalesce("score", F.lit(0.0)) > 0.9) & F.coalesce("all_required", F.lit(False)))
    weak = (count("n1") == 0) | (F.col("top_score") == 0)
    return rows.select("doc_id", needs.alias("needs_second"), weak.alias("weak"), F.when(needs & (count("n2") > count("n1")), 2).otherwise(1).alias("primary_pass"))


def registration_words(words: DataFrame) -> DataFrame:
    """doc_id, value: the first word of a document that is a registration number by itself, once all but letters and digits is stripped. Only sound words leave their partition."""
    bare = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    sound = words.select("doc_id", "line_num", "word_num", bare.alias("t")).where(text.valid_registration(F.col("t")))
    first = sound.groupBy("doc_id").agg(F.min(F.struct("line_num", "word_num", "t")).alias("f"))
    return first.select("doc_id", text.format_registration(F.col("f.t")).alias("value"))


def field_value(values: Column, name: str, confidence: float) -> Column:
    """struct(value, confidence) of a field; an absent or empty one has confidence 0."""
    value = F.nullif(F.try_element_at(values, F.lit(name)), F.lit(""))
    return F.struct(value.alias("value"), F.when(value.isNotNull(), confidence).otherwise(0.0).alias("confidence"))


def typed_records(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, document_type, and one struct for each type, of which that of the document's type isn't null."""
    pairs = fields.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("field_name", "value"))).alias("v"))
    rows = docs.hint("merge").join(pairs, "doc_id", "left").withColumn("v", F.coalesce("v", F.create_map().cast("map<string,string>")))
    v = F.col("v")

    def record(kind: str) -> Column:
        parts = [field_value(v, n, c).alias(n) for n, c in rules.DEFAULT_CONFIDENCE[kind].items()]
        if kind == "pan":
            parts.append(F.coalesce(F.try_element_at(v, F.lit("signature_present")) == "true", F.lit(False)).alias("signature_present"))
        return F.when(F.col("doc_type") == kind, F.struct(*parts)).alias(kind)

    return rows.select("doc_id", F.col("doc_type").alias("document_type"), *[record(k) for k in rules.TYPES])


def to_json_record() -> Column:
    """A typed record as nested JSON; absent parts are left out."""
    return F.to_json(F.struct("doc_id", "document_type", *rules.TYPES))


def label_value_proximity(words: DataFrame, labels: list[str], below: int = BELOW) -> DataFrame:
    """doc_id, label, value, gap: per label the nearest other word right of it in its line, or below it within reach and overlapping in width. Labels meet the words of their own line, and those of their own band of pixels and the next."""
    w = words.withColumn("is_label", F.lower("text").isin(labels))
    a = w.where("is_label").select("doc_id", F.lower("text").alias("label"), F.col("line_num").alias("al"), F.col("word_num").alias("aw"), *[F.col(c).alias(f"a{c}") for c in ("x", "y")], F.col("w").alias("width"))
    b = w.where("NOT is_label").select("doc_id", "text", "line_num", "word_num", "x", "y", "w")
    end = F.col("ax") + F.col("width")
    right = a.hint("merge").join(b.withColumn("ay", F.col("y")), ["doc_id", "ay"]).where(F.col("x") >= end).withColumn("gap", F.col("x") - end)
    band = lambda c: F.floor(F.col(c) / below)
    reach = a.select("*", F.explode(F.sequence(band("ay"), band("ay") + 1)).alias("band")).hint("merge").join(b.withColumn("band", band("y")), ["doc_id", "band"])
    under = reach.where((F.col("y") > F.col("ay")) & (F.col("y") <= F.col("ay") + below) & (F.col("x") < end) & (F.col("x") + F.col("w") > F.col("ax"))).withColumn("gap", F.col("y") - F.col("ay"))
    keep = ["doc_id", "label", "al", "aw", "gap", "line_num", "word_num", "text"]
    met = right.select(*keep).unionByName(under.select(*keep))
    best = met.groupBy("doc_id", "label", "al", "aw").agg(F.min(F.struct("gap", "line_num", "word_num", "text")).alias("m"))
    return best.select("doc_id", "label", F.col("m.text").alias("value"), F.col("m.gap").alias("gap"))
