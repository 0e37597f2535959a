"""Triage of document types that exist only as rows of the rule tables.

Keywords and patterns choose the type, labelled_values find its fields, weights
and required fields score them, anchors are sought by similarity; the decision
is the one of all documents. Types of the library keep their own branches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions.dialect import SPARK
from papersluice.operators import classify, keywords
from papersluice.plans import triage as tr
from papersluice.session import dealt, read_table, written
from papersluice.sources import rules

#: Documents that a task holds with all their lines, words and fields.
DOCS_A_TASK = 50_000


def type_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_type and all its rules in one row: values, weights, their total, required, anchors (classify.holds_anchor()), n_asked of them required, profile; empty arrays or null where a table has none."""
    a = F.struct("required", "threshold", F.lower("anchor").alias("low"), F.size(classify.lower_words(F.col("anchor"))).alias("n"), classify.sorted_words(F.col("anchor")).alias("wanted"))
    parts = [
        tables["labelled_values"].select("type", F.struct("field_name", "place", "pattern").alias("values")),
        tables["field_weights"].select("type", F.struct("field_name", "weight").alias("weights")),
        tables["required_fields"].select("type", F.col("field_name").alias("required")),
        tables["anchors"].select("type", a.alias("anchors")),
        tables["profiles"].select("type", F.struct("min_numeric", "max_special").alias("profile")),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).where("type IS NOT NULL")
    lists = [F.array_sort(F.collect_list(c)).alias(c) for c in ("values", "weights", "required", "anchors")]
    rows = rows.groupBy("type").agg(*lists, F.count_if("anchors.required").alias("n_asked"), F.min("profile").alias("profile"))
    return rows.withColumn("total", _sum("weights", lambda w: w["weight"])).withColumnRenamed("type", "doc_type")


def _sum(rows: str, number: Callable[[Column], Column]) -> Column:
    """Sum over an array, in its order; nulls count nothing."""
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.coalesce(number(r), F.lit(0.0)))


#: Per document, first what its type's patterns find, by field and place; then each field's first value. text, values.
LABELLED = [
    {"found": "array_sort(filter(transform(values, v -> named_struct('field_name', v.field_name, 'place', v.place, 'value', trim(regexp_extract(text, v.pattern, 1)))), f -> f.value <> ''))"},
    {"fields": "transform(filter(found, (f, i) -> i = 0 OR NOT (f.field_name <=> get(found, i - 1).field_name)), f -> named_struct('field_name', f.field_name, 'value', f.value))"},
]


#: What the library's own branches need of a document besides triage.RESULT.
OWN = [c for c in tr.BASE if c not in tr.RESULT]


def _by_rules(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """docs (triage.BASE) with triage.RESULT for those of types without a branch; the library's types keep OWN, which is null for the others.

    A document meets the one row of its type's rules; everything about it is
    computed from its own row, without a row a field or an anchor. `text` is
    null for the library's types, so that nothing is sought in them.
    """
    d, own = SPARK, F.col("doc_type").isin(*rules.TYPES)
    rows = docs.withColumns({"rule_type": F.when(~own, F.col("doc_type")), "text": F.when(~own, F.col("full_text")), **{c: F.when(own, F.col(c)) for c in ("full_text", "line_texts", "word_texts")}})
    rows = rows.join(F.broadcast(type_rules(tables).withColumnRenamed("doc_type", "rule_type")), "rule_type", "left").drop("rule_type")
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("values", "weights", "required", "anchors")}
    rows = rows.withColumns(empty | {"low": F.lower("text"), "held": classify.lower_words(F.col("text"))})
    rows = tr.run_stages(tr.settled(rows), LABELLED)
    present = lambda name: F.coalesce(F.exists("fields", lambda f: f["field_name"] == name), F.lit(False))
    has = F.transform("weights", lambda w: F.struct(w["field_name"].alias("field_name"), w["weight"].alias("weight"), present(w["field_name"]).alias("has")))
    rows = tr.settled(rows.withColumns({"weights": has, "lacks": F.exists("required", lambda r: r.isNotNull() & ~present(r))}).drop("found", "values", "required"))
    critical = F.transform(F.filter("weights", lambda w: ~w["has"] & (w["weight"] >= rules.CRITICAL_WEIGHT)), lambda w: w["field_name"])
    found = lambda required: F.size(F.filter("anchors", lambda a: (a["required"] == F.lit(required)) & classify.holds_anchor(F.col("low"), F.col("held"), a)))
    size, chars = F.greatest(F.length("text"), F.lit(1)), F.length("text")
    others = lambda p: F.length(F.regexp_replace("text", p, ""))
    rows = rows.withColumns({
        "schema_score": F.coalesce(F.try_divide(_sum("weights", lambda w: F.when(w["has"], w["weight"])), "total"), F.lit(0.0)),
        "missing_critical": F.array_join(F.array_sort(critical), ", "), "required_present": (F.size("weights") == 0) | ~F.col("lacks"), "n_met": found(True), "n_more": found(False),
        "digit_share": others("[^0-9]+") / size, "special_share": F.when(chars > 0, 1 - (chars - others(r"[\p{L}\p{N}\s]+")) / size).otherwise(0.0),
        "min_numeric": F.col("profile.min_numeric"), "max_special": F.col("profile.max_special"),
    }).drop("low", "held", "lacks", "weights", "total", "anchors", "profile")
    fuzzy = F.least(F.lit(1.0), F.try_divide("n_met", "n_asked") + F.least(F.lit(0.2), F.col("n_more") * 0.05))
    short = F.when(F.col("digit_share") < F.col("min_numeric"), (F.col("min_numeric") - F.col("digit_share")) / F.col("min_numeric") * 0.5).otherwise(0.0)
    over = F.when(F.col("special_share") > F.col("max_special"), (F.col("special_share") - F.col("max_special")) / (1 - F.col("max_special")) * 0.8).otherwise(0.0)
    spread_score = F.when(F.length("text") == 0, 0.0).when(F.col("min_numeric").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - short - over))
    rows = rows.withColumns({
        "fuzzy_score": F.when(F.col("n_asked") > 0, fuzzy).otherwise(0.0), "regex_score": F.col("schema_score"), "layout_score": F.col("ocr_confidence_score"), "kv_score": F.lit(0.5), "distribution_score": spread_score,
        "consistency_score": F.when(F.col("required_present"), 1.0).otherwise(0.5), "mandatory_present": F.col("required_present") & (F.col("missing_critical") == ""),
    }).drop("text")
    return tr.run_stages(tr.settled(rows), [tr.final(d), *tr.decided(d)]).select(*tr.RESULT, *OWN)


def triage_by_rules(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """docs with the columns of triage.INPUT to triage.RESULT; types from the rule tables (rules.rule_tables()).

    Documents without any hit are of the first type in rules.TIE_ORDER; ties go
    to the library's types. A type without weights has a schema score of 0,
    without required fields none is missing, without anchors a fuzzy score of
    0, without a profile a distribution score of 1.

    All documents are typed, and those of types without a branch decided, in one
    pass that is written once; the library's branches read it. Only rule tables
    too large for the workers take joins, by doc_id.
    """
    docs = docs.withColumns({c: F.expr(v) for c, v in tr.FLAGS.items() if c not in docs.columns})
    base = tr.settled(tr.run_stages(docs, tr.unsorted(SPARK))).select(*[c for c in tr.BASE if c != "doc_type"])
    kind = keywords.best_type(F.col("full_text"), tables, rules.TIE_ORDER)
    if kind is None:
        base = written(base, "read")
        best = keywords.best_types(keywords.rule_scores(base.select("doc_id", "full_text"), "full_text", tables), rules.TIE_ORDER)
        typed = dealt(base, "doc_id", DOCS_A_TASK).hint("merge").join(best.select("doc_id", "doc_type"), "doc_id", "left")
    else:
        typed = base.withColumn("doc_type", kind)
    typed = typed.withColumn("doc_type", F.coalesce("doc_type", F.lit(rules.TIE_ORDER[0])))
    done = written(_by_rules(typed.select(*tr.BASE), tables), "typed")
    out = done.where(~F.col("doc_type").isin(*rules.TYPES)).select(*tr.RESULT)
    for k in rules.TYPES:
        out = out.unionByName(tr.run_stages(done.where(F.col("doc_type") == k).select(*tr.BASE), tr.branch(SPARK, k)).select(*tr.RESULT))
    return out


#: A type of its own: order slips.
ORDER_SLIP = rules.DocumentType(
    "order_slip",
    ["order slip", "order no", "total amount", "ship to"],
    [r"order\s+no\.?\s*[0-9]+"],
    {"order_number": 0.5, "total": 0.3, "order_date": 0.2},
    ["order_number", "total"],
    {"order_number": [r"Order No\.? ([0-9]+)"], "total": [r"Total Amount: ([0-9.]+)", r"(?i)sum ([0-9.]+)"], "order_date": [r"Date: ([0-9]{4}-[0-9]{2}-[0-9]{2})"], "priority": [r"Priority: ([A-Z0-9 -]+)"]},
    ["order slip", "total amount"],
    ["ship to"],
)
#: Slips rendered from orders, the same text in both engines; some lack the total, some the date, some have a misread label.
SLIPS = """SELECT o_orderkey AS doc_id, concat_ws(chr(10), CASE WHEN o_orderkey % 9 = 0 THEN 'ORDER SLlP' ELSE 'ORDER SLIP' END, concat('Order No. ', CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat('Sum ', CAST(o_custkey * 2 AS STRING)) ELSE concat('Total Amount: ', CAST(o_custkey * 3 AS STRING)) END,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Date: ', substring(CAST(o_orderdate AS STRING), 1, 10)) END, concat('Priority: ', o_orderpriority), 'Ship to: the usual place') AS full_text FROM {orders}"""


def slip_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slips as triage input, without image metrics."""
    orders = dealt(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), "o_orderkey", DOCS_A_TASK)
    slips = spark.sql(SLIPS, orders=orders)
    lines = F.transform(F.split("full_text", "\n"), lambda t, i: F.struct(t.alias("text"), (70 + (F.col("doc_id") + i) % 30).cast("double").alias("confidence")))
    metrics = ("blur_score", "brightness_score", "resolution_score", "contrast_score", "edge_density", "glare_ratio")
    return tr.settled(slips.select("doc_id", lines.alias("lines"), *[F.lit(None).cast("double").alias(m) for m in metrics]))


def slip_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order slips from text to decision: a type that only the rule tables know."""
    out = triage_by_rules(slip_input(spark, sf_dir), rules.rule_tables(spark, [ORDER_SLIP]))
    value = lambda n: F.try_element_at(F.map_from_entries("fields"), F.lit(n)).alias(n)
    rounded = [F.round(c, 9).alias(c) for c in ("schema_score", "fuzzy_score", "final_score")]
    return out.select("doc_id", "doc_type", *[value(n) for n in ORDER_SLIP.values], "missing_critical", *rounded, "decision", F.array_join("reasons", "; ").alias("reasons"))


QUERIES = {"slip_triage": slip_triage}
#: Written apart from the rules and the operators. Every slip has enough words of good confidence and no metrics, so the image scores 1.
SQL = {
    "slip_triage": """WITH s AS (""" + SLIPS.format(orders="orders").replace("AS STRING", "AS VARCHAR") + """),
  w AS (SELECT *, string_split(full_text, chr(10)) AS ls FROM s),
  t AS (SELECT doc_id, full_text, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM w),
  k AS (SELECT doc_id, 70 + (doc_id + i) % 30 AS c, unnest(string_split(l, ' ')) AS word FROM t),
  o AS (SELECT doc_id, sum(c * wt) / sum(wt) AS mean, avg(CASE WHEN num THEN 1 ELSE 0 END) AS nums FROM
    (SELECT *, CASE WHEN word IN ('the', 'to') THEN 0.3 WHEN num THEN 1.5 ELSE 1 END AS wt FROM (SELECT *, 2 * length(regexp_replace(word, '[^0-9]', '', 'g')) > length(regexp_replace(word, '[,.$]', '', 'g')) AS num FROM k) q) r GROUP BY doc_id),
  f AS (SELECT doc_id, full_text, CAST(doc_id AS VARCHAR) AS order_number, nullif(coalesce(nullif(regexp_extract(full_text, 'Total Amount: ([0-9]+)', 1), ''), regexp_extract(full_text, 'Sum ([0-9]+)', 1)), '') AS total,
    nullif(regexp_extract(full_text, 'Date: (\\d+-\\d+-\\d+)', 1), '') AS order_date, trim(split_part(regexp_extract(full_text, 'Priority: ([^\\n]+)', 1), 'zzz', 1)) AS priority_text FROM s),
  g AS (SELECT f.*, regexp_extract(priority_text, '^[A-Z0-9 -]+') AS priority, least(1, least(1, mean / 100 + least(0.1, 0.2 * nums))) AS ocr,
    (50 + CASE WHEN total IS NULL THEN 0 ELSE 30 END + CASE WHEN order_date IS NULL THEN 0 ELSE 20 END) / 100.0::DOUBLE AS schema_score,
    least(1, CASE WHEN contains(full_text, 'Total Amount') THEN 1.0 WHEN list_max(list_transform(range(1, len(string_split_regex(lower(full_text), '\\s+'))), lambda i: 1 - levenshtein(array_to_string(list_sort(string_split_regex(lower(full_text), '\\s+')[i:i + 1]), ' '), 'amount total')::DOUBLE / greatest(12, length(array_to_string(list_sort(string_split_regex(lower(full_text), '\\s+')[i:i + 1]), ' '))))) >= 0.8 THEN 1.0 ELSE 0 END / 2
      + 0.5 + 0.05) AS fuzzy_score FROM f JOIN o USING (doc_id)),
  h AS (SELECT *, round(0.1 + 0.15 * ocr + 0.1 * schema_score + 0.1 * fuzzy_score + 0.1 * ocr + 0.05 + 0.1 * CASE WHEN total IS NULL THEN 0.5 ELSE 1 END + 0.15 * schema_score + 0.05 + 0.05, 9) AS final_score,
    CASE WHEN total IS NULL THEN 'total' ELSE '' END AS missing_critical FROM g)
  SELECT doc_id, 'order_slip' AS doc_type, order_number, total, order_date, nullif(trim(priority), '') AS priority, missing_critical, round(schema_score, 9) AS schema_score, round(fuzzy_score, 9) AS fuzzy_score, final_score,
    CASE WHEN total IS NULL THEN 'reject' WHEN final_score >= 0.85 THEN 'accept' WHEN final_score >= 0.6 THEN 'review' ELSE 'reject' END AS decision,
    CASE WHEN total IS NULL THEN 'Missing critical field(s): total; Mandatory fields are missing' ELSE concat_ws('; ', 'Confidence score ' || printf('%.2f', floor(final_score * 100 + 0.5) / 100) || CASE WHEN final_score >= 0.85 THEN ' exceeds accept threshold 0.85' ELSE ' in review range [0.6, 0.85)' END,
      CASE WHEN final_score >= 0.85 THEN 'High image quality' END, CASE WHEN final_score >= 0.85 AND schema_score > 0.9 THEN 'Strong schema completeness' END, CASE WHEN final_score >= 0.85 AND schema_score > 0.9 THEN 'Strong regex matches' END,
      CASE WHEN final_score >= 0.85 THEN 'Excellent consistency checks' END, CASE WHEN final_score < 0.85 AND ocr < 0.7 THEN 'Low OCR confidence' END, CASE WHEN final_score < 0.85 AND schema_score < 0.7 THEN 'Incomplete schema' END,
      CASE WHEN final_score < 0.85 AND schema_score < 0.7 THEN 'Weak regex matches' END, CASE WHEN final_score < 0.85 AND ocr < 0.5 THEN 'Poor layout match' END) END AS reasons FROM h""",
}
