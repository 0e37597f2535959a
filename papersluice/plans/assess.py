"""Triage with everything else that is known of a document: both passes, the layout of its fields, its regions, business rules.

The decision's inputs come from the operators: where the fields' boxes fall
apart, schemas conflict; more than one region is more than one document; dates
and amounts fail rules. A first pass too weak to be typed gives way to the
enhanced one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions.dialect import DUCK, SPARK
from papersluice.operators import documents, extract, fields, layout
from papersluice.plans import triage as tr
from papersluice.plans.decision_queries import METRIC_EXPRS
from papersluice.plans.join_queries import _fields_sql
from papersluice.plans.layout_queries import dbscan_sql, spatial_sql
from papersluice.session import written
from papersluice.sources import fixtures, rules

#: Boxed lines, and those of an enhanced second pass (null where there is none).
LINES = "ARRAY<STRUCT<line_num INT, text STRING, confidence DOUBLE, x INT, y INT, w INT, h INT>>"


def stronger_pass(docs: DataFrame) -> DataFrame:
    """docs (lines, enhanced) with lines of the pass that is used, and `reclassified`: a first pass without words, or of which no type scores, gives way to an enhanced one with words."""
    first = tr.run_stages(docs, [tr.texts(SPARK), tr.tokens(SPARK), tr.typed(SPARK)])
    weak = (F.size("words") == 0) | (F.greatest(*[F.col(f"score_{k}") for k in rules.TYPES]) == 0)
    more = F.coalesce(F.exists("enhanced", lambda x: F.trim(x["text"]) != ""), F.lit(False))
    used = first.withColumn("reclassified", weak & more)
    lines = F.when(F.col("reclassified"), F.col("enhanced")).otherwise(F.col("lines"))
    return tr.settled(used.withColumn("lines", lines).select(*docs.columns, "reclassified"))


def spatial_flags(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, spatial_score, conflicting_schemas of scored documents: 1 without fields, 0.5 if none of them has a box, else by their boxes; two clusters of boxes conflict."""
    held = documents.fields_of(scored).where("field_name <> 'signature_present'")
    boxes = written(fields.field_boxes(held, lines), "boxes")
    placed = layout.spatial_scores(boxes).select("doc_id", "spatial_score", (F.col("n_clusters") > 1).alias("conflicting_schemas"))
    has = F.exists("fields", lambda f: f["field_name"] != "signature_present")
    score = F.when(~has, 1.0).otherwise(F.coalesce("spatial_score", F.lit(0.5)))
    return scored.select("doc_id", "fields").hint("merge").join(placed, "doc_id", "left").select("doc_id", score.alias("spatial_score"), F.coalesce("conflicting_schemas", F.lit(False)).alias("conflicting_schemas"))


def document_regions(lines: DataFrame, page_w: int, page_h: int, least_confidence: float = 0.3, least_area: float = 0.05) -> DataFrame:
    """Regions of clustered lines that are large and dense enough, without duplicates: doc_id, region_id, x, y, w, h, confidence, area_ratio."""
    points = lines.select("doc_id", F.col("line_num").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
    found = layout.cluster_regions(lines, layout.clusters(points), page_w, page_h).withColumnRenamed("cluster", "region_id")
    high = lines.groupBy("doc_id").agg(F.greatest(F.lit(page_h), F.max(F.col("y") + F.col("h")) + layout.PADDING).alias("high"))
    sized = found.hint("merge").join(high, "doc_id").withColumn("area_ratio", F.col("w") * F.col("h") / (page_w * F.col("high")))
    good = written(layout.filter_regions(sized, least_confidence, least_area), "regions")
    kept = layout.suppress_duplicates(good).select("doc_id", F.explode("kept").alias("region_id"))
    return good.hint("merge").join(kept, ["doc_id", "region_id"]).select("doc_id", "region_id", "x", "y", "w", "h", "confidence", "area_ratio")


def assess(docs: DataFrame, as_of: str, page: tuple[int, int], dates: list[str] = fields.DATE_FIELDS, least_confidence: float = 0.3, least_area: float = 0.05) -> DataFrame:
    """triage.RESULT, reclassified, n_regions of documents with boxed lines.

    docs: doc_id (a key), lines and enhanced (LINES), the metrics of
    triage.INPUT. A document without a region counts as one region, the page.
    """
    used = written(stronger_pass(docs), "used")
    lines = written(used.select("doc_id", F.inline("lines")), "lines")
    scored = written(tr.scored(used.drop("enhanced", "reclassified")), "scored")
    regions = document_regions(lines, *page, least_confidence, least_area).groupBy("doc_id").agg(F.count("*").alias("n_regions"))
    failed = fields.business_rules(documents.fields_of(scored), as_of, dates)
    rows = scored.drop("spatial_score", "conflicting_schemas", "multi_document", "rule_failures").hint("merge").join(spatial_flags(scored, lines), "doc_id").hint("merge").join(regions, "doc_id", "left").hint("merge").join(failed, "doc_id", "left")
    rows = rows.withColumns({"n_regions": F.coalesce("n_regions", F.lit(1)), "rule_failures": F.coalesce("rule_failures", F.lit(""))}).withColumn("multi_document", F.col("n_regions") > 1)
    rows = written(rows, "flagged")
    return tr.decide(tr.settled(rows.select(*tr.SCORED))).hint("merge").join(rows.select("doc_id", "n_regions"), "doc_id").hint("merge").join(used.select("doc_id", "reclassified"), "doc_id")


AS_OF, SECOND_X = "2010-06-30", 900
#: Every sixth first pass is illegible; every eleventh image shows a second card at the right.
_SPOILT, _PASTED = "doc_id % 6 = 1", "doc_id % 11 = 4"


def photo_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of cards: boxed lines of both passes, and metrics."""
    own = fixtures.cards(spark, sf_dir).select("doc_id", "full_text")
    customers = fixtures.customers(spark, sf_dir).withColumnRenamed("c_custkey", "doc_id")
    clean = fixtures.layout_lines(fixtures.cards(spark, sf_dir, clean=True), "full_text")
    beside = fixtures.layout_lines(own.withColumn("doc_id", F.col("doc_id") - 1), "full_text").where(_PASTED).withColumns({"line_num": F.col("line_num") + 100, "x": F.col("x") + SECOND_X})
    first = fixtures.layout_lines(own, "full_text").unionByName(beside)
    seen = first.withColumn("text", F.when(F.expr(_SPOILT), F.lit("~~ ~~")).otherwise(F.col("text")))
    item = F.array_sort(F.collect_list(F.struct("line_num", "text", "confidence", "x", "y", "w", "h")))
    lines = [x.groupBy("doc_id").agg(item.alias(n)) for x, n in ((seen, "lines"), (clean, "enhanced"))]
    return customers.selectExpr("*", *METRIC_EXPRS).drop("c_acctbal").hint("merge").join(lines[0], "doc_id").hint("merge").join(lines[1], "doc_id")


def assessed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on photos of cards, of which some are illegible at first or show two cards."""
    page = (fixtures.PAGE_W * 2, fixtures.PAGE_H)
    out = assess(photo_input(spark, sf_dir), AS_OF, page, fields.ID_DATE_FIELDS, 0.1, 0.005)
    return out.select("doc_id", "doc_type", "reclassified", "n_regions", F.round("spatial_score", 9).alias("spatial_score"), "decision", "hard_rejection", F.round("final_score", 9).alias("final_score"), F.array_join("reasons", "; ").alias("reasons"))


QUERIES = {"assessed_decisions": assessed_decisions}
_LINES_OF = lambda cards: fixtures.lines_sql(cards, "full_text")
_ALIAS = " OR ".join(f"doc_type = '{k}' AND field_name = '{a}'" for k, names in extract.ALIASES.items() for a in names)
#: The pass is chosen by what was spoilt (and by cards of noise, which no type claims, unless another card stands beside them); flags come from pairs of boxes, reachable lines and dates. Types, fields and scores come from the common generator, which other queries check.
_SHOWN = f"""clean AS (SELECT * FROM {fixtures.CLEAN_CARDS} c), own AS (SELECT * FROM {fixtures.CARDS} c), next AS (SELECT doc_id - 1 AS doc_id, full_text FROM own),
  shown AS MATERIALIZED (SELECT * FROM ({_LINES_OF("clean")}) a WHERE {_SPOILT} UNION ALL SELECT * FROM ({_LINES_OF("own")}) b WHERE NOT {_SPOILT}
    UNION ALL SELECT doc_id, line_num + 100, text, confidence, x + {SECOND_X}, y, w, h FROM ({_LINES_OF("next")}) c WHERE {_PASTED} AND NOT {_SPOILT} AND doc_id IN (SELECT c_custkey FROM customer)),
  docs AS MATERIALIZED (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_num) AS full_text, list({{'text': text, 'confidence': confidence}} ORDER BY line_num) AS lines FROM shown GROUP BY doc_id),
  fields AS MATERIALIZED (SELECT * FROM {_fields_sql("docs")} f WHERE NOT ({_ALIAS}) AND field_name <> 'signature_present'),
  held AS MATERIALIZED (SELECT f.doc_id, f.field_name, l.line_num, l.x, l.y, l.w, l.h FROM fields f JOIN shown l ON l.doc_id = f.doc_id AND (contains(lower(trim(l.text)), lower(trim(f.value))) OR contains(lower(trim(f.value)), lower(trim(l.text))))),
  boxes AS MATERIALIZED (SELECT * FROM held h WHERE line_num = (SELECT min(line_num) FROM held g WHERE g.doc_id = h.doc_id AND g.field_name = h.field_name)),
  spread AS MATERIALIZED ({spatial_sql("boxes")}),
  regions AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM ({dbscan_sql("shown", 2 * fixtures.PAGE_W, fixtures.PAGE_H)}) r
    WHERE confidence >= 0.1 AND w * h >= 0.005 * {2 * fixtures.PAGE_W} * greatest({fixtures.PAGE_H}, (SELECT max(s.y + s.h) + 20 FROM shown s WHERE s.doc_id = r.doc_id)) AND w::DOUBLE / h BETWEEN 0.1 AND 10 GROUP BY doc_id),
  births AS (SELECT doc_id, 'Future DOB detected: ' || value AS why FROM fields WHERE field_name = 'date_of_birth' AND try_strptime(value, '%d/%m/%Y') > DATE '{AS_OF}'),
  input AS MATERIALIZED (SELECT d.doc_id, d.lines, {", ".join("m." + x.rsplit(" AS ", 1)[1] for x in METRIC_EXPRS)}, coalesce(s.n_clusters > 1, false) AS conflicting_schemas, coalesce(r.n, 1) > 1 AS multi_document, coalesce(b.why, '') AS rule_failures,
    CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM fields) THEN 1 ELSE coalesce(s.spatial_score, 0.5) END::DOUBLE AS spatial_score, coalesce(r.n, 1) AS n_regions
    FROM docs d JOIN (SELECT doc_id, {", ".join(METRIC_EXPRS)} FROM (SELECT c_custkey AS doc_id, c_acctbal FROM customer) k) m USING (doc_id) LEFT JOIN spread s USING (doc_id) LEFT JOIN regions r USING (doc_id) LEFT JOIN births b USING (doc_id))"""
_BRANCHES, _BASE = tr.triage_sql(DUCK, "(SELECT * EXCLUDE (n_regions) FROM input)")
SQL = {
    "assessed_decisions": f"""WITH {_SHOWN}, base AS (SELECT * FROM {_BASE} b), tri AS (SELECT * FROM {_BRANCHES} t)
  SELECT tri.doc_id, doc_type, tri.{_SPOILT} OR tri.doc_id % 20 = 19 AND NOT (tri.{_PASTED} AND tri.doc_id + 1 IN (SELECT c_custkey FROM customer)) AS reclassified, n_regions, round(tri.spatial_score, 9) AS spatial_score, decision, hard_rejection, round(final_score, 9) AS final_score, array_to_string(reasons, '; ') AS reasons FROM tri JOIN input ON input.doc_id = tri.doc_id""",
}
