"""Queries over page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersluice.functions import sql
from papersluice.operators import classify, layout, words
from papersluice.session import read_table, spread
from papersluice.sources import fixtures, rules
from papersluice.sources.fixtures import PADDING, PAGE_H, PAGE_W


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regions_of(fixtures.document_lines(spark, sf_dir), PAGE_W, PAGE_H)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.document_lines(spark, sf_dir)
    return lines.select("doc_id", F.col("line_num").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))


def box_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.box_metrics(fixtures.document_lines(spark, sf_dir)).select("doc_id", "line_num", "area", "cx", "cy", F.round("aspect", 9).alias("aspect"))


def region_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.filter_regions(_regions(spark, sf_dir).where(layout.region_valid()), 0.3, 0.005)
    return found.select("doc_id", "region_id", "confidence", F.round("area_ratio", 9).alias("area_ratio"), F.round(layout.shape_confidence(F.col("area_ratio"), F.lit(4)), 9).alias("shape_confidence"), (F.count("*").over(Window.partitionBy("doc_id")) > 1).alias("multi_document"))


def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.region_overlaps(_regions(spark, sf_dir), 0.1).withColumn("iou", F.round("iou", 9))


def region_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best regions of each document."""
    return layout.top_regions(_regions(spark, sf_dir), 5).select("doc_id", "region_id", "rank", "confidence")


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppress_duplicates(_regions(spark, sf_dir), 0.1).select("doc_id", F.explode("kept").alias("region_id"))


def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_overlaps(_regions(spark, sf_dir), 0.1)


def layout_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = classify.classify(fixtures.cards(spark, sf_dir), "full_text").select("doc_id", "doc_type")
    return layout.layout_scores(fixtures.card_lines(spark, sf_dir), typed, PAGE_H)


def word_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean length of a document's words is in its type's range."""
    docs = classify.classify(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    mean = F.length(F.regexp_replace("text", r"\s+", "")) / F.size(tokens)
    low, high = (F.create_map(*[F.lit(v) for k, p in rules.PROFILES.items() for v in (k, p[i])])[F.col("doc_type")] for i in (2, 3))
    return docs.select("doc_id", "doc_type", F.when(F.size(tokens) > 0, F.round(mean, 9)).alias("mean_length"), F.coalesce(mean.between(low, high), F.lit(False)).alias("in_range"))


def box_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.neighbours(_points(spark, sf_dir)).where("a < b")


def dbscan_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.document_lines(spark, sf_dir)
    return layout.cluster_regions(lines, layout.clusters(_points(spark, sf_dir)), PAGE_W, PAGE_H)


def words_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of cards inside the padded boxes of their lines."""
    lines = fixtures.card_lines(spark, sf_dir)
    return layout.words_in_region(words.line_words(lines), layout.regions_of(lines, PAGE_W, PAGE_H))


def spatial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spatial_scores(fixtures.card_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (box_metrics, region_filters, region_overlaps, region_topk, nms, merge_overlaps, layout_score, word_length_profile, box_neighbours, dbscan_regions, words_in_region, spatial_score)}


def _regions_sql(lines: str) -> str:
    return f"""(SELECT doc_id, region_id, x, y, w, h, confidence, (w * h)::DOUBLE / ({PAGE_W} * high) AS area_ratio FROM (SELECT doc_id, line_num AS region_id, confidence / 100 AS confidence, high,
      greatest(x - {PADDING}, 0) AS x, greatest(y - {PADDING}, 0) AS y, least(x + w + {PADDING}, {PAGE_W}) - greatest(x - {PADDING}, 0) AS w, least(y + h + {PADDING}, high) - greatest(y - {PADDING}, 0) AS h
      FROM (SELECT *, greatest({PAGE_H}, max(y + h) OVER (PARTITION BY doc_id) + {PADDING}) AS high FROM {lines} l0) l1) l2)"""


def spatial_sql(boxes: str) -> str:
    return f"""WITH c AS MATERIALIZED (SELECT doc_id, (x + w // 2)::DOUBLE AS cx, (y + h // 2)::DOUBLE AS cy FROM {boxes} l),
      f AS (SELECT a.doc_id, max(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS far FROM c a JOIN c b USING (doc_id) GROUP BY a.doc_id),
      g AS (SELECT doc_id, count(*) AS n_fields, round(CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(var_pop(cx) + var_pop(cy)) / 1000 END, 9) AS dispersion FROM c GROUP BY doc_id),
      s AS (SELECT g.*, CASE WHEN far > 500 THEN 2 ELSE 1 END AS n_clusters, 1 - least(1.0::DOUBLE, dispersion / 0.5::DOUBLE) AS v FROM g JOIN f USING (doc_id))
      SELECT doc_id, n_fields, dispersion, n_clusters, round(CASE WHEN n_clusters > 1 THEN v * 0.5 ELSE v END, 9) AS spatial_score FROM s"""


_LINES, _R = fixtures.DOCUMENT_LINES, _regions_sql(fixtures.DOCUMENT_LINES)
_LENGTHS = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN m BETWEEN {p[2]} AND {p[3]}" for k, p in rules.PROFILES.items()) + " END"
_TYPED = sql.classified("documents", "coalesce(text, '')", "doc_id, text")
SQL = {
    "word_length_profile": rf"""SELECT doc_id, doc_type, round(m, 9) AS mean_length, coalesce({_LENGTHS}, false) AS in_range FROM (SELECT doc_id, doc_type,
      length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE / nullif(len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')), 0) AS m FROM {_TYPED} c) d""",
    "box_metrics": f"SELECT doc_id, line_num, w * h AS area, CAST(x + w // 2 AS INT) AS cx, CAST(y + h // 2 AS INT) AS cy, round(CASE WHEN h = 0 THEN 0 ELSE w::DOUBLE / h END, 9) AS aspect FROM {_LINES} l",
    "region_filters": f"SELECT doc_id, region_id, confidence, round(area_ratio, 9) AS area_ratio, round(least(1.0::DOUBLE, 0.7::DOUBLE * area_ratio + 0.3::DOUBLE), 9) AS shape_confidence, count(*) OVER (PARTITION BY doc_id) > 1 AS multi_document FROM {_R} r WHERE confidence >= 0.3 AND area_ratio >= 0.005 AND w::DOUBLE / h BETWEEN 0.1 AND 10",
    "region_overlaps": f"""WITH r AS MATERIALIZED (SELECT * FROM {_R} q), p AS (SELECT a.doc_id, a.region_id AS a, b.region_id AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih, a.w * a.h + b.w * b.h AS s
        FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.region_id < b.region_id AND b.y <= a.y + a.h AND a.y <= b.y + b.h)
      SELECT doc_id, a, b, round((iw * ih)::DOUBLE / (s - iw * ih), 9) AS iou FROM p WHERE iw > 0 AND ih > 0 AND (iw * ih)::DOUBLE / (s - iw * ih) >= 0.1""",
    "region_topk": f"SELECT doc_id, region_id, CAST(rank AS INT) AS rank, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, region_id) AS rank FROM {_R} r) k WHERE rank <= 5",
    "box_neighbours": f"SELECT a.doc_id, a.line_num AS a, b.line_num AS b FROM {_LINES} a JOIN {_LINES} b ON a.doc_id = b.doc_id AND a.line_num < b.line_num AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500",
    "words_in_region": f"""SELECT w.doc_id, region_id, string_agg(text, ' ' ORDER BY line_num, word_num) AS text, count(*) AS n_words FROM {sql.words(fixtures.CARD_LINES)} w JOIN {_regions_sql(fixtures.CARD_LINES)} r
      ON w.doc_id = r.doc_id AND w.x + w.w // 2 BETWEEN r.x AND r.x + r.w AND w.y + w.h // 2 BETWEEN r.y AND r.y + r.h GROUP BY w.doc_id, region_id""",
    "spatial_score": spatial_sql(fixtures.CARD_LINES),
}


def _greedy_sql(order: str) -> str:
    """Regions in an order, one after the other: the place of the first seed that each overlaps, its own if there is none."""
    inter = "greatest(0, least(k.x + k.w, n.x + n.w) - greatest(k.x, n.x)) * greatest(0, least(k.y + k.h, n.y + n.h) - greatest(k.y, n.y))"
    held = f"list_filter(s.kept, lambda k: ({inter})::DOUBLE / (k.w * k.h + n.w * n.h - {inter}) >= 0.1)"
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS place FROM {_R} r),
  walk(doc_id, place, seed, kept) AS (SELECT doc_id, place, place, [{{'place': place, 'x': x, 'y': y, 'w': w, 'h': h}}] FROM o WHERE place = 1
    UNION ALL SELECT n.doc_id, n.place, coalesce(({held})[1].place, n.place), CASE WHEN len({held}) > 0 THEN s.kept ELSE list_append(s.kept, {{'place': n.place, 'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h}}) END
    FROM walk s JOIN o n ON n.doc_id = s.doc_id AND n.place = s.place + 1)"""


SQL["nms"] = f"WITH RECURSIVE {_greedy_sql('confidence DESC, region_id')} SELECT o.doc_id, o.region_id FROM walk JOIN o USING (doc_id, place) WHERE walk.seed = walk.place"
SQL["merge_overlaps"] = f"""WITH RECURSIVE {_greedy_sql('region_id')} SELECT o.doc_id, min(o.region_id) AS region_id, CAST(count(*) AS INT) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(avg(confidence), 9) AS confidence
  FROM walk JOIN o USING (doc_id, place) GROUP BY o.doc_id, walk.seed"""
def dbscan_sql(lines: str, page_w: int, page_h: int) -> str:
    """Neighbours by pairs, clusters by reachability."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, line_num AS i, x, y, w, h FROM {lines} l),
  n AS MATERIALIZED (SELECT a.doc_id, a.i AS a, b.i AS b FROM p a JOIN p b ON a.doc_id = b.doc_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2500),
  core AS MATERIALIZED (SELECT doc_id, a FROM n GROUP BY doc_id, a HAVING count(*) >= 3), e AS MATERIALIZED (SELECT n.* FROM n JOIN core USING (doc_id, a) JOIN core d ON d.doc_id = n.doc_id AND d.a = n.b),
  reach(doc_id, a, b) AS (SELECT doc_id, a, a FROM core UNION SELECT r.doc_id, r.a, e.b FROM reach r JOIN e ON e.doc_id = r.doc_id AND e.a = r.b),
  named AS (SELECT doc_id, b AS a, min(a) AS c FROM reach GROUP BY doc_id, b),
  member AS (SELECT doc_id, a, c FROM named UNION ALL SELECT n.doc_id, n.a, min(m.c) FROM n JOIN named m ON m.doc_id = n.doc_id AND m.a = n.b
    WHERE NOT EXISTS (SELECT 1 FROM core k WHERE k.doc_id = n.doc_id AND k.a = n.a) GROUP BY n.doc_id, n.a),
  b AS (SELECT p.doc_id, c AS cluster, count(*) AS n, greatest(min(x) - 20, 0) AS x, greatest(min(y) - 20, 0) AS y, least(max(x + w) + 20, {page_w}) AS x2, greatest({page_h}, max(y + h) + 20) AS high, max(y + h) + 20 AS y2
    FROM p JOIN member ON p.doc_id = member.doc_id AND p.i = member.a GROUP BY p.doc_id, c HAVING count(*) >= 5)
  SELECT doc_id, cluster, n, x, y, x2 - x AS w, least(y2, high) - y AS h, round(least(1.0, 1000.0 * n / ((x2 - x) * (least(y2, high) - y))), 9)::DOUBLE AS confidence FROM b"""


SQL["dbscan_regions"] = dbscan_sql(_LINES, PAGE_W, PAGE_H)
_ANCHOR_ROWS = ", ".join(f"('{t}', '{w}', {({'top': 0.0, 'center': 0.5, 'bottom': 1.0})[band]}, {off})" for t, rows in rules.LAYOUT.items() for w, band, off in rows)
SQL["layout_score"] = f"""WITH a(doc_type, word, middle, off) AS (VALUES {_ANCHOR_ROWS}), d AS (SELECT doc_id, doc_type FROM {sql.classified(fixtures.CARDS, "full_text")} c),
  l AS (SELECT *, greatest({PAGE_H}, max(y + h) OVER (PARTITION BY doc_id) + 20) AS high FROM {fixtures.CARD_LINES} z),
  f AS (SELECT d.doc_id, d.doc_type, a.word, count(*) FILTER (contains(lower(l.text), a.word) AND abs((l.y + l.h / 2.0) / l.high - a.middle) <= a.off) AS hits FROM d JOIN a USING (doc_type) JOIN l USING (doc_id) GROUP BY ALL)
  SELECT doc_id, doc_type, CAST(count(*) FILTER (hits > 0) AS INT) AS n_found, round(count(*) FILTER (hits > 0) / count(*)::DOUBLE, 9) AS layout_score, count(*) FILTER (hits > 0) >= 2 AS enough FROM f GROUP BY doc_id, doc_type"""

