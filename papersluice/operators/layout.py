"""Boxes and regions of a page: metrics, overlaps, suppression, neighbours, clusters. Every join leads with doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersluice.operators.boxes import box, iou, region_overlaps  # noqa: F401
from papersluice.operators.density import EPS, MIN_SAMPLES, density_clusters
from papersluice.operators.greedy import seeds
from papersluice.operators.hull import farthest

MIN_CLUSTER, PADDING = 5, 20


def box_metrics(df: DataFrame) -> DataFrame:
    """area, centre (integer division) and aspect (0 for no height) of x, y, w, h."""
    return df.withColumns({"area": F.col("w") * F.col("h"), "cx": F.expr("CAST(x + w DIV 2 AS INT)"), "cy": F.expr("CAST(y + h DIV 2 AS INT)"), "aspect": F.when(F.col("h") == 0, 0.0).otherwise(F.col("w") / F.col("h"))})


def regions_of(lines: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Candidate regions: a padded box around each line; confidence from the line; share of the page's area."""
    page = Window.partitionBy("doc_id")
    high = F.greatest(F.lit(page_h), F.max(F.col("y") + F.col("h")).over(page) + PADDING)
    x, y = F.greatest(F.col("x") - PADDING, F.lit(0)), F.greatest(F.col("y") - PADDING, F.lit(0))
    w, h = F.least(F.col("x") + F.col("w") + PADDING, F.lit(page_w)) - x, F.least(F.col("y") + F.col("h") + PADDING, high) - y
    return lines.select("doc_id", F.col("line_num").alias("region_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (F.col("confidence") / 100).alias("confidence"), F.lit("text_cluster").alias("method"), (w * h / (page_w * high)).alias("area_ratio"))


def filter_regions(regions: DataFrame, least_confidence: float = 0.3, least_area: float = 0.05) -> DataFrame:
    aspect = F.col("w") / F.col("h")
    return regions.where((F.col("confidence") >= least_confidence) & (F.col("area_ratio") >= least_area) & aspect.between(0.1, 10.0))


def region_valid() -> Column:
    return F.col("confidence").between(0, 1) & F.col("area_ratio").between(0, 1) & F.col("method").isin("contour", "text_cluster", "merged", "full_image")


def shape_confidence(area_ratio: Column, n_vertices: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 * area_ratio + 0.3 * 4 / n_vertices)


def valid_document_shape(shapes: DataFrame, least_area: float = 0.20, most_area: float = 0.95, margin: int = 5) -> DataFrame:
    """Candidate shapes (x, y, w, h, area_ratio, n_vertices, page_w, page_h) that can be documents: size, 4 to 6 vertices, aspect, and off the page's edges unless large."""
    aspect = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0)
    inside = (F.col("x") + F.col("w") <= F.col("page_w") - margin) & (F.col("y") + F.col("h") <= F.col("page_h") - margin)
    sized = F.col("area_ratio").between(least_area, most_area) & F.col("n_vertices").between(4, 6) & aspect.between(0.3, 3.0)
    return shapes.where(sized & (F.col("x") >= margin) & (F.col("y") >= margin) & (inside | (F.col("area_ratio") >= 0.8)))


def region_union(docs: DataFrame, shapes: DataFrame, texts: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Regions of both detectors; documents (doc_id) without any get one of the whole page."""
    columns = ["doc_id", "region_id", "x", "y", "w", "h"]
    found = shapes.select(*columns, shape_confidence(F.col("area_ratio"), F.col("n_vertices")).alias("confidence"), F.lit("contour").alias("method"))
    found = found.unionByName(texts.select(*columns, "confidence", F.lit("text_cluster").alias("method")))
    bare = docs.hint("merge").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = [F.lit(v).alias(c) for c, v in (("region_id", -1), ("x", 0), ("y", 0), ("w", page_w), ("h", page_h), ("confidence", 1.0), ("method", "full_image"))]
    return found.unionByName(bare.select("doc_id", *whole))


def top_regions(regions: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "region_id")
    return regions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def suppress_duplicates(regions: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, kept: a document's regions by confidence (ties by id), each kept unless it overlaps one already kept."""
    chosen = seeds(regions, [F.desc("confidence"), F.col("region_id")], least).where("seed = place")
    return chosen.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "region_id"))), lambda x: x["region_id"]).alias("kept"))


def neighbours(points: DataFrame, eps: int = EPS) -> DataFrame:
    """doc_id, a, b: points (doc_id, id, px, py) within eps of each other, self included. Grid cells of eps make it an equi-join over 3 x 3 cells."""
    cell = lambda c: F.floor(F.col(c) / eps)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    left = points.select("doc_id", F.col("id").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"), cell("px").alias("gx"), cell("py").alias("gy"))
    right = points.select("doc_id", F.col("id").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by"), around("px").alias("gx"))
    right = right.select("doc_id", "b", "bx", "by", "gx", around("by").alias("gy"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return left.hint("merge").join(right, ["doc_id", "gx", "gy"]).where(dx * dx + dy * dy <= eps * eps).select("doc_id", "a", "b")


def clusters(points: DataFrame, eps: int = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """doc_id, id, cluster: density clusters, as in density.density_clusters()."""
    return density_clusters(points, eps, min_samples)


def cluster_regions(lines: DataFrame, labels: DataFrame, page_w: int, page_h: int, least: int = MIN_CLUSTER) -> DataFrame:
    """A padded region around each cluster of at least `least` lines; confidence by density."""
    joined = lines.hint("merge").join(labels.select("doc_id", F.col("id").alias("line_num"), "cluster"), ["doc_id", "line_num"])
    high = F.greatest(F.lit(page_h), F.max(F.col("y") + F.col("h")) + PADDING)
    hull = joined.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.greatest(F.min("x") - PADDING, F.lit(0)).alias("x"), F.greatest(F.min("y") - PADDING, F.lit(0)).alias("y"), F.least(F.max(F.col("x") + F.col("w")) + PADDING, F.lit(page_w)).alias("x2"), F.least(F.max(F.col("y") + F.col("h")) + PADDING, high).alias("y2")).where(F.col("n") >= least)
    w, h = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return hull.select("doc_id", "cluster", "n", "x", "y", w.alias("w"), h.alias("h"), F.round(F.least(F.lit(1.0), 1000 * F.col("n") / (w * h)), 9).alias("confidence"))


def words_in_region(words: DataFrame, regions: DataFrame, band: int = 64) -> DataFrame:
    """doc_id, region_id, text, n_words: words whose centre lies in a region, edges included, in order. A word meets only the regions that reach into its centre's band of pixels in height."""
    bands = F.sequence(F.floor(F.col("y") / band), F.floor((F.col("y") + F.col("h")) / band))
    r = regions.select("doc_id", "region_id", *[F.col(c).alias(f"r{c}") for c in "xywh"], F.explode(bands).alias("band"))
    centred = words.select("doc_id", "line_num", "word_num", "text", F.expr("x + w DIV 2").alias("cx"), F.expr("y + h DIV 2").alias("cy")).withColumn("band", F.floor(F.col("cy") / band))
    inside = F.col("cx").between(F.col("rx"), F.col("rx") + F.col("rw")) & F.col("cy").between(F.col("ry"), F.col("ry") + F.col("rh"))
    item = F.struct("line_num", "word_num", "text")
    met = centred.hint("merge").join(r, ["doc_id", "band"]).where(inside)
    return met.groupBy("doc_id", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_words"))


def spatial_scores(boxes: DataFrame, most: float = 0.5, far: float = 500.0) -> DataFrame:
    """Per document of field boxes (doc_id, x, y, w, h): dispersion of the centres, number of clusters (2 if two are farther apart than `far`), score."""
    c = boxes.select("doc_id", F.expr("CAST(x + w DIV 2 AS DOUBLE)").alias("px"), F.expr("CAST(y + h DIV 2 AS DOUBLE)").alias("py"))
    g = c.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.var_pop("px").alias("vx"), F.var_pop("py").alias("vy"))
    spread = F.when(F.col("n_fields") < 2, 0.0).otherwise(F.sqrt(F.col("vx") + F.col("vy")) / 1000)
    two = g.hint("merge").join(farthest(c), "doc_id", "left").withColumns({"dispersion": F.round(spread, 9), "n_clusters": F.when(F.col("distance") > far, 2).otherwise(1)})
    score = 1 - F.least(F.lit(1.0), F.col("dispersion") / most)
    return two.select("doc_id", "n_fields", "dispersion", "n_clusters", F.round(F.when(F.col("n_clusters") > 1, score * 0.5).otherwise(score), 9).alias("spatial_score"))


def merge_overlaps(regions: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, region_id, n, x, y, w, h, confidence: in the order of region_id each region joins the first seed that it overlaps, else it is a seed itself; seeds become the hull of their members with the mean confidence."""
    joined = seeds(regions, [F.col("region_id")], least)
    hull = joined.groupBy("doc_id", "seed").agg(
        F.min_by("region_id", "place").alias("region_id"), F.count("*").cast("int").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.round(F.avg("confidence"), 9).alias("confidence"),
    )
    return hull.select("doc_id", "region_id", "n", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "confidence")


def layout_scores(lines: DataFrame, docs: DataFrame, page_h: int) -> DataFrame:
    """Per document of docs (doc_id, doc_type): share of its type's layout anchors whose line lies in their band of the page, and whether enough do."""
    from papersluice.sources import rules

    pages = lines.groupBy("doc_id").agg(F.greatest(F.lit(page_h), F.max(F.col("y") + F.col("h")) + PADDING).alias("high"), F.collect_list(F.struct(F.lower("text").alias("t"), (F.col("y") + F.col("h") / 2).alias("c"))).alias("ls"))
    middle = {"top": 0.0, "center": 0.5, "bottom": 1.0}

    def placed(word: str, band: str, off: float) -> Column:
        return F.exists("ls", lambda x: F.contains(x["t"], F.lit(word)) & (F.abs(x["c"] / F.col("high") - middle[band]) <= off)).cast("int")

    n, of = F.lit(0), F.lit(1)
    for kind, anchors in rules.LAYOUT.items():
        hits = F.lit(0)
        for word, band, off in anchors:
            hits = hits + placed(word, band, off)
        n, of = F.when(F.col("doc_type") == kind, hits).otherwise(n), F.when(F.col("doc_type") == kind, len(anchors)).otherwise(of)
    return docs.hint("merge").join(pages, "doc_id").select("doc_id", "doc_type", n.alias("n_found"), F.round(n / of, 9).alias("layout_score"), (n >= rules.LAYOUT_LEAST).alias("enough"))
