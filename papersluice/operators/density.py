"""Density clusters (DBSCAN) by cells instead of pairs.

Cells have a diagonal of eps, so all points of a cell are neighbours: a cell
with min_samples points has core points only, without a pair being looked at,
and all core points of a cell belong to one cluster. Only points of sparser
cells (fewer than min_samples a cell) count their neighbours. Cells are linked
if two of their core points are within eps. The closest points of two cells
stand at the ends of their rows or columns, so a cell sends only these: with
whole pixels a number that eps bounds, however many points it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.session import written

EPS, MIN_SAMPLES = 50, 3


def _offsets(half: bool) -> Column:
    """Cells that can hold a point within eps: two away in each direction. half: each pair of cells once, without the cell itself."""
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if not half or (i, j) > (0, 0)]
    return F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in steps])).alias("o")


def _within(eps: float) -> Column:
    dx, dy = F.col("px").cast("double") - F.col("qx"), F.col("py").cast("double") - F.col("qy")
    return dx * dx + dy * dy <= eps * eps


def _other(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("doc_id", "gx", "gy", F.col("px").alias("qx"), F.col("py").alias("qy"), *keep)


def cell_ends(spots: DataFrame) -> DataFrame:
    """doc_id, gx, gy, node, px, py: of each cell the ends of its rows and columns of points."""
    cell = ["doc_id", "gx", "gy", "node"]
    end = lambda line, along: spots.groupBy(*cell, line).agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    rows = end("py", "px").select(*cell, F.explode(F.array("lo", "hi")).alias("px"), "py")
    columns = end("px", "py").select(*cell, "px", F.explode(F.array("lo", "hi")).alias("py"))
    return rows.unionByName(columns).distinct()


def _least_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, node, label: the least node of each component; labels spread to neighbours and jump to their own label's label until nothing changes."""
    both = written(edges.unionByName(edges.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(nodes.select("doc_id", "node", F.col("node").alias("label")), "labels")
    while both.take(1):
        met = both.hint("merge").join(labels.select("doc_id", F.col("node").alias("b"), "label"), ["doc_id", "b"]).select("doc_id", F.col("a").alias("node"), "label")
        near = met.unionByName(labels.select("doc_id", "node", "label")).groupBy("doc_id", "node").agg(F.min("label").alias("label"))
        near = written(near, "labels")
        up = near.select("doc_id", F.col("node").alias("label"), F.col("label").alias("up"))
        after = written(near.hint("merge").join(up, ["doc_id", "label"]).select("doc_id", "node", F.col("up").alias("label")), "labels")
        moved = after.hint("merge").join(labels.withColumnRenamed("label", "was"), ["doc_id", "node"]).where("label <> was").take(1)
        labels = after
        if not moved:
            break
    return labels


def density_clusters(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """doc_id, id, cluster of the points (doc_id, id, px, py; ids are unique within a document) that belong to one.

    A point is core with min_samples points within eps, itself included;
    connected cores make a cluster, named by its least core id; other points
    within eps of a core join the least such cluster; the rest is noise and has
    no row. Points without a place have none. Equal places are points of their own.
    """
    side = eps / math.sqrt(2) * (1 - 1e-12)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    at = ["doc_id", "gx", "gy"]
    placed = points.where("px IS NOT NULL AND py IS NOT NULL").select("doc_id", "id", "px", "py", cell("px").alias("gx"), cell("py").alias("gy"))
    spots = written(placed.groupBy(*at, "px", "py").agg(F.count("*").alias("m"), F.min("id").alias("id")), "spots")
    full = spots.groupBy(*at).agg((F.sum("m") >= min_samples).alias("dense"))
    spots = written(spots.hint("merge").join(full, at), "spots")
    around = spots.where("NOT dense").select("doc_id", "px", "py", "gx", "gy", _offsets(False))
    around = around.select("doc_id", "px", "py", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    many = around.hint("merge").join(_other(spots, "m"), at).where(_within(eps)).groupBy("doc_id", "px", "py").agg((F.sum("m") >= min_samples).alias("enough"))
    judged = spots.hint("merge").join(many, ["doc_id", "px", "py"], "left").withColumn("core", F.col("dense") | F.coalesce("enough", F.lit(False)))
    judged = written(judged.drop("enough", "dense"), "judged")
    named = judged.where("core").groupBy(*at).agg(F.min("id").alias("node"))
    cores = written(judged.where("core").hint("merge").join(named, at), "cores")
    ends = written(cell_ends(cores), "ends")
    ahead = ends.select("*", _offsets(True))
    ahead = ahead.select("doc_id", F.col("node").alias("a"), "px", "py", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    edges = ahead.hint("merge").join(_other(ends, "node"), at).where(_within(eps)).select("doc_id", "a", F.col("node").alias("b")).distinct()
    labels = _least_labels(written(edges, "edges"), named.select("doc_id", "node"))
    border = judged.where("NOT core").select("doc_id", "px", "py", "gx", "gy", _offsets(False))
    border = border.select("doc_id", "px", "py", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    joins = border.hint("merge").join(_other(ends, "node"), at).where(_within(eps)).hint("merge").join(labels, ["doc_id", "node"]).groupBy("doc_id", "px", "py").agg(F.min("label").alias("cluster"))
    own = cores.select("doc_id", "px", "py", "node").hint("merge").join(labels, ["doc_id", "node"]).select("doc_id", "px", "py", F.col("label").alias("cluster"))
    return placed.hint("merge").join(own.unionByName(joins), ["doc_id", "px", "py"]).select("doc_id", "id", "cluster")
