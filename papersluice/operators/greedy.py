"""Greedy choice among overlapping regions, by rounds over the graph of overlaps.

In a given order each region is a seed unless an earlier seed overlaps it. A
region without an undecided earlier neighbour is decided at once, so each round
takes all such local firsts of all documents together and drops what they
overlap; the result is that of the sequential order. Dense pages are done after
a few rounds. What is left after ROUNDS are long chains, in which each region
waits for the one before: these are walked per document, in time linear in
their overlaps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersluice.operators.boxes import region_overlaps
from papersluice.session import written

ROUNDS = 6


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """doc_id, b: what is dropped of one document's remaining overlaps (a before b)."""
    dropped: set[int] = set()
    for a, b in edges.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
        if a not in dropped:
            dropped.add(b)
    return pd.DataFrame({"doc_id": edges["doc_id"].iloc[0], "b": sorted(dropped)})


def dropped(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, b: the regions that an earlier kept one overlaps. edges: doc_id, a, b (distinct; a comes before b)."""
    left, out = edges, []
    for _ in range(rounds or ROUNDS):
        firsts = left.select("doc_id", "a").distinct().hint("merge").join(left.select("doc_id", F.col("b").alias("a")), ["doc_id", "a"], "left_anti")
        hit = written(left.hint("merge").join(firsts, ["doc_id", "a"]).select("doc_id", "b").distinct(), "hit")
        out.append(hit)
        gone = hit.withColumnRenamed("b", "a")
        rest = left.hint("merge").join(firsts, ["doc_id", "a"], "left_anti").hint("merge").join(gone, ["doc_id", "a"], "left_anti").hint("merge").join(hit, ["doc_id", "b"], "left_anti")
        left = written(rest.select("doc_id", "a", "b"), "overlaps")
        if not left.take(1):
            break
    else:
        kind = left.select("doc_id").schema.simpleString()[len("struct<") : -1]
        out.append(left.groupBy("doc_id").applyInPandas(_walk, f"{kind}, b long"))
    all_hits = out[0]
    for more in out[1:]:
        all_hits = all_hits.unionByName(more)
    return all_hits.distinct()


def seeds(regions: DataFrame, order: list[Column], least: float, rounds: int | None = None) -> DataFrame:
    """The columns of regions with place (from 1, in the order within the document) and seed, the place of the earliest seed that overlaps it by `least` or more (its own if it is a seed).

    regions: doc_id, region_id, x, y, w, h; order: columns, total within a
    document (ties are broken by the box, then they don't matter). Of equal
    boxes only the first takes part: the others share its seed. Boxes without
    area overlap nothing, not even their equals.
    """
    placed = written(regions.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "x", "y", "w", "h")).cast("long")), "placed")
    boxes = placed.where("w > 0 AND h > 0").groupBy("doc_id", "x", "y", "w", "h").agg(F.min("place").alias("region_id"))
    edges = written(region_overlaps(boxes, least).select("doc_id", "a", "b"), "overlaps")
    gone = written(dropped(edges, rounds), "dropped")
    keeps = edges.hint("merge").join(gone.withColumnRenamed("b", "a"), ["doc_id", "a"], "left_anti").groupBy("doc_id", "b").agg(F.min("a").alias("seed"))
    taken = boxes.hint("merge").join(keeps.withColumnRenamed("b", "region_id"), ["doc_id", "region_id"], "left").select("doc_id", "x", "y", "w", "h", F.coalesce("seed", "region_id").alias("seed"))
    return placed.hint("merge").join(taken, ["doc_id", "x", "y", "w", "h"], "left").select(*placed.columns, F.coalesce("seed", "place").alias("seed"))
