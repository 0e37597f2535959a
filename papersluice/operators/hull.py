"""The farthest two points of a document: convex hull, then rotating calipers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a batch of results.
BATCH = 10_000


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull of sorted distinct points, counter-clockwise, without points on its sides (monotone chain)."""
    if len(points) < 3:
        return points

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def diameter(points: list[tuple[float, float]]) -> float:
    """The largest distance of two points; 0 for one. Of n points in n log n steps."""
    hull = convex_hull(sorted(set(points)))
    n = len(hull)
    square = lambda i, j: (hull[i][0] - hull[j][0]) ** 2 + (hull[i][1] - hull[j][1]) ** 2
    if n < 3:
        return square(0, n - 1) ** 0.5 if n else 0.0

    def area(i, j):
        a, b, p = hull[i], hull[(i + 1) % n], hull[j % n]
        return abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))

    best, j = 0.0, 1
    for i in range(n):
        while area(i, j + 1) > area(i, j):
            j += 1
        for k in (j % n, (j + 1) % n):
            best = max(best, square(i, k), square((i + 1) % n, k))
    return best**0.5


def farthest(points: DataFrame) -> DataFrame:
    """doc_id, distance of each document's farthest two points (doc_id, px, py); 0 for a single one. Points without a place don't count; only the ends of each column of points leave their partition for the hull.

    Partitions are sorted by document and walked batch by batch, so a worker
    gets many documents at a time, and holds one.
    """
    ends = points.where("px IS NOT NULL AND py IS NOT NULL").select("doc_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    ends = ends.groupBy("doc_id", "px").agg(F.min("py").alias("lo"), F.max("py").alias("hi")).select("doc_id", "px", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("py"))
    kind = points.select("doc_id").schema.simpleString()[len("struct<") : -1]

    def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((doc, xy) for b in batches for doc, *xy in zip(b["doc_id"], b["px"], b["py"], strict=True))
        found = ((doc, diameter([(x, y) for _, (x, y) in own])) for doc, own in groupby(rows, key=itemgetter(0)))
        while part := list(islice(found, BATCH)):
            yield pd.DataFrame(part, columns=["doc_id", "distance"])

    return ends.repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(widest, f"{kind}, distance double")
