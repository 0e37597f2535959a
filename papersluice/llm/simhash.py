"""Operator 12: near duplicates by SimHash, compared exactly in tiles.

A text's fingerprint is the bitwise majority of its shingles' hashes. Equal
fingerprints are one from the start. The others are dealt into tiles by their
population counts (of the whole fingerprint, its halves or its quarters): two
fingerprints that differ in r bits have counts that differ by r at most in
total, so only tiles whose counts are that close meet. Within a task the tiles
are cut again, by the counts of quarters, and the same rule skips most of what
is left. Tiles that meet are compared by numpy: exclusive or, bit counts.

Every pair of texts within the radius is found: nothing is sampled, and no
bucket stands between two fingerprints. That makes the comparison quadratic in
the number of different fingerprints, over the share of tile pairs that isn't
skipped: about a half by whole counts, a third by halves, an eighth by quarters.
A pair of tiles returns the components that it links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.near import components
from papersluice.session import read_table, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Most fingerprints of a tile, on average, and of the pieces that are compared at a time.
TILE, PIECE = 16_384, 256
#: Population counts are taken of so many parts, if about FILLED fingerprints share one combination of counts then.
PARTS, COMBINATIONS, FILLED = (1, 2, 4), (17, 137, 4_600), 2_048
#: Hashes whose bits are counted at a time.
HASHES = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The majority bits of the hashes of all n-word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(n, len(words))
    digest, counts, m = xxhash.xxh64_intdigest, np.zeros(64, "i8"), len(words) - k + 1
    for lo in range(0, m, HASHES):
        hi = min(lo + HASHES, m)
        spans = zip(starts[lo:hi].tolist(), (ends[lo + k - 1 : hi + k - 1] - 1).tolist(), strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long, of every row of docs."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = np.array([fingerprint(t, n) for t in batch["text"]], "u8")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": marks.view("i8")})

    kind = docs.select("doc_id").schema.simpleString()[len("struct<") : -1]
    return docs.select("doc_id", "text").mapInPandas(marked, f"{kind}, fp long")


def part_counts(fp: Column, parts: int) -> Column:
    """The population counts of equal parts of a fingerprint."""
    width = 64 // parts
    mask = -1 if width == 64 else (1 << width) - 1
    return F.array(*[F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask).cast("long"))) for k in range(parts)])


def close_counts(parts: int, radius: int) -> list[list[int]]:
    """All differences of part counts that add up to the radius at most."""
    return [list(d) for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each node's least linked node, itself a root) with nodes i and j linked."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _pieces(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """x in order of its count, then those of its quarters; the pieces' places; their least and largest counts of the whole, the halves and the quarters."""
    quarters = np.bitwise_count(x.view("u2").reshape(-1, 4)).astype("i2")
    halves = quarters[:, ::2] + quarters[:, 1::2]
    counts = np.hstack([halves.sum(axis=1, keepdims=True), halves, quarters])
    order = np.lexsort((counts[:, 5], counts[:, 4], counts[:, 3], counts[:, 0]))
    x, counts = x[order], counts[order]
    cut = [np.arange(lo, min(lo + PIECE, len(x))) for lo in range(0, len(x), PIECE)]
    return x, cut, np.array([counts[c].min(axis=0) for c in cut]), np.array([counts[c].max(axis=0) for c in cut])


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """a, b: links that join what the fingerprints within the radius join; and how many pairs were compared."""
    x, xs, x_least, x_most = _pieces(np.ascontiguousarray(left))
    y, ys, y_least, y_most = _pieces(np.ascontiguousarray(right))
    gaps = np.maximum(0, np.maximum(x_least[:, None] - y_most[None], y_least[None] - x_most[:, None]))
    apart = np.maximum(gaps[..., 0], np.maximum(gaps[..., 1:3].sum(axis=2), gaps[..., 3:].sum(axis=2)))
    root, compared = np.arange(len(x) + len(y)), 0
    for k, m in zip(*np.nonzero(apart <= radius), strict=True):
        near = np.flatnonzero(np.bitwise_count(x[xs[k]][:, None] ^ y[ys[m]][None, :]) <= radius)
        i, j = np.divmod(near, len(ys[m]))
        compared += len(xs[k]) * len(ys[m])
        root = unite(root, xs[k][i], len(x) + ys[m][j])
    both = np.concatenate([x, y])
    linked = both[root] != both
    return both[root][linked], both[linked], compared


def linked_fingerprints(marks: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """a, b: links between the distinct fingerprints of marks (fp) that join all within the radius. parts: of a fingerprint, whose bits are counted."""
    many = marks.count()
    if parts is None:
        parts = max([p for p, c in zip(PARTS, COMBINATIONS, strict=True) if many >= c * FILLED], default=PARTS[0])
    counted = written(marks.select("fp", part_counts(F.col("fp"), parts).alias("c")), "counted")
    sizes = written(counted.groupBy("c").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")), "sizes")  # at most (64 / parts + 1)^parts rows
    tiles = sizes.select("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    steps = F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in close_counts(parts, radius)])).alias("d")
    beside = sizes.select("c", steps).select("c", F.zip_with("c", "d", lambda c, d: c + d).alias("e"))
    met = beside.join(sizes.select(F.col("c").alias("e")), "e").where("c <= e")
    other = tiles.select(F.col("c").alias("e"), F.col("t").alias("u"))
    meet = met.join(tiles, "c").join(other, "e").where("c < e OR t <= u").select(F.struct("c", "t").alias("x"), F.struct(F.col("e").alias("c"), F.col("u").alias("t")).alias("y"))
    meet = written(meet.withColumn("pair", F.monotonically_increasing_id()), "meet")
    dealt = written(counted.join(sizes, "c").select("fp", F.struct("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("t")).alias("at")), "dealt")
    side = lambda c: meet.select("pair", F.col(c).alias("at")).join(dealt, "at").select(F.col("pair").alias("pair"), F.col("fp").alias("fp")).groupBy("pair")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b, _ = tile_links(x["fp"].to_numpy("i8").view("u8"), y["fp"].to_numpy("i8").view("u8"), radius)
        return pd.DataFrame({"a": a.view("i8"), "b": b.view("i8")})

    return side("x").cogroup(side("y")).applyInPandas(compare, "a long, b long")


def simhash_components(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """doc_id, fp (long), component_id (the least doc_id of the component) of every row of docs (doc_id, text).

    Null, empty and blank texts have the fingerprint 0, which is linked like
    any other. Null doc_ids count in no minimum, so only a component of null
    ids has a null component_id; repeated rows stay and share their component.
    Other columns don't matter; an empty table gives an empty result.
    """
    marks = written(fingerprints(docs, n), "marks")
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = written(linked_fingerprints(nodes.select("fp"), radius, tile, parts), "links")
    if not links.take(1):
        return marks.join(nodes, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))
    labels = components(links).withColumnRenamed("v", "fp")
    placed = written(nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "placed")
    named = written(placed.groupBy("label").agg(F.min("least").alias("component_id")), "named")
    by_mark = written(placed.join(named, "label").select("fp", "component_id"), "by_mark")
    return marks.join(by_mark, "fp").select("doc_id", "fp", "component_id")


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; nulls, empty texts and repeated rows as in simhash_components()."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
