"""Operator 4: exact top-k search with multi-resolution segment statistics.

A vector is cut into segments, 1, 4, 16 and 32 of them. With a segment's mean m
and deviation s (of L components), the squared distance of two segments is at
least L * ((m1 - m2)^2 + (s1 - s2)^2). Summed over the segments this bounds the
distance of two vectors from below, the finer the tighter, and so their inner
product (|a|^2 + |b|^2 - distance^2) / 2 from above, by the sum of
L * (m1 * m2 + s1 * s2).

Two passes over blocks of rows and queries. The first takes each query's rows
of the best bounds and their exact scores, from all blocks; the k-th of these
is a floor that the query's results can't be below. The second drops, coarse to
fine, the pairs whose bound is below the query's floor; the survivors get exact
integer products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersluice.session import read_table, written

SCALE = 256
SEGMENTS = (1, 4, 16, 32)
#: Rows and queries that meet in a task, and the least number of row blocks; components that either may have, which bounds a task's memory at any dimension.
ROWS, QUERIES, BLOCKS = 65_536, 16_384, 64
COMPONENTS = 1 << 22
#: Rows and queries compared at a time: bounds the memory of a task.
STEP, QUERY_STEP = 2048, 1024
#: Share of live pairs from which a level is worked out for all pairs at once.
DENSE = 0.1


def quantized(vector: Column | str) -> Column:
    """floor(SCALE * x) of each component; null for vectors that are null or hold null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector sqrt(L) * (means, deviations) of its segments: products of these rows bound the vectors' products from above."""
    parts = np.array_split(x.astype("f8"), min(segments, x.shape[1]), axis=1)
    return np.hstack([np.column_stack([p.mean(axis=1), p.std(axis=1)]) * np.sqrt(p.shape[1]) for p in parts])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum stays below 2^53, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return a @ b.T if most < 2**62 else (a.astype(object) @ b.astype(object).T)


class Block:
    """Rows and queries that meet: bounds by level, and exact products of pairs. query_ids and row_ids tell whether both are one row; vec_ids are the rows' ids in the result (default row_ids)."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray | None = None):
        self.query_ids, self.queries, self.row_ids, self.rows = query_ids, queries, row_ids, rows
        self.vec_ids = row_ids if vec_ids is None else vec_ids
        self.levels = [(statistics(queries, s), statistics(rows, s)) for s in SEGMENTS]
        norm = lambda x: np.linalg.norm(x.astype("f8"), axis=1)
        self.slack = 1e-9 * norm(queries)[:, None] * norm(rows)[None, :] + 1e-6
        self.others = query_ids[:, None] != row_ids[None, :]

    def bounds(self, level: int) -> np.ndarray:
        q, x = self.levels[level]
        return q @ x.T + self.slack

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Products of pairs of a query and a row."""
        most = float(np.abs(self.queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * self.rows.shape[1]
        if most < 2**53 and len(i) > DENSE * self.others.size:
            return products(self.queries, self.rows)[i, j]
        out = [products_of(self.queries[i[lo : lo + STEP]], self.rows[j[lo : lo + STEP]], most) for lo in range(0, len(i), STEP)]
        return np.concatenate(out) if out else np.zeros(0, "i8")

    def survivors(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Pairs whose bounds reach their query's floor on every level, and how many did so by level."""
        alive, counts = self.others, []
        i = j = None
        for level, (q, x) in enumerate(self.levels):
            if i is None and alive.sum() > DENSE * alive.size:
                alive = alive & (self.bounds(level) >= floor[:, None])
            else:
                if i is None:
                    i, j = np.nonzero(alive)
                bound = np.einsum("ab,ab->a", q[i], x[j]) + self.slack[i, j]
                i, j = i[bound >= floor[i]], j[bound >= floor[i]]
            counts.append(int(alive.sum()) if i is None else len(i))
        if i is None:
            i, j = np.nonzero(alive)
        return i, j, counts

    def best(self, i: np.ndarray, j: np.ndarray, k: int) -> pd.DataFrame:
        """Per query the k best of the given pairs: query_id, vec_id, score; ties to the smaller vec_id."""
        found = pd.DataFrame({"query_id": self.query_ids[i], "vec_id": self.vec_ids[j], "score": self.exact(i, j)})
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def products_of(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    if most < 2**53:
        return np.einsum("ab,ab->a", a.astype("f8"), b.astype("f8")).astype("i8")
    return (a * b).sum(axis=1) if most < 2**62 else (a.astype(object) * b.astype(object)).sum(axis=1)


def blocks_of(q: pd.DataFrame, x: pd.DataFrame) -> Iterator[tuple[Block, pd.DataFrame]]:
    """Blocks of at most QUERY_STEP queries and STEP rows, and the queries of each."""
    for lo in range(0, len(q), QUERY_STEP):
        part = q.iloc[lo : lo + QUERY_STEP]
        queries = np.stack(part["q"].to_numpy())
        for at in range(0, len(x), STEP):
            rows = x.iloc[at : at + STEP]
            yield Block(part["key"].to_numpy(), queries, rows["key"].to_numpy(), np.stack(rows["q"].to_numpy()), rows["vec_id"].to_numpy()), part


def likely(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query 2 * k rows of the best bounds."""
    bound = np.where(block.others, block.bounds(len(SEGMENTS) - 1), -np.inf)
    n = min(2 * k, bound.shape[1])
    j = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    i = np.repeat(np.arange(len(bound)), n)
    own = np.isfinite(bound[i, j.ravel()])
    return i[own], j.ravel()[own]


NONE = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def floor_block(x: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query the k best exact scores of its likely rows."""
    if not len(x) or not len(q):
        return NONE
    found = pd.concat([block.best(*likely(block, k), k) for block, _ in blocks_of(q, x)])
    return found.sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id").head(k)


def search_block(x: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query the k best of the rows that reach its floor."""
    if not len(x) or not len(q):
        return NONE
    found = []
    for block, part in blocks_of(q, x):
        i, j, _ = block.survivors(part["floor"].fillna(-np.inf).to_numpy())
        found.append(block.best(i, j, k))
    return pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int, blocks: tuple[int, int, int] = (ROWS, QUERIES, BLOCKS), key: str = "vec_id") -> DataFrame:
    """Per query its k rows of highest inner product: query_id, rank, vec_id, score.

    rows and queries: vec_id long, q array<long> (from quantized()); they are
    dealt into hash blocks, and each pair of blocks meets in one task of bounded
    size. key: a long column of both that names a row; a query's own row is no
    candidate, and of queries with one key one vector (the least) counts. With
    a key of its own for every row, rows that share a vec_id are queries and
    candidates each. Only vectors of equal length are compared; null vectors,
    keys and ids take no part; repeated rows are candidates each; ties go to
    the smaller vec_id. Other columns don't matter. Empty tables give an empty
    result.
    """
    named = lambda df: df.where(f"q IS NOT NULL AND vec_id IS NOT NULL AND `{key}` IS NOT NULL").select(F.col(key).alias("key"), "vec_id", "q")
    rows = written(named(rows), "vectors")
    queries = named(queries).groupBy("key").agg(F.min(F.struct("q", "vec_id")).alias("v"))
    queries = written(queries.select("key", F.col("v.vec_id").alias("vec_id"), F.col("v.q").alias("q")), "queries")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(1)).alias("d")).first()
    most = [max(1, min(b, COMPONENTS // max(1, size.d))) for b in blocks[:2]]
    row_blocks, query_blocks = max(1, min(blocks[2], -(-size.n // STEP)), -(-size.n // most[0])), max(1, -(-queries.count() // most[1]))
    deal = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys, schema = ["rb", "qb", "dim"], "query_id long, vec_id long, score long"

    def meet(asked: DataFrame, run: Callable) -> DataFrame:
        held = [F.col(c).alias(c) for c in ("key", "vec_id", "q")]
        left = rows.select(*held, F.size("q").alias("dim"), deal(row_blocks).alias("rb"), each(query_blocks).alias("qb"))
        right = asked.select("*", F.size("q").alias("dim"), deal(query_blocks).alias("qb"), each(row_blocks).alias("rb"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda x, q: run(x, q, k), schema)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    likely_ones = meet(queries, floor_block).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = written(likely_ones.select(F.col("query_id").alias("key"), F.col("score").cast("double").alias("floor")), "floors")
    asked = written(queries.join(floors, "key", "left").select("key", "q", "floor"), "asked")
    met = meet(asked, search_block)
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = queries.select("key", F.col("vec_id").alias("asked_id"))
    return best.withColumnRenamed("query_id", "key").join(ids, "key").select(F.col("asked_id").alias("query_id"), "rank", "vec_id", "score")


def op4_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every query vector; each row is a query or candidate of its own, whatever its id; nulls and ties as in exact_top_k()."""
    given = read_table(spark, sf_dir, "embeddings").select(F.monotonically_increasing_id().alias("row"), "vec_id", quantized("embedding").alias("q"))
    rows = written(given, "rows")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5, key="row")


SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r AS q, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
