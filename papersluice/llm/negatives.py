"""Operator 11: hard negatives by threshold joins over an inverted index (L2AP style).

All vectors that score at least t with an anchor are found dimension by
dimension. A row's entries are indexed up to the dimension from which its
remaining (suffix) norm times any anchor's is below the threshold: what is left
of it can't reach t by itself, so it is left out of the inverted lists. Walking
the lists adds up partial scores; a pair is dropped as soon as its partial
score plus the product of the remaining norms is below t. Survivors get their
exact integer scores.

A request asks for the k best rows of a window of scores. Its threshold starts
near the window's upper end and is lowered until the window holds k rows or the
lower end is reached. Each threshold is one pass of the open requests over
blocks of rows; a pass returns at most k rows a request and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersluice.llm.search import products_of, quantized
from papersluice.session import read_table, written

#: Components in a block of rows and in one of anchors: bounds the memory of a task at any dimension.
ROW_COMPONENTS, ANCHOR_COMPONENTS = 1 << 20, 1 << 17
#: Rows and anchors compared at a time, and dimensions in a group of inverted lists.
STEP, ANCHOR_STEP, GROUP = 2048, 512, 8
#: Share of live pairs under which they are followed one by one.
SPARSE = 0.1
#: Thresholds, as parts of the way from the upper to the lower end of a window.
LOWERED = (0.125, 0.25, 0.5, 1.0)
#: Without an upper end: parts of the largest possible score, and no threshold at last.
FROM_MOST = (0.5, 0.35, 0.25, 0.0, None)
NO_LEAST, NO_MOST = -(1 << 62), 1 << 62
FOUND = "request long, row long, vec_id long, score long"


def floor_div(a: Column, b: int) -> Column:
    """floor(a / b) of longs."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Per vector the norms of its components from each dimension on; 0 behind the last."""
    squares = np.cumsum(np.square(x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(x), 1))]))


def candidates(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of an anchor and a row that may score least[i] or more, and how many list entries were used."""
    order = np.argsort(-np.square(rows.astype("f8")).sum(axis=0), kind="stable")
    q, x = anchors[:, order].astype("f8"), rows[:, order].astype("f8")
    q_norms, x_norms = suffix_norms(q), suffix_norms(x)
    floor = least - 1e-9 * q_norms[:, 0] * (x_norms[:, 0].max(initial=0)) - 1e-6
    # per dimension the largest norm of an anchor's rest, in units of its threshold
    reach = (q_norms / floor[:, None]).max(axis=0, initial=0) if (floor > 0).all() else np.full(q.shape[1] + 1, np.inf)
    partial, used = np.zeros((len(q), len(x))), 0
    indexed = np.ones(len(x), bool)
    covered = np.zeros(len(x), "i8")
    alive = np.ones(partial.shape, bool)
    for lo in range(0, x.shape[1], GROUP):
        with np.errstate(invalid="ignore"):
            indexed &= ~(x_norms[:, lo] * reach[lo] < 1)
        listed = np.flatnonzero(indexed & alive.any(axis=0))
        if not len(listed):
            break
        hi = min(lo + GROUP, x.shape[1])
        partial[:, listed] += q[:, lo:hi] @ x[listed, lo:hi].T
        covered[listed], used = hi, used + len(listed) * (hi - lo)
        alive[:, listed] &= partial[:, listed] + q_norms[:, hi, None] * x_norms[listed, hi] >= floor[:, None]
        if alive.mean() < SPARSE:
            break
    i, j = np.nonzero(alive)
    near = partial[i, j] + q_norms[i, covered[j]] * x_norms[j, covered[j]] >= floor[i]
    return i[near], j[near], used


def in_windows(rows: pd.DataFrame, anchors: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """Of a block of rows, per request the k best of its window at or above its threshold."""
    out = []
    for at in range(0, len(anchors) if len(rows) else 0, ANCHOR_STEP):
        part = anchors.iloc[at : at + ANCHOR_STEP]
        q, own, label = np.stack(part["q"].to_numpy()), part["row"].to_numpy(), part["label"].to_numpy()
        asked = pd.DataFrame([(i, w["request"], w["least"], w["most"]) for i, ws in enumerate(part["windows"]) for w in ws], columns=["i", "request", "least", "most"])
        least = asked.groupby("i")["least"].min().to_numpy().astype("f8")
        for lo in range(0, len(rows), STEP):
            some = rows.iloc[lo : lo + STEP]
            x = np.stack(some["q"].to_numpy())
            i, j, _ = candidates(q, x, least)
            fit = ((label[i] == some["label"].to_numpy()[j]) == same) & (own[i] != some["row"].to_numpy()[j])
            i, j = i[fit], j[fit]
            top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
            cut = [products_of(q[i[n : n + STEP]], x[j[n : n + STEP]], top) for n in range(0, len(i), STEP)]
            score = np.concatenate(cut).astype("i8") if cut else np.zeros(0, "i8")
            pairs = pd.DataFrame({"i": i, "row": some["row"].to_numpy()[j], "vec_id": some["vec_id"].to_numpy()[j], "score": score})
            met = pairs[score >= least[i]].merge(asked, on="i")
            out.append(_best(met[(met.score >= met.least) & (met.score <= met.most)], k))
    return _best(pd.concat(out), k)[["request", "row", "vec_id", "score"]] if out else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}, dtype="int64")


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["request", "score", "vec_id", "row"], ascending=[True, False, True, True]).groupby("request").head(k)


def threshold_join(rows: DataFrame, requests: DataFrame, k: int, same: bool, blocks: tuple[int, int] = (ROW_COMPONENTS, ANCHOR_COMPONENTS)) -> DataFrame:
    """request, rank, row, vec_id, score: per request the k best rows of its window; ties to the smaller vec_id, then row.

    rows: row (a key), vec_id, label, q (array<long>). requests: request (a
    key), row and label and q of the anchor, steps (array<long>: falling
    thresholds, the last being the window's lower end), most (its upper end).
    Rows of the anchor's label (same) or of others; never the anchor's own row.
    Only vectors of equal length are compared.
    """
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    parts = lambda n, components: max(1, -(-(n or 0) * max(1, size.d or 1) // components))
    row_parts = parts(size.n, blocks[0])
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = [F.size("q").alias("d"), F.col("label").alias("g") if same else F.lit(0).alias("g")]
    keys = ["d", "g", "rp", "ap"]
    order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id", "row")
    still, done = requests, []
    for n in range(_most_steps(requests)):
        now = still.withColumn("least", F.get("steps", F.least(F.lit(n), F.size("steps") - 1)))
        windows = F.collect_list(F.struct("request", "least", "most")).alias("windows")
        anchors = written(now.groupBy("row", "label", "q").agg(windows), "anchors")
        anchor_parts = parts(anchors.count(), blocks[1])
        left = rows.select("row", "vec_id", "label", "q", *group, deal("row", row_parts).alias("rp"), each(anchor_parts).alias("ap"))
        right = anchors.select("*", *group, deal("row", anchor_parts).alias("ap"), each(row_parts).alias("rp"))
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda x, a: in_windows(x, a, k, same), FOUND)
        met = written(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "met")
        full = met.where(F.col("rank") == k).select("request", F.lit(True).alias("full"))
        state = now.join(full, "request", "left").withColumn("last", F.size("steps") <= n + 1)
        state = written(state.withColumn("over", F.coalesce("full", F.lit(False)) | F.col("last")), "state")
        done.append(met.join(state.where("over").select("request"), "request", "left_semi"))
        still = state.where("NOT over").select(*requests.columns)
        if not still.take(1):
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("request", "rank", "row", "vec_id", "score")


def _most_steps(requests: DataFrame) -> int:
    return requests.agg(F.max(F.size("steps"))).first()[0] or 1


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 10, lower: tuple[int, int] = (3, 10), upper: tuple[int, int] = (9, 10)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id long, label, q array<long> (from search.quantized()). anchors:
    the condition for anchor rows. An anchor's positives are the best other
    rows of its label; for each, the negatives are the k best rows of other
    labels that score from lower to upper (fractions) of the positive's score.

    Rows with a null label, vector or vec_id take no part; rows that share a
    vec_id are rows of their own, as anchors too; ties go to the smaller
    vec_id. A positive of negative score has no negatives. Only vectors of
    equal length are compared; products have to fit into a long. Empty tables
    give an empty result; other columns don't matter.
    """
    named = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    rows = written(named.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q", F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    asked = rows.where("anchor").select("row", "vec_id", "label", "q", norm.alias("norm"))
    longest = rows.groupBy("label").agg(F.max(norm).alias("longest"))
    most = F.col("norm") * F.col("longest")
    steps = F.array(*[F.lit(NO_LEAST) if f is None else F.ceil(most * f).cast("long") for f in FROM_MOST])
    first = asked.join(longest, "label").select(F.col("row").alias("request"), "row", "vec_id", "label", "q", steps.alias("steps"), F.lit(NO_MOST).alias("most"))
    first = written(first, "asked")
    found = threshold_join(rows, first.drop("vec_id"), positives, True)
    found = found.select(F.col("request").alias("row"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = first.select("row", F.col("vec_id").alias("anchor_id"), "label", "q").join(found.where("positive_score >= 0"), "row")
    low, high = (floor_div(F.col("positive_score") * sign * a, b) * sign for sign, (a, b) in ((-1, lower), (1, upper)))
    pairs = pairs.select(F.monotonically_increasing_id().alias("request"), "*", low.alias("low"), high.alias("most")).where("low <= most")
    down = [F.col("most") - F.floor((F.col("most") - F.col("low")) * f).cast("long") for f in LOWERED[:-1]]
    pairs = written(pairs.withColumn("steps", F.array(*down, F.col("low"))), "pairs")
    mined = threshold_join(rows, pairs.select("request", "row", "label", "q", "steps", "most"), k, False)
    mined = mined.select("request", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.select("request", "anchor_id", "positive_id", "positive_score").join(mined, "request")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of five positives of every anchor; nulls, ties and repeated rows as in hard_negatives()."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantized("embedding").alias("q"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS vec_id, a.label = b.label AS same,
  CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id, s.br) AS INT) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
