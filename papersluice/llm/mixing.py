"""Operator 10: mixing sources to target weights along a time-varying curriculum.

Each source has a total target (words) and a weight schedule over the training
time t in [0, 1], a density 1 + slope * (2t - 1). Its cumulative demand is the
schedule's integral, target * (slope * t^2 + (1 - slope) * t); a document whose
middle word stands at m words of its source's order is read at the time where
the demand reaches m, the inverse of that integral. Documents are then sorted
by that position, by range. Native DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersluice.llm.text import WORD, key_string, whole, word_count
from papersluice.session import read_table, written

#: Fixed by the contract: weights by the rank of a source, the share of all words to take, the most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Slopes of the schedules by the rank of a source: even, early, late.
SLOPES = (0.0, -0.5, 0.5)
#: Documents of a source that are numbered together, about.
BUCKET_ROWS = 4096


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: rank, slope, source_size, target. One row per source passes through one task.

    Targets are the level of water poured into the sources by weight: source s
    gets min(2 * size, level * weight). Sources sorted by size / weight fill up
    in that order, so the level is what is left for the first that isn't full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fills = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    upto, rest = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", _cycle(WEIGHTS, "rank").cast("long"))
        .withColumn("slope", _cycle(SLOPES, "rank"))
    )
    total = F.sum("source_size").over(Window.partitionBy())
    level = (
        ranked.withColumn("left", total * F.lit(SHARE) - REPEATS * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("open", F.col("level") * F.col("weight") <= REPEATS * F.col("source_size"))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("open"), F.struct(-F.col("source_size") / F.col("weight"), -F.col("rank"), "level"))).over(Window.partitionBy())["level"], F.lit(0.0)))
    )
    return level.select("source", "rank", "slope", "source_size", F.least((REPEATS * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _cycle(values: tuple, rank: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(rank) % len(values) + 1).cast("int"))


def position_at(share: Column, slope: Column) -> Column:
    """The time at which a schedule of this slope has taken this share of its words."""
    even = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(even * even + 4 * slope * share) - even) / (2 * slope))


def order_of() -> Column:
    """What documents of a source are ordered by."""
    return F.md5(F.concat(key_string("doc_id"), F.lit("|"), F.md5(whole("text"))))


def curriculum(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per document: the columns `keep` of docs (default doc_id), size, source_size, target, taken, positions.

    Within a source documents follow the MD5 of their doc_id and text; pass e
    of the source reads a document if the word in its middle stands before the
    target, so a source misses its target by half a document at most. positions
    has one time in [0, 1] for each reading. Running sums are made in two steps
    (sums of hash buckets, as many as the documents need, then rows inside a
    bucket), so that no task holds a whole source. Null texts have size 0;
    sources of size 0 have target 0 and are never read; a null source is a
    source, the last; repeated rows each count, next to each other; null and
    repeated doc_ids are told apart by their texts.
    """
    rows, digits = docs.count(), 1
    while 16**digits * BUCKET_ROWS < rows and digits < 8:
        digits += 1
    keep = ["doc_id"] if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    named = docs.select(row, "source", word_count("text").alias("size"), order_of().alias("h"))
    bucket = F.substring("h", 1, digits).alias("bucket")
    sized = written(named.groupBy("source", bucket).agg(F.sum("size").alias("size")), "sizes")
    sources = written(source_targets(sized), "sources")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sized.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first")), "sums")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = named.withColumn("bucket", bucket).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = _with(_with(inner, sums, ["source", "bucket"]), sources, ["source"]).withColumn("at", F.col("first") + F.col("inner") + F.col("size") / 2)
    middles = F.filter(F.array(*[F.col("at") + e * F.col("source_size") for e in range(REPEATS)]), lambda m: m < F.col("target"))
    slope = F.col("slope")
    return rows.withColumn("middles", middles).select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("middles")).cast("long").alias("taken"),
        F.transform("middles", lambda m: F.round(position_at(m / F.col("target"), slope), 9)).alias("positions"),
    )


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join in which null keys meet; the columns of right other than the keys are added."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    return left.join(named, on).drop(*[f"_{k}" for k in keys])


def mixed(docs: DataFrame) -> DataFrame:
    """The documents the mix reads, each as often as it is read, range-sorted by position; columns as in docs, which may have any names.

    Null, empty and repeated rows as in curriculum(): what has no words is never read.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    out = curriculum(packed, ["_row"]).select("_row", F.explode("positions").alias("_position"))
    return out.repartitionByRange("_position").sortWithinPartitions("_position").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their first reading, unread ones first; nulls, empty texts and repeated rows as in curriculum()."""
    plan = curriculum(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    each = [F.get("positions", F.lit(e)).alias(f"position_{e + 1}") for e in range(REPEATS)]
    return plan.select("doc_id", "size", "source_size", "target", "taken", *each).orderBy("position_1", "doc_id")


def _at(mid: str) -> str:
    share = f"({mid} / target)"
    bent = f"(sqrt((1 - slope) * (1 - slope) + 4 * slope * {share}) - (1 - slope)) / (2 * slope)"
    return f"CASE WHEN {mid} < target THEN round(CASE WHEN slope = 0 THEN {share} ELSE {bent} END, 9) END"


SQL = rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM g),
w AS (SELECT *, [3, 1, 2][CAST(rk % 3 + 1 AS INT)] AS weight, [0.0, -0.5, 0.5][CAST(rk % 3 + 1 AS INT)]::DOUBLE AS slope FROM r),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
v AS (SELECT lv FROM f WHERE lv * weight <= 2 * source_size ORDER BY source_size::DOUBLE / weight, rk LIMIT 1),
t AS (SELECT source, source_size, slope, least((2 * source_size)::DOUBLE, coalesce((SELECT lv FROM v), 0) * weight) AS target FROM f),
c AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.slope,
        (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0)::DOUBLE AS mid
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * ((CASE WHEN mid < target THEN 1 ELSE 0 END) + (CASE WHEN mid + source_size < target THEN 1 ELSE 0 END)) AS BIGINT) AS taken,
  {_at("mid")} AS position_1, {_at("(mid + source_size)")} AS position_2
FROM c
"""
