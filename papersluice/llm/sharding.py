"""Operator 1: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a score from the hash of (key, shard) and the record goes to
the shard with the highest score, -weight / ln(u) with u uniform in (0, 1).
Only the key and the shards decide, so adding a shard moves just the records
that the new shard wins, a share of its weight, and moves them into it alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersluice.llm.text import whole
from papersluice.session import read_table, written

SHARDS = 40
#: Rows of a shard that are numbered together, about: no task sorts a whole shard.
BUCKET_ROWS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the index of the highest score; ties go to the smaller index."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def score(weight: Column, shard: Column) -> Column:
        top53 = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11).cast("double")
        return F.struct((-weight / F.log((top53 + 0.5) / F.lit(float(2**53)))).alias("score"), (-shard).alias("shard"))

    return (-F.array_max(F.transform(F.array(*[F.lit(float(w)) for w in weights]), score))["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """df with a column shard_of by rendezvous hashing of its column key.

    A null key is a key like any other (all null keys share a shard); repeated
    keys share a shard; an empty table stays empty. No shuffle. A column of df
    named shard_of is replaced.
    """
    return df.withColumn("shard_of", rendezvous(F.col(key), weights))


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str, files: int = 1) -> None:
    """Write df as Parquet below path, a folder for each shard, each shard in up to `files` files."""
    placed = assign_shards(df, key, weights)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not dict(df.dtypes)[c].startswith("map")]), F.lit(files))
    placed.repartition(F.col("shard_of"), salt).write.partitionBy("shard_of").parquet(path)


def shard_slots(df: DataFrame, key: str, text: str, weights: Sequence[float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per record: key, size, text_crc32, law, shard, slot, grown_shard.

    slot numbers the records of a shard from 0 without gaps: rows are counted in
    hash buckets of each shard, as many as the rows need, the counts are summed
    up to offsets, and rows are numbered inside a bucket. The texts themselves
    aren't shuffled. grown_shard is the shard with one more shard of the mean
    weight. A null text counts as empty, a null key is a key; repeated keys are
    told apart by their texts. Rows equal in key and text may swap their slots
    between runs, others keep them. Other columns don't matter; an empty table
    gives an empty result. Rows equal in key and text that are more than a
    bucket holds are dealt over several, so no group makes a task large.
    """
    more = [*weights, sum(weights) / len(weights)]
    id_ = F.col(key)
    crc = F.crc32(whole(text))
    placed = written(
        df.select(
            id_,
            (F.octet_length(whole(text)) + 16).cast("long").alias("size"),
            crc.cast("long").alias("text_crc32"),
            rendezvous(id_, weights).alias("shard"),
            rendezvous(id_, more).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    )
    buckets = max(1, -(-placed.count() // (bucket_rows * len(weights))))
    alike = placed.groupBy(F.col(key).alias("of_key"), F.col("text_crc32").alias("of_crc")).agg(F.ceil(F.count("*") / bucket_rows).alias("parts"))
    alike = written(alike.where("parts > 1"), "alike")
    salted = placed.join(alike, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("text_crc32") == F.col("of_crc")), "left")
    spot = F.xxhash64(key, "text_crc32", F.coalesce(F.pmod("row", "parts"), F.lit(0)), F.lit("slot"))
    placed = salted.withColumn("bucket", F.pmod(spot, F.lit(buckets))).drop("of_key", "of_crc", "parts", "row")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")),
        "offsets",
    )
    inside = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32", "size")
    return placed.join(offsets, ["shard", "bucket"]).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law `key`; nulls, empty and long texts, repeated rows as in shard_slots()."""
    return shard_slots(read_table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)
