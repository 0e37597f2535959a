"""Which of a document's values hold which of its tokens, or are held by them.

An inverted index of short substrings takes the place of comparing every value
with every token: if t lies in v, the first GRAM characters of t are one of v's
substrings of that length (or t itself, if shorter, is one of v's shorter
ones). So both sides are joined on (doc_id, substring) and only pairs that share
it are verified. Documents of at most PAIRS pairs need no index: there every
pair is compared, which moves each value and token once instead of once a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.session import written

#: Characters of a key.
GRAM = 3
#: Pairs that a document without an index has at most.
PAIRS = 4096


def substrings(c: Column, most: int = GRAM) -> Column:
    """The distinct substrings of 1 to `most` characters."""
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, most + 1)]))


def candidates(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, v, t: pairs of a document that share a key, each once; unverified. values: doc_id, v; tokens: doc_id, t (distinct rows)."""
    v, t = values.where("v <> ''"), tokens.where("t <> ''")
    inside = v.select("doc_id", "v", F.explode(substrings(F.col("v"))).alias("key")).hint("merge").join(t.select("doc_id", "t", F.left("t", F.lit(GRAM)).alias("key")), ["doc_id", "key"])
    inside = inside.where(F.length("t") <= F.length("v"))
    lengths = F.length("v")
    least = v.groupBy("doc_id").agg(F.min(F.when(lengths >= GRAM, lengths)).alias("least"), F.min(F.when(lengths < GRAM, lengths)).alias("short"))
    longer = t.hint("merge").join(least, "doc_id").where(F.length("t") > F.least("least", "short"))
    whole = lambda g: F.length(g) == GRAM
    asked = F.filter(substrings(F.col("t")), lambda g: F.when(whole(g), F.length("t") > F.col("least")).otherwise(F.length(g) >= F.col("short")))
    around = longer.select("doc_id", "t", F.explode(asked).alias("key")).hint("merge").join(v.select("doc_id", "v", F.left("v", F.lit(GRAM)).alias("key")), ["doc_id", "key"])
    around = around.where(F.length("t") > F.length("v"))
    return inside.select("doc_id", "v", "t").unionByName(around.select("doc_id", "v", "t"))


def large_documents(values: DataFrame, tokens: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """doc_id of documents with more pairs of a value and a token than `pairs`."""
    count = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    return count(values, "nv").hint("merge").join(count(tokens, "nt"), "doc_id").where(F.col("nv") * F.col("nt") > pairs).select("doc_id")


def containments(values: DataFrame, tokens: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """doc_id, v, t and further columns of tokens: the document's token t lies in its value v, or v in t. Nulls and empty texts hold nothing and are held by nothing.

    Both tables are read several times, so they should be stored. pairs:
    documents of more pairs are looked up by the index.
    """
    v, t = values.select("doc_id", "v").where("v <> ''"), tokens.where("t <> ''")
    held = F.contains("v", "t") | F.contains("t", "v")
    large = written(large_documents(v, t, pairs), "large")
    if not large.take(1):
        return v.hint("merge").join(t, "doc_id").where(held)
    of = lambda df, how: df.hint("merge").join(large, "doc_id", how)
    small = of(v, "left_anti").hint("merge").join(of(t, "left_anti"), "doc_id").where(held)
    met = candidates(of(v, "left_semi"), of(t.select("doc_id", "t"), "left_semi")).where(held)
    return small.unionByName(met.hint("merge").join(t, ["doc_id", "t"]))
