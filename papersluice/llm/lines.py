"""Operator 2: removal of repeated runs of lines by winnowing.

Lines with words are hashed. A shingle starts at each line and takes lines up
to SHINGLE words; from every stretch of RUN words the shingle of the least hash
is kept as a fingerprint, so any run of RUN or more words that two places share
holds a fingerprint that both places kept. Fingerprints that several places
have bring the whole stretches they were chosen for; of places with an equal
stretch every one but the first is deleted. A line goes exactly if it lies in a
run of RUN words or more that some earlier place has too, whichever place that
is. Native DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersluice.llm.text import WORD, tie_of, whole
from papersluice.session import read_table, written

#: Words of a run that is deleted where it is repeated, and of a shingle.
RUN, SHINGLE = 50, 25
BREAK = "\n"


def _lines_for(a: Column, start: Column, n: int) -> Column:
    """How many lines from `start` on hold n words; null where the lines end before."""
    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("c"))
    add = lambda acc, x: F.when(acc["w"] >= n, acc).otherwise(F.struct((acc["w"] + x["w"]).alias("w"), (acc["c"] + 1).alias("c")))
    walked = F.aggregate(F.slice(a, start + 1, F.lit(n)), zero, add, lambda acc: F.when(acc["w"] >= n, acc["c"]))
    return F.when(F.get(a, start)["w"] >= n, F.lit(1)).otherwise(walked)


def fingerprints(docs: DataFrame, run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """Per fingerprint: doc_id, tie, g, and the stretches it was chosen for (hash, first and last line).

    From each line on, the shortest stretch of `run` words counts, and longer
    ones as long as they need that line for their `run` words. The stretches
    inside any run of `run` words or more cover it, and each two neighbouring
    lines of it. There are at most about two a line. No shuffle; work and
    memory follow the lines of one text.
    """
    line = lambda x, i: F.struct(i.alias("p"), F.xxhash64(F.trim(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))
    one = docs.select("doc_id", tie_of().alias("tie"), F.filter(F.transform(F.split(whole("text"), BREAK, -1), line), lambda x: x["w"] > 0).alias("a"))
    a = F.col("a")
    two = one.select("doc_id", "tie", "a", F.transform(a, lambda x, i: F.struct(i.alias("s"), _lines_for(a, i, shingle).alias("k"), _lines_for(a, i, run).alias("t"))).alias("b"))
    hashed = lambda s, n: F.xxhash64(F.transform(F.slice(a, s + 1, n), lambda y: y["h"]))
    three = two.select("doc_id", "tie", "a", "b", F.transform("b", lambda x: F.struct(F.when(x["k"].isNotNull(), hashed(x["s"], x["k"])).alias("g"), x["s"].alias("s"), x["k"].alias("k"), x["t"].alias("t"))).alias("c"))
    c = F.col("c")
    inside = lambda x: F.filter(F.slice(c, x["s"] + 1, x["t"]), lambda y: y["k"].isNotNull() & (y["s"] + y["k"] <= x["s"] + x["t"]))
    least = lambda x: F.array_min(F.transform(inside(x), lambda y: F.struct(y["g"].alias("g"), y["s"].alias("s"))))

    def stretches(x: Column) -> Column:
        after = F.get("b", x["s"] + 1)["t"]
        longest = F.when(after.isNull(), F.size(a) - x["s"]).when(x["t"] == 1, F.greatest(after, F.lit(2))).otherwise(after)
        return F.transform(F.sequence(x["t"], F.greatest(x["t"], longest)), lambda n: F.struct(hashed(x["s"], n).alias("h"), F.get(a, x["s"])["p"].alias("first"), F.get(a, x["s"] + n - 1)["p"].alias("last")))

    four = three.select("doc_id", "tie", F.transform(F.filter(c, lambda x: x["t"].isNotNull()), lambda x: F.struct(least(x).alias("f"), stretches(x).alias("of"))).alias("d"))
    d = F.col("d")
    chosen_for = lambda f: F.filter(F.slice(d, F.greatest(f["s"] - run, F.lit(0)) + 1, F.least(f["s"], F.lit(run)) + 1), lambda x: x["f"]["s"] == f["s"])
    mark = lambda f: F.struct(f["g"].alias("g"), F.flatten(F.transform(chosen_for(f), lambda x: x["of"])).alias("stretches"))
    return four.select("doc_id", "tie", F.explode(F.transform(F.array_distinct(F.transform(d, lambda x: x["f"])), mark)).alias("f")).select("doc_id", "tie", "f.*")


def repeated_runs(docs: DataFrame, run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """Per document and later repeated run: doc_id, tie, first and last line (from 0); runs of a document don't overlap.

    The first place of a stretch is the least in (doc_id, tie, line). Each
    stretch meets that one place only, so a group of n copies makes n rows a
    stretch; stretches are equal whole, so no later place is left to compare.
    """
    marks = written(fingerprints(docs, run, shingle), "marks")
    often = written(marks.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "often")
    held = written(marks.join(often, "g").select("doc_id", "tie", "g", F.explode("stretches").alias("x")).select("doc_id", "tie", "g", "x.*"), "stretches")
    firsts = written(held.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "first")).alias("o")).where("n > 1").select("g", "h", "o"), "firsts")
    met = held.join(firsts, ["g", "h"]).where(~(F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("tie") == F.col("o.tie")) & (F.col("first") == F.col("o.first"))))
    runs = met.select("doc_id", "tie", F.col("first").alias("a"), F.col("last").alias("b"))
    of = Window.partitionBy("doc_id", "tie").orderBy("a", "b")
    before = F.max("b").over(of.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.distinct().withColumn("new", (F.coalesce(before, F.lit(-2)) + 1 < F.col("a")).cast("int"))
    return opened.withColumn("part", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "tie", "part").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("part")


def without_repeats(docs: DataFrame, run: int = RUN, shingle: int = SHINGLE, counted: str = "n_deleted") -> DataFrame:
    """docs with later repeated runs cut from text, and the number of lines cut in the column `counted`; texts without such runs stay as they are.

    Null texts stay null; texts of fewer than `run` words never change; of
    documents with one text the least doc_id (null before all) keeps it; rows
    that share doc_id and text count as one document and stay alike. An empty
    table stays empty. Other columns pass through, whatever their names; one
    named as `counted` is replaced.
    """
    bare = docs.select("doc_id", "text")
    runs = repeated_runs(bare, run, shingle).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first", "last")).alias("cut"))
    runs = runs.withColumnsRenamed({"doc_id": "id", "tie": "of"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    keyed = docs.select(row, "text", F.col("doc_id").alias("key"), tie_of().alias("tie"))
    joined = keyed.join(runs, F.col("key").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("of")), "left")
    rest = F.filter(F.split("text", BREAK, -1), lambda x, i: ~F.exists("cut", lambda c: i.between(c["first"], c["last"])))
    joined = joined.withColumn("text", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(rest, BREAK)))
    n_cut = F.coalesce(F.aggregate("cut", F.lit(0), lambda acc, c: acc + c["last"] - c["first"] + 1), F.lit(0)).cast("long")
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != counted]
    return joined.select(*kept, n_cut.alias(counted))


def op2_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs; nulls, empty texts and repeated rows as in without_repeats()."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", BREAK, -1))).cast("long")
    return without_repeats(docs.withColumn("n_lines", lines)).select("doc_id", "n_lines", "n_deleted", "text")
