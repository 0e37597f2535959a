"""Words of recognised lines, and statistics of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersluice.functions.text import devanagari_digits, is_numeric, is_stopword
from papersluice.sources import rules


def full_text(lines: DataFrame) -> DataFrame:
    """doc_id, full_text: a document's lines joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct("line_num", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(pairs, lambda x: x["text"]), "\n").alias("full_text"))


#: Words of a line whose widths are summed at a time.
BLOCK = 32


def plain_words(lines: DataFrame) -> DataFrame:
    """line_words() without the boxes, for statistics of words: doc_id, line_num, word_num, text, confidence, is_numeric, is_stopword."""
    tokens = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    each = lines.select("doc_id", (F.col("line_num") + 1).alias("line_num"), "confidence", F.posexplode(tokens).alias("i", "t"))
    word = F.col("t")
    return each.select("doc_id", "line_num", (F.col("i") + 1).alias("word_num"), word.alias("text"), "confidence", is_numeric(word).alias("is_numeric"), is_stopword(word).alias("is_stopword"))


def line_words(lines: DataFrame) -> DataFrame:
    """A row per word. Boxes are estimated along the line: a word's width is its share of the line's, and the next one starts an average character later.

    Running sums stay inside a line's array, so nothing is shuffled: sums of
    blocks of words first, then within a block, so that a long line isn't
    summed anew for every word.
    """
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    per_char = F.col("w") / F.length(F.trim("text"))
    width = lambda x: F.floor(F.length(x) * F.col("per_char")).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    one = lines.withColumns({"tokens": F.split(t, " "), "per_char": per_char}).withColumn("widths", F.transform("tokens", width))
    starts = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / BLOCK).cast("int"))
    two = one.withColumn("sums", F.aggregate(F.transform(starts, lambda b: total(F.slice("widths", b * BLOCK + 1, F.lit(BLOCK)))), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    before = lambda i: F.get("sums", block(i)) + total(F.slice("widths", block(i) * BLOCK + 1, i % BLOCK))
    place = lambda i: F.floor(F.col("x") + before(i) + i * F.col("per_char")).cast("int")
    items = F.transform("tokens", lambda x, i: F.struct((i + 1).alias("word_num"), x.alias("text"), place(i).alias("x"), width(x).alias("w")))
    each = two.select("doc_id", (F.col("line_num") + 1).alias("line_num"), "confidence", "y", "h", F.explode(items).alias("i"))
    return each.select("doc_id", "line_num", "i.word_num", "i.text", "confidence", "i.x", "y", "i.w", "h", is_numeric(F.col("i.text")).alias("is_numeric"), is_stopword(F.col("i.text")).alias("is_stopword"))


def by_confidence(words: DataFrame, least: float) -> DataFrame:
    return words.where(F.col("confidence") >= least)


def numeric_words(words: DataFrame) -> DataFrame:
    return words.where("is_numeric")


def word_weight() -> Column:
    w = rules.WORD_WEIGHTS
    return F.when(F.col("is_stopword"), w["stopword"]).when(F.col("is_numeric"), w["numeric"]).otherwise(w["other"])


def ocr_stats(words: DataFrame, *keys: str) -> DataFrame:
    """Per document: counts, weighted mean confidence and the recognition score."""
    stats = words.groupBy(*(keys or ("doc_id",))).agg(
        F.count("*").alias("total_words"),
        F.count_if(F.col("confidence") < rules.LOW_CONFIDENCE).alias("low_confidence_words"),
        F.count_if("is_numeric").alias("numeric_words"),
        F.coalesce(F.sum(F.col("confidence") * word_weight()) / F.sum(word_weight()), F.lit(0.0)).alias("mean_confidence"),
    )
    return stats.withColumn("ocr_score", ocr_score())


def ocr_score() -> Column:
    n = F.col("total_words")
    good = F.least(F.lit(1.0), F.col("mean_confidence") / 100.0 + F.least(F.lit(0.1), F.col("numeric_words") / n * 0.2))
    return F.when((n < rules.LEAST_WORDS) | (F.col("low_confidence_words") / n > 0.4), 0.0).otherwise(good)


def digit_runs(words: DataFrame) -> DataFrame:
    """Three consecutive words of four digits, among a document's words that have four once everything else is stripped: doc_id, value."""
    order = Window.partitionBy("doc_id").orderBy("line_num", "word_num")
    digits = words.withColumn("text", F.regexp_replace(devanagari_digits(F.col("text")), "[^0-9]", "")).where(F.length("text") == 4)
    three = digits.select("doc_id", "line_num", "word_num", F.concat("text", F.lead("text", 1).over(order), F.lead("text", 2).over(order)).alias("value"))
    return three.where("value IS NOT NULL")
