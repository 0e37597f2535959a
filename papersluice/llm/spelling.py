"""Operator 13: grouping spelling variants by PartEnum signatures.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. Their letter multisets, written as binary vectors over (letter,
occurrence), then differ in two places at most. PartEnum cuts the vectors into
PARTS parts; two places lie in two parts at most, so the vectors agree on all
parts but some two. A signature is the projection on all parts but two, one for
each two: near words share a signature. An equi-join over signatures finds the
candidates, and the edit distance verifies them.

Signatures alone pair all words that are nearly anagrams (190 million pairs for
280,000 words), so the join key also holds half a word: the edit lies in one
half of the shorter word, and the words agree on the other, its first or last
half. Every near pair still shares a key, 24 keys a word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import key_string, whole
from papersluice.session import read_table, written

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Parts of a multiset's vector; two may differ.
PARTS, DIFFERENT = 4, 2
#: Words have so many code points and occurrences at least; a form has so many times the word's occurrences.
LENGTH, OFTEN, TIMES = 5, 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter (the contract's simulated typing errors).
SLIPS = 97


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: all runs of letters of all texts, A-Z lower-cased."""
    lowered = F.translate(whole("text"), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))


def slipped(found: DataFrame, one_in: int = SLIPS) -> DataFrame:
    """word: the runs, of which those whose hash with the doc_id one_in divides lose one code point."""
    h = F.crc32(F.concat(key_string("doc_id"), F.lit(":"), F.col("run")).cast("binary"))
    hashed = found.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """word, n: the words of enough code points and occurrences."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def part_hashes(word: Column, parts: int = PARTS) -> Column:
    """Per part of the binary vector of a word's letter multiset a hash of the places that are set."""
    letters = F.array_sort(F.split(word, ""))
    places = F.transform(letters, lambda c, i: F.xxhash64(c, i - F.array_position(letters, c)))
    combined = lambda p: F.aggregate(F.filter(places, lambda h: F.pmod(h, F.lit(parts)) == p), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    return F.array(*[combined(p) for p in range(parts)])


def signatures(parts: Column, of: int = PARTS, different: int = DIFFERENT) -> Column:
    """PartEnum: the projections on all parts but some `different`, each told apart by these."""
    return F.array(*[F.xxhash64(F.lit(k), *[parts[p] for p in range(of) if p not in out]) for k, out in enumerate(combinations(range(of), different))])


def join_keys(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """key, word, short: signatures with a half of the word, for a shorter word of the same length (short) and of one letter less."""
    signed = words.select("word", F.explode(F.array(part_hashes(F.col("word"), parts))).alias("p"))
    signed = signed.select("word", signatures(F.col("p"), parts).alias("sigs"))
    half = lambda m: F.floor(m / 2).cast("int")
    side = lambda m: [F.struct(F.lit(s).alias("side"), m.alias("m"), text.alias("half")) for s, text in ((0, F.left("word", half(m))), (1, F.right("word", half(m))))]
    n = F.length("word")
    halves = F.explode(F.array(*side(n), *side(n - 1))).alias("h")
    spread = signed.select("word", "sigs", halves).select("word", F.explode("sigs").alias("sig"), "h")
    return spread.select(F.xxhash64("sig", "h.side", "h.m", "h.half").alias("key"), "word", (F.col("h.m") == F.length("word")).alias("short"))


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, b (a < b): the words of one edit between them, each pair once."""
    keys = join_keys(words, parts)
    x = keys.select("key", F.col("word").alias("a"), F.col("short").alias("short_a"))
    y = keys.select("key", F.col("word").alias("b"), F.col("short").alias("short_b"))
    near = (F.col("a") < F.col("b")) & (F.col("short_a") | F.col("short_b")) & (F.levenshtein("a", "b", 1) == 1)
    return x.join(y.hint("merge"), "key").where(near).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form, null for none) followed to the last. Pointers double, so chains of n forms take log2(n) rounds; forms must make no circle."""
    at = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        after = written(at.join(up, "root").select("word", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        at = after.select("word", "root")
        if not after.where("moved").take(1):
            return at


def variants(words: DataFrame, times: int = TIMES, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n; words are distinct and not null).

    form: the near word of most occurrences (ties: first in code-point order)
    if it has `times` the word's at least; root: the last of the chain of
    forms, the word itself without one. An empty vocabulary gives an empty
    result; other columns don't matter.
    """
    words = written(words.select("word", "n"), "words")
    pairs = written(near_words(words, parts), "near")
    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = each.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = met.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "b")).alias("top"))
    known = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    enough = -F.col("top.less") >= times * F.col("n")
    forms = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("top.b")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n"))
    forms = written(forms, "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root. Null texts have no words; a null doc_id is written as nothing; repeated rows count each."""
    return variants(vocabulary(slipped(runs(read_table(spark, sf_dir, "documents")))))
