"""Keywords and patterns of rule tables of any length in texts.

Tables up to WORKER_CHARS characters (measured first) are handed to the
workers, which find all keywords of a text in one walk of an Aho-Corasick
automaton. Larger tables are joined: a keyword is looked up by one of its
substrings of GRAM characters, the one that the fewest keywords have, and the
pairs that share it are verified. Both ways give the same rows. Where only the
best type is asked for, tables that fit give it as a column: no row of scores,
no join, and no pattern of a type that can't win any more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.operators.containment import substrings

#: Characters of a rule table that workers may hold, about 100 bytes each in an automaton.
WORKER_CHARS = 2_000_000
GRAM = 4


def keyword_table(keywords: DataFrame) -> DataFrame:
    """Distinct (type, keyword, weight); null and empty keywords are no rules; of repeated ones the largest weight counts."""
    return keywords.where("keyword <> '' AND type IS NOT NULL").groupBy("type", "keyword").agg(F.max("weight").cast("long").alias("weight"))


def pattern_table(patterns: DataFrame) -> DataFrame:
    """Distinct (type, pattern, weight), as keyword_table()."""
    return patterns.where("pattern IS NOT NULL AND type IS NOT NULL").groupBy("type", "pattern").agg(F.max("weight").cast("long").alias("weight"))


def fits_workers(table: DataFrame, column: str, most: int = WORKER_CHARS) -> bool:
    """Whether a rule table is small enough to be held by every worker."""
    return (table.agg(F.sum(F.length(column) + 16)).first()[0] or 0) <= most


def _scorer(rows: list[tuple[str, str, int]]) -> Callable[[str], dict[str, int]]:
    """By an automaton, the score of each type with a keyword in a lower-cased text. rows: type, keyword, weight."""
    import ahocorasick

    worth = defaultdict(list)
    for kind, word, weight in rows:
        worth[word].append((kind, weight))
    automaton = ahocorasick.Automaton()
    for word in worth:
        automaton.add_word(word, word)
    if worth:
        automaton.make_automaton()

    def score(text: str) -> dict[str, int]:
        out = defaultdict(int)
        for word in {w for _, w in automaton.iter(text)} if worth else ():
            for kind, weight in worth[word]:
                out[kind] += weight
        return out

    return score


def _walked(docs: DataFrame, rows: list[tuple[str, str, int]]) -> DataFrame:
    """doc_id, type, score by an automaton. docs: doc_id, t."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(rows)
        for batch in batches:
            out = [(doc, kind, n) for doc, text in zip(batch["doc_id"], batch["t"], strict=True) for kind, n in score(text).items()]
            yield pd.DataFrame(out, columns=["doc_id", "type", "score"])

    kind = docs.select("doc_id").schema.simpleString()[len("struct<") : -1]
    return docs.mapInPandas(walk, f"{kind}, type string, score long")


def keyword_pairs(docs: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches): doc_id, keyword of texts t that share the keyword's key, and of those that hold the keyword."""
    words = keywords.select("keyword").distinct()
    grams = words.where(F.length("keyword") >= GRAM).select("keyword", F.explode(F.filter(substrings(F.col("keyword"), GRAM), lambda g: F.length(g) == GRAM)).alias("key"))
    common = grams.groupBy("key").agg(F.count("*").alias("n"))
    rarest = grams.join(common, "key").groupBy("keyword").agg(F.min(F.struct("n", "key")).alias("k")).select("keyword", "k.key")
    keyed = rarest.unionByName(words.where(F.length("keyword") < GRAM).select("keyword", F.col("keyword").alias("key")))
    held = docs.select("doc_id", F.explode(substrings(F.col("t"), GRAM)).alias("key"))
    pairs = held.join(keyed, "key").select("doc_id", "keyword")
    return pairs, pairs.join(docs, "doc_id").where(F.contains("t", "keyword")).select("doc_id", "keyword")


def keyword_scores(docs: DataFrame, text: str, keywords: DataFrame, most: int = WORKER_CHARS) -> DataFrame:
    """doc_id, type, score: the weights of each type's keywords that the lower-cased text contains, each once; only types with any.

    docs: doc_id (a key), text; keywords: type, keyword, weight, of any number.
    Null texts contain nothing.
    """
    table = keyword_table(keywords)
    low = docs.select("doc_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    if fits_workers(table, "keyword", most):
        return _walked(low, [tuple(r) for r in table.select("type", "keyword", "weight").collect()])
    _, met = keyword_pairs(low, table)
    return met.join(table, "keyword").groupBy("doc_id", "type").agg(F.sum("weight").alias("score"))


def pattern_scores(docs: DataFrame, text: str, patterns: DataFrame, most: int = WORKER_CHARS) -> DataFrame:
    """doc_id, type, score: the weights of each type's patterns that the text matches, upper or lower case. patterns: type, pattern, weight.

    Every text is held against every pattern: expressions have no common key.
    A table that fits is compiled once a task; a larger one is taken in parts
    that fit, each a pass of its own over the texts.
    """
    table = pattern_table(patterns)
    plain = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = table.agg(F.sum(F.length("pattern") + 16)).first()[0] or 0
    parts = max(1, -(-size // max(1, most)))
    part = F.pmod(F.xxhash64("type", "pattern"), F.lit(parts))
    found = [_matched(plain, [tuple(r) for r in table.where(part == k).select("type", "pattern", "weight").collect()]) for k in range(parts)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "type").agg(F.sum("score").alias("score")) if parts > 1 else found[0]


def _matched(docs: DataFrame, rows: list[tuple[str, str, int]]) -> DataFrame:
    """doc_id, type, score by patterns. docs: doc_id, t."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        compiled = [(kind, regex.compile(p, regex.IGNORECASE), n) for kind, p, n in rows]
        for batch in batches:
            out = []
            for doc, t in zip(batch["doc_id"], batch["t"], strict=True):
                score = defaultdict(int)
                for kind, p, n in compiled:
                    if p.search(t):
                        score[kind] += n
                out += [(doc, kind, n) for kind, n in score.items()]
            yield pd.DataFrame(out, columns=["doc_id", "type", "score"])

    kind = docs.select("doc_id").schema.simpleString()[len("struct<") : -1]
    return docs.mapInPandas(match, f"{kind}, type string, score long")


def rule_scores(docs: DataFrame, text: str, tables: dict[str, DataFrame], most: int = WORKER_CHARS) -> DataFrame:
    """doc_id, type, score from the tables type_keywords and type_patterns; only types with any."""
    words = keyword_scores(docs, text, tables["type_keywords"], most)
    return words.unionByName(pattern_scores(docs, text, tables["type_patterns"], most)).groupBy("doc_id", "type").agg(F.sum("score").alias("score"))


def best_types(scores: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """doc_id, doc_type, score: each document's type of the highest score; of equal ones the later in `order`, types that aren't in it before all, by name."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("type"))
    return scores.groupBy("doc_id").agg(F.max(F.struct("score", place.alias("place"), "type")).alias("b")).select("doc_id", F.col("b.type").alias("doc_type"), "b.score")


def _chooser(words: list[tuple[str, str, int]], patterns: list[tuple[str, str, int]], order: tuple[str, ...]) -> Callable[[str, str], str | None]:
    """The type that best_types() chooses for (lower-cased text, text).

    Types are taken by the score of their keywords. A type's patterns are
    searched as long as those left can lift it to the best of the types before;
    patterns that may begin at any edge of a word cost most and come last.
    """
    import regex

    score, place = _scorer(words), {k: i + 1 for i, k in enumerate(order)}
    mine = defaultdict(list)
    for kind, p, n in sorted(patterns, key=lambda r: (r[1].startswith("(^"), r[1])):
        mine[kind].append((regex.compile(p, regex.IGNORECASE), n))
    most = {kind: sum(max(n, 0) for _, n in ps) for kind, ps in mine.items()}

    def choose(low: str, text: str) -> str | None:
        scores = score(low)
        best = max(((n, place.get(k, 0), k) for k, n in scores.items() if k not in mine), default=None)
        for kind in sorted(mine, key=lambda k: -scores.get(k, 0)):
            left, hit, n = most[kind], kind in scores, scores.get(kind, 0)
            for p, weight in mine[kind]:
                if best and n + left < best[0]:
                    break
                left -= max(weight, 0)
                if p.search(text):
                    n, hit = n + weight, True
            if hit:
                best = max(best, (n, place.get(kind, 0), kind)) if best else (n, place.get(kind, 0), kind)
        return best[2] if best else None

    return choose


def best_type(text: Column, tables: dict[str, DataFrame], order: tuple[str, ...], most: int = WORKER_CHARS) -> Column | None:
    """The doc_type of best_types(rule_scores()) as a column, null where no rule hits; None if the rule tables are too large for the workers."""
    words, patterns = keyword_table(tables["type_keywords"]), pattern_table(tables["type_patterns"])
    if not (fits_workers(words, "keyword", most) and fits_workers(patterns, "pattern", most)):
        return None
    word_rows = [tuple(r) for r in words.select("type", "keyword", "weight").collect()]
    pattern_rows = [tuple(r) for r in patterns.select("type", "pattern", "weight").collect()]

    @F.pandas_udf("string")
    def chosen(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        choose = _chooser(word_rows, pattern_rows, order)
        for low, t in batches:
            yield pd.Series([choose(a, b) for a, b in zip(low, t, strict=True)], dtype="object")

    t = F.coalesce(text, F.lit(""))
    return chosen(F.lower(t), t)
