"""Document types from keywords and patterns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.operators.keywords import rule_scores
from papersluice.sources import rules


def keyword_hits(text: Column, kind: str) -> Column:
    """Weights of the type's keywords that the text contains, each once; phrases weigh more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(k)), rules.PHRASE_WEIGHT if " " in k else 1).otherwise(0) for k in rules.KEYWORDS[kind]], F.lit(0))


def pattern_hits(text: Column, kind: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a + b, [F.when(t.rlike(f"(?i){p}"), rules.PATTERN_WEIGHT).otherwise(0) for p in rules.PATTERNS[kind]], F.lit(0))


def type_scores(docs: DataFrame, text: str) -> DataFrame:
    """docs with score_<type>: literal sums in one projection, so no join, no shuffle, and streams can use it."""
    return docs.withColumns({f"score_{k}": keyword_hits(F.col(text), k) + pattern_hits(F.col(text), k) for k in rules.TYPES})


def best_type() -> Column:
    """The type of the highest score; of equal ones the last in TIE_ORDER; the first type if all are 0."""
    best = F.greatest(*[F.col(f"score_{k}") for k in rules.TYPES])
    chosen = F.lit(rules.TIE_ORDER[0])
    for k in rules.TIE_ORDER:
        chosen = F.when(F.col(f"score_{k}") == best, F.lit(k)).otherwise(chosen)
    return F.when(best == 0, F.lit(rules.TIE_ORDER[0])).otherwise(chosen)


def classify(docs: DataFrame, text: str) -> DataFrame:
    return type_scores(docs, text).withColumn("doc_type", best_type())


def classify_by_rules(docs: DataFrame, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id, type, score of every type of the rule tables, of any length; for types that are added as rows."""
    scores = rule_scores(docs, text, tables)
    types = tables["type_keywords"].select("type").unionByName(tables["type_patterns"].select("type")).distinct()
    names = F.array(*[F.lit(r["type"]) for r in types.where("type IS NOT NULL").collect()])
    every = docs.select("doc_id", F.explode(names).alias("type"))
    return every.hint("merge").join(scores, ["doc_id", "type"], "left").select("doc_id", "type", F.coalesce("score", F.lit(0)).alias("score"))


def anchor_windows(text: Column, n: int) -> Column:
    """The lower-cased words of every n words in a row, sorted and joined; one window of all words if there are fewer."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.array_sort(F.slice(words, i, n)), " "))


def anchor_filter(anchor: str) -> tuple[str, int, int, int, list[str]]:
    """(sorted words, least and most length of a window, most edits, pieces) for windows that can reach ANCHOR_THRESHOLD.

    A similarity of t per cent allows (100 - t) / 100 of the longer length in
    edits. At most d edits leave one of d + 1 pieces of the anchor untouched, so
    a window without any of the pieces needs no distance.
    """
    wanted, share = " ".join(sorted(anchor.split())), (100 - rules.ANCHOR_THRESHOLD) / 100
    n = len(wanted)
    least, most = math.ceil(n * (1 - share) - 1e-9), math.floor(n / (1 - share) + 1e-9)
    edits = math.floor(most * share + 1e-9)
    cut = [round(k * n / (edits + 1)) for k in range(edits + 2)]
    pieces = [wanted[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    return wanted, least, most, edits, [p for p in pieces if p] if all(pieces) else []


def near_anchor(window: Column, anchor: str) -> tuple[Column, Column]:
    """(whether a window has to be compared, whether it is similar enough): the distance is worked out only for the first."""
    wanted, least, most, edits, pieces = anchor_filter(anchor)
    may = F.length(window).between(least, most)
    if pieces:
        may = may & reduce(lambda a, b: a | b, [F.contains(window, F.lit(p)) for p in pieces])
    distance = F.levenshtein(window, F.lit(wanted), edits)
    longer = F.greatest(F.length(window), F.lit(len(wanted)))
    return may, may & (distance >= 0) & (100.0 * (1 - distance / longer) >= rules.ANCHOR_THRESHOLD)


def lower_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def sorted_words(text: Column) -> Column:
    """The words that an anchor's windows are compared with."""
    return F.array_join(F.sort_array(lower_words(text)), " ")


def holds_anchor(low: Column, held: Column, a: Column) -> Column:
    """Whether a text has an anchor, or a window of words similar enough to it. low: the text in lower case; held: its lower_words(); a: low, n (words), wanted (sorted_words()), threshold.

    Lengths that differ too much already bound the similarity: there the
    distance isn't worked out.
    """
    longer = lambda w: F.greatest(F.length(w), F.length(a["wanted"]))
    reaches = lambda edits, w: 100.0 * (1 - edits / longer(w)) >= a["threshold"]
    near = lambda w: reaches(F.abs(F.length(w) - F.length(a["wanted"])), w) & reaches(F.levenshtein(w, a["wanted"]), w)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(held) - a["n"] + 1, F.lit(1))), lambda i: F.array_join(F.sort_array(F.slice(held, i, a["n"])), " "))
    return F.when(F.contains(low, a["low"]), F.lit(100.0) >= a["threshold"]).otherwise(F.exists(windows, near))


def anchor_scores(docs: DataFrame, text: str, kinds: tuple[str, ...] = rules.TYPES) -> DataFrame:
    """docs with <type>_required, <type>_optional and <type>_score: how many of a type's anchors the text holds or nearly holds, and the score. Windows of words are built once for each length."""
    names = {a for k in kinds for part in rules.ANCHORS[k].values() for a in part}
    lengths = sorted({len(a.split()) for a in names})
    held = docs.withColumns({"_low": F.lower(F.coalesce(F.col(text), F.lit(""))), **{f"_win{n}": anchor_windows(F.coalesce(F.col(text), F.lit("")), n) for n in lengths}})
    held = held.select(F.inline(F.array(F.struct("*"))))  # the windows are computed here, not in every anchor's filter
    found = lambda a: (F.contains("_low", F.lit(a)) | F.exists(f"_win{len(a.split())}", lambda w: near_anchor(w, a)[1])).cast("int")
    counts = {f"{k}_{part}": reduce(lambda x, y: x + y, [found(a) for a in rules.ANCHORS[k][part]], F.lit(0)) for k in kinds for part in ("required", "optional")}
    out = held.withColumns(counts)
    score = lambda k: F.least(F.lit(1.0), F.col(f"{k}_required") / len(rules.ANCHORS[k]["required"]) + F.least(F.lit(0.2), F.col(f"{k}_optional") * 0.05))
    return out.withColumns({f"{k}_score": score(k) for k in kinds}).drop("_low", *[f"_win{n}" for n in lengths])
