"""Operator 8: quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit for each rule that failed. A policy is a mask of bits with a
version, so a policy is applied, and its ablations are counted, with bitwise
operations over the ledger, without another look at the texts. Native
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import WORD, whole, words
from papersluice.session import read_table, written

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

LETTERED = r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"
BULLET, ELLIPSIS = r"^[\x20\x09-\x0D]*[-*\x{2022}]", r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"

#: Rules in the order of their bits: name, condition under which a document fails. No threshold divides, so empty texts need no case.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 100000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("few_letters", "100 * n_lettered < 50 * n_words"),
    ("bullets", "100 * n_bullets > 90 * n_lines"),
    ("ellipses", "100 * n_ellipses > 30 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
#: v1: rules of words and lines; v2: all but the length; v3: all.
POLICIES = (
    BASE,
    Policy("v1", tuple(name for name, _ in RULES[:7] if name != "many_words")),
    Policy("v2", tuple(name for name, _ in RULES if name != "many_words")),
    Policy("v3", tuple(name for name, _ in RULES)),
)
CURRENT = POLICIES[-1]


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) and the measurements of each text, in one pass and without a shuffle.

    Repeated windows are found by sorting a text's window hashes (64 bits) with
    their positions, n log n in the words of one text.
    """
    keep = [f"`{c}`" for c in (["doc_id"] if keep is None else keep)]
    t = whole(f"`{text}`")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    like = lambda p: F.size(F.filter("_m_lines", lambda x: x.rlike(p))).cast("long")
    w = F.col("_m_words")
    first = docs.select(
        *keep,
        words(f"`{text}`").alias("_m_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(LETTERED)).cast("long").alias("n_lettered"),
        lines.alias("_m_lines"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    second = first.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lettered",
        F.size("_m_lines").cast("long").alias("n_lines"),
        like(BULLET).alias("n_bullets"),
        like(ELLIPSIS).alias("n_ellipses"),
        (F.size("_m_lines") - F.size(F.array_distinct("_m_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > 3, F.array_sort(windows)).alias("_m_sorted"),
    )
    s = F.col("_m_sorted")
    found = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])))
    third = second.withColumn("_m_found", F.transform(found, lambda x: x["p"]))
    covered = F.array_distinct(F.flatten(F.transform("_m_found", lambda p: F.array(p, p + 1, p + 2))))
    counts = ("n_words", "word_chars", "n_symbols", "n_lettered", "n_lines", "n_bullets", "n_ellipses", "n_dup_lines")
    return third.select(*keep, *counts, F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words")).withColumn(
        "n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long"))
    )


def failures() -> Column:
    """The bits of the rules that fail, from the measurements."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """measured() and `failed`, the bits of the failed rules.

    A null text counts as empty and fails few_words; repeated rows are judged
    alike; an empty table gives an empty ledger; other columns of docs, whatever
    their names, pass only when named in keep and must not be named as a measure.
    """
    return measured(docs, text, keep).withColumn("failed", failures())


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it. One row per rule; one pass over the ledger."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    names = [(i, name) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    sums = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_or(hit), F.lit(0)).alias("any"),
        F.count_if(hit == 0).alias("kept"),
        *[F.count_if(hit.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i, _ in names],
        *[F.count_if(hit == (1 << i)).alias(f"a{i}") for i, _ in names],
    )
    each = F.array(*[F.struct(F.lit(policy.version).alias("version"), F.lit(name).alias("rule"), F.col(f"f{i}").alias("failing"), F.col(f"a{i}").alias("failing_alone"), (F.col("kept") + F.col(f"a{i}")).alias("kept_without")) for i, name in names])
    return sums.select(F.inline(each))


def kept_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The documents that the policy keeps; columns as in docs, which may have any names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    judged = ledger(packed, "_text", ["_row"]).select("_row", F.explode(F.array("failed")).alias("failed"))  # else the filter, pushed below the lambdas, repeats their arrays for each element
    return judged.where(passes(policy)).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents and what each policy makes of it; nulls, empty texts and repeated rows as in ledger()."""
    rows = ledger(read_table(spark, sf_dir, "documents"))
    verdicts = [passes(p).alias(f"kept_{p.version}") for p in POLICIES[1:]]
    return rows.select("doc_id", *MEASURES, (~passes(BASE)).alias("base_failed"), passes(CURRENT).alias("kept"), "n_lines", "n_lettered", "n_bullets", "n_ellipses", *verdicts, "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablations of every policy over one stored ledger of all documents."""
    stored = written(ledger(read_table(spark, sf_dir, "documents")), "ledger")
    out = ablations(stored, POLICIES[0])
    for policy in POLICIES[1:]:
        out = out.unionByName(ablations(stored, policy))
    return out


_LEDGER = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{LETTERED}')) AS BIGINT) AS n_lettered FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS n FROM t),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols, n_lettered,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) AS BIGINT) AS n_bullets, CAST(len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS BIGINT) AS n_ellipses,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
    FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, CAST({" + ".join(f"(CASE WHEN {fails} THEN {1 << i} ELSE 0 END)" for i, (_, fails) in enumerate(RULES))} AS BIGINT) AS failed FROM m)
"""
SQL = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {BASE.mask} <> 0 AS base_failed, failed & {CURRENT.mask} = 0 AS kept, n_lines,
  n_lettered, n_bullets, n_ellipses, {", ".join(f"failed & {p.mask} = 0 AS kept_{p.version}" for p in POLICIES[1:])}, failed FROM b
"""
_BITS = ", ".join(f"('{p.version}', '{name}', {p.mask}, {1 << i})" for p in POLICIES for i, (name, _) in enumerate(RULES) if p.mask >> i & 1)
ABLATIONS_SQL = f"""{_LEDGER}, r(version, rule, mask, bit) AS (VALUES {_BITS})
SELECT version, rule, count_if(failed & bit <> 0)::BIGINT AS failing, count_if(failed & mask = bit)::BIGINT AS failing_alone, count_if(failed & (mask - bit) = 0)::BIGINT AS kept_without
FROM b CROSS JOIN r GROUP BY version, rule
"""
