"""Operator 7: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the words,
the stems of words (first 3 to 6 letters) and the inner parts of very long runs
of letters that it holds, a document's is the noisy-or of its sentences', 1 - prod(1 - p): toxic if any
sentence is. The weights are trained from labels of documents alone, and the
trained sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import key_string, whole
from papersluice.session import read_table, written

#: Features get a weight if their document counts over the rows that the weights are fitted on tell the labels apart, at a G statistic of LEAST_G or more.
LEAST_G = 8.0
#: Lengths of stems; the most letters of a whole word; runs longer than that are features by inner parts of PART letters.
STEMS, WHOLE, PART = (3, 4, 5, 6), 24, 6
#: Words whose features a task remembers.
REMEMBERED = 300_000
#: Labelled documents of either label that features are chosen and weights fitted on, about: with more, those whose hash is below a threshold. So a word that tells the labels apart counts alike in a table of any size, and the vocabulary stays bounded.
FIT_ROWS = 5_000
ROUNDS, RATE, DECAY = 400, 0.3, 1e-4
CUT = 0.7

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    found = [word[:n] for n in STEMS if len(word) >= n]
    if len(word) <= WHOLE:
        return [*found, f"{word}$"]
    return [*found, *dict.fromkeys(word[i : i + PART] for i in range(len(word) - PART + 1))]


class Known(dict):
    """Word to those of its features that are in the vocabulary; to all without one."""

    def __init__(self, vocabulary=None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if self.vocabulary is None or f in self.vocabulary)
        return found

    def of(self, sentence: str) -> set[str]:
        return {f for w in WORD.findall(sentence) if (found := self[w]) for f in found}


def log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0.0, z)


class Bags:
    """Documents as bags of sentences, and the log loss of the noisy-or over them.

    bags: per document its sentences that hold a feature of the vocabulary, as
    feature numbers; empty: per document how many other sentences it has. The
    parameters are the weights and, last, the bias.
    """

    def __init__(self, bags: list[list[list[int]]], empty: list[int], labels: list[int], n_words: int):
        self.y, self.rest, self.n_words = np.asarray(labels, "f8"), np.asarray(empty, "f8"), n_words
        self.doc = np.array([d for d, bag in enumerate(bags) for _ in bag], "i8")
        sizes = np.array([len(x) for bag in bags for x in bag], "i8")
        self.sent = np.repeat(np.arange(len(sizes)), sizes)
        self.word = np.array([w for bag in bags for x in bag for w in x], "i8")

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean log loss plus the weights' decay, and its gradient."""
        y, v, bias = self.y, self.n_words, theta[-1]
        z = bias + np.bincount(self.sent, theta[self.word], len(self.doc))
        log_q = np.bincount(self.doc, log_clean(z), len(y)) + self.rest * log_clean(theta[v:])[0]
        p = np.clip(-np.expm1(log_q), 1e-12, 1 - 1e-12)
        pull = np.where(y > 0, -(1 - p) / p, 1.0) / len(y)  # d loss / d(-log_q)
        dz = pull[self.doc] / (1 + np.exp(-z))
        g = np.bincount(self.word, dz[self.sent], v + 1) if len(self.word) else np.zeros(v + 1)
        g[v] = dz.sum() + (pull * self.rest).sum() / (1 + math.exp(-bias))
        g[:v] += DECAY * theta[:v]
        value = -np.where(y > 0, np.log(p), np.log1p(-p)).mean() + DECAY / 2 * (theta[:v] ** 2).sum()
        return float(value), g


def fit(bags: list[list[list[int]]], empty: list[int], labels: list[int], words: list[str]) -> Model:
    """Gradient descent (Adam) on the log loss of the noisy-or."""
    y = np.asarray(labels, "f8")
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return Model({}, math.log(share / (1 - share)))
    data, v = Bags(bags, empty, labels, len(words)), len(words)
    theta = np.zeros(v + 1)
    theta[v] = -5.0
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    for t in range(1, ROUNDS + 1):
        _, g = data.loss(theta)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return Model({w: round(float(x), 9) for w, x in zip(words, theta[:v], strict=True) if abs(x) > 1e-6}, round(float(theta[v]), 9))


def in_training(doc_id: Column) -> Column:
    """Fixed by the contract: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(key_string(doc_id)) % 3 != 1


def tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and feature: documents that hold it, and those of label 1."""
    known = Known()
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch["text"], batch["label"], strict=True):
            found = {f for w in set(WORD.findall(text.lower())) for f in known[w]}
            every.update(found)
            if label:
                toxic.update(found)
        yield pd.DataFrame({"word": list(every), "t": list(every.values()), "a": [toxic[w] for w in every]})


def train(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, label (0 or 1, others don't count).

    About FIT_ROWS rows of either label are used: the features are chosen by
    the G statistic of their document counts, and the weights fitted; only the
    rows' features of the vocabulary reach the driver. Null texts are empty,
    repeated rows count each. Without rows, or with one label alone, every
    score is that label's smoothed share.
    """
    every = written(labelled.where("label IN (0, 1)").select("doc_id", whole("text").alias("text"), "label"), "labelled")
    total = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")).first()
    totals = total(every)
    if not 0 < totals["k"] < totals["n"]:
        return fit([], [], [0] * (totals["n"] - totals["k"]) + [1] * totals["k"], [])
    share = lambda count: F.lit(min(1.0, FIT_ROWS / count) * 1_000_000)
    picked = F.pmod(F.xxhash64(key_string("doc_id"), "text"), F.lit(1_000_000)) < F.when(F.col("label") == 1, share(totals["k"])).otherwise(share(totals["n"] - totals["k"]))
    rows = written(every.where(picked), "fitted")
    totals = total(rows)
    n, k = float(totals["n"]), float(totals["k"])
    cell = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, t = F.col("a").cast("double"), F.col("t").cast("double")
    g = cell(a, t * k / n) + cell(t - a, t * (n - k) / n) + cell(k - a, (n - t) * k / n) + cell(n - k - t + a, (n - t) * (n - k) / n)
    counts = rows.select("text", "label").mapInPandas(tallies, "word string, t long, a long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("a").alias("a"))
    telling = counts.where("t >= 3").select("word", F.round(g, 6).alias("g")).where(F.col("g") >= LEAST_G)
    top = [r["word"] for r in telling.orderBy(F.desc("g"), "word").collect()]
    number = {w: i for i, w in enumerate(top)}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, known = [], Known(number)
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found = [sorted(number[f] for f in known.of(s)) for s in SENTENCE.findall(text.lower())]
                out.append((np.array([f for x in found if x for f in (*x, -1)], "i4").tobytes(), sum(not x for x in found), label))
            yield pd.DataFrame(out, columns=["bag", "empty", "label"])

    got = sorted((r["label"], r["empty"], bytes(r["bag"])) for r in rows.select("text", "label").mapInPandas(bags, "bag binary, empty int, label int").collect())
    return fit([_sentences(bag) for _, _, bag in got], [empty for _, empty, _ in got], [label for label, _, _ in got], top)


def _sentences(bag: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(bag, "i4")
    return [x[x >= 0] for x in np.split(flat, np.flatnonzero(flat < 0) + 1)[:-1]]


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, without its text, with score and offending: the spans (start, end, score) of sentences that alone reach CUT.

    Whole texts are scored; a null or empty text is one sentence without words;
    repeated rows are scored alike; an empty table gives an empty result. Other
    columns pass through, whatever their names; ones named score or offending
    are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "score", "offending")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], whole(F.col(f"`{text}`")).alias("_text"))
    schema = ", ".join([inner.drop("_text").schema.simpleString()[len("struct<") : -1]] * bool(keep) + ["score double", "offending array<struct<start:int,end:int,score:double>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, known, bias, low = model.weights, Known(model.weights), model.bias, -math.log1p(math.exp(model.bias))
        for batch in batches:
            scores, spans = [], []
            for t in batch["_text"]:
                log_q, found, n = 0.0, [], 0
                for m in SENTENCE.finditer(t):
                    n += 1
                    hits = known.of(m[0].lower())
                    z = bias + sum(weights[w] for w in sorted(hits)) if hits else bias
                    log_q += low if z == bias else -math.log1p(math.exp(z)) if z < 30 else -z
                    if z > 0 and (p := 1 / (1 + math.exp(-z))) >= CUT:
                        found.append({"start": m.start(), "end": m.end(), "score": p})
                scores.append(min(1.0, max(0.0, -math.expm1(log_q if n else low))))
                spans.append(found)
            out = batch.drop(columns=["_text"])
            out["score"], out["offending"] = scores, spans
            yield out

    done = inner.mapInPandas(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score", "offending")


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, empty and long texts, repeated rows as in scored(). Labels of held-out rows are never read."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    known = labels.where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    model = train(docs.where(in_training(F.col("doc_id"))).join(known.hint("merge"), "doc_id"))
    out = scored(docs, model)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
