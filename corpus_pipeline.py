"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result as
Parquet in the shared folder, reads it again as the next one's docs and then
removes the stage's intermediate tables.

Whoever calls the stages writes each result before the next stage. A stage then
removes the intermediate tables of the one before it over the same sf_dir,
unless its docs still read them; those of the last stage stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm import lines, mixing, near, packing, quality
from papersluice.llm.text import word_count
from papersluice.session import read_table, release, tables_since, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By sf_dir, the intermediate tables of the stage called last outside run().
_BEFORE: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """A stage that first removes what the stage before it has left."""

    @wraps(stage)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _BEFORE.pop(sf_dir, [])
        if stage is not STAGES[0][1].__wrapped__ and not any(path.rsplit("/", 1)[-1] in file for path in left for file in docs.inputFiles()):
            release(spark, left)
        n = len(tables_since())
        out = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1].__wrapped__:
            _BEFORE[sf_dir] = tables_since(n)
        return out

    return tidy


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Null and empty texts fail it; repeated rows are judged alike; other columns pass through."""
    return quality.kept_documents(docs)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut; a document goes if that leaves it without words. n_chars follows the text; nulls as in lines.without_repeats()."""
    n = "n_cut"
    while n in docs.columns:
        n += "_"
    cut = lines.without_repeats(docs, counted=n)
    left = cut.where((F.col(n) == 0) | (word_count("text") > 0))
    length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return left.withColumn("n_chars", F.when(F.col(n) > 0, length).otherwise(F.col("n_chars"))).select(*[f"`{c}`" for c in docs.columns])


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; texts without words stay; as in near.one_of_each()."""
    return near.one_of_each(docs)


@_tidy
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in the curriculum's order; texts without words are never read; as in mixing.mixed()."""
    return mixing.mixed(docs)


@_tidy
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences; null texts are empty ones; as in packing.packed_documents()."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("packing", packing_stage),
]
#: Near-duplicate search and tokenizing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus. Runs don't share tables; those of the last stage stay, since its result is lazy."""
    docs, left = read_table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        n = len(tables_since())
        docs = stage.__wrapped__(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            *used, result = tables_since(n)
            release(spark, [*left, *used])
            left = [result]
    return docs
