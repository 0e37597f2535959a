"""Layout operators over streams: whole micro-batches through the table operators, each written once.

Neighbours and clusters of boxes join a document's boxes with each other, in
rounds, which no streaming query does by itself. A document arrives as one row
with all its lines, so a micro-batch holds whole documents and the table
operators run on it unchanged, inside foreachBatch.

A batch may be run again: after a failure Spark repeats the last batch under
the same number. Its output goes to a folder named by that number, in
overwrite mode, so a repetition replaces what a broken run had left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papersluice.operators import layout
from papersluice.session import written

#: What the layout streams read: a document's lines with their boxes.
BOXED = "doc_id BIGINT, ts TIMESTAMP, lines ARRAY<STRUCT<line_num INT, text STRING, confidence DOUBLE, x INT, y INT, w INT, h INT>>"
Work = Callable[[DataFrame], DataFrame]


def boxed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_num, text, confidence, x, y, w, h of documents with boxed lines."""
    return docs.select("doc_id", F.inline("lines"))


def centres(lines: DataFrame) -> DataFrame:
    """doc_id, id, px, py: the lines' centres as points."""
    return lines.select("doc_id", F.col("line_num").alias("id"), F.expr("CAST(x + w DIV 2 AS INT)").alias("px"), F.expr("CAST(y + h DIV 2 AS INT)").alias("py"))


def neighbour_pairs(docs: DataFrame) -> DataFrame:
    return layout.neighbours(centres(boxed_lines(docs)))


def cluster_rows(docs: DataFrame) -> DataFrame:
    return layout.clusters(centres(boxed_lines(docs)))


def once(target: str, work: Work) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: work(batch) is stored under target/batch=<number>, a repeated batch in place of its first try.

    The batch is written in the shared folder first: work may read it many
    times, and a source that is read again (a socket, a trimmed topic) needn't
    give the same rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        stored = written(batch, "batch")
        work(stored).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run


def layout_stream(docs: DataFrame, work: Work, target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts work (neighbour_pairs, cluster_rows or another function of tables) over a stream of documents; its results are the Parquet table `target`, by batch."""
    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once(target, work)).trigger(**(trigger or {"availableNow": True})).start()
