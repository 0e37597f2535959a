"""Triage of streams: stateless decisions, decision rates over event time, retries dropped, what was late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papersluice.plans.triage import triage

#: State on local disk with changelog checkpoints: a batch uploads what has changed, however large the state is.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB."""
    for key, value in ROCKSDB.items():
        spark.conf.set(key, value)


def triage_stream(docs: DataFrame) -> DataFrame:
    """docs: a stream with the columns of triage.INPUT. Stateless, append: the same projections as over tables."""
    return triage(docs)


def dedup_stream(docs: DataFrame, key: str = "doc_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark; state is kept for `late` only."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def decision_rate(results: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Decisions per type and event-time window; later rows than the watermark are dropped. Also runs over tables."""
    timed = results.withWatermark(time, late) if results.isStreaming else results
    return timed.groupBy(F.window(time, window).alias("w"), "doc_type", "decision").agg(F.count("*").alias("n_docs")).select(F.col("w.start").alias("window_start"), "doc_type", "decision", "n_docs")


def observed(results: DataFrame, name: str, time: str = "ts") -> DataFrame:
    """results with metrics under `name` in every batch's progress: rows, earliest and latest event, rows without a time."""
    return results.observe(name, F.count("*").alias("rows"), F.min(time).alias("earliest"), F.max(time).alias("latest"), F.count_if(F.col(time).isNull()).alias("without_time"))


def rate_stream(results: DataFrame, target: str, checkpoint: str, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", **trigger: object) -> StreamingQuery:
    """Starts decision rates of a stream (doc_id, doc_type, decision, ts) into the Parquet table `target`.

    Retries of a document within `late` count once. Append mode: a window's
    row comes once, when the watermark has passed its end, and its state goes
    then; rows older than the watermark are dropped and counted in
    batch_report(). Rows without a time belong to no window.
    """
    seen = observed(results, "results", time)
    first = seen.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id"])
    grouped = first.groupBy(F.window(time, window).alias("w"), "doc_type", "decision").agg(F.count("*").alias("n_docs"))
    rates = grouped.select(F.col("w.start").alias("window_start"), "doc_type", "decision", "n_docs")
    out = rates.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return out.trigger(**(trigger or {"availableNow": True})).start()


def batch_report(query: StreamingQuery, name: str = "results") -> list[dict]:
    """Per micro-batch of a query: its number, rows, watermark, rows dropped as late, rows of state, and the metrics observed under `name`. A few numbers for each batch that Spark still remembers."""
    out = []
    for p in query.recentProgress:
        state = p["stateOperators"]
        metrics = p["observedMetrics"].get(name)
        out.append({
            "batch": p["batchId"], "rows": p["numInputRows"], "watermark": p["eventTime"].get("watermark"), "late": sum(s["numRowsDroppedByWatermark"] for s in state),
            "state_rows": sum(s["numRowsTotal"] for s in state), "evicted": sum(s["numRowsRemoved"] for s in state), "observed": metrics.asDict() if metrics else None,
        })
    return out
