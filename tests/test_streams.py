"""Streams that fail and go on, late and repeated rows, state that shrinks."""

import random

import pytest
from pyspark.sql import functions as F

from papersluice.streaming import layout as layout_streams
from papersluice.streaming import triage as rates


def documents(spark, seed, ids):
    r = random.Random(seed)
    rows = []
    for d in ids:
        n = r.choice([1, 8, 30])
        rows.append((d, None, [(i, "t", 80.0, r.randrange(300), r.randrange(300), 10, 10) for i in range(n)]))
    return spark.createDataFrame(rows, layout_streams.BOXED)


@pytest.mark.parametrize("work", [layout_streams.neighbour_pairs, layout_streams.cluster_rows])
def test_a_broken_layout_stream_goes_on_where_it_stopped(spark, tmp_path, work):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(3):
        documents(spark, k, range(10 * k, 10 * k + 10)).coalesce(1).write.mode("append").parquet(source)
    whole = {tuple(r) for r in work(spark.read.schema(layout_streams.BOXED).parquet(source)).collect()}
    stream = lambda: spark.readStream.schema(layout_streams.BOXED).option("maxFilesPerTrigger", 1).parquet(source)
    runs = []

    def breaks(docs):
        runs.append(docs.count())
        out = work(docs)
        if len(runs) == 2:  # half of the second batch is written when the job dies
            out.limit(3).write.mode("overwrite").parquet(f"{target}/batch=1")
            raise RuntimeError("lost")
        return out

    query = layout_streams.layout_stream(stream(), breaks, target, checkpoint)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert len(runs) == 2
    query = layout_streams.layout_stream(stream(), breaks, target, checkpoint)
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(target).drop("batch").collect()]
    assert len(runs) == 4 and len(got) == len(whole) and set(got) == whole
    # the batch that ended before its commit was noted runs once more: no row twice
    layout_streams.once(target, work)(spark.read.parquet(source).where("doc_id >= 10 AND doc_id < 20"), 1)
    assert spark.read.parquet(target).count() == len(whole)


def test_late_and_repeated_rows(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    before = {k: spark.conf.get(k, None) for k in rates.ROCKSDB}
    rates.use_rocksdb(spark)
    schema = "doc_id BIGINT, doc_type STRING, decision STRING, ts TIMESTAMP"

    def batch(rows):
        frame = spark.createDataFrame([(d, "pan", "accept", h, m) for d, h, m in rows], "doc_id bigint, doc_type string, decision string, h int, m int")
        ts = F.make_timestamp(F.lit(2024), F.lit(5), F.lit(1), "h", "m", F.lit(30))
        frame.select("doc_id", "doc_type", "decision", ts.alias("ts")).coalesce(1).write.mode("append").parquet(source)
        query = rates.rate_stream(spark.readStream.schema(schema).parquet(source), target, checkpoint)
        query.awaitTermination()
        return rates.batch_report(query)

    first = batch([(1, 10, 1), (2, 10, 7), (3, 10, 2), (1, 10, 3), (4, 10, 12)] + [(d, 10, 12) for d in range(100, 160)])  # out of order; 1 comes twice
    second = batch([(5, 10, 9), (2, 10, 8), (6, 12, 0)])  # 5 is late by 3 minutes but within the watermark; 2 again
    third = batch([(7, 10, 4), (8, 12, 1)])  # 7 is older than the watermark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {(r.window_start.strftime("%H:%M"), r.n_docs) for r in spark.read.parquet(target).collect()}
    assert got == {("10:00", 2), ("10:05", 2), ("10:10", 61)}
    assert sum(b["late"] for b in first + second) == 0 and sum(b["late"] for b in third) == 1
    assert max(b["state_rows"] for b in first) > 60 and third[-1]["state_rows"] < 10
    assert sum(b["evicted"] for b in second + third) > 60
    assert [b["observed"]["rows"] for b in first if b["rows"]] == [65]
