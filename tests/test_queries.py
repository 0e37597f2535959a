"""Every query with SQL against that SQL on the smallest tables; layout operators without SQL by brute force; streams against tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from papersluice.operators import classify, layout
from papersluice.plans import catalogue, decision_queries, layout_queries, triage
from papersluice.sources import fixtures, rules
from papersluice.sources import lines as line_sources
from papersluice.streaming.triage import decision_rate, dedup_stream, triage_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    r = con.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    at = [list(r.columns).index(c) for c in columns]
    want = sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
    got = sorted((tuple(norm(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_clusters_match_brute_force(spark):
    import random

    r = random.Random(4)
    points = [(d, i, r.randrange(400), r.randrange(400)) for d in range(4) for i in range(60)]
    got = {(x.doc_id, x.id): x.cluster for x in layout.clusters(spark.createDataFrame(points, "doc_id int, id int, px int, py int")).collect()}
    for d in range(4):
        own = {i: (x, y) for k, i, x, y in points if k == d}
        near = {i: [j for j in own if (own[i][0] - own[j][0]) ** 2 + (own[i][1] - own[j][1]) ** 2 <= 2500] for i in own}
        cores = {i for i in own if len(near[i]) >= 3}
        label = {i: i for i in cores}
        for _ in own:
            label = {i: min(label[j] for j in near[i] if j in cores) for i in cores}
        want = label | {i: min(label[j] for j in near[i] if j in cores) for i in own if i not in cores and any(j in cores for j in near[i])}
        assert {i: c for (k, i), c in got.items() if k == d} == want


def test_words_in_every_region(spark):
    lines = fixtures.card_lines(spark, SF)
    held = {}
    for w in layout_queries.words.line_words(lines).collect():
        held.setdefault(w.doc_id, []).append((w.x + w.w // 2, w.y + w.h // 2))
    want = {}
    for r in layout_queries.layout.regions_of(lines, layout_queries.PAGE_W, layout_queries.PAGE_H).collect():
        n = sum(r.x <= x <= r.x + r.w and r.y <= y <= r.y + r.h for x, y in held.get(r.doc_id, []))
        if n:
            want[r.doc_id, r.region_id] = n
    got = {(r.doc_id, r.region_id): r.n_words for r in layout_queries.words_in_region(spark, SF).collect()}
    assert got == want and max(k for _, k in got) > 3


def test_suppression(spark):
    rows = [(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 1, 0, 10, 10, 0.8), (1, 2, 50, 50, 10, 10, 0.5), (1, 3, 2, 0, 10, 10, 0.95)]
    got = layout.suppress_duplicates(spark.createDataFrame(rows, "doc_id int, region_id int, x int, y int, w int, h int, confidence double"), 0.7)
    assert got.first().kept == [3, 0, 2]


def test_merging(spark):
    rows = [(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 5, 0, 10, 10, 0.7), (1, 2, 10, 0, 10, 10, 0.5), (1, 3, 50, 50, 4, 4, 0.2)]
    got = layout.merge_overlaps(spark.createDataFrame(rows, "doc_id int, region_id int, x int, y int, w int, h int, confidence double"), 0.3)
    assert sorted((r.region_id, r.n, r.x, r.w, r.confidence) for r in got.collect()) == [(0, 2, 0, 15, 0.8), (2, 1, 10, 10, 0.5), (3, 1, 50, 4, 0.2)]


def test_triage_is_total(spark):
    out = decision_queries.triaged(spark, SF).select("doc_id", "decision", "final_score").toPandas()
    assert len(out) == 150 and set(out.decision) <= {"accept", "review", "reject"} and out.final_score.between(0, 1).all()


def test_streams_equal_tables(spark, tmp_path):
    cards = decision_queries.card_input(spark, SF).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 7))
    source = str(tmp_path / "in")
    cards.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(cards.schema).parquet(source)
    keep = ["doc_id", "decision", "final_score"]
    run = triage_stream(dedup_stream(stream)).select(*keep).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    want = {tuple(r) for r in triage.triage(cards.drop("ts")).select(*keep).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    results = stream.select("doc_id", "ts", F.lit("pan").alias("doc_type"), F.lit("accept").alias("decision"))
    run = decision_rate(results).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("rates").agg(F.sum("n_docs")).first()[0] == 150


def test_new_document_type(spark):
    more = [rules.DocumentType("invoice", ["invoice", "total amount"], ["(?:amount due)"])]
    docs = spark.createDataFrame([(1, "Invoice: total amount, amount due")], "doc_id int, t string")
    got = {r.type: r.score for r in classify.classify_by_rules(docs, "t", rules.rule_tables(spark, more)).collect()}
    assert got["invoice"] == 8 and set(got) == {"aadhaar", "pan", "vehicle_rc", "invoice"}


def test_sources(spark, tmp_path):
    lines = fixtures.document_lines(spark, SF)
    assert lines.count() > 200
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"x")
    (tmp_path / "f" / "b.bin").write_bytes(b"%PDF-1")
    (tmp_path / "f" / "c.png").write_bytes(b"x")
    (tmp_path / "f" / "d").write_bytes(b"x")
    got = {r.name: r.kind for r in line_sources.route_files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.pdf": "pdf", "b.bin": "pdf", "c.png": "png", "d": "jpg"}
    raw = spark.createDataFrame([(1, 0, " a ", 0.5, [[1.0, 2.0], [5.0, 2.0], [5.0, 9.0], [1.0, 9.0]]), (1, 1, " ", 0.5, [[0.0, 0.0]])], "doc_id long, line_num int, text string, score double, polygon array<array<double>>")
    raw.write.json(str(tmp_path / "raw"))
    row = line_sources.read_ocr_lines(spark, str(tmp_path / "raw"), "json").collect()
    assert [(r.text, r.confidence, r.x, r.y, r.w, r.h) for r in row] == [("a", 50.0, 1, 2, 4, 7)]
    line_sources.write_results(decision_queries.triaged(spark, SF), str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res")).count() == 150
    (tmp_path / "c.yaml").write_text("anchors:\n  pan:\n    required: ['x']\n    threshold: 70\nscoring:\n  weights: {kv: 0.1}\ndecision: {accept_threshold: 0.9}\n")
    tables = rules.load_rules(spark, str(tmp_path / "c.yaml"))
    assert tables["anchors"].first().threshold == 70.0 and tables["thresholds"].first().value == 0.9
