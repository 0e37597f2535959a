"""Indexes, cells, rounds, hulls and automata against the plain loops that they take the place of."""

import math
import random

import pytest
from pyspark.sql import functions as F

from papersluice.operators import containment, density, extract, fields, greedy, hull, keywords, layout
from papersluice.plans import catalogue, join_queries
from papersluice.session import dealt

REGIONS = "doc_id int, region_id int, x int, y int, w int, h int, confidence double"


def overlap(a, b):
    w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0


def greedy_loop(rows, least):
    """seed of each row, in the order of rows"""
    kept, of = [], {}
    for r in rows:
        of[r[1]] = next((k[1] for k in kept if overlap(k, r) >= least), r[1])
        if of[r[1]] == r[1]:
            kept.append(r)
    return of


def pages(seed):
    r = random.Random(seed)
    out = [(d, i, r.randrange(0, 300), r.randrange(0, 300), r.randrange(0, 80), r.randrange(1, 60), r.randrange(1, 8) / 10) for d in range(6) for i in range(90)]
    out += [(50, i, 7, 7, 20, 20, 0.5) for i in range(40)]  # one box many times
    return out + [(51, i, 0, 6 * i, 30, 12, 0.9 - i / 1000) for i in range(150)]  # a chain, each waits for the one before


@pytest.mark.parametrize("rounds", [1, 6])
def test_suppression_is_the_sequential_one(spark, rounds, monkeypatch):
    monkeypatch.setattr(greedy, "ROUNDS", rounds)
    rows, frame = pages(1), spark.createDataFrame(pages(1), REGIONS)
    for least in (0.2, 0.7):
        got = {x.doc_id: x.kept for x in layout.suppress_duplicates(frame, least).collect()}
        for d in {r[0] for r in rows}:
            order = sorted((r for r in rows if r[0] == d), key=lambda r: (-r[6], r[1]))
            of = greedy_loop(order, least)
            assert got[d] == [r[1] for r in order if of[r[1]] == r[1]]


def test_merging_is_the_sequential_one(spark):
    rows = pages(2)
    got = {(x.doc_id, x.region_id): (x.n, x.x, x.y, x.w, x.h, x.confidence) for x in layout.merge_overlaps(spark.createDataFrame(rows, REGIONS), 0.25).collect()}
    want = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        of = greedy_loop(own, 0.25)
        for s in set(of.values()):
            m = [r for r in own if of[r[1]] == s]
            x, y = min(r[2] for r in m), min(r[3] for r in m)
            want[d, s] = (len(m), x, y, max(r[2] + r[4] for r in m) - x, max(r[3] + r[5] for r in m) - y, round(sum(r[6] for r in m) / len(m), 9))
    assert {k: v[:5] for k, v in got.items()} == {k: v[:5] for k, v in want.items()}
    assert all(abs(got[k][5] - v[5]) < 1e-8 for k, v in want.items())


def dbscan_loop(points, eps, least):
    near = {i: [j for j, q in points.items() if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if label.setdefault(j, i) == i:
                    todo += [k for k in near[j] if k in core and k not in label]
    for i in points:
        if i not in core and any(j in core for j in near[i]):
            label[i] = min(label[j] for j in near[i] if j in core)
    return label


@pytest.mark.parametrize(("eps", "least"), [(50, 3), (20, 1), (33.3, 6), (80, 12)])
def test_cells_cluster_as_pairs_do(spark, eps, least):
    r = random.Random(int(eps))
    points = {d: {i: (r.randrange(-200, 1500 // (d + 1)), r.randrange(-200, 1500 // (d + 1))) for i in range(250)} for d in range(4)}
    points[9] = {i: (30 * (i % 40), 50 * (i // 40)) for i in range(300)}  # distances of exactly eps
    points[10] = {i: (5, 5) for i in range(7)}
    rows = [(d, i, x, y) for d, own in points.items() for i, (x, y) in own.items()] + [(11, 0, None, 3)]
    got = density.density_clusters(spark.createDataFrame(rows, "doc_id int, id int, px int, py int"), eps, least).collect()
    want = {(d, i): c for d, own in points.items() for i, c in dbscan_loop(own, eps, least).items()}
    assert len(got) == len(want) and {(x.doc_id, x.id): x.cluster for x in got} == want


def test_a_full_cell_makes_no_pairs(spark):
    n = 100_000
    full = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id"), (F.col("id") % 30).cast("int").alias("px"), (F.col("id") * 7 % 31).cast("int").alias("py"))
    more = spark.createDataFrame([(1, n + 1, 60, 10), (1, n + 2, 500, 500)], "doc_id int, id long, px int, py int")
    got = density.density_clusters(full.unionByName(more)).groupBy("cluster").count().collect()
    assert [(r.cluster, r["count"]) for r in got] == [(0, n + 1)]
    cores = full.select("doc_id", F.lit(0).alias("gx"), F.lit(0).alias("gy"), F.lit(0).alias("node"), "px", "py").distinct()
    assert density.cell_ends(cores).count() <= 2 * (30 + 31)


def test_diameters(spark):
    r = random.Random(8)
    sets = [[(r.randrange(50), r.randrange(50)) for _ in range(n)] for n in (1, 2, 3, 5, 40, 200)] + [[(i, 2 * i) for i in range(9)], [(3, 3)] * 4, [(0, i) for i in range(5)], [(i % 5, i // 5) for i in range(25)]]
    sets += [[(r.random(), r.random()) for _ in range(60)], [(round(100 * math.cos(k / 5)), round(100 * math.sin(k / 5))) for k in range(32)]]
    want = [max(math.dist(a, b) for a in s for b in s) for s in sets]
    assert [hull.diameter(s) for s in sets] == pytest.approx(want)
    rows = [(d, float(x), float(y)) for d, s in enumerate(sets) for x, y in s] + [(0, None, 2.0)]
    got = {x.doc_id: x.distance for x in hull.farthest(spark.createDataFrame(rows, "doc_id int, px double, py double")).collect()}
    assert [got[d] for d in range(len(sets))] == pytest.approx(want)


def test_containment_meets_few_pairs(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(n))
    tokens = {d: {word(r.randint(1, 9)) for _ in range(400)} | {""} for d in range(3)}
    values = {d: {word(r.randint(1, 4)) for _ in range(10)} | {"".join(r.sample(sorted(tokens[d]), 3)) for _ in range(30)} | {"x"} for d in range(3)}
    v = spark.createDataFrame([(d, x) for d in values for x in values[d]], "doc_id int, v string")
    t = spark.createDataFrame([(d, x) for d in tokens for x in tokens[d]], "doc_id int, t string")
    want = {(d, x, y) for d in values for x in values[d] for y in tokens[d] if y and (x in y or y in x)}
    got = [tuple(x) for x in containment.containments(v, t).collect()]
    assert len(got) == len(want) and set(got) == want
    assert containment.candidates(v, t).count() < 0.25 * sum(len(values[d]) * len(tokens[d]) for d in values)


def test_containment_without_and_with_the_index(spark):
    v = spark.createDataFrame([(d, x) for d in range(3) for x in ("abcd", "b", "xyz", "", None)], "doc_id int, v string")
    tokens = [(0, "bc", 1), (0, "wxyz", 2), (1, "xyz", 3), (1, "é", 4), (1, None, 5)] + [(2, f"a{i}b", i) for i in range(50)]
    t = spark.createDataFrame(tokens, "doc_id int, t string, n int")
    want = {(d, x, y, n) for d, x in ((r.doc_id, r.v) for r in v.collect()) for e, y, n in tokens if d == e and x and y and (x in y or y in x)}
    assert {r.doc_id for r in containment.large_documents(v.where("v <> ''"), t.where("t <> ''"), 10).collect()} == {2}
    for pairs in (0, 10, 1000):
        got = [(r.doc_id, r.v, r.t, r.n) for r in containment.containments(v, t, pairs).collect()]
        assert len(got) == len(want) and set(got) == want


def test_hulls_of_many_documents_go_to_python_together(spark):
    rows = [(d, 3.0 * (i % 2), 4.0 * (i % 2)) for d in range(12_000) for i in range(3)]
    far = hull.farthest(spark.createDataFrame(rows, "doc_id int, px double, py double").repartition(5))
    assert far.groupBy("distance").count().collect() == [(5.0, 12_000)]
    assert "FlatMapGroupsInPandas" not in far._jdf.queryExecution().toString()


#: Queries that join tables which grow with the input.
GROWING = ["dbscan_regions", "merge_overlaps", "words_in_region", "field_boxes", "field_spatial_score", "assessed_decisions", "attached_documents", "field_confidence", "spatial_score", "merge_passes"]


@pytest.mark.parametrize("name", GROWING)
def test_no_growing_table_goes_through_the_driver(spark, name):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = store.executionsList()
    plans = [seen.apply(i).physicalPlanDescription() for i in range(seen.size()) if seen.apply(i).executionId() >= before]
    assert plans and not [p for p in plans if "BroadcastExchange" in p]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_boxes_are_joined_once(spark, monkeypatch):
    asked, scored = [], []
    monkeypatch.setattr(fields, "containments", lambda v, t: asked.append((v, t)) or containment.containments(v, t))
    monkeypatch.setattr(join_queries.layout, "spatial_scores", lambda boxes: scored.append(boxes) or boxes)
    join_queries.field_spatial_score(spark, "/root/testdata/sf0.001")
    assert [shuffles(df) for pair in asked for df in pair] + [shuffles(df) for df in scored] == [0, 0, 0]


def test_values_of_confidences_are_worked_out_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(fields, "containments", lambda v, t: asked.append((v, t)) or containment.containments(v, t))
    join_queries.field_confidence(spark, "/root/testdata/sf0.001")
    assert [shuffles(df) for pair in asked for df in pair] == [0, 0]


def test_a_type_is_no_key_to_deal_documents_by(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert catalogue.QUERIES["slip_triage"](spark, "/root/testdata/sf0.001").count() == 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = store.executionsList()
    plans = [seen.apply(i).physicalPlanDescription() for i in range(seen.size()) if seen.apply(i).executionId() >= before]
    assert plans and not [p for p in plans if "hashpartitioning(doc_type" in p]


def test_rows_are_dealt_whatever_the_files(spark):
    sizes = dealt(spark.range(0, 3000, 1, 1), "id", 100).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 30 and max(n for _, n in sizes) < 200


def test_a_second_pass_of_the_same_text_is_not_read_anew(spark, monkeypatch):
    read, real = [], extract.extract_fields
    monkeypatch.setattr(extract, "extract_fields", lambda docs: (read.append(docs.count()), real(docs))[1])
    catalogue.QUERIES["merge_passes"](spark, "/root/testdata/sf0.001")
    assert read[0] == 150 and 0 < read[1] < 50


def test_a_hundred_thousand_keywords(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    words = sorted({word(r.randint(1, 9)) for _ in range(130_000)} - {""})[:100_000]
    rows = [(f"t{i % 7}", w, 1 + i % 3) for i, w in enumerate(words)] + [("t1", words[3], 9), ("t2", "", 5), ("t2", None, 5), (None, "x", 1)]
    table = spark.createDataFrame(rows, "type string, keyword string, weight int").repartition(8)
    texts = [None, "", "ABCDE", "é"] + [word(r.randint(3, 60)) for _ in range(30)] + ["abc " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    worth = {}
    for k, w, n in rows:
        if k and w:
            worth[k, w] = max(n, worth.get((k, w), 0))
    want = {}
    for d, text in enumerate(texts):
        for (k, w), n in worth.items():
            if w in (text or "").lower():
                want[d, k] = want.get((d, k), 0) + n
    for most in (10**9, 0):  # by automaton, by join
        got = keywords.keyword_scores(docs, "t", table, most).collect()
        assert len(got) == len(want) and {(x.doc_id, x.type): x.score for x in got} == want
    pairs, met = keywords.keyword_pairs(docs.select("doc_id", F.lower("t").alias("t")), keywords.keyword_table(table))
    assert pairs.count() < 0.05 * len(texts) * len(words) and met.count() > 1000


def test_patterns_in_parts(spark):
    table = spark.createDataFrame([("a", r"x+\d", 5), ("a", "yy", 3), ("b", r"\bX1\b", 2), ("b", None, 9), ("c", "z$", 4)], "type string, pattern string, weight int")
    docs = spark.createDataFrame([(1, "xx1 YY"), (2, "x1"), (3, None), (4, "a\nz")], "doc_id int, t string")
    want = {(1, "a", 8), (2, "a", 5), (2, "b", 2), (4, "c", 4)}
    for most in (10**6, 40):
        assert {tuple(r) for r in keywords.pattern_scores(docs, "t", table, most).collect()} == want


def test_quarantine_counts_every_reason(spark):
    from pyspark.sql import Observation

    from papersluice.operators import quarantine

    rows = [(1, 0.5, 0.1, "merged", 0, 0, 4, 4), (2, 1.5, None, "ocr", 0, 0, 4, 4), (3, float("nan"), 0.2, None, 0, 0, -1, 4), (None, 1.0, 1.0, "contour", 0, 0, 0, 0), (5, 0.1, 0.1, "contour", None, 0, 1, 1)]
    frame = spark.createDataFrame(rows, "region_id int, confidence double, area_ratio double, method string, x int, y int, w int, h int")
    seen = Observation("regions")
    good, bad = quarantine.split(frame, quarantine.region_faults(), seen)
    assert {r.region_id: r.reasons for r in bad.collect()} == {2: ["confidence", "area_ratio", "method"], 3: ["confidence", "method", "box"], 5: ["box"]}
    assert seen.get == {"good": 2, "faulty": 3, "reason_confidence": 2, "reason_area_ratio": 1, "reason_method": 2, "reason_box": 2}
    assert {r.region_id for r in good.drop("reasons").collect()} == {1, None} and good.columns == frame.columns
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(['{"doc_id": 1, "lines": [{"text": "a", "confidence": 5}]}', "{", None, "[]", '{"doc_id": 2, "lines": null}', '{"doc_id": 3, "lines": [null]}'])], "k int, json string")
    got = {r.k: r.reasons for r in quarantine.judged(quarantine.parsed_documents(texts), quarantine.document_faults()).collect()}
    assert got[0] == [] and got[1] == ["unreadable"] and got[4] == ["no lines"] and all(got[k] for k in (2, 3, 5))


def test_anchors_are_found_with_few_distances(spark):
    from papersluice.operators import classify
    from papersluice.sources import rules

    r = random.Random(11)
    names = sorted({a for k in rules.ANCHORS.values() for part in k.values() for a in part})

    def damaged(a):
        a = " ".join(r.sample(a.split(), len(a.split())))
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(a))
            a = r.choice([a[:k] + a[k + 1 :], a[:k] + r.choice("aeio") + a[k:], a[:k] + r.choice("aeio") + a[k + 1 :]]) or "x"
        return a

    texts = [" ".join(damaged(r.choice(names)) for _ in range(12)).title() for _ in range(60)] + ["", "Pan", None]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
        return row[-1]

    def found(text, a):
        ws, n, wanted = text.lower().split(), len(a.split()), " ".join(sorted(a.split()))
        windows = [" ".join(sorted(ws[i : i + n])) for i in range(max(len(ws) - n + 1, 1))]
        return a in text.lower() or any(100 * (1 - distance(w, wanted) / max(len(w), len(wanted))) >= 80 for w in windows)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    for row in classify.anchor_scores(frame, "t").collect():
        for k, parts in rules.ANCHORS.items():
            assert (row[f"{k}_required"], row[f"{k}_optional"]) == tuple(sum(found(texts[row.doc_id] or "", a) for a in parts[p]) for p in ("required", "optional"))
    windows = {n: [w for x in frame.select(classify.anchor_windows(F.coalesce("t", F.lit("")), n).alias("w")).collect() for w in x.w] for n in (1, 2, 3)}
    compared = total = 0
    for a in names:
        own = spark.createDataFrame([(w,) for w in windows[len(a.split())]], "w string")
        total += own.count()
        compared += own.where(classify.near_anchor(F.col("w"), a)[0]).count()
    assert compared < 0.1 * total


def test_records_carry_quality_and_regions(spark):
    import json

    from papersluice.operators import documents

    metrics = ", ".join(f"{m} double" for m in documents.METRICS)
    row = spark.createDataFrame([(*[float(i) for i in range(6)], 0.5, False, ["dark"], (1, 2, 30, 0, 0.9, "merged", 0.1))], f"{metrics}, image_quality_score double, quality_passed boolean, quality_reasons array<string>, r struct<x:int,y:int,w:int,h:int,confidence:double,method:string,area_ratio:double>")
    q, r = row.select(F.to_json(documents.quality_dict()), F.to_json(documents.region_dict(F.col("r")))).first()
    assert json.loads(q) == {m: float(i) for i, m in enumerate(documents.METRICS)} | {"composite_score": 0.5, "passed": False, "failure_reasons": ["dark"]}
    assert json.loads(r) == {"bbox": [1, 2, 30, 0], "confidence": 0.9, "detection_method": "merged", "area_ratio": 0.1, "aspect_ratio": 0}


def test_a_line_of_many_words(spark):
    from papersluice.operators import words

    n = 100_000
    text = " ".join("ab" if i % 3 else "abcde" for i in range(n))
    line = spark.createDataFrame([(1, 0, text, 90.0, 5, 7, 2 * len(text), 9)], "doc_id int, line_num int, text string, confidence double, x int, y int, w int, h int")
    got = {r.word_num: (r.x, r.w) for r in words.line_words(line).where("word_num % 9999 = 1 OR word_num < 40").select("word_num", "x", "w").collect()}
    x = 5
    for i in range(n):
        width = 4 if i % 3 else 10
        if i + 1 in got:
            assert got[i + 1] == (x, width)
        x += width + 2
    assert len(got) > 45


def test_words_meet_regions_and_labels_in_bands(spark):
    from papersluice.operators import records

    r = random.Random(12)
    words_ = [(d, i // 5, i % 5, r.choice(["dob:", "a", "b"]), r.randrange(0, 400), 20 * r.randrange(0, 30), r.randrange(5, 60), r.randrange(0, 20)) for d in range(3) for i in range(120)]
    regions = [(d, k, r.randrange(0, 300), r.randrange(0, 500), r.randrange(0, 200), r.randrange(0, 200)) for d in range(3) for k in range(20)]
    w = spark.createDataFrame(words_, "doc_id int, line_num int, word_num int, text string, x int, y int, w int, h int")
    g = spark.createDataFrame(regions, "doc_id int, region_id int, x int, y int, w int, h int")
    got = {(x.doc_id, x.region_id): (x.text, x.n_words) for x in layout.words_in_region(w, g).collect()}
    want = {}
    for d, k, x, y, rw, rh in regions:
        own = [v[3] for v in sorted(words_) if v[0] == d and x <= v[4] + v[6] // 2 <= x + rw and y <= v[5] + v[7] // 2 <= y + rh]
        if own:
            want[d, k] = (" ".join(own), len(own))
    assert got == want
    found = sorted((x.doc_id, x.label, x.gap) for x in records.label_value_proximity(w, ["dob:"]).collect())
    nearest = []
    for a in (v for v in words_ if v[3] == "dob:"):
        gaps = [b[4] - a[4] - a[6] for b in words_ if b[0] == a[0] and b[3] != "dob:" and b[5] == a[5] and b[4] >= a[4] + a[6]]
        gaps += [b[5] - a[5] for b in words_ if b[0] == a[0] and b[3] != "dob:" and a[5] < b[5] <= a[5] + 60 and b[4] < a[4] + a[6] and b[4] + b[6] > a[4]]
        if gaps:
            nearest.append((a[0], "dob:", min(gaps)))
    assert found == sorted(nearest)


def test_slips_are_triaged_without_joins(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids = lambda seen: [seen.apply(i).executionId() for i in range(seen.size())]
    before = max(ids(store.executionsList()), default=-1)
    assert catalogue.QUERIES["slip_triage"](spark, "/root/testdata/sf0.001").count() == 1500
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = store.executionsList()
    plans = [seen.apply(i).physicalPlanDescription() for i in range(seen.size()) if seen.apply(i).executionId() > before]
    assert sum("InsertIntoHadoopFsRelationCommand" in p for p in plans) == 1
    assert not [p for p in plans if "SortMergeJoin" in p or "hashpartitioning(doc_id" in p]


def test_types_chosen_in_the_workers_are_those_of_all_scores(spark):
    r = random.Random(21)
    bits = ["order", "Order No 7", "slip", "pan", "UIDAI", "é 12", "zz9", "model", "x", "1234 5678 9012", "İ"]
    texts = [" ".join(r.choices(bits, k=r.randint(0, 5))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    words = spark.createDataFrame([("a", "order", 2), ("a", "slip", -3), ("b", "pan", 2), ("pan", "pan", 2), ("aadhaar", "x", 1), ("c", "é", 4), (None, "x", 9), ("c", None, 9)], "type string, keyword string, weight int")
    patterns = spark.createDataFrame([("a", r"order no", 5), ("a", r"z+9", -4), ("b", r"(^|\s)x", 3), ("pan", "model", 3), ("aadhaar", "uidai", 5), ("vehicle_rc", r"(^|[^0-9])[0-9]{4} ", 5), ("d", "zz", 0), ("c", None, 9)], "type string, pattern string, weight int")
    tables, order = {"type_keywords": words, "type_patterns": patterns}, ("aadhaar", "pan", "vehicle_rc")
    want = {x.doc_id: x.doc_type for x in keywords.best_types(keywords.rule_scores(docs, "t", tables), order).collect()}
    got = {x.doc_id: x.k for x in docs.select("doc_id", keywords.best_type(F.col("t"), tables, order).alias("k")).collect()}
    assert len(set(want.values())) > 5 and got == {d: want.get(d) for d in got}
    assert keywords.best_type(F.col("t"), tables, order, 10) is None


@pytest.mark.parametrize("most", [10**6, 10])
def test_rules_of_a_type_by_hand(spark, most, monkeypatch):
    from papersluice.plans import rule_triage
    from papersluice.sources import rules

    monkeypatch.setattr(keywords.best_type, "__defaults__", (most,))
    more = [rules.DocumentType("bill", ["bill"], [], {"no": 0.6, "sum": 0.25, "day": 0.15}, ["no", "who"], {"no": ["No ([0-9]+)"], "sum": ["Total ([0-9]+)", "Sum ([0-9]+)"], "who": ["By( *)", "by ([a-z]+)"]}, ["bill of sale", "due now"], ["vat"]), rules.DocumentType("memo", ["memo"], required=["x"])]
    lines = {1: ["Bill of sale", "No 7 Sum 5", "by ann due now vat"], 2: ["bill", "Sum 5 Total 6", "sale of bil"], 3: ["memo a b c d e"], 4: ["UIDAI 1 2 3 4 5"], 5: []}
    docs = spark.createDataFrame([(k, [(t, 90.0) for t in v]) for k, v in lines.items()], "doc_id long, lines array<struct<text:string,confidence:double>>")
    docs = docs.withColumns({m: F.lit(None).cast("double") for m in ("blur_score", "brightness_score", "resolution_score", "contrast_score", "edge_density", "glare_ratio")})
    out = {r.doc_id: r for r in rule_triage.triage_by_rules(docs, rules.rule_tables(spark, more)).collect()}
    shown = lambda r: (r.doc_type, {f.field_name: f.value for f in r.fields}, round(r.schema_score, 9), r.fuzzy_score, r.missing_critical, r.mandatory_present)
    assert shown(out[1]) == ("bill", {"no": "7", "sum": "5", "who": "ann"}, 0.85, 1.0, "", True)
    assert shown(out[2]) == ("bill", {"sum": "6"}, 0.25, 0.5, "no", False)  # two of twelve letters differ
    assert shown(out[3]) == ("memo", {}, 0.0, 0.0, "", True)
    assert out[4].doc_type == out[5].doc_type == "aadhaar" and "No text detected in image" in out[5].reasons and len(out) == 5
