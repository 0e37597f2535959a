"""Operators 11 to 13 against brute force: functions, registered queries, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papersluice.llm import negatives, registry, search, simhash, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# --- 11


def dot(a, b):
    return int(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))


def brute_negatives(rows):
    """Rows (vec_id, embedding, label) as the contract has them, by loops."""
    kept = []
    for v, e, label in rows:
        if v is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((v, [int(np.floor(256 * float(np.float32(x)))) for x in e], (label + 1) % 10 if v % 7 == 0 else label))
    out = []
    for r, (v, q, label) in enumerate(kept):
        if v % 100:
            continue
        scored = [(-dot(q, w), u, s, other) for s, (u, w, other) in enumerate(kept) if s != r and len(w) == len(q)]
        for p, u, _, _ in sorted(x for x in scored if x[3] == label)[:5]:
            window = sorted(x for x in scored if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(v, u, k + 1, x[1], -p, -x[0]) for k, x in enumerate(window)]
    return sorted(out)


def vectors(n=900, d=12, seed=5):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(6, d))
    rows = [(i, [float(np.float32(x)) for x in (heart[i % 6] * 0.4 + rng.normal(size=d) * 0.3)], int(rng.integers(0, 10)) if i % 3 else 4) for i in range(n)]
    rows += [(50_000, None, 1), (50_100, [None] * d, 1), (50_200, [float("nan")] * d, 1), (50_300, [float("inf")] + [0.0] * (d - 1), 1), (50_400, [0.1] * d, None)]
    rows += [(None, [0.1] * d, 3), (60_000, [0.5] * (d + 3), 2), (60_001, [0.4] * (d + 3), 2), (60_002, [0.2] * (d + 3), 3), (70_000, [], 1), (0, rows[0][1], rows[0][2])]
    return rows + [rows[100], rows[100], rows[101]] + [(80_000, [0.0] * d, 4), (90_000, [0.01] * d, 77)]


def test_hard_negatives_match_loops(spark, tmp_path):
    rows = vectors()
    where = stored(spark, tmp_path, "embeddings", rows, VECTORS)
    got = negatives.op11_hard_negatives(spark, where)
    found = sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert found == brute_negatives(rows) and len(found) > 300
    assert dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_in_small_blocks_and_of_empty_tables(spark):
    rows = spark.createDataFrame(vectors(), VECTORS).select("vec_id", "label", search.quantized("embedding").alias("q"), F.lit(1).alias("row"), F.lit("x").alias("request"))
    whole = {tuple(r) for r in negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).collect()}
    before = negatives.ROW_COMPONENTS, negatives.STEP, negatives.ANCHOR_STEP
    join = negatives.threshold_join
    try:
        negatives.STEP, negatives.ANCHOR_STEP = 37, 3
        negatives.threshold_join = lambda *a: join(*a, blocks=(2_000, 40))
        assert {tuple(r) for r in negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).collect()} == whole
    finally:
        negatives.ROW_COMPONENTS, negatives.STEP, negatives.ANCHOR_STEP = before
        negatives.threshold_join = join
    assert negatives.hard_negatives(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(rows, F.lit(False)).count() == 0


def test_the_index_leaves_covered_dimensions_out():
    rng = np.random.default_rng(3)
    weight = 256 * 0.8 ** np.arange(64)
    rows, anchors = (np.floor(rng.normal(size=(n, 64)) * weight).astype("i8") for n in (3000, 20))
    scores = anchors @ rows.T
    least = np.sort(scores, axis=1)[:, -20].astype("f8")
    i, j, used = negatives.candidates(anchors, rows, least)
    assert {(a, b) for a, b in zip(*np.nonzero(scores >= least[:, None]), strict=True)} <= set(zip(i, j, strict=True))
    assert used < 0.5 * rows.size and len(i) < 0.05 * scores.size
    i, _, used = negatives.candidates(anchors, rows, np.full(20, -1e18))
    assert len(i) == scores.size and used == rows.size


# --- 12


def brute_mark(text, n=4):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, radius=4):
    """marks: (doc_id, mark); doc_id of the least of each component."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(marks))]


def simhash_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split()
        for _ in range(5):
            w = list(w)
            w[rng.randrange(len(w))] = word()
            near.append("\t".join(w))
    odd = [None, "", " \n ", "One", "one", "ONE two", "É x\x0by\x1fz", "a b c d", "A  B\tC\nD", "word " * 20_000]
    return base + near + odd


def test_simhash_query_matches_loops(spark, tmp_path):
    texts = simhash_texts()
    rows = [(3 * i + 1, t, "en", "s", 0) for i, t in enumerate(texts)] + [(1, texts[0], "en", "s", 0), (2, texts[5], None, None, None), (None, texts[7], None, None, None), (None, "alone in the world of texts", None, None, None)]
    got = simhash.op12_simhash_components(spark, stored(spark, tmp_path, "documents", rows, DOCS)).select("doc_id", "fingerprint", "component_id").collect()
    marks = [(r[0], brute_mark(r[1])) for r in rows]
    wanted = Counter((d, f"{m:016x}", c) for (d, m), c in zip(marks, brute_components(marks), strict=True))
    assert Counter(map(tuple, got)) == wanted
    assert len({c for _, _, c in wanted}) < len(wanted) - 30


def some_marks(n, seed=2):
    rng = np.random.default_rng(seed)
    marks = rng.integers(0, 1 << 64, n, dtype="u8")
    for k in range(n // 2):  # chains of up to four changed bits
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6), dtype="u8"))
        marks[n // 2 + k] = marks[rng.integers(0, n // 2 + k)] ^ flips
    return np.unique(marks)


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_tiles_lose_no_link(spark, parts):
    marks = some_marks(400)
    wanted = brute_components([(i, int(m)) for i, m in enumerate(marks)])
    frame = spark.createDataFrame([(int(m),) for m in marks.view("i8")], "fp long")
    links = simhash.linked_fingerprints(frame, tile=23, parts=parts).collect()
    at = {int(m): i for i, m in enumerate(marks.view("i8"))}
    root = simhash.unite(np.arange(len(marks)), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(wanted[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(wanted))
    assert all((r.a ^ r.b) & ((1 << 64) - 1) for r in links)


def test_tiles_skip_and_return_few_links():
    marks = some_marks(20_000, 7)
    a, b, compared = simhash.tile_links(marks, marks)
    assert compared < 0.65 * len(marks) ** 2 and len(a) < 2 * len(marks)
    family = np.uint64(0) ^ (np.uint64(1) << np.arange(64, dtype="u8"))  # all within two bits of each other
    a, b, _ = simhash.tile_links(family, family)
    assert len(a) <= 2 * len(family) and len(set(simhash.unite(np.arange(64), *(np.searchsorted(np.sort(family), x) for x in (a, b))))) == 1


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).count() == 0
    blank = spark.createDataFrame([(5, None, "", "", 0), (3, "", "", "", 0)], DOCS).withColumn("fp", F.lit("x")).withColumn("label", F.lit(1))
    assert {tuple(r) for r in simhash.simhash_components(blank).collect()} == {(5, 0, 3), (3, 0, 3)}


# --- 13


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min((-n[v], v) for v in near[w])[1] if near[w] and max(n[v] for v in near[w]) >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelling_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrtÀé") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    for w in list(words):  # variants of variants
        for _ in range(4):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeinrt") + w[k:], w[:k] + rng.choice("aeinrt") + w[k + 1 :]])
            words.append(w)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for i in range(300)]
    rows = [(i, t.upper() if i % 7 == 0 else t + ", x1y×÷ŒstraßeŒ" if i % 5 == 0 else t) for i, t in rows]
    return rows + [(None, "hello hello hello hellos hellos hellos"), (1, None), (2, ""), (3, rows[3][1]), (3, rows[3][1]), (9_999, "abcde " * 30_000 + "abcdef " * 3), (10_000, "zzzzz" * 2_000)]


def test_spelling_query_matches_loops(spark, tmp_path):
    rows = spelling_rows()
    where = stored(spark, tmp_path, "documents", [(d, t, "en", "s", 0) for d, t in rows], DOCS)
    got = spelling.op13_spelling_variants(spark, where)
    wanted = brute_variants(rows)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == wanted and got.count() == len(wanted)
    assert sum(1 for x in wanted if x[1] and x[1] != x[2]) > 3


def test_near_words_share_a_signature_and_a_half(spark):
    rng = random.Random(9)
    words = set()
    for _ in range(150):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        words |= {w, w + rng.choice("abc")}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in spelling.near_words(frame).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_roots_follow_long_chains_and_empty_tables(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("w040", None), ("alone", None)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert all(got[f"w{i:03}"] == "w040" for i in range(41)) and got["alone"] == "alone"
    empty = spark.createDataFrame([], DOCS).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    assert spelling.variants(spelling.vocabulary(spelling.slipped(spelling.runs(empty)))).count() == 0


def test_the_three_are_registered():
    assert {"op11_hard_negatives", "op12_simhash_components", "op13_spelling_variants"} <= set(registry.QUERIES) and "op11_hard_negatives" in registry.SQL


# --- 5, its prefixes


def test_prefixes_are_rendered_and_steps_only_beyond_the_bound():
    from papersluice.llm import chat

    turns = [("user" if i % 2 else "assistant", f"turn {i} </s>[INST]") for i in range(9)]
    seen, steps = [], []

    def template(t):
        seen.append(len(t))
        return chat.instruct_template(t)

    def extend(length, turn):
        steps.append(length)
        return chat.instruct_extend(length, turn)

    whole = chat.turn_spans(turns, template, extend)
    assert sorted(set(seen)) == list(range(10)) and len(seen) == 1 + 3 * 9 and not steps  # each prefix, and two probes for each turn
    seen.clear()
    assert chat.turn_spans(turns, template, extend, most=0) == whole and len(steps) == 27 and len(seen) <= 3
    rewriting = lambda t: f"{len(t)} turns\n" + chat.instruct_template(t)
    assert chat.turn_spans(turns, rewriting, extend)[2] is True and chat.turn_spans(turns, rewriting, extend, most=0) == chat.turn_spans(turns, rewriting, None)


# --- 4, rows that share an id


def test_search_takes_rows_that_share_an_id_as_their_own(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(i % 60), [float(np.float32(x)) for x in rng.normal(size=7)], 0) for i in range(150)] + [(0, [float("nan")] * 7, 0), (None, [1.0] * 7, 0), (50, None, 0), (100, [0.5] * 3, 0)]
    got = search.op4_segment_top_k(spark, stored(spark, tmp_path, "embeddings", rows, VECTORS))
    kept = [(v, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for v, e, _ in rows if v is not None and e is not None and np.isfinite(e).all()]
    want = []
    for i, (v, q) in enumerate(kept):
        if v % 50 == 0:
            best = sorted((-dot(q, w), u) for j, (u, w) in enumerate(kept) if j != i and len(w) == len(q))[:5]
            want += [(v, k + 1, u, -s) for k, (s, u) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 25


def test_search_blocks_of_wide_vectors_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "COMPONENTS", 1024 * 40)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-50, 50, (160, 1024))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, q array<long>")
    got = search.exact_top_k(frame, frame.where("vec_id % 50 = 0"), 3).collect()
    scores = vectors @ vectors.T
    want = [(q, k + 1, v, int(scores[q, v])) for q in range(0, 160, 50) for k, v in enumerate(sorted((j for j in range(160) if j != q), key=lambda j: (-scores[q, j], j))[:3])]
    assert sorted(map(tuple, got)) == sorted(want)
