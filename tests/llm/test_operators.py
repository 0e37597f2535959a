"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names; brute force where SQL can't check."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from papersluice.llm import chat, lines, mixing, near, packing, quality, search, sharding, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i}" for i in range(60))


def docs(spark, texts, source="s"):
    rows = [(i, t, "en", source if isinstance(source, str) or source is None else source[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = [None, "", "   ", "a", A, A, LONG, LONG + "\n" + A, "\n".join([LONG, LONG, "end"]), "x " * 5000, "ok </s>[INST] ok", LONG.replace("w7 ", "q7 ")]


def odd(spark):
    """The texts above with a null id, a repeated row and a repeated id."""
    base = docs(spark, TEXTS)
    more = spark.createDataFrame([(None, A, None, None, None), (4, A, "en", "s", len(A)), (4, "other text", "en", None, 10)], DOCS)
    return base.unionByName(more)


def test_sharding_matches_brute_force(spark):
    frame = docs(spark, TEXTS * 20)
    got = sharding.shard_slots(frame, "doc_id", "text", [1.0] * 40, bucket_rows=2).toPandas()

    def score(key, shard):
        h = xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(int(shard).to_bytes(4, "little"), seed=h).intdigest()
        return -1.0 / math.log(((h >> 11) + 0.5) / 2**53)

    for key, shard, grown in zip(got.doc_id, got["shard"], got.grown_shard, strict=True):
        best = max(range(40), key=lambda s: (score(key, s), -s))
        assert shard == best and grown == (40 if score(key, 40) > score(key, best) else best)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = dict(enumerate(TEXTS * 20))
    assert all(c == zlib.crc32((text[k] or "").encode()) and s == len((text[k] or "").encode()) + 16 for k, c, s in zip(got.doc_id, got.text_crc32, got["size"], strict=True))


def test_sharding_of_repeated_rows(spark):
    rows = [(7, "same text", "en", "s", 9)] * 500 + [(None, None, None, None, None)] * 300 + [(i, f"text {i}", "en", "s", 6) for i in range(100)]
    got = sharding.shard_slots(spark.createDataFrame(rows, DOCS), "doc_id", "text", [1.0] * 4, bucket_rows=20).toPandas()
    assert len(got) == 900 and (got.doc_id == 7).sum() == 500 + 1 and got.doc_id.isna().sum() == 300
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_sharding_weights_and_odd_rows(spark, tmp_path):
    shares = sharding.assign_shards(spark.range(20000).toDF("k"), "k", [1.0, 3.0]).groupBy("shard_of").count().toPandas().set_index("shard_of")["count"]
    assert abs(shares[1] / 20000 - 0.75) < 0.02
    assert sharding.shard_slots(odd(spark), "doc_id", "text", [1.0] * 3).count() == len(TEXTS) + 3
    assert sharding.shard_slots(odd(spark).limit(0), "doc_id", "text", [1.0] * 3).count() == 0
    sharding.write_shards(odd(spark), "doc_id", [1.0] * 3, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS) + 3
    with pytest.raises(ValueError):
        sharding.assign_shards(odd(spark), "doc_id", [])


def brute_repeats(texts, run=50):
    """doc -> kept lines; a line goes if it lies in a run of `run` words that any earlier place has too. All pairs of places."""
    arrays = {d: [(p, x.strip(" "), len(x.split())) for p, x in enumerate((t or "").split("\n")) if x.split()] for d, t in texts.items()}
    cut = {d: set() for d in texts}
    for d, a in arrays.items():
        for e, b in arrays.items():
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while (e, j) < (d, i) and i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                        n += 1
                    if n and sum(x[2] for x in a[i : i + n]) >= run:
                        cut[d] |= set(range(a[i][0], a[i + n - 1][0] + 1))
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut[d]) for d, t in texts.items()}


def test_lines_meet_every_earlier_place(spark):
    say = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    f, x = say("f", 30), say("x", 22)
    texts = {1: "\n".join([say("a", 30), f, say("b", 30)]), 2: "\n".join([say("c", 30), f, x, say("d", 30)]), 3: "\n".join([say("e", 30), f, x, say("g", 30)])}
    rng = np.random.default_rng(11)
    pool = [say(f"p{k}_", int(rng.choice([1, 8, 20, 30, 60]))) for k in range(12)]
    texts |= {10 + i: "\n".join(pool[j] if rng.random() < 0.9 else "" for j in rng.integers(0, 12, rng.integers(1, 14))) for i in range(60)}
    got = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[3] == "\n".join([say("e", 30), say("g", 30)]) and got[2] == texts[2]
    assert got == brute_repeats(texts)


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(f"v{rng.integers(40)}" for _ in range(rng.integers(1, 40))) for _ in range(30)]
    texts = {i: "\n".join(pool[j] if rng.random() < 0.9 else "" for j in rng.integers(0, 30, rng.integers(1, 12))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "\n".join(pool[:8]), 103: "\n".join(pool[:8]), 104: "\n".join(["a b c"] * 60)}
    texts |= {105: "\n".join(f"line {k} of a long text with words" for k in range(4000))}
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.without_repeats(frame).collect()}
    assert got.pop(105) == texts.pop(105)
    assert got == brute_repeats(texts)
    assert got[103] == "" or "\n" not in got[103].strip()


def clash(frame, *names):
    """frame with further columns of these names."""
    for name in names:
        frame = frame.withColumn(name, F.lit(7))
    return frame


def test_clashing_columns(spark):
    cut = lines.without_repeats(clash(odd(spark), "n_deleted", "_l_cut", "row", "cut", "id", "tie"))
    assert cut.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "_l_cut", "row", "cut", "id", "tie", "n_deleted"]
    got = {r.text: r.n_deleted for r in cut.collect() if r.doc_id == 8}
    assert got == {"end": 2}
    rows = near.one_of_each(clash(odd(spark), "d", "tie", "row", "worded", "key"))
    assert rows.columns[-5:] == ["d", "tie", "row", "worded", "key"] and {r.key for r in rows.collect()} == {7}
    assert near.near_classes(clash(odd(spark), "d", "s", "w", "class_id"))[0].count() == len(TEXTS) + 3
    pages = spark.createDataFrame([(1, "http://a.org/", "x")], "page_id long, url string, html string")
    assert urls.judged(clash(pages, "host", "r", "links", "trust")).first().verdict == "allow"
    vectors = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (1, [3, 4])], "vec_id long, q array<long>")
    assert search.exact_top_k(clash(vectors, "rb", "score"), clash(vectors.where("vec_id = 0"), "dim"), 5).count() == 2
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(clash(turns, "turns", "spans")).first().formatted == "[INST]user\nx[/INST]"
    scored = toxicity.scored(clash(odd(spark), "score", "_text", "c0"), toxicity.Model({}, -1.0))
    assert scored.columns[-2:] == ["score", "offending"] and scored.columns.count("score") == 1 and {r.c0 for r in scored.collect()} == {7}
    assert packing.packed_documents(clash(odd(spark), "start", "_number", "_bucket")).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    mix = mixing.mixed(clash(odd(spark), "_row", "_position", "size"))
    assert mix.columns[-3:] == ["_row", "_position", "size"] and mix.count() > 0


def test_lines_odd_rows(spark):
    out = lines.without_repeats(odd(spark))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") + ["n_deleted"]
    got = out.toPandas()
    assert len(got) == len(TEXTS) + 3 and got[got.doc_id == 0].text.isna().all()
    assert got[got.doc_id == 8].text.iloc[0] == "end" and got[got.doc_id == 7].text.iloc[0] == A
    assert lines.without_repeats(odd(spark).limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://A.ORG/x?y", '<a href="http://good.net/a">g</a>'),
        (2, "https://sub.example.org/es/1", '<a class=x href="//bad.net/">b</a>'),
        (3, "http://x.example.org/en/12", None),
        (4, "http://good.net/p", ""),
        (5, "http://links.net/", '<a href="http://x.com/de/">d</a>'),
        (6, "http://x.com/de/3#f", ""),
        (7, None, '<a href="http://good.net/a">'),
        (8, "no url", None),
        (8, "no url", None),
        (None, "http://x.com/fr/", None),
    ]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().sort_values("page_id")
    by = {k: v for k, v in zip(got.page_id, got.to_dict("records"), strict=True)}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.org", "/x", "org/", "allow")
    assert (by[2]["rule"], by[2]["verdict"]) == ("example.org/es/", "block") and by[3]["rule"] == "example.org/en/1"
    assert by[4]["verdict"] == "allow" and by[4]["trust"] > 0 and by[5]["verdict"] == "block" and by[5]["distrust"] > 0
    assert by[6]["rule"] == "com/de/" and (by[7]["host"], by[7]["path"], by[8]["verdict"]) == ("", "", "allow")
    assert len(got) == len(rows) and urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_ranks_reach_far(spark):
    big = 10**6
    edges = [("a", "b", 1), ("a", "x", big), ("b", "c", 1), ("b", "x", big)] + [(f"{'c' if i == 0 else f'd{i}'}", f"d{i + 1}", 1) for i in range(16)]
    frame = spark.createDataFrame([("t", *e) for e in edges], "kind string, src string, dst string, n int")
    got = {r.host: r["rank"] for r in urls.spread(spark.createDataFrame([("t", "a", 1.0)], "kind string, host string, seed double"), frame, rounds=None).collect()}
    want = 0.15 * 0.85**2 / (big + 1) ** 2
    assert got["c"] == pytest.approx(want, rel=1e-5) and got["d16"] == pytest.approx(want * 0.85**16, rel=1e-5)
    pages = spark.createDataFrame([(1, "http://p/", "<a href=http://Q.net/x>q</a> <a href='//r.net/'>r</a>")], "page_id long, url string, html string")
    assert pages.select(urls.linked_hosts(F.col("html"), F.lit("p")).alias("l")).first().l == ["q.net", "r.net"]


def test_pagerank_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = [(f"h{a}", f"h{b}", int(n)) for a, b, n in rng.integers(0, 12, (40, 3)) if a != b and n]
    seeds = {"h1": 1.0, "h3": 0.5}
    got = {r.host: r["rank"] for r in urls.spread(spark.createDataFrame([("t", h, s) for h, s in seeds.items()], "kind string, host string, seed double"), spark.createDataFrame([("t", *e) for e in edges], "kind string, src string, dst string, n int")).collect()}
    out, weight = Counter(), Counter()
    for a, b, n in edges:
        out[a] += n
        weight[a, b] += n
    rank = dict(seeds)
    for _ in range(urls.ROUNDS):
        after = Counter({h: 0.15 * s for h, s in seeds.items()})
        for (a, b), n in weight.items():
            after[b] += rank.get(a, 0) * n / out[a] * 0.85
        rank = after
    assert all(abs(got.get(h, 0) - v) < 1e-6 for h, v in rank.items())


def test_verdicts_match_brute_force(spark):
    rng = np.random.default_rng(9)
    hosts = [f"h{i}.net" for i in range(40)] + ["good.org", "x.example.org", "www.com"]
    pages = []
    for i in range(300):
        host = hosts[rng.integers(43)]
        path = rng.choice(["/", "/es/1", "/fr/2", "/de/3"])
        targets = [hosts[j] for j in rng.integers(0, 43, rng.integers(0, 5))] + ["h0.net"] * (i % 3)  # h0 is a hub
        pages.append((i, f"http://{host}{path}", "".join(f'<a href="https://{t}/p">x</a>' for t in targets)))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    table = spark.createDataFrame([(r.action, r.host, r.path) for r in urls.RULES], "action string, host string, path string")

    def rule(host, path):
        fit = [(len(r.host + r.path), r.action) for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit)[1] if fit else None

    own, links = {}, Counter()
    for _, url, html in pages:
        host, path = url[7:].split("/")[0], url[7 + len(url[7:].split("/")[0]) :]
        own.setdefault(host, []).append(rule(host, path))
        for t in set(re.findall(r"https://([^/]*)/", html)) - {host}:
            links[host, t] += 1
    ranks = {}
    for kind, action in (("trust", "allow"), ("distrust", "block")):
        edges = links if kind == "trust" else Counter({(b, a): n for (a, b), n in links.items()})
        seeds = {h: sum(x == action for x in v) / len(v) for h, v in own.items() if action in v}
        total = Counter()
        for (a, _), n in edges.items():
            total[a] += n
        rank = dict(seeds)
        for _ in range(150):
            after = Counter({h: 0.15 * v for h, v in seeds.items()})
            for (a, b), n in edges.items():
                after[b] += 0.85 * rank.get(a, 0) * n / total[a]
            rank = after
        ranks[kind] = rank
    for rules in (urls.RULES, table):
        for r in urls.judged(frame, rules).collect():
            t, d = ranks["trust"].get(r.host, 0), ranks["distrust"].get(r.host, 0)
            want = rule(r.host, r.path) or ("block" if d > 0 and d > 0.5 * (t + d) else "allow")
            assert r.verdict == want and r.trust == pytest.approx(t, rel=1e-4) and r.distrust == pytest.approx(d, rel=1e-4)
    edges = spark.createDataFrame([("t", f"a{i % 3}", f"b{i}", 1 + i % 4) for i in range(200)], "kind string, src string, dst string, n int")
    seeds = spark.createDataFrame([("t", f"a{i}", 1.0 + i) for i in range(3)], "kind string, host string, seed double")
    one, many = ({r.host: r["rank"] for r in urls.spread(seeds, edges, hub=h).collect()} for h in (7, 10_000))
    assert one == many and len(one) == 203


def test_few_products_on_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    whose = rng.integers(0, 40, 50_000)
    rows = np.floor(256 * (centres[whose] + 0.05 * rng.normal(size=(50_000, 64)))).astype("i8")
    asked = np.arange(0, 50_000, 500)
    floor = np.sort(search.products(rows[asked], rows), axis=1)[:, -6].astype("f8")
    made = 0
    for lo in range(0, 50_000, search.STEP):
        block = search.Block(asked, rows[asked], np.arange(lo, min(lo + search.STEP, 50_000)), rows[lo : lo + search.STEP])
        i, j, counts = block.survivors(floor)
        assert counts == sorted(counts, reverse=True) and len(i) == counts[-1]
        exact = block.exact(i, j)
        assert (exact == (rows[asked][i] * rows[lo : lo + search.STEP][j]).sum(axis=1)).all()
        made += len(i)
    assert made < 50_000 * len(asked) / 3


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {i: [float(x) for x in rng.normal(size=20) * (1 + i % 3)] for i in range(300)}
    vectors[7], vectors[8], vectors[9], vectors[100] = None, [float("nan")] * 20, [None] * 20, vectors[50]
    vectors[11] = [1.0, 2.0]
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").select("vec_id", search.quantized("embedding").alias("q"))
    got = search.exact_top_k(frame, frame.where("vec_id % 50 = 0"), 5, (64, 3, 4)).toPandas()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == 20)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == want and list(mine["rank"]) == [1, 2, 3, 4, 5]
    assert search.exact_top_k(frame.limit(0), frame.limit(0), 5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-300, 300, (40, 33)), rng.integers(-300, 300, (50, 33))
    before = None
    for s in search.SEGMENTS:
        bound = search.statistics(a, s) @ search.statistics(b, s).T
        assert (bound + 1e-6 >= a @ b.T).all()
        before = bound if before is None else before
    big = np.array([[2**40, 3]], "i8")
    assert search.products(big, big)[0, 0] == 2**80 + 9


def test_chat_round_trip(spark):
    turns = [("system", "a\\b [INST] <s>"), ("user", ""), ("assistant", "</s>[/INST]\\"), ("we\nird", "\n"), ("assistant", "")]
    text, spans, rewrites = chat.turn_spans(turns, chat.instruct_template)
    assert chat.read_instruct(text) == turns and not rewrites
    assert [chat.unescape(text[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b, _, _ in spans) == text
    last_only = lambda ts: "".join(f"{r}:{t};" for r, t in ts[-1:])
    assert chat.turn_spans(turns[:2], last_only)[2]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "user", "q"), (2, 0, "assistant", "r"), (2, 0, "assistant", "r")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.read_instruct(got[1].formatted) == [("user", ""), ("assistant", "b")] and len(got[2].spans) == 3 and chat.read_instruct(got[None].formatted) == [("", "x")]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_by_steps_equals_prefixes(spark):
    rng = np.random.default_rng(2)
    say = lambda: "".join(rng.choice(list("ab[]/<>s\\\nINT"), rng.integers(0, 12)))
    for _ in range(50):
        turns = [(rng.choice(["user", "assistant", "sys\ntem"]), say()) for _ in range(rng.integers(0, 7))]
        assert chat.turn_spans(turns, chat.instruct_template, chat.instruct_extend) == chat.turn_spans(turns, chat.instruct_template)
    wrong = lambda length, turn: (length, turn[1])
    assert chat.spans_by_step([("user", "x")], chat.instruct_template, wrong) is None
    assert chat.turn_spans([("user", "x")], chat.instruct_template, wrong)[1] == [(0, 19, 11, 12)]
    last = lambda ts: "".join(f"{r}:{t};" for r, t in ts[-1:])
    assert chat.turn_spans([("a", "b"), ("c", "d")], last, lambda n, t: (0, f"{t[0]}:{t[1]};"))[2]
    long = [("user" if k % 2 else "assistant", f"turn {k} " * 20) for k in range(20_000)]
    text, spans, rewrites = chat.turn_spans(long, chat.instruct_template, chat.instruct_extend)
    assert not rewrites and len(spans) == 20_000 and all(text[c:d] == t for (_, _, c, d), (_, t) in zip(spans, long, strict=True))


def brute_classes(texts):
    grams = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def test_near_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = {}
    for i in range(60):  # a family: some similar, some only alike
        w = list(base)
        for k in rng.integers(0, 120, i % 12):
            w[k] = f"n{i}_{k}"
        texts[i] = " ".join(w)
    texts |= {60: None, 61: "", 62: "a b", 63: "A  b", 64: "a b c", 65: texts[3], 66: " ".join(f"u{i}" for i in range(3000))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows, by_text = near.near_classes(frame)
    got = {r.doc_id: r for r in rows.collect()}
    assert {i: r.class_id for i, r in got.items()} == brute_classes(texts)
    assert got[65].n_links == got[3].n_links >= 1 and got[60].n_links == got[66].n_links == 0 and got[62].n_links == 1
    kept = near.one_of_each(odd(spark))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = kept.toPandas().doc_id
    assert len(ids) == len(set(ids.dropna())) + ids.isna().sum() + (ids == 4).sum() - (1 if (ids == 4).any() else 0)
    assert near.near_classes(frame.limit(0))[0].count() == 0 and near.one_of_each(odd(spark).limit(0)).count() == 0


def test_families_link_every_component(spark, monkeypatch):
    monkeypatch.setattr(near, "LIGHT", 2)
    monkeypatch.setattr(near, "CELL", 8)
    monkeypatch.setattr(near, "SMALL", 4)
    rng = np.random.default_rng(21)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(70):  # copies of one text, about as unlike as the limit
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(1, 6)):
            w[k] = f"n{i}_{k}"
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    grams = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in texts.items() for w in [t.split()]}
    rows = [(bytes([i]), bytes([i]), [hash(g) for g in grams[i]]) for i in texts]
    table = spark.createDataFrame(rows, "d binary, label binary, s array<long>")
    pairs, families = near.rare_links(table, 0.8)
    similar = {(bytes([i]), bytes([j])) for i in texts for j in texts if i < j and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    linked = {(bytes(r.a), bytes(r.b)) for r in near.family_links(families, table, 0.8).collect()}
    linked = {(min(p), max(p)) for p in linked}
    assert linked <= similar and similar <= linked | {(bytes(r.a), bytes(r.b)) for r in pairs.collect()} and len(linked) > 20
    got = {r.doc_id: r.n_links for r in near.near_classes(frame)[0].collect()}
    assert got == {i: sum(bytes([i]) in p for p in similar) for i in texts}


def test_overlaps():
    rng = np.random.default_rng(1)
    xs, ys = ([np.unique(rng.integers(0, 9000, n)) for n in rng.integers(1, 6000, 9)] for _ in range(2))
    assert (near.overlaps(xs, ys) == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]).all()


def test_near_with_repeated_ids(spark):
    rows = [(None, f"{LONG} {i % 40}") for i in range(400)] + [(5, f"{LONG} x{i}") for i in range(40)]
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))[0].toPandas()
    assert len(got) == 440 and got.class_id.isna().all() and (got[got.doc_id.isna()].n_links == 9 + 39 + 40).all() and (got[got.doc_id == 5].n_links == 79).all()


def test_near_counts_every_link(spark):
    rng = np.random.default_rng(12)
    texts, base = {}, [f"w{i}" for i in range(400)]
    for i in range(90):  # all similar to each other, in more than a cell
        texts[i] = " ".join([*base, f"a{i}", f"b{i}"])
    for i in range(100, 140):  # a chain: near ones are similar, far ones aren't
        texts[i] = " ".join(f"c{k}" for k in range(i * 4, i * 4 + 100))
    for i in range(200, 240):
        w = [f"e{k}" for k in range(150 + i % 40)]
        for k in rng.integers(0, 150, i % 4):
            w[k] = f"n{i}_{k}"
        texts[i] = " ".join(w)
    texts[300] = texts[5]
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in near.near_classes(frame)[0].collect()}
    grams = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in texts.items() for w in [t.split()]}
    similar = {i: {texts[j] for j in texts if texts[j] != texts[i] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8} for i in texts}
    copies = Counter(texts.values())
    assert got == {i: len(similar[i]) + copies[texts[i]] - 1 for i in texts} and got[0] == 89 and got[5] == 90


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(600):
        s = [" ".join(word() for _ in range(8)) for _ in range(rng.integers(1, 9))]
        toxic = int(i % 4 == 0)
        if toxic:
            s[rng.integers(len(s))] += f" {rng.choice(['vexilot', 'zorky', 'quambus'])} you"
        rows.append((i, ". ".join(s) + ".", toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(frame.where("doc_id < 400"))
    got = toxicity.scored(frame.where("doc_id >= 400"), model).toPandas()
    assert ((got.score >= toxicity.CUT) == (got.label == 1)).mean() > 0.98
    hit = got[got.label == 1].iloc[0]
    text = dict((r[0], r[1]) for r in rows)[hit.doc_id]
    assert any(re.search("vexilot|zorky|quambus", text[s["start"] : s["end"]]) for s in hit.offending)
    edge = toxicity.scored(odd(spark).select("doc_id", "text"), model).toPandas()
    assert edge.score.between(0, 1).all() and len(edge) == len(TEXTS) + 3
    assert toxicity.scored(frame.limit(0), model).count() == 0
    none = toxicity.train(frame.limit(0))
    assert 0 < toxicity.scored(frame.limit(1), none).first().score < 1


def test_scores_match_brute_force(spark):
    model = toxicity.Model({"bad$": 3.0, "wor": 1.5, "worse": 0.5, "fine": -1.0}, -2.5)
    texts = [None, "", "bad. fine", "Worse words! bad\nbad", "worse", "x" * 40 + "fine" + "y" * 40, "fine bad worst. " * 3000]
    got = toxicity.scored(docs(spark, texts), model).toPandas().set_index("doc_id").score
    for i, text in enumerate(texts):
        clean = 1.0
        for sentence in re.findall(r"[^.!?\n]+", text or "") or [""]:
            held = {f for w in re.findall(r"[^\W_]+", sentence.lower()) for f in [*(w[:n] for n in (3, 4, 5, 6) if len(w) >= n), w + "$"]}
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in held))))
        assert got[i] == pytest.approx(1 - clean, abs=1e-9)


def test_gradient_of_the_noisy_or():
    rng = np.random.default_rng(7)
    bags = [[list(rng.choice(6, rng.integers(1, 4), replace=False)) for _ in range(rng.integers(0, 4))] for _ in range(30)]
    data = toxicity.Bags(bags, list(rng.integers(0, 3, 30) + 1), list(rng.integers(0, 2, 30)), 6)
    theta = rng.normal(size=7)
    _, g = data.loss(theta)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert g[k] == pytest.approx((data.loss(theta + step)[0] - data.loss(theta - step)[0]) / 2e-6, abs=1e-6)


def test_quality(spark):
    got = quality.ledger(odd(spark)).toPandas()
    row = got[got.doc_id == 9].iloc[0]
    assert (row.n_words, row.word_chars, row.n_repeat_words) == (5000, 5000, 5000) and int(row.failed) & 2
    assert got[got.doc_id == 0].n_words.iloc[0] == 0 and got[got.doc_id == 8].n_dup_lines.iloc[0] == 1
    kept = quality.kept_documents(odd(spark).withColumnRenamed("lang", "n_words"))
    assert kept.columns == ["doc_id", "text", "n_words", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {6, 7, 11}
    table = quality.ablations(quality.ledger(odd(spark))).toPandas().set_index("rule")
    for policy in quality.POLICIES:  # bit aggregates against loops over the ledger
        for row in quality.ablations(quality.ledger(odd(spark)), policy).collect():
            bit = 1 << [n for n, _ in quality.RULES].index(row.rule)
            masked = [int(x) & policy.mask for x in got.failed]
            assert row.failing == sum(bool(x & bit) for x in masked) and row.failing_alone == sum(x == bit for x in masked) and row.kept_without == sum(not x & ~bit for x in masked)
    assert table.loc["few_words", "failing"] == (got.n_words < 50).sum() and quality.kept_documents(odd(spark).limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd_ones = ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|>", "x <|endoftext|>", "\x1c a\x1f b", "a\u00a0 b", "\u3000 a  b", "a\u2028 b  ", "e\u0301 ", "🙂 🙂  x", "'s 't  've", "z" * 5000]
    texts = [*TEXTS, "a  b", "a   b \n  c", " lead", "trail ", "tab\t x", "é ü — 中文 <|endoftext|> it's", LONG * 80, *odd_ones]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("ab1.' \n\té"), 40)) for _ in range(200)]
    got = packing.packed_documents(docs(spark, texts), keep_ids=True).toPandas()
    for i, t in enumerate(texts):
        part = got[got.doc_id == i].sort_values("start")
        ids = [x for piece in part.ids for x in piece]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, packing.END], t
        assert list(part.start) == list(np.cumsum([0, *part.length])[:-1]) and set(part.doc_tokens) == {len(ids)}
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == list(np.cumsum([0, *s.length])[:-1]) and s.length.sum() <= packing.WINDOW
    assert packing.packed_documents(odd(spark)).count() >= len(TEXTS) + 3 and packing.packed_documents(odd(spark).limit(0)).count() == 0


def test_best_fit_matches_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = [int(x) for x in rng.integers(1, 101, 150)]
        seq, off = packing.best_fit_decreasing(lengths, 100)
        rooms = []
        for k in sorted(range(150), key=lambda k: -lengths[k]):
            fits = [r for r in rooms if r >= lengths[k]]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 100) - lengths[k])
        used = Counter()
        for s, n in zip(seq, lengths, strict=True):
            used[s] += n
        assert sorted(100 - u for u in used.values()) == sorted(rooms) and len({*zip(seq, off, strict=True)}) == 150


def test_mixing(spark):
    sources = [None if i % 7 == 0 else f"s{i % 4}" for i in range(400)]
    frame = docs(spark, [" ".join(["w"] * (1 + i % 13)) for i in range(400)], sources)
    got = mixing.curriculum(frame).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == 400
    total = 0
    for _, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 13
        total += part.target.iloc[0]
    assert abs(total - 1.5 * got["size"].sum()) < 1e-6
    order = mixing.mixed(frame)
    assert order.columns == frame.columns and order.count() == sum(len(p) for p in got.positions)
    assert mixing.curriculum(odd(spark)).count() == len(TEXTS) + 3 and mixing.mixed(odd(spark).limit(0)).count() == 0
    empty = mixing.curriculum(docs(spark, [None, "", " "])).toPandas()
    assert (empty.taken == 0).all() and (empty.target == 0).all()


def test_pipeline_stages(spark, tmp_path):
    frame = odd(spark).unionByName(docs(spark, [" ".join(f"k{i}_{j}" for j in range(80)) + "\n" + LONG for i in range(30)]).withColumn("doc_id", F.col("doc_id") + 100))
    frame = clash(frame, "_row", "row", "tie", "n_deleted", "_position", "key")
    for empty in (False, True):
        at = frame.limit(0) if empty else frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == frame.columns
            out.write.parquet(str(tmp_path / f"{empty}{k}"))
            at = spark.read.parquet(str(tmp_path / f"{empty}{k}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.where("n_deleted <> 7 OR _row <> 7 OR key <> 7").count() == 0
        assert (at.count() == 0) == empty
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "False1")).collect()]
    assert sum(LONG in t for t in texts) == 1


def brute_pipeline(rows):
    """(doc_id, doc_tokens) of the pieces, as often as they come, by loops: rules, lines, classes, mix; rows: doc_id, text, source."""
    from tokenizers import Tokenizer

    import public_tokenizers

    word = re.compile(r"[^\x20\x09-\x0D]+")
    kept = {}
    for i, t, source in rows:
        w = word.findall(t or "")
        spans = {}
        for k in range(len(w) - 2):
            spans.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeated = {p + e for ps in spans.values() if len(ps) > 1 for p in ps for e in range(3)}
        held = [x for x in (t or "").split("\n") if word.search(x)]
        chars, symbols, letters = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(any(c.isalpha() for c in x) for x in w)
        bullets, dots = sum(bool(re.match(r"\s*[-*•]", x)) for x in held), sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in held)
        n, dups = len(w), len(held) - len(set(held))
        fails = n < 50 or 100 * len(repeated) > 50 * n or n > 100_000 or chars < 2 * n or chars > 20 * n or 100 * symbols > 25 * n
        if not (fails or 100 * dups > 50 * len(held) or 100 * letters < 50 * n or 100 * bullets > 90 * len(held) or 100 * dots > 30 * len(held)):
            kept[i] = (t, source)
    cut = brute_repeats({i: t for i, (t, _) in kept.items()})
    left = {i: cut[i] for i in kept if word.search(cut[i])}
    first = {i: t for i, t in left.items() if brute_classes(left)[i] == i}
    sizes = {i: len(word.findall(t)) for i, t in first.items()}
    sources = sorted({kept[i][1] for i in first})
    total = {s: sum(n for i, n in sizes.items() if kept[i][1] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, full = {}, set()
    while len(full) < len(sources):
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and level * weight[s] > 2 * total[s]}
        target = {s: 2 * total[s] if s in full else level * weight[s] for s in sources}
        if not over:
            break
        full |= over
    order = lambda i: hashlib.md5(f"{i}|{hashlib.md5(first[i].encode()).hexdigest()}".encode()).hexdigest()
    taken, tok = Counter(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for s in sources:
        at = 0
        for i in sorted((i for i in first if kept[i][1] == s), key=order):
            taken[i] = sum(at + sizes[i] / 2 + e * total[s] < target[s] for e in (0, 1))
            at += sizes[i]
    out = Counter()
    for i, n in taken.items():
        ids = len(tok.encode(first[i], add_special_tokens=False).ids) + 1
        for start in range(0, ids, packing.WINDOW):
            out[i, start, min(packing.WINDOW, ids - start), ids] += n
    return +out


def test_pipeline_matches_brute_force_and_runs_twice(spark, tmp_path):
    rng = np.random.default_rng(13)
    say = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 3000, n))
    shared, rows = "\n".join(say(30) for _ in range(3)), []
    for i in range(40):
        text = "\n".join(say(int(rng.integers(10, 60))) for _ in range(rng.integers(1, 6)))
        text = [text, f"{text}\n{shared}", "a b c " * 60, f"# $ % {text}", text.replace("v1", "u1")][i % 5]
        rows.append((i, text, f"s{i % 3}"))
    rows += [(50, rows[0][1], "s1"), (51, rows[0][1] + " more", "s2"), (52, None, "s0"), (53, "", "s0"), (54, say(9000), "s0")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    want = brute_pipeline(rows)
    for out in (first, second):
        assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in out.collect()) == want
