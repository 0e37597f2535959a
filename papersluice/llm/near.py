"""Operator 6: joining documents by the Jaccard similarity of their word n-grams.

MinHash LSH forest: a signature is dealt out to TREES tries of depth DEPTH. Two
texts of similarity s share a prefix of k values in some trie with probability
1 - (1 - s^k)^TREES; the prefixes are shortened from DEPTH until that reaches
the target recall. Candidates are verified exactly.

Each trie is a sorted run of signature slices, dealt by range, so a text finds
its longest matching prefixes beside it. Neighbours that match to the full
depth are compared first; then the prefix is shortened, for those texts whose
neighbours aren't linked yet, down to the length that reaches the recall. What
is linked so far makes components.

A node of the shortest length that still holds several components goes on to
an exact join: of a text's n-grams, rarest first, the first
n - ceil(s * n) + 1 must hold one of those of any similar text. n-grams that
few texts have in that place join texts directly, so that their pairs follow
the texts in number; texts that meet over frequent ones make families, and the
texts of a family meet in cells of bounded size, which return the components
that they link instead of pairs. So no link between two components is left
out, and no group makes a row for each pair. Texts with the same words are one
text from the start.

Similar texts are in one component, so links are counted there: where the links
found so far aren't all pairs, texts meet in cells of bounded size, by bands of
their number of n-grams, and a cell counts its texts' links without a row for
each. Counting is quadratic in a component's texts; the rows aren't.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import WORD, tie_of, words
from papersluice.session import read_table, written

NGRAM, SIMILAR, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 16, 6
SEED = 20_240_601
#: Texts and n-grams of a cell, on average, where all texts of a group meet; n-grams looked at together.
CELL, CELL_GRAMS, COLUMNS = 256, 200_000, 4096
#: Most texts of a component that meet inside a row.
SMALL = 32
#: An n-gram joins texts directly if at most so many have it in their prefix.
LIGHT = 64
#: Rounding of similarities.
ROUND = 1e-9


def shortest_prefix(similar: float = SIMILAR, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that still reaches the recall."""
    for k in range(depth, 0, -1):
        if 1 - (1 - similar**k) ** trees >= recall:
            return k
    return 1


def word_list(text: str) -> Column:
    return F.transform(words(text), F.lower)


def digest(w: Column) -> Column:
    """128 bits of the words; null without words."""
    return F.when(F.size(w) > 0, F.unhex(F.md5(F.array_join(w, " "))))


def shingles(w: Column, n: int = NGRAM) -> Column:
    """Distinct 64-bit hashes of the n-grams; a text of fewer words has one, of all."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.array_distinct(F.when(F.size(w) >= n, grams).when(F.size(w) > 0, F.array(F.xxhash64(w))))


def _signatures(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    random = np.random.default_rng(SEED)
    a, b = (random.integers(1 << 31, 1 << 32, size, dtype="u4") | 1 for _ in range(2))

    def least(x: np.ndarray) -> np.ndarray:
        x = x.view("u8")
        x = (x ^ (x >> np.uint64(32))).astype("u4")
        out = np.full(size, 0xFFFFFFFF, "u4")
        for lo in range(0, len(x), 2048):
            y = a[:, None] * x[None, lo : lo + 2048]
            y ^= y >> np.uint32(15)
            y *= b[:, None]
            np.minimum(out, y.min(axis=1), out=out)
        return out.view("i4")

    for batch in batches:
        out = batch.drop(columns=["s"])
        out["n"] = [len(s) for s in batch["s"]]
        out["sig"] = [least(np.asarray(s, "i8")) for s in batch["s"]]
        yield out


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least node of each node's component. edges: a, b. Least labels spread to neighbours and jump to their own label's label until nothing changes."""
    pairs = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    both = written(pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("label")), "labels")
    while True:
        met = both.join(labels.withColumnRenamed("v", "u"), "u").select("v", "label").unionByName(labels)
        near = written(met.groupBy("v").agg(F.min("label").alias("label")), "labels")
        top = near.select(F.col("v").alias("label"), F.col("label").alias("up"))
        after = written(near.join(top, "label").select("v", F.col("up").alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "v").where("label <> was").limit(1).count()
        labels = after
        if not moved:
            return labels


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, j: exact Jaccard similarities."""
    left, right = sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), sets.select(F.col("d").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("j"))


def sorted_neighbours(entries: DataFrame) -> DataFrame:
    """a, b, lcp: texts that stand next to each other in a trie, and the length of the prefix they share. entries: tree, slice (DEPTH values), d.

    Sorted by ranges, so a node of any size is spread over tasks. Neighbours in
    different ranges aren't compared; they meet in other tries or, being in one
    node, in the exact join.
    """
    of = entries.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = entries.select("tree", "slice", "d").repartitionByRange(int(of), "tree", "slice", "d").sortWithinPartitions("tree", "slice", "d")
    return ranged.mapInPandas(_beside, "a binary, b binary, lcp int")


def _beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for batch in batches:
        if last is not None:
            batch = pd.concat([last, batch])
        last = batch.iloc[-1:]
        tree, values, d = batch["tree"].to_numpy(), np.stack(batch["slice"].to_numpy()), batch["d"].to_numpy()
        same = np.cumprod((values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
        at = np.flatnonzero(same > 0)
        x, y = d[at], d[at + 1]
        swap = x > y
        yield pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "lcp": same[at].astype("i4")})


def _room(x: str, y: str, similar: float) -> Column:
    """Whether two numbers of n-grams can belong to similar texts."""
    return F.least(x, y) >= (similar - ROUND) * F.greatest(x, y)


def rare_links(texts: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, families) among texts of different labels that may be similar. texts: d, label, s (n-grams).

    n-grams are ordered by how many of these texts hold them. Two similar texts
    share one among the first n - ceil(similar * n) + 1 of either, at places
    that leave room for the overlap they need; n-grams of one text take places,
    but need no join. pairs: a, b that share an n-gram which at most LIGHT
    texts have there. families: d, family; texts that share another one are in
    one family. Every similar pair of different labels is in one of the two.
    """
    grams = written(texts.select("d", "label", F.size("s").alias("n"), F.explode("s").alias("h")), "grams")
    often = grams.groupBy("h").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y"))
    often = written(often.where("df > 1").select("h", "df", (F.col("x") != F.col("y")).alias("cross")), "often")
    held = grams.join(often, "h").groupBy("d", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h", "cross"))).alias("g"))
    first = F.col("n") - F.ceil(F.col("n") * (similar - ROUND)) + 1
    spots = held.select("d", "label", "n", F.posexplode("g").alias("i", "g"), (F.col("n") - F.size("g")).alias("own"), first.alias("first"))
    spots = spots.select("d", "label", "n", (F.col("own") + F.col("i")).alias("at"), "g.h", "g.cross", "first").where("cross AND at < first")
    spots = written(spots.drop("cross", "first"), "spots")
    met = spots.groupBy("h").agg(F.count("*").alias("c"), F.min("d").alias("lead"), F.min("label").alias("x"), F.max("label").alias("y"))
    met = written(met.where("x <> y").select("h", "c", "lead"), "met")
    near = spots.join(met.where(F.col("c") <= LIGHT).select("h"), "h")
    x, y = (near.select("h", *[F.col(c).alias(f"{c}{side}") for c in ("d", "label", "n", "at")]) for side in "xy")
    needed = (F.col("nx") + F.col("ny")) * (similar / (1 + similar)) - 1e-6
    able = (F.col("dx") < F.col("dy")) & (F.col("labelx") != F.col("labely")) & _room("nx", "ny", similar)
    able = able & (F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) >= needed)
    pairs = x.join(y, "h").where(able).select(F.col("dx").alias("a"), F.col("dy").alias("b")).distinct()
    heavy = spots.join(met.where(F.col("c") > LIGHT), "h").select(F.col("lead").alias("a"), F.col("d").alias("b"))
    heavy = written(heavy.distinct(), "heavy")
    if not heavy.take(1):
        return pairs, heavy.select(F.col("b").alias("d"), F.col("a").alias("family"))
    return pairs, components(heavy).select(F.col("v").alias("d"), F.col("label").alias("family"))


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of xs shares with each of ys, all being distinct within a text."""
    flat_x, flat_y = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(xs), len(ys)), "f4")

    def spots(texts: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, flat)
        hit = common[np.minimum(at, len(common) - 1)] == flat
        return np.repeat(np.arange(len(texts)), [len(t) for t in texts])[hit], at[hit]

    if len(common):
        (row_x, at_x), (row_y, at_y) = spots(xs, flat_x), spots(ys, flat_y)
        for lo in range(0, len(common), COLUMNS):
            a, b = np.zeros((len(xs), COLUMNS), "f4"), np.zeros((len(ys), COLUMNS), "f4")
            for m, row, at in ((a, row_x, at_x), (b, row_y, at_y)):
                own = (at >= lo) & (at < lo + COLUMNS)
                m[row[own], at[own] - lo] = 1
            out += a @ b.T
    return out


def similar_in(left: pd.DataFrame, right: pd.DataFrame, similar: float) -> np.ndarray:
    """Which rows of two cells are similar texts."""
    both = overlaps(list(left["s"]), list(right["s"]))
    n = np.array([len(s) for s in left["s"]])[:, None] + np.array([len(s) for s in right["s"]])[None, :] - both
    return both / n >= similar


def in_cells(members: DataFrame, similar: float, both_orders: bool, found: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """found() of each two cells of a group that may hold similar texts, in either order or in one. members: g (a group), d, label, s.

    A group is dealt into cells of bounded size by band (numbers of n-grams of
    similar texts are at most one band apart) and hash.
    """
    band = F.floor(F.log(F.size("s").cast("double")) / math.log(1 / min(similar, 0.99)) + ROUND)
    placed = written(members.select("g", "d", "label", "s", band.alias("band")), "placed")
    cells = placed.groupBy("g", "band").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum(F.size("s")) / CELL_GRAMS)).cast("long").alias("k"))
    cells = written(cells, "cells")
    part = F.pmod(F.xxhash64("d", F.lit(SEED)), F.col("k")).alias("part")
    dealt = placed.join(cells, ["g", "band"]).select("g", F.struct("band", part).alias("cell"), "d", "label", "s")
    each = cells.select("g", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"))
    left, right = each.select("g", F.struct("band", "part").alias("x")), each.select("g", F.struct("band", "part").alias("y"))
    meet = left.join(right, "g").where(F.abs(F.col("x.band") - F.col("y.band")) <= 1)
    meet = written(meet if both_orders else meet.where("x <= y"), "meet")
    side = lambda c: dealt.withColumnRenamed("cell", c).join(meet, ["g", c]).select(*[F.col(k).alias(k) for k in ("g", "x", "y", "d", "label", "s")]).groupBy("g", "x", "y")
    return side("x").cogroup(side("y")).applyInPandas(lambda x, y: found(x, y) if len(x) and len(y) else pd.DataFrame(), schema)


def family_links(families: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """a, b: labels of which a family holds similar texts. families: d, family; texts: d, label, s."""

    def found(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero(similar_in(x, y, similar))
        pairs = {(a, b) for a, b in zip(x["label"].to_numpy()[i], y["label"].to_numpy()[j], strict=True) if a != b}
        return pd.DataFrame(sorted(pairs), columns=["a", "b"])

    members = families.join(texts, "d").withColumnRenamed("family", "g")
    return in_cells(members, similar, False, found, "a binary, b binary").distinct()


def link_counts(links: DataFrame, labels: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """d, links: how many other texts of its component each text is similar to. links: a, b; labels: v, label of all linked texts; sets: d, s.

    Components where the links are all pairs are counted from these. The texts
    of other components meet inside a row where a component fits into a cell,
    else in cells.
    """
    size = labels.groupBy("label").agg(F.count("*").alias("m"))
    held = links.join(labels.withColumnRenamed("v", "a"), "a").groupBy("label").agg(F.count("*").alias("l"))
    known = F.coalesce("l", F.lit(0))
    open_ = written(size.join(held, "label", "left").where(2 * known < F.col("m") * (F.col("m") - 1)).select("label", "m"), "open")
    members = written(labels.withColumnRenamed("v", "d").join(open_, "label").join(sets, "d").select("d", "label", "m", "s"), "members")
    small = members.where(F.col("m") <= SMALL).groupBy("label").agg(F.collect_list(F.struct("d", "s")).alias("t"))
    count = lambda p: F.struct(p["d"].alias("d"), F.size(F.filter("t", lambda q: (p["d"] != q["d"]) & _alike(p, q, similar))).cast("long").alias("links"))
    counted = small.select(F.explode(F.transform("t", count)).alias("c")).select("c.*")
    large = members.where(F.col("m") > SMALL).select(F.col("label").alias("g"), "d", "label", "s")
    if large.take(1):

        def found(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            alike = similar_in(x, y, similar) & (x["d"].to_numpy()[:, None] != y["d"].to_numpy()[None, :])
            return pd.DataFrame({"d": x["d"], "links": alike.sum(axis=1).astype("i8")})

        met = in_cells(large, similar, True, found, "d binary, links long")
        counted = counted.unionByName(met.groupBy("d").agg(F.sum("links").alias("links")))
    each = links.select(F.explode(F.array("a", "b")).alias("d"))
    whole = each.join(members.select("d"), "d", "left_anti").groupBy("d").agg(F.count("*").alias("links"))
    return whole.unionByName(counted)


def _alike(p: Column, q: Column, similar: float) -> Column:
    """Similarity of two texts' n-grams within a row; that of unlike sizes isn't worked out."""
    room = F.least(F.size(p["s"]), F.size(q["s"])) >= (similar - ROUND) * F.greatest(F.size(p["s"]), F.size(q["s"]))
    many = F.size(F.array_intersect(p["s"], q["s"]))
    return room & F.transform(F.array(many), lambda i: i / (F.size(p["s"]) + F.size(q["s"]) - i) >= similar)[0]


def forest_links(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similar: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, entries, sets): similar neighbours a, b; the tries' entries (key: the shortest prefix) of texts that share one; their n-grams.

    texts: d, sig. sets_of gives d, s of texts d.
    """
    least = shortest_prefix(similar, recall)
    tree = F.array(*[F.struct(F.lit(t).alias("tree"), F.slice("sig", t * DEPTH + 1, DEPTH).alias("slice")) for t in range(TREES)])
    prefix = F.xxhash64("tree", *[F.get("slice", F.lit(i)) for i in range(least)]).alias("key")
    entries = texts.select("d", F.explode(tree).alias("t")).select("d", "t.*").select("d", "tree", "slice", prefix)
    shared = written(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    entries = written(entries.join(shared, "key"), "entries")
    sets = sets_of(written(entries.select("d").distinct(), "used"))
    beside = sorted_neighbours(entries).where(F.col("lcp") >= least)
    beside = written(beside.groupBy("a", "b").agg(F.max("lcp").alias("lcp")), "beside")
    deep = written(_compared(beside.where(F.col("lcp") == DEPTH).select("a", "b"), sets).where(F.col("j") >= similar).select("a", "b"), "links")
    met = deep.select(F.explode(F.array(F.struct(F.col("a").alias("d"), F.col("b").alias("o")), F.struct(F.col("b").alias("d"), F.col("a").alias("o")))).alias("e")).select("e.*")
    star = written(met.groupBy("d").agg(F.least(F.first("d"), F.min("o")).alias("star")), "star")
    rest = beside.where(F.col("lcp") < DEPTH).select("a", "b")
    for side in "ab":
        rest = rest.join(star.select(F.col("d").alias(side), F.col("star").alias(f"star_{side}")), side, "left")
    rest = written(rest.where("star_a IS NULL OR star_b IS NULL OR star_a <> star_b").select("a", "b"), "rest")
    more = written(_compared(rest, sets).where(F.col("j") >= similar).select("a", "b"), "links")
    return deep.unionByName(more), entries, sets


def near_classes(docs: DataFrame, n: int = NGRAM, similar: float = SIMILAR, recall: float = RECALL, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, texts).

    documents, a row per row of docs: doc_id, tie (a hash of its text), class_id
    (the least doc_id of its class), n_links (its other copies, and all other
    texts of its class that it is similar to; null unless counted). texts, a
    row per distinct text: d, doc_id and tie of its least document, class_d and
    class_id of its class.

    Similar means a Jaccard similarity of at least `similar` between the sets
    of lower-cased word n-grams; classes are connected components. Texts
    without words (null, empty, blank) are alone, without links. Null doc_ids
    are the least, so a class that holds one has a null class_id. Repeated rows
    are copies of each other; rows that share a doc_id only are told apart by
    their texts. Other columns don't matter, whatever their names.
    """
    w = docs.select("doc_id", tie_of().alias("tie"), word_list("text").alias("w"))
    hashed = w.select("doc_id", "tie", digest(F.col("w")).alias("d"), shingles(F.col("w"), n).alias("s"), F.size("w").alias("m"))
    first = hashed.where("m > 0").select("doc_id", "tie", "d", "s")
    schema = first.drop("s").schema.simpleString()[len("struct<") : -1] + ", n int, sig array<int>"
    signed = written(first.mapInPandas(lambda rows: _signatures(rows, TREES * DEPTH), schema), "signed")
    texts = signed.groupBy("d").agg(F.min(F.struct("doc_id", "tie")).alias("o"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    texts = written(texts.select("d", "o.doc_id", "o.tie", "copies", "sig"), "texts")

    def sets_of(used: DataFrame) -> DataFrame:
        wanted = written(used.join(texts.select("d", "doc_id", "tie"), "d"), "wanted")
        rows = docs.select(F.col("doc_id").alias("_id"), tie_of().alias("_tie"), "text")
        again = rows.join(wanted.hint("merge"), (F.col("_tie") == F.col("tie")) & F.col("_id").eqNullSafe(F.col("doc_id")))
        again = again.select("d", F.explode(F.array(word_list("text"))).alias("w")).select("d", shingles(F.col("w"), n).alias("s"))
        return written(again.dropDuplicates(["d"]), "sets")

    forest, entries, sets = forest_links(texts, sets_of, similar, recall)
    labels = components(forest)

    placed = entries.select("key", "d").join(labels.withColumnRenamed("v", "d"), "d", "left").withColumn("label", F.coalesce("label", "d"))
    placed = written(placed, "labelled")
    mixed = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = placed.join(written(mixed, "mixed"), "key").select("d", "label").distinct()
    rest = written(rest.join(sets, "d"), "rest")
    pairs, families = rare_links(rest, similar)
    more = written(_compared(written(pairs, "found"), sets).where(F.col("j") >= similar).select("a", "b"), "links")
    families = written(families, "families")
    links, bonds = forest.unionByName(more), more
    if families.take(1):
        bonds = more.unionByName(written(family_links(families, rest, similar), "bonds"))
    if bonds.take(1):
        labels = components(forest.unionByName(bonds))

    joined = texts.select("d", "doc_id", "tie", "copies").join(labels.withColumnRenamed("v", "d"), "d", "left")
    total = F.lit(None).cast("long")
    if counted:
        joined = joined.join(link_counts(links, labels, sets, similar), "d", "left")
        total = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    joined = written(joined.select("d", "doc_id", "tie", F.coalesce("label", "d").alias("label"), total.alias("n_links")), "joined")
    classes = written(joined.groupBy("label").agg(F.min(F.struct("doc_id", "d")).alias("c")), "classes")
    of = [F.col("c.d").alias("class_d"), F.col("c.doc_id").alias("class_id")]
    by_text = written(joined.join(classes, "label").select("d", "doc_id", "tie", "n_links", *of), "by_text")
    bare = hashed.where("m <= 0").select("doc_id", "tie", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    rows = signed.select("doc_id", "tie", "d").join(by_text.select("d", "class_id", "n_links"), "d")
    return rows.select("doc_id", "tie", "class_id", F.col("n_links").cast("long")).unionByName(bare), by_text


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of least doc_id of each class, and those without words; columns as in docs, which may have any names.

    Null texts have no words and stay, as do empty and blank ones, repeated or
    not. Of repeated rows one stays. A null doc_id is the least.
    """
    _, texts = near_classes(docs.select("doc_id", "text"), counted=False)
    stay = texts.where("d = class_d").select(F.col("doc_id").alias("id"), F.col("tie").alias("of"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("key"), tie_of().alias("tie"), F.coalesce(F.col("text"), F.lit("")).rlike(WORD).alias("worded"))
    held = keyed.where("worded").join(stay, F.col("key").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("of"))).dropDuplicates(["key", "tie"])
    return held.select("row").unionByName(keyed.where("NOT worded").select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document; nulls, empty texts and repeated rows as in near_classes()."""
    rows, _ = near_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "class_id", "n_links")
