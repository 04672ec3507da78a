"""Operator 5: exact Jaccard join of documents on n-word shingles, as a metric-space join.

Jaccard distance d = 1 - J is a metric, and two documents link when d <= r = 1 - t, that is when their symmetric
difference is at most D = floor((1-t)/(1+t) * (a+b)) for sizes a, b. Whole documents as top-level pivots do not work on text: nearly all
distances to them lie at 0.95 to 1, so windows of 2 r copy every document into every region. The join therefore
takes its metric on restrictions first, and whole pivots inside the regions that these leave:

1. *Cells.* The shingle universe is cut by hash into B > D disjoint parts, so of a linked pair at least one part has
   restrictions at distance 0: each document lies in the Voronoi cells (distance 0) of its own B restrictions. B depends on
   the size class of the larger document; *windows*: by the triangle inequality through the empty set | |x| - |y| | <= D, so a
   document is copied into the cells of every larger class whose border lies within that of its size. A document with
   so many empty parts that the count fails (at most D non-empty ones) is also dealt to the cells of its empty parts.
2. *Regions* are the connected unions of cells with more than one document; no link leaves its region. Each region gets a
   *pivot* p: the shingles that most of a bounded sample of its documents hold (any set is a right pivot; a central one prunes best). With the
   residual e(x) = x symmetric-difference p, the distance of x and y is |e(x) sym-diff e(y)|, which by the triangle inequality lies between
   | |e(x)| - |e(y)| | and |e(x)| + |e(y)|.
3. *Inside the ball*: where |e(x)| + |e(y)| <= D the pair links for certain. For connectivity it is enough to link every document
   with the most central document of each size within the size window (the chain x - c(|y|) - c(|x|) - y holds).
4. *Recursion* outside it: a linked pair must share (|e(x)| + |e(y)| - D) / 2 residual shingles, so it meets in the sub-region of one of
   the first D + 1 residual shingles of both, those that are rare in the region first, and k more of these bring k more meetings. Pairs that meet
   so often, are not yet connected and pass the bounds are compared exactly.

Nothing is dropped: a pair is skipped only when the bounds prove it unlinked or it is already connected, so
components are exact. Equal shingle sets are joined first as one, so copies are never compared.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .bytesvec import U64, Words, mix, packed, pieces, shingles
from .common import arrow_rows, components, dropped, released, settled, shared_dir, small_side

_SETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType(), False),
        T.StructField("d1", T.LongType(), False),
        T.StructField("d2", T.LongType(), False),
        T.StructField("keys", T.ArrayType(T.LongType()), False),
        T.StructField("peers", T.ArrayType(T.LongType()), False),
    ]
)


#: Beyond the first, a linked pair shares one more of its first residual shingles for so many of its shingles.
SHARED = 16


def size_classes(most: int = 1 << 40) -> list[int]:
    """Lower bounds of the size classes: each is a quarter wider than the one before."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def parts_of_class(classes: list[int], num: int, den: int) -> np.ndarray:
    """Number of parts B of each class: over the largest difference D that a linked pair can have, with a tenth to spare; 0 where D is 0 and only equal sets link."""
    tops = [x - 1 for x in classes[1:]]
    d = [2 * top * (den - num) // (den + num) for top in tops]
    return np.array([x + 1 + max(1, x // 10) if x else 0 for x in d], np.int64)


def classes_above(classes: list[int], num: int, den: int) -> int:
    """The most classes above its own in which a document can have a linked partner, that is one of at most den / num times its size."""
    return max(bisect_right(classes, (classes[k + 1] - 1) * den // num) - 1 - k for k in range(len(classes) - 1))


def _three_sums(gid: np.ndarray, m: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the set of values in each group: three exact sums of 22-bit pieces, mixed."""
    out = np.zeros(size, U64)
    for shift in (0, 22, 44):
        part = ((m >> U64(shift)) & U64((1 << 22) - 1)).astype(np.float64)
        out = mix(out * U64(0x9FB21C651E98DF25) + np.bincount(gid, part, size).astype(U64))
    return out


def _cell_keys(u: np.ndarray, offs: np.ndarray, num: int, den: int, classes: list[int], parts: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of each set, and their offsets."""
    sizes = np.diff(offs)
    m1 = mix(u ^ U64(0x8BB84B93962EACC9))
    owners, found = [], []
    own = np.searchsorted(np.array(classes), sizes, side="right") - 1
    for up in range(above + 1):
        cls = own + up
        low = np.array(classes)[np.maximum(cls, 0)]
        into = (sizes > 0) & (parts[np.maximum(cls, 0)] > 0)
        if up:
            into &= sizes * den >= num * low  # some partner of that class can be near enough
        docs = np.flatnonzero(into)
        if not len(docs):
            continue
        b = parts[cls[docs]]
        base = np.concatenate([[0], np.cumsum(b)])
        n = sizes[docs]
        where = np.repeat(np.arange(len(docs)), n)
        at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.repeat(offs[docs], n)
        part = ((u[at] >> U64(17)) % b[where].astype(U64)).astype(np.int64)
        gid = base[:-1][where] + part
        full = np.bincount(gid, minlength=base[-1])
        key = _three_sums(gid, m1[at], base[-1])
        owner = np.repeat(np.arange(len(docs)), b)
        number = np.arange(base[-1]) - base[:-1][owner]
        key = mix(key ^ mix((cls[docs][owner] * 0x100000001 + number).astype(U64)))
        empty = full == 0
        key[empty] = mix(mix((cls[docs][owner[empty]] * 0x100000001 + number[empty]).astype(U64)) + U64(0xE7037ED1A0B428DB))
        top = np.minimum(np.array(classes)[cls[docs] + 1] - 1, n * den // num)
        few = np.bincount(owner, ~empty, len(docs)).astype(np.int64) <= (n + top) * (den - num) // (den + num)
        keep = ~empty | few[owner]
        owners.append(docs[owner[keep]])
        found.append(key[keep])
    if not found:
        return np.zeros(0, U64), np.zeros(len(sizes) + 1, np.int64)
    who, keys = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(who, kind="stable")
    return keys[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(sizes)))])


def _local_cells(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cells that several documents at hand share stay with the smallest id of them; the others get its id as a peer instead.

    So a cell that a third of all documents hold is no hot key of the exchange: each chunk of documents sends it once.
    """
    owner = np.repeat(np.arange(len(ids)), np.diff(at))
    order = np.lexsort((ids[owner], keys))
    k, o = keys[order], owner[order]
    first = np.append(True, k[1:] != k[:-1])[: len(k)]
    holder = o[first][np.cumsum(first) - 1]
    stay = np.sort(order[first])
    pairs = np.unique(np.stack([o[~first], holder[~first]]), axis=1) if (~first).any() else np.zeros((2, 0), np.int64)
    pairs = pairs[:, pairs[0] != pairs[1]]
    peers = np.split(ids[pairs[1]], np.cumsum(np.bincount(pairs[0], minlength=len(ids)))[:-1])
    return keys[stay], np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=len(ids)))]), peers


def shingle_sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """A row (id, n, d1, d2, keys, peers) for each row (id, text): set size, 128-bit digest of the set, cell keys, and documents of the same chunk that hold its other cells."""
    classes = size_classes()
    above = classes_above(classes, num, den)
    parts = np.append(parts_of_class(classes, num, den), np.zeros(above + 1, np.int64))
    bounds = classes + [classes[-1] * 2] * (above + 1)

    def run(batches):
        for chunk in (c for batch in batches for c in pieces(batch, most=2 << 20)):
            ids = chunk["id"].fill_null(1 << 62).to_numpy(zero_copy_only=False)
            got = []
            for x in pieces(chunk):
                u, offs = shingles(Words(*packed(x["text"]), lower=True), words)
                sizes = np.diff(offs)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                d1 = _three_sums(owner, mix(u ^ U64(0x5851F42D4C957F2D)), len(sizes)) ^ sizes.astype(U64)
                d2 = _three_sums(owner, mix(u ^ U64(0x14057B7EF767814F)), len(sizes))
                keys, at = _cell_keys(u, offs, num, den, bounds, parts, above)
                valid = np.repeat(x["id"].is_valid().to_numpy(zero_copy_only=False), np.diff(at))
                got.append((sizes, d1, d2, keys[valid], np.where(x["id"].is_valid(), np.diff(at), 0)))
            sizes, d1, d2, keys, count = (np.concatenate([g[j] for g in got]) for j in range(5))
            keys, at, peers = _local_cells(ids, keys, np.concatenate([[0], np.cumsum(count)]))
            yield pa.record_batch(
                [
                    chunk["id"],
                    pa.array(sizes),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))),
                    pa.array(peers, pa.list_(pa.int64())),
                ],
                names=_SETS.names,
            )

    return docs.mapInArrow(run, _SETS)


def _whole_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for x in pieces(batch):
                u, offs = shingles(Words(*packed(x["text"]), lower=True), words)
                rows = [u[a:b] for a, b in zip(offs, offs[1:], strict=False)]
                hist = [np.bincount((r >> U64(40)).astype(np.int64) % 256, minlength=256) for r in rows]
                packed_ = [h.astype(np.uint16).tobytes() if h.max() < 1 << 16 else None for h in hist]
                yield pa.record_batch([x["id"], pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(packed_, pa.binary())], names=["id", "shingles", "hist"])

    return docs.mapInArrow(run, "id long, shingles binary, hist binary")


def _can_link(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, need, ..) whose sets can share ``need`` / (num + den) shingles: they share no more than the sum of the smaller counts over 256 parts of the universe.

    A set too large for these counts stays.
    """

    def run(batches):
        for batch in batches:
            solid = batch.filter(pa.compute.and_(batch["x"].is_valid(), batch["y"].is_valid()))
            p, q = (np.frombuffer(packed(solid[c])[0].tobytes(), np.uint16).reshape(-1, 256) for c in ("x", "y"))
            most = np.minimum(p, q).sum(axis=1, dtype=np.int64) * (num + den)
            yield solid.filter(pa.array(most >= solid["need"].to_numpy())).select(["a", "b", "c"])
            yield batch.filter(pa.compute.or_(batch["x"].is_null(), batch["y"].is_null())).select(["a", "b", "c"])

    x, y = (sets.select(F.col("id").alias(k), F.col("hist").alias(v)) for k, v in (("b", "y"), ("a", "x")))
    return pairs.join(x, "b").join(y, "a").select("a", "b", "c", "need", "x", "y").mapInArrow(run, "a long, b long, c long")


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact intersection and union sizes of all pairs (a, b)."""

    def run(batches):
        for batch in batches:
            got = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                got.append((both, len(p) + len(q) - both))
            cols = np.array(got, np.int64).reshape(-1, 2)
            yield pa.record_batch([batch["a"], batch["b"], pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["a", "b", "both", "either"])

    x = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, both long, either long")


def _pivots(sets: DataFrame, sample: int) -> DataFrame:
    """A row (g, pivot, common) for each region of sets (g, id, shingles): what most of at most ``sample`` documents hold, and what others of at least two hold."""
    place = F.row_number().over(W.Window.partitionBy("g").orderBy(F.xxhash64("id"), "id"))
    few = sets.withColumn("k", place).where(F.col("k") <= sample)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        value, count = np.unique(np.concatenate([np.frombuffer(x, U64) for x in df["shingles"]]), return_counts=True)
        core = 2 * count > len(df)
        return pd.DataFrame({"g": [df["g"].iloc[0]], "pivot": [value[core].tobytes()], "common": [value[~core & (count > 1)].tobytes()]})

    return few.select("g", "shingles").groupBy("g").applyInPandas(run, "g long, pivot binary, common binary")


def _residuals(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of each document (g, id, shingles, pivot, common): its size n, the size e of its residual, and the first residual shingles, rare ones first."""

    def inside(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
        if not len(ref):
            return np.zeros(len(x), bool)
        at = np.searchsorted(ref, x)
        at[at == len(ref)] = 0
        return ref[at] == x

    def run(batches):
        for batch in batches:
            n, e, first = [], [], []
            for x, p, c in zip(batch["shingles"], batch["pivot"], batch["common"], strict=True):
                x, p, c = (np.frombuffer(v.as_buffer(), U64) for v in (x, p, c))
                new, gone = x[~inside(x, p)], p[~inside(p, x)]
                usual = inside(new, c)
                order = np.concatenate([new[~usual], new[usual], gone])
                n.append(len(x))
                e.append(len(order))
                first.append(order[: len(x) * (den - num) // num + 1 + len(x) // SHARED].view(np.int64))
            yield pa.record_batch([batch["g"], batch["id"], pa.array(n, pa.int64()), pa.array(e, pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["g", "id", "n", "e", "first"])

    return sets.select("g", "id", "shingles", "pivot", "common").mapInArrow(run, "g long, id long, n long, e long, first array<long>")


def _regions(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored tables: sets (id, n, d1, d2), those with shingles and an id, their classes (d1, d2, rep), and the region g of each representative that meets another."""
    spark, cells, bare = docs.sparkSession, shared_dir(docs.sparkSession), shared_dir(docs.sparkSession)
    with arrow_rows(spark, 1000):
        keyed = settled(shingle_sets(docs, words, num, den), cells)
    sets = settled(keyed.select("id", "n", "d1", "d2"), bare)
    solid = sets.where("n > 0 AND id IS NOT NULL")
    classes = settled(solid.groupBy("d1", "d2").agg(F.min("id").alias("rep")))
    of_id = solid.join(classes, ["d1", "d2"]).select("id", "rep").distinct()
    reps = classes.select(F.col("rep").alias("id")).distinct()
    live = keyed.where("n > 0 AND id IS NOT NULL")
    dealt = live.select("id", "keys").join(reps, "id", "left_semi").select("id", F.explode("keys").alias("cell"))
    # One exchange by cell gives each cell's smallest document and the links to it.
    p = F.min("id").over(W.Window.partitionBy("cell"))
    near = dealt.withColumn("p", p).where("id <> p").select(F.col("id").alias("src"), F.col("p").alias("dst"))
    # Peers of the same chunk count by their classes, as only a class's representative deals its cells.
    local = live.select("id", F.explode("peers").alias("peer")).distinct().join(of_id, "id").select("peer", F.col("rep").alias("src"))
    local = local.join(of_id.select(F.col("id").alias("peer"), F.col("rep").alias("dst")), "peer").where("src <> dst").select("src", "dst")
    near = settled(near.union(local).distinct())
    dropped(spark, cells)
    return sets, solid, classes, settled(components(near)).select("id", F.col("root").alias("g"))


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, sample: int = 64) -> tuple[DataFrame, DataFrame]:
    """Links of all documents (id, text) with Jaccard similarity of at least num / den on ``words``-word shingles.

    Returns (members, links). members: a row (id, n, component) for each input row; n is the set's size, component
    the smallest id reachable by links. links: pairs (a, b) of class representatives that link and connect them.
    White space is ASCII, A-Z count as a-z. A text of fewer words than ``words`` is one shingle; an
    empty, blank or null text has no shingles and links with nothing. Rows that repeat an id are one
    node with all their texts; a null id stays alone (component null). Other columns are ignored. ``sample`` bounds the documents
    that choose a region's pivot; it has no part in the result.
    """
    assert 0 < num < den
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    sets, solid, classes, regions = _regions(docs, words, num, den)
    released(spark)
    n = regions.count()
    with arrow_rows(spark, 1000):
        whole = settled(_whole_sets(docs.join(small_side(regions.select("id"), n), "id", "left_semi"), words))
    placed = whole.join(small_side(regions, n), "id")
    both = placed.join(settled(_pivots(placed, sample)), "g")
    passing = shared_dir(spark), shared_dir(spark)
    with arrow_rows(spark, 256):  # each row holds three sets
        rest = settled(_residuals(both, num, den), passing[0])
    del both, placed
    released(spark)
    # Rows that repeat an id join their classes.
    joined = solid.join(classes, ["d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    twice = solid.groupBy("id").count().where("count > 1").select(F.col("id").alias("a"))
    links = joined.join(twice, "a", "left_semi").where("a <> b")

    side = lambda df, s, *more: df.select("g", *(F.col(c).alias(c + s) for c in ("id", "n", "e")), *more)
    sizes = f"least(n1, n2) * {den}L >= greatest(n1, n2) * {num}L"
    limit = f"(n1 + n2) * {den - num}L"  # (den + num) x the largest difference of a linked pair
    inner = rest.where(f"e * {num}L <= n * {den - num}L")
    step = F.floor(F.log(F.col("n")) / float(np.log(den / num)) + 1e-9)
    centres = inner.groupBy("g", "n").agg(F.min(F.struct("e", "id")).alias("c")).select("g", "n", "c.e", "c.id")
    centres = side(centres.withColumn("step", F.explode(F.array(step - 1, step, step + 1))), "2", "step")
    ball = side(inner.withColumn("step", step), "1", "step").join(centres, ["g", "step"]).where("id1 <> id2").where(sizes).where(f"(e1 + e2) * {den + num}L <= {limit}")
    links = settled(links.union(ball.select(F.col("id1").alias("a"), F.col("id2").alias("b"))).distinct())

    graph = lambda x: settled(components(x.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    comp = graph(links)
    known = rest.join(comp, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    open_ = known.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("g")
    # One exchange by residual shingle: those of one document, or of one component, alone go before anything is joined.
    shared = W.Window.partitionBy("g", "key")
    met = known.join(open_, "g").select("g", "id", "n", "e", "comp", F.posexplode("first").alias("at", "key"))
    met = met.withColumn("c0", F.min("comp").over(shared)).withColumn("c1", F.max("comp").over(shared)).where("c0 <> c1").drop("c0", "c1")
    met = settled(met, passing[1])
    dropped(spark, passing[0])
    released(spark)
    left, right = side(met, "1", "key", F.col("at").alias("at1"), F.col("comp").alias("comp1")), side(met, "2", "key", F.col("at").alias("at2"), F.col("comp").alias("comp2"))
    # Twice the shared residual shingles that a linked pair needs, and those that can still come from this one on.
    needed = f"((e1 + e2) * {den + num}L - {limit})"
    met_in = left.join(right, ["g", "key"]).where("id1 < id2 AND comp1 <> comp2").where(sizes).where(f"abs(e1 - e2) * {den + num}L <= {limit}")
    pairs = met_in.groupBy("id1", "id2", "n1", "n2", "e1", "e2").agg(F.count("*").alias("c"), F.min("at1").alias("at1"), F.min("at2").alias("at2"))
    pairs = pairs.where(f"2 * (e1 - at1) * {den + num}L >= {needed} AND 2 * (e2 - at2) * {den + num}L >= {needed}")
    pairs = pairs.where(f"c >= 1 + least(n1, n2) div {SHARED} OR 2 * c * {den + num}L >= {needed}")
    # A class of many near copies needs few of its pairs: each document's best partner is compared first, then what is still apart.
    need = ((F.col("n1") + F.col("n2")) * num).cast("long")
    hists = whole.groupBy("id").agg(F.when(F.count("*") == 1, F.min("hist")).alias("hist"))  # an id of several texts is not judged by one
    todo = settled(_can_link(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"), "c", need.alias("need")), hists, num, den))
    dropped(spark, passing[1])
    for all_left in (False, True):
        best = F.row_number().over(W.Window.partitionBy("a").orderBy(F.desc("c"), "b"))
        now = todo if all_left else todo.withColumn("k", best).where("k = 1")
        with arrow_rows(spark, 512):
            checked = settled(_shared(now.select("a", "b"), whole))
        more = checked.where(f"both * {den}L >= either * {num}L").select("a", "b")
        if more.take(1):
            links = settled(links.union(more))
            comp = graph(links)
        if not all_left:
            root = lambda c: comp.select(F.col("id").alias(c), F.col("root").alias("r" + c))
            apart = todo.join(checked, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
            todo = settled(apart.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "c"))
        released(spark)
    members = sets.join(classes, ["d1", "d2"], "left").join(comp.select(F.col("id").alias("rep"), "root"), "rep", "left")
    members = members.select("id", "n", F.when(F.col("n") > 0, F.coalesce("root", F.when(F.col("id").isNotNull(), F.col("rep")))).otherwise(F.col("id")).alias("component"))
    return members.withColumn("component", F.when(F.col("id").isNotNull(), F.col("component"))), links


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and component, three-word shingles, similarity 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    members, _ = jaccard_join(docs, words=3, num=9, den=10)
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents of which no smaller doc_id is reachable by links, with all their columns.

    A row without doc_id is kept, and all rows of a kept doc_id are.
    """
    members, _ = jaccard_join(docs.select(F.col("doc_id").alias("id"), "text"), words, num, den)
    gone = settled(members.where("component <> id").select(F.col("id").alias("doc_id")).distinct())
    return docs.join(small_side(gone, gone.count(), 2_000_000), "doc_id", "left_anti").select(docs.columns)


ORACLE_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.g) AS k
         FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) f USING (g)),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
         FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id
         WHERE a.k <= a.n - (9 * a.n + 9) // 10 + 1 AND b.k <= b.n - (9 * b.n + 9) // 10 + 1),
link AS (SELECT x, y FROM (SELECT c.x, c.y, c.nx, c.ny, count(*) AS i
         FROM cand c JOIN s a ON a.doc_id = c.x JOIN s b ON b.doc_id = c.y AND b.g = a.g GROUP BY ALL)
         WHERE 100 * i >= 90 * (nx + ny - i)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
