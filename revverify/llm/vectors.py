"""Operators 1 and 8 on embeddings: near-duplicates by random-hyperplane hashing, and exact top-k by a pivot table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import components, dropped, shared_dir, small_side, stored


def usable(vec: str) -> Column:
    """True for a vector with components, all of them finite numbers."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tables_for(recall: float, p: float, bits: int) -> int:
    """Tables in which a pair whose signs agree with chance p meets at least once with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, bucket: int = 256, block: int = 1024, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Links between vectors (id, vec, label) of equal label with cosine >= threshold in double precision.

    Returns (members, edges). members: a row (id, n_links, component) for each input row; edges: (src, dst), a spanning set of
    the links found.

    Equal vectors are one class, so copies never meet one another. Signs against ``bits`` random hyperplanes make
    a bucket number in each of several tables: ``bits`` follows the number of vectors of the label so that an even bucket holds
    about ``bucket`` vectors, and the number of tables follows from ``recall``, the chance that a pair at the threshold meets in
    one table at least (nearer pairs do so more surely). A bucket of more than 2 x ``block`` vectors is cut into
    blocks by a hash of the id, and all pairs of blocks are compared, each in its own group: no bucket is
    capped and no group is unbounded. A group returns sums and a spanning forest for each vector, never its pairs. A
    pair that meets in several tables counts in the first of them only. Every link is checked exactly.

    A vector that is null, empty, zero or holds null or non-finite components, or has no label, links with nothing. Rows
    that repeat an id are vectors of their own and count one another's links; they share a component. A null id takes
    no part and has component null. Vectors of different lengths never link. Other columns are not looked at, and an empty table
    gives no rows.
    """
    kind = "float" if dict(vectors.dtypes)["vec"] == "array<float>" else "double"
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(f"array<{kind}>").alias("vec"), F.col("label").cast("string").alias("label"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    live = rows.where(usable("vec")).where("label IS NOT NULL AND id IS NOT NULL").where(norm > 0)
    spark, held = vectors.sparkSession, shared_dir(vectors.sparkSession)
    classes = stored(live.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("uid", F.xxhash64("label", "vec")))
    # Bits by label: a label of many vectors has more and smaller buckets, and more tables to keep the recall.
    of_label = stored(classes.groupBy("label").agg(F.greatest(F.lit(2), F.least(F.lit(30), F.ceil(F.log2(F.count("*") / F.lit(bucket))))).cast("int").alias("bits")))
    p = 1 - math.acos(threshold) / math.pi

    def signed(batches):
        planes: dict[tuple, np.ndarray] = {}
        for df in batches:
            dims, bits_of, codes = df["vec"].map(len).to_numpy(), df["bits"].to_numpy(), [None] * len(df)
            for dim, bits in sorted(set(zip(dims.tolist(), bits_of.tolist(), strict=True))):
                at = np.flatnonzero((dims == dim) & (bits_of == bits))
                tables = tables_for(recall, p, bits)
                if (dim, bits) not in planes:
                    planes[dim, bits] = np.random.default_rng([seed, dim, bits]).standard_normal((dim, tables * bits))
                x = np.stack(df["vec"].to_numpy()[at]).astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                up = (x @ planes[dim, bits] > 0).reshape(len(at), tables, bits)
                for i, row in zip(at.tolist(), (up @ (1 << np.arange(bits))).astype(np.int32), strict=True):
                    codes[i] = row
            yield df.drop(columns="bits").assign(codes=codes, dim=dims.astype(np.int32))

    coded = classes.join(small_side(of_label, of_label.count()), "label").select("label", "vec", "rep", "copies", "uid", "bits")
    coded = stored(coded.mapInPandas(signed, f"label string, vec array<{kind}>, rep long, copies long, uid long, codes array<int>, dim int"), held)
    dealt = coded.select("*", F.posexplode("codes").alias("t", "code"))
    keys = ["t", "label", "dim", "code"]
    hot = dealt.groupBy(*keys).agg(F.count("*").alias("c")).where(F.col("c") > 2 * block)
    hot = hot.select(*keys, F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    dealt = dealt.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
    # A pair that shares a bucket meets there once; of its codes only those of earlier tables tell whether it met before.
    dealt = dealt.withColumn("codes", F.slice("codes", 1, F.col("t")))

    def compared(df: pd.DataFrame) -> pd.DataFrame:
        n, t = len(df), int(df["t"].iloc[0])
        cols = ["uid", "rep", "links", "root"]
        if n < 2 and df["b1"].iloc[0] != df["b2"].iloc[0]:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
        x = np.stack(df["vec"].to_numpy()).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        codes, copies, own = (np.stack(df["codes"].to_numpy()) if t else None), df["copies"].to_numpy(), df["own"].to_numpy()
        across = df["b1"].iloc[0] != df["b2"].iloc[0]
        links, left, right = np.zeros(n, np.int64), [], []
        for s in range(0, n, 512):
            near = x[s : s + 512] @ x.T >= threshold - 1e-12
            i, j = np.nonzero(near)
            i += s
            keep = i < j
            if across:
                keep &= own[i] != own[j]
            i, j = i[keep], j[keep]
            keep = np.ones(len(i), bool)
            for k in range(t):
                keep &= codes[i, k] != codes[j, k]
            i, j = i[keep], j[keep]
            dot = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
            i, j = i[dot >= threshold], j[dot >= threshold]
            links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
            left.append(i)
            right.append(j)
        rep = df["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        root = rep[order][_local_roots(n, rank[np.concatenate(left)], rank[np.concatenate(right)])][rank]
        has = links > 0
        return pd.DataFrame({"uid": df["uid"].to_numpy()[has], "rep": rep[has], "links": links[has], "root": root[has]}, columns=cols)

    partial = stored(dealt.groupBy(*keys, "b1", "b2").applyInPandas(compared, "uid long, rep long, links long, root long"))
    dropped(spark, held)
    count = partial.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = partial.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")).distinct()
    # Rows that repeat an id with other vectors join their classes.
    joined = live.join(classes, ["label", "vec"]).select("id", "rep", "uid", "copies")
    again = live.groupBy("id").count().where("count > 1").select("id")
    edges = stored(edges.union(joined.join(again, "id", "left_semi").where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))))
    comp = stored(components(edges))
    known = joined.join(count, "uid", "left").join(comp.select(F.col("id").alias("rep"), "root"), "rep", "left")
    known = known.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    other = rows.where(~(usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(norm > 0, F.lit(False))))
    other = other.join(comp, "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component"))
    return known.union(other), edges


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its number of links at cosine 0.93 within its label, its component and whether it is the one kept."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    out, _ = near_vectors(v)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


ORACLE_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, vec_id = c.m AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def _pivot_rows(points: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """A bounded sample of the points as pivots, ``pivots`` for each vector length among at most 16 lengths, by hash order."""
    dims = [x["dim"] for x in points.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect()]
    out = {}
    for dim in dims:
        got = points.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        out[int(dim)] = np.array([x["vec"] for x in got], float)
    return out


def _with_distances(rows: DataFrame, table: dict[int, np.ndarray]) -> DataFrame:
    """Rows (id, vec, dim, norm) with the pivot table: dist (distances to the pivots of that length) and home (the nearest pivot)."""

    def run(batches):
        for df in batches:
            dist, home = [np.zeros(0)] * len(df), np.zeros(len(df), np.int32)
            dims = df["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in table:
                    at, p = np.flatnonzero(dims == dim), table[dim]
                    x = np.stack(df["vec"].to_numpy()[at]).astype(float)
                    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))
                    home[at] = d.argmin(1)
                    for i, row in zip(at.tolist(), d, strict=True):
                        dist[i] = row
            yield df.assign(dist=dist, home=home)

    return rows.mapInPandas(run, "id long, vec array<long>, dim int, norm double, dist array<double>, home int")


def _search(k: int):
    """Evaluates the points of one block for the queries that visit it: rows (query, id, score), at most k a query."""

    def searched(df: pd.DataFrame) -> pd.DataFrame:
        isq = df["query"].to_numpy()
        out = {"query": [], "id": [], "score": []}
        qs, xs = df[isq], df[~isq].sort_values("id", kind="stable")
        if len(qs) and len(xs):
            exact_floats = qs["norm"].max() < 2.0**53 and xs["norm"].max() < 2.0**53
            kind = np.float64 if exact_floats else np.int64
            a, b = (np.stack(d["vec"].to_numpy()).astype(kind) for d in (qs, xs))
            da, db = (np.stack(d["dist"].to_numpy()) for d in (qs, xs))
            na, nb, qid, xid, floor = qs["norm"].to_numpy(), xs["norm"].to_numpy(), qs["id"].to_numpy(), xs["id"].to_numpy(), qs["tau"].to_numpy()
            for i in range(len(a)):
                pick = np.flatnonzero(xid != qid[i])
                slack, upper = 0.0, None
                if da.shape[1]:
                    # The largest |d(q,p) - d(x,p)| is a lower bound of d(q,x), and so bounds the inner product from above.
                    low = np.abs(db[pick] - da[i]).max(axis=1)
                    upper, slack = (na[i] + nb[pick] - low * low) / 2, 1e-6 * (1 + na[i] + nb.max())
                    alive = np.flatnonzero(upper + slack >= floor[i])
                    alive = alive[np.argsort(-upper[alive], kind="stable")]
                    pick, upper = pick[alive], upper[alive]
                best_s, best_x, at, step = np.zeros(0, kind), np.zeros(0, np.int64), 0, 512
                while at < len(pick):
                    if upper is not None and len(best_s) >= k and upper[at] + slack < best_s[k - 1]:
                        break  # no later bound can reach the k-th score
                    part = pick[at : at + step]
                    best_s, best_x = np.concatenate([best_s, b[part] @ a[i]]), np.concatenate([best_x, xid[part]])
                    top = np.lexsort((best_x, -best_s))[:k]
                    best_s, best_x, at, step = best_s[top], best_x[top], at + step, step * 2
                out["query"].append(np.full(len(best_x), qid[i]))
                out["id"].append(best_x)
                out["score"].append(best_s.astype(np.int64))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return searched


def exact_top_k(vectors: DataFrame, queries: str, k: int = 5, pivots: int = 16, query_block: int = 4096, point_block: int = 16384) -> DataFrame:
    """The k rows of highest inner product with each query among all rows (id, vec) of integer vectors: query, rank, id, score.

    ``queries`` is a condition on id. Scores are exact 64-bit integers, ties go to the smaller id, and a query's
    own id is no candidate. Vectors that are null or hold nulls, empty ones and null ids take no part, nor do those whose squared length
    reaches 2^62, as their scores could pass 64 bits; only vectors of one length meet. Rows repeating an id are candidates of their
    own; as queries they count once (first by vector). An empty table gives no rows; other columns are not looked at.

    Pivot-table elimination: distances of every point to fixed pivots are computed once and stored with it; for a query q and a
    point x the largest |d(q,p) - d(x,p)| is a lower bound of d(q,x), so (|q|^2 + |x|^2 - bound^2) / 2 bounds their
    inner product from above. Points lie in blocks by their nearest pivot, each with the range of its distances. Every query first
    searches one block of its own pivot, which gives it a k-th score to beat; it then visits only those other blocks whose
    range still allows that score, and there evaluates points in the order of their bounds until the next bound falls below its k-th
    score. Equal bounds are still evaluated, so results are exact whatever the bounds prune. A block of points moves once for each block of
    queries that visits it, and of each visit only k rows a query go on.
    """
    rows = vectors.where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").where(~F.exists("vec", lambda x: x.isNull()))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<long>").alias("vec"), F.size("vec").alias("dim"), norm.alias("norm")).where(F.col("norm") < 2.0**62)
    rows = stored(rows)
    points = stored(_with_distances(rows, _pivot_rows(rows, pivots)).withColumn("place", F.monotonically_increasing_id()))
    cut = lambda df, most: df.groupBy("dim", "home").agg(F.ceil(F.count("*") / most).cast("int").alias("subs"))
    # At most 16 x ``pivots`` pairs of length and pivot, and one for each further length.
    subs = stored(cut(points, point_block))
    few = subs.count()
    points = points.join(small_side(subs, few), ["dim", "home"]).withColumn("sub", F.pmod(F.xxhash64("id", "place"), F.col("subs")).cast("int"))
    q = points.where(queries).groupBy("id").agg(F.min_by(F.struct("vec", "dim", "norm", "dist", "home", "subs"), "vec").alias("q")).select("id", "q.*")
    q = stored(q)
    parts = cut(q, query_block) if q.count() > query_block else q.select("dim", "home", F.lit(0).alias("subs")).distinct()
    q = q.join(small_side(parts.withColumnRenamed("subs", "parts"), few), ["dim", "home"])
    q = q.withColumn("qb", F.when(F.col("parts") == 0, F.lit("all")).otherwise(F.concat_ws("-", "home", F.pmod(F.xxhash64("id"), F.greatest("parts", F.lit(1))))))

    def visited(visits: DataFrame) -> DataFrame:
        """Top rows of the queries (id, dim, qb, tau, vec, norm, dist) that visit point blocks (home, sub)."""
        pairs = visits.select("dim", "home", "sub", "qb").distinct()
        cols = ["id", "dim", "home", "sub", "qb", "vec", "norm", "dist"]
        x = points.join(pairs, ["dim", "home", "sub"]).select(F.lit(False).alias("query"), *cols, F.lit(0.0).alias("tau"))
        return visits.select(F.lit(True).alias("query"), *cols, "tau").unionByName(x).groupBy("dim", "home", "sub", "qb").applyInPandas(_search(k), "query long, id long, score long")

    first = q.withColumn("sub", F.pmod(F.xxhash64("qb"), F.col("subs")).cast("int")).withColumn("tau", F.lit(float("-inf")))
    near = stored(visited(first))
    tau = near.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("tau"))
    # Range of a block's distances to each pivot, and its longest vector.
    ranges = points.groupBy("dim", "home", "sub").agg(
        F.max("norm").alias("top"), F.array(*[F.min(F.get("dist", F.lit(i))) for i in range(pivots)]).alias("lo"), F.array(*[F.max(F.get("dist", F.lit(i))) for i in range(pivots)]).alias("hi")
    )
    ranges = stored(ranges)
    q = q.join(tau, "id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("-inf")))).withColumn("own", F.pmod(F.xxhash64("qb"), F.col("subs")).cast("int")).withColumnRenamed("home", "base")
    pairs = q.join(small_side(ranges, ranges.count()), "dim").where("NOT (home = base AND sub = own)")
    gap = F.zip_with(F.arrays_zip("lo", "hi"), "dist", lambda r, d: F.greatest(F.lit(0.0), r["lo"] - d, d - r["hi"]))
    low = F.coalesce(F.array_max(F.filter(gap, lambda g: g.isNotNull())), F.lit(0.0))
    bound = (F.col("norm") + F.col("top") - low * low) / 2 + 1e-6 * (1 + F.col("norm") + F.col("top"))
    found = near.union(visited(pairs.where(bound >= F.col("tau"))))
    best = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50, among all other vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable("embedding"))
    v = v.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    out = exact_top_k(v, "id % 50 = 0")
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLE_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
