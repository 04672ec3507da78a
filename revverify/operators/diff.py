"""Two-sided comparison: clause pairing, facts, multiset differences, block differences."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import pairwise
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.text import ASCII, fp, norm, normalized, stable_id
from ..plans.materialize import kept


def _unique_pairs(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(pair_id, b, a, same_fp, same_path): clause numbers paired by a key that is unique on both sides, and whether the clauses' fingerprints and paths are equal."""

    def one(df: DataFrame, name: str) -> DataFrame:
        df = df.select("pair_id", key, F.col("clause_no").alias(name), F.unhex("fp").alias("fp_" + name), F.col("ancestor_path").alias("path_" + name))
        return df.withColumn("c", F.count("*").over(W.Window.partitionBy("pair_id", key))).where("c = 1").drop("c")

    return one(before, "b").join(one(after, "a"), ["pair_id", key]).select("pair_id", "b", "a", (F.col("fp_b") == F.col("fp_a")).alias("same_fp"), (F.col("path_b") == F.col("path_a")).alias("same_path"))


def matched_clauses(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JN-01, JN-02: pairs as ``_unique_pairs``, and each side's clauses without identity partner: what later steps ask of paired clauses goes with the pairs, so both sides are joined once."""
    ident = F.unhex(F.sha2(F.to_json(F.struct(F.lower("label").alias("l"), F.transform("ancestor_path", lambda x: F.lower(x)).alias("p"), F.lower("heading").alias("h"))), 256))
    before, after = before.withColumn("ident", ident), after.withColumn("ident", ident)
    first = kept(_unique_pairs(before, after, "ident"))
    cols = ["pair_id", "clause_no", "label", "ancestor_path", "heading", "fp"]
    rest = lambda df, name: kept(df.select(*cols).join(first.select("pair_id", F.col(name).alias("clause_no")), ["pair_id", "clause_no"], "left_anti"))
    rest_b, rest_a = rest(before, "b"), rest(after, "a")
    return first.union(kept(_unique_pairs(rest_b, rest_a, "fp"))), rest_b, rest_a


def _asked(rows: DataFrame, edits: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """The rows (pair_id, b, a: clauses) with what edits (pair_id, before) and rules (pair_id, label) of their pair look for, and the tests that tell what these can find."""
    tests = []
    if edits is not None:
        rows = rows.join(edits.groupBy("pair_id").agg(F.collect_set("before").alias("befores")), "pair_id", "left")
        tests.append(F.exists("befores", lambda x: F.contains(F.col("b.text"), x)))
    if labels is not None:
        # A label that is not ASCII may be equal to any other after its normalization, which is done later.
        plain = labels.groupBy("pair_id").agg(F.collect_set(norm(F.col("label"))).alias("labels"), F.max(~F.col("label").rlike(ASCII)).alias("any_label"))
        rows = rows.join(plain, "pair_id", "left")
        tests += [F.col("any_label") | F.array_contains("labels", norm(c)) | (F.col("labels").isNotNull() & ~c.rlike(ASCII)) for c in (F.col("b.label"), F.col("a.label"))]
    return rows, [F.coalesce(t, F.lit(False)) for t in tests]


def matched_sides(clauses: DataFrame, edits: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame, DataFrame, DataFrame]:
    """JN-01, JN-02 of both sides' clauses (pair_id, side, clause_no, label, heading, ancestor_path, text) in one table: pairs and clauses without partner as ``matched_clauses``, each side's clauses, the pairs' ids (those with a baseline).

    Most clauses are equal and stand where they stood, so no change, value or rule is told by them. Those go as soon as they are paired, before anything is written or exchanged: what is returned holds
    the clauses that differ, have no partner, hold a text of edits (pair_id, before) or have a label of rules (pair_id, label), and all clauses of pairs whose order may have changed.
    """
    row = F.struct("clause_no", "label", "heading", "ancestor_path", "text")
    ident = F.to_json(F.struct(F.lower("label").alias("l"), F.transform("ancestor_path", lambda x: F.lower(x)).alias("p"), F.lower("heading").alias("h")))
    g = clauses.withColumn("ident", ident).groupBy("pair_id", "ident").agg(F.collect_list(F.when(F.col("side") == 0, row)).alias("bs"), F.collect_list(F.when(F.col("side") == 1, row)).alias("as"))
    kind = dict(g.dtypes)["bs"].removeprefix("array<").removesuffix(">")
    both = lambda b, a: F.struct((F.lit(None) if b is None else b).cast(kind).alias("b"), (F.lit(None) if a is None else a).cast(kind).alias("a"))
    once = (F.size("bs") == 1) & (F.size("as") == 1)
    rows = F.when(once, F.array(both(F.get("bs", F.lit(0)), F.get("as", F.lit(0))))).otherwise(F.concat(F.transform("bs", lambda x: both(x, None)), F.transform("as", lambda x: both(None, x))))
    p = g.select("pair_id", F.explode(rows).alias("x")).select("pair_id", "x.*")
    p, tests = _asked(p, edits, labels)
    b, a = F.col("b"), F.col("a")
    needed = reduce(or_, tests, b.isNull() | a.isNull() | F.coalesce(b["text"] != a["text"], F.lit(True)))
    p = p.select("pair_id", b["clause_no"].alias("b_no"), a["clause_no"].alias("a_no"), F.coalesce(b["ancestor_path"] == a["ancestor_path"], F.lit(False)).alias("same_path"), F.coalesce(b["text"] == a["text"], F.lit(False)).alias("same_text"), needed.alias("needed"), "b", "a")
    p = p.withColumn("b", F.when(F.col("needed"), b)).withColumn("a", F.when(F.col("needed"), a))
    order, whole = W.Window.partitionBy("pair_id").orderBy(F.col("b_no").asc_nulls_last()), W.Window.partitionBy("pair_id")
    p = p.withColumn("first", F.row_number().over(order) == 1).withColumn("back", F.col("b_no").isNotNull() & (F.col("a_no") < F.max("a_no").over(order.rowsBetween(W.Window.unboundedPreceding, -1))))
    # Fingerprints can pair what is left on both sides; that, and pairs that cross, may change the ranks of all.
    open_ = (F.max(F.coalesce("back", F.lit(False))).over(whole)) | (F.max(F.col("a_no").isNull()).over(whole) & F.max(F.col("b_no").isNull()).over(whole))
    k = kept(p.withColumn("open", open_).where("needed OR first OR open OR NOT same_path").select("pair_id", "b_no", "a_no", "same_path", "same_text", "b", "a"))

    same_fp = F.when(F.col("same_text"), F.lit(True)).otherwise(normalized(F.col("b.text")) == normalized(F.col("a.text")))
    first = kept(k.where("b_no IS NOT NULL AND a_no IS NOT NULL").select("pair_id", F.col("b_no").alias("b"), F.col("a_no").alias("a"), same_fp.alias("same_fp"), "same_path"))
    cols = ["pair_id", "clause_no", "label", "ancestor_path", "heading", "fp"]
    rest = lambda s, other: kept(k.where(f"{other}_no IS NULL").select("pair_id", f"{s}.*").withColumn("fp", fp(normalized(F.col("text")))).select(*cols))
    rest_b, rest_a = rest("b", "a"), rest("a", "b")
    side = lambda s: k.where(f"{s} IS NOT NULL").select("pair_id", f"{s}.*")
    return (first.union(kept(_unique_pairs(rest_b, rest_a, "fp"))), rest_b, rest_a), side("b"), side("a"), k.where("b_no IS NOT NULL").select("pair_id").distinct()


def pair_clauses(before: DataFrame, after: DataFrame) -> DataFrame:
    """JN-01, JN-02: pairs of clauses (pair_id, clause_no, label, ancestor_path, heading, fp): unique identity first, then fingerprint unique among the rest."""
    return matched_clauses(before, after)[0].select("pair_id", "b", "a")


def clause_changes(before: DataFrame, after: DataFrame, matched: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """WIN-05, SET-03: a row for each changed clause: pair_id, kind (added, removed, modified, moved, unresolved), b, a, change_id.

    modified hides moved. A clause without partner is unresolved when its identity or fingerprint is left without partner on both sides.
    """
    pairs, rest_b, rest_a = matched_clauses(before, after) if matched is None else matched
    rank = lambda c: F.row_number().over(W.Window.partitionBy("pair_id").orderBy(c))
    p = pairs.withColumn("rb", rank("b")).withColumn("ra", rank("a"))
    kind = F.when(~F.col("same_fp"), "modified").when(~F.col("same_path") | (F.col("rb") != F.col("ra")), "moved")
    changed = p.withColumn("kind", kind).where("kind IS NOT NULL").select("pair_id", "kind", "b", "a")

    def alone(df: DataFrame, name: str) -> DataFrame:
        ident = F.concat_ws("\0", F.lower("label"), F.array_join(F.transform("ancestor_path", lambda x: F.lower(x)), "\1"), F.lower("heading"))
        return df.join(pairs.select("pair_id", F.col(name).alias("clause_no")), ["pair_id", "clause_no"], "left_anti").select("pair_id", "clause_no", "fp", ident.alias("ident"))

    lb, la = alone(rest_b, "b"), alone(rest_a, "a")

    def side(df: DataFrame, other: DataFrame, name: str, kind: str) -> DataFrame:
        tied = lambda k: other.select("pair_id", F.col(k), F.lit(True).alias("tie_" + k)).distinct()
        df = df.join(tied("ident"), ["pair_id", "ident"], "left").join(tied("fp"), ["pair_id", "fp"], "left")
        k = F.when(F.coalesce("tie_ident", "tie_fp", F.lit(False)), "unresolved").otherwise(kind)
        none = F.lit(None).cast("int")
        return df.select("pair_id", k.alias("kind"), (F.col("clause_no") if name == "b" else none).alias("b"), (F.col("clause_no") if name == "a" else none).alias("a"))

    out = changed.union(side(lb, la, "b", "removed")).union(side(la, lb, "a", "added"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return out.withColumn("change_id", stable_id("fact", F.col("pair_id").cast("string"), F.col("kind"), part("b"), part("a")))


def changes_of_sides(matched: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``clause_changes`` of what ``matched_sides`` has paired: pairs that are left out there are in order, so ranks among the others tell the same moves."""
    return clause_changes(*matched[1:], matched)


def change_summary(changes: DataFrame) -> DataFrame:
    """AGG-01: counts by kind of each pair."""
    kinds = ("added", "removed", "modified", "moved", "unresolved")
    return changes.groupBy("pair_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count("*").alias("total"))


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """SET-05: rows of one side beyond the other's, counting repeats: keys and side (removed, added)."""
    count = lambda df, s: df.groupBy(*keys).agg(F.sum(F.lit(s)).alias("n"))
    n = count(before, 1).union(count(after, -1)).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    return n.select(*keys, F.when(F.col("n") > 0, "removed").otherwise("added").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("k")).drop("k")


def entity_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-04: entity changes of paired clauses (pair_id, b, kind, value on each side): residuals of one kind that are one on each side make one change row."""
    d = multiset_diff(before.select("pair_id", "b", "kind", "value"), after.select("pair_id", "b", "kind", "value"), ["pair_id", "b", "kind", "value"])
    c = W.Window.partitionBy("pair_id", "b", "kind")
    d = d.withColumn("gone", F.count_if(F.col("side") == "removed").over(c)).withColumn("new", F.count_if(F.col("side") == "added").over(c))
    single = d.where("gone = 1 AND new = 1").groupBy("pair_id", "b", "kind").agg(F.max(F.when(F.col("side") == "removed", F.col("value"))).alias("before"), F.max(F.when(F.col("side") == "added", F.col("value"))).alias("after"))
    rest = d.where("NOT (gone = 1 AND new = 1)")
    return single.union(rest.select("pair_id", "b", "kind", F.when(F.col("side") == "removed", F.col("value")).alias("before"), F.when(F.col("side") == "added", F.col("value")).alias("after")))


def facts_equal(given: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """SET-07: pair_id and whether both tables hold the same rows as multisets."""
    diff = multiset_diff(given.select("pair_id", *keys), recomputed.select("pair_id", *keys), ["pair_id", *keys]).select("pair_id", F.lit(False).alias("bad")).distinct()
    pairs = given.select("pair_id").union(recomputed.select("pair_id")).distinct()
    return pairs.join(diff, "pair_id", "left").select("pair_id", F.col("bad").isNull().alias("equal"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _longest_rising(values: pa.Array) -> pa.Array:
    """Of each list the places of its longest rising part (patience)."""
    return pa.array([None if v is None else _rising(v) for v in values.to_pylist()], pa.list_(pa.int32()))


def _rising(values: list) -> list[int]:
    if all(x < y for x, y in pairwise(values)):
        return list(range(len(values)))
    tails, at, prev = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        prev.append(at[k - 1] if k else -1)
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    keep, i = [], at[-1]
    while i >= 0:
        keep.append(i)
        i = prev[i]
    return keep[::-1]


def in_order_anchors(matched: DataFrame) -> DataFrame:
    """UDF-02: of matched blocks (pair_id, b, a) the longest subset in order on both sides (patience; one pair's matches in a list, many lists in a batch)."""
    rows = matched.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("b", "a"))).alias("m"))
    rows = rows.withColumn("at", _longest_rising(F.transform("m", lambda x: x["a"].cast("long"))))
    return rows.select("pair_id", F.inline(F.transform("at", lambda i: F.get("m", i)))).select(*matched.columns)


def block_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-01, SET-02: changes of blocks (pair_id, ordinal, key): added, removed, and moved for a key gone and new exactly once.

    Blocks match by key and occurrence. Pairs whose matches are all in order need no more; only the others go through the in-order subset.
    """
    occ = F.row_number().over(W.Window.partitionBy("pair_id", "key").orderBy("ordinal"))
    b = before.withColumn("occ", occ).select("pair_id", "key", "occ", F.col("ordinal").alias("b"))
    a = after.withColumn("occ", occ).select("pair_id", "key", "occ", F.col("ordinal").alias("a"))
    b, a = kept(b), kept(a)
    m = kept(b.join(a, ["pair_id", "key", "occ"]).select("pair_id", "b", "a"))
    back = m.withColumn("back", F.col("a") < F.lag("a").over(W.Window.partitionBy("pair_id").orderBy("b")))
    out_of_order = back.where("back").select("pair_id").distinct()
    matched = m.join(out_of_order, "pair_id", "left_anti").union(in_order_anchors(m.join(out_of_order, "pair_id", "left_semi")))
    matched = kept(matched)
    gone = b.join(matched, ["pair_id", "b"], "left_anti").select("pair_id", "key", "b")
    new = a.join(matched, ["pair_id", "a"], "left_anti").select("pair_id", "key", "a")
    once = lambda df: df.withColumn("c", F.count("*").over(W.Window.partitionBy("pair_id", "key"))).where("c = 1").drop("c")
    moved = once(gone).join(once(new), ["pair_id", "key"])
    left = lambda df: df.join(moved.select("pair_id", "key"), ["pair_id", "key"], "left_anti")
    none = F.lit(None).cast("int")
    parts = [moved.select("pair_id", F.lit("moved").alias("kind"), "key", "b", "a"), left(gone).select("pair_id", F.lit("removed"), "key", "b", none.alias("a")), left(new).select("pair_id", F.lit("added"), "key", none.alias("b"), "a")]
    return reduce(DataFrame.union, parts)


def _tied_pairs(left: DataFrame) -> DataFrame:
    """Pairs within runs of equal similarity: where some b and some a are each other's best, all with all and with nobody else, the k-th b has the k-th a."""
    by = lambda *k: W.Window.partitionBy("g", *k)
    top = lambda k: F.col("similarity").eqNullSafe(F.max("similarity").over(by(k)))
    t = left.withColumn("top_b", top("b")).withColumn("top_a", top("a"))
    t = t.withColumn("n_b", F.count_if("top_b").over(by("b"))).withColumn("n_a", F.count_if("top_a").over(by("a"))).where("top_b AND top_a")
    t = t.withColumn("first_a", F.min("a").over(by("b"))).withColumn("first_b", F.min("b").over(by("a")))
    run = by("first_a", "first_b", "similarity")
    t = t.withColumn("k_b", F.dense_rank().over(run.orderBy("b"))).withColumn("k_a", F.dense_rank().over(run.orderBy("a")))
    bs, as_ = F.max("k_b").over(run), F.max("k_a").over(run)
    closed = (F.min("n_b").over(run) == as_) & (F.max("n_b").over(run) == as_) & (F.min("n_a").over(run) == bs) & (F.max("n_a").over(run) == bs)
    t = t.withColumn("whole", closed & (F.count("*").over(run) == bs.cast("long") * as_))
    return t.where("whole AND k_b = k_a").select("g", "b", "a", "similarity")


def greedy_pair(cands: DataFrame) -> DataFrame:
    """JN-12: one-to-one pairs (g, b, a) of candidates (g, b, a, similarity), best first by (-similarity, b, a): rounds of mutual bests, each one relational, until no candidate is left.

    Runs of ties take one round. A repeated (g, b, a) counts with its best similarity; a candidate without b or a is none.
    """
    left = kept(cands.where("b IS NOT NULL AND a IS NOT NULL").groupBy("g", "b", "a").agg(F.max("similarity").alias("similarity")))
    out: list[DataFrame] = []
    while left.take(1):
        order = [F.col("similarity").desc(), F.col("b"), F.col("a")]
        best = lambda k: F.row_number().over(W.Window.partitionBy("g", k).orderBy(*order))
        won = left.withColumn("x", best("b")).withColumn("y", best("a")).where("x = 1 AND y = 1").select("g", "b", "a", "similarity")
        won = kept(won.union(_tied_pairs(left)).distinct())
        out.append(won)
        for k in ("b", "a"):
            gone = won.select(F.col("g").alias("g_"), F.col(k).alias("k_"))
            left = left.join(gone, F.col("g").eqNullSafe(F.col("g_")) & (F.col(k) == F.col("k_")), "left_anti")
        left = kept(left)
    return reduce(DataFrame.union, out) if out else left.select("g", "b", "a", "similarity")
