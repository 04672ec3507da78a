"""Operator 9 [native]: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. *Targets.* Each source gets a target of words: shares of the budget by weight, no share above ``repeats`` times the source's
   own words, the excess reshared by weight (water filling, in closed form over the sorted ratios).
2. *Blocks.* A source's documents fall into blocks by a keyed hash, about ``block_rows`` documents each, with exact word counts.
3. *Quotas.* A source takes part with whole passes over its blocks and one partial pass: its blocks in a permuted order, as far as
   their words stay within what is left of the target, the next block only in part. Each block of a pass is a ticket.
4. *Splitting tree.* The set of output shards is halved again and again. At each node the tickets of all sources are drawn without
   replacement and the left half's exact share goes left, so the numbers of tickets by source that go left are multivariate
   hypergeometric, and every source's quota is met exactly by the shards together.
5. A shard's tickets of a source stand for disjoint permuted blocks; their documents go to the shard and are ordered there by a keyed
   hash (local shuffle). What a document gives to the mix is what the tree dealt of its block, nothing else.

Everything is DataFrame expressions. Ranks and running sums over sources, tickets and documents are taken bin by bin, and the bins'
totals are added up in a second step, so no task holds all rows of a source or all tickets of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import small_side, stored

WORD = r"[^\x20\x09-\x0D]+"
_BEFORE = (W.Window.unboundedPreceding, -1)


def keyed(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def running(df: DataFrame, keys: list[str], order: list[str], value: str | None = None, bits: int = 10) -> DataFrame:
    """df with ``rank`` (from 1) and, of ``value``, ``below`` (the sum of all rows before) within keys, in the order of a hash and ties (order).

    Rows meet in bins of the hash's first bits only; the bins' totals are at most 2^bits rows a key.
    """
    v = F.col(value) if value else F.lit(1)
    d = df.withColumn("_bin", F.shiftright(order[0], 64 - bits))
    by = W.Window.partitionBy(*keys, "_bin").orderBy(*order)
    d = d.withColumn("_k", F.row_number().over(by)).withColumn("_s", F.coalesce(F.sum(v).over(by.rowsBetween(*_BEFORE)), F.lit(0)))
    bins = df.groupBy(*keys, F.shiftright(order[0], 64 - bits).alias("_bin")).agg(F.count("*").alias("_n"), F.sum(v).alias("_v"))
    up = W.Window.partitionBy(*keys).orderBy("_bin").rowsBetween(*_BEFORE)
    names = [f"_{k}" for k in [*keys, "bin"]]
    bins = bins.select(*[F.col(k).alias(n) for k, n in zip([*keys, "_bin"], names, strict=True)], F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(up), F.lit(0)).alias("_v0"))
    bins = bins.withColumnsRenamed({n: n + "_" for n in names})
    on = None
    for k, n in zip([*keys, "_bin"], names, strict=True):
        on = same(d[k], bins[n + "_"]) if on is None else on & same(d[k], bins[n + "_"])
    out = d.join(bins, on)
    return out.select(*df.columns, (F.col("_k") + F.col("_n0")).alias("rank"), *([(F.col("_s") + F.col("_v0")).alias("below")] if value else []))


def _in_order(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with ``rank`` from 1 and ``<sum>_before`` of each of ``sums`` in the whole table's order: range parts, then the parts' totals."""
    d = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    by = W.Window.partitionBy("_part").orderBy(*order)
    first = lambda c: F.coalesce(F.sum(c).over(by.rowsBetween(*_BEFORE)), F.lit(0.0))
    here = d.withColumn("_k", F.row_number().over(by)).withColumns({f"_{c}": first(c) for c in sums})
    up = W.Window.orderBy("_part").rowsBetween(*_BEFORE)  # one row a partition
    parts = d.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{c}").over(up), F.lit(0.0)).alias(f"_b_{c}") for c in sums])
    return here.join(parts, "_part").select(*df.columns, (F.col("_k") + F.col("_n0")).alias("rank"), *[(F.col(f"_{c}") + F.col(f"_b_{c}")).alias(f"{c}_before") for c in sums])


def source_targets(sizes: DataFrame, weights: list[int], share: float, repeats: float) -> DataFrame:
    """target of each row (source, source_size): weights repeat over the sources in code point order, null last."""
    t = _in_order(sizes, [F.col("source").asc_nulls_last()], [])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = t.withColumn("weight", w).drop("rank").withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_ = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("words"), F.coalesce(F.sum("weight"), F.lit(1.0)).alias("weights"))
    t = _in_order(t, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], ["cap", "weight"]).join(F.broadcast(all_))  # one row
    level = (F.col("words") * float(share) - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    # The first source, by ratio, that its share does not fill sets the level for itself and all after it.
    t = stored(t.withColumn("level", level))
    final = t.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "rank").alias("final"))
    t = t.join(F.broadcast(final))  # one row
    return t.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def split_tree(tickets: DataFrame, keys: list[str], shards: int, seed: int) -> DataFrame:
    """shard of each ticket (keys): at every node of the tree exact draws without replacement, from the root down."""
    t = tickets.select(*keys, F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    spans, depth = [(0, shards)], 0
    while any(b - a > 1 for a, b in spans):
        spans = [(x, y) for a, b in spans for x, y in ([(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)])]
        t = t.withColumn("draw", keyed(seed + 1 + depth, *keys))
        counts = t.groupBy("lo", "hi").agg(F.count("*").alias("n"))  # one row a node
        t = running(t, ["lo", "hi"], ["draw", *keys]).join(F.broadcast(counts), ["lo", "hi"])
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        # The left child's share of the node's tickets, rounded to the nearest whole one.
        left = F.floor(F.col("n") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5)
        open_ = F.col("hi") - F.col("lo") > 1
        go = F.col("rank") <= left
        t = stored(t.select(*keys, F.when(open_ & ~go, mid).otherwise(F.col("lo")).alias("lo"), F.when(open_ & go, mid).otherwise(F.col("hi")).alias("hi")))
        depth += 1
    return t.select(*keys, F.col("lo").alias("shard"))


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _identity(seed: int) -> Column:
    """Hash of all that tells one row from another; equal rows share it."""
    text = F.col("text").cast("string")
    return keyed(seed, F.col("doc_id"), F.col("source").cast("string"), text, text.isNull())


def _numbered(rows: DataFrame) -> DataFrame:
    """h for each row: its identity's hash, and for rows that repeat an identity, however many, hashes of their own by occurrence."""
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    many = rows.groupBy("same").agg(F.count("*").alias("c")).where("c > 1").select("same")
    n = many.count()
    if not n:
        return rows.withColumn("h", F.col("same")).withColumn("nth", F.lit(1).cast("long"))
    many = small_side(many, n)
    alone = rows.join(many, "same", "left_anti").withColumn("nth", F.lit(1).cast("long"))
    again = running(rows.join(many, "same", "left_semi").withColumn("spread", F.xxhash64("at")), ["same"], ["spread", "at"]).withColumn("nth", F.col("rank").cast("long"))
    both = alone.unionByName(again.select(*rows.columns, "nth"))
    return stored(both.withColumn("h", F.when(F.col("nth") == 1, F.col("same")).otherwise(F.xxhash64("same", "nth"))))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, shards: int = 16, block_rows: int = 2048, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, targets): rows (doc_id, source, size, same, nth, block, part, shards), one for each row of docs, and targets (source, source_size, target).

    ``shards`` holds the shard of each copy that the tree dealt.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _identity(seed).alias("same"))
    rows = _numbered(rows)
    per = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    per = stored(per.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long")))
    targets = source_targets(per.select("source", "source_size"), list(weights), share, repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    plan = targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = stored(plan.withColumnRenamed("source", "s").join(per.select(F.col("source").alias("s2"), "blocks"), same(F.col("s"), F.col("s2"))).drop("s2"))
    n = plan.count()
    # The block of a row: its hash's upper 31 bits as a fraction of the source's blocks.
    count = small_side(per.select(F.col("source").alias("s"), F.col("blocks").alias("b")), n)
    rows = stored(rows.join(count, same(rows["source"], count["s"])).withColumn("block", F.shiftrightunsigned(F.shiftrightunsigned("h", 33) * F.col("b"), 31)).drop("s", "b", "at"))
    words = stored(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    # The permuted order of a source's blocks, and how far the partial pass goes in it.
    order = stored(running(words.withColumn("draw", keyed(seed, "source", "block")), ["source"], ["draw", "block"], "words"))
    order = order.join(small_side(plan, n), same(order["source"], F.col("s"))).drop("s")
    part = F.when(F.col("below") >= F.col("rest"), 0.0).otherwise(F.least(F.lit(1.0), (F.col("rest") - F.col("below")) / F.greatest(F.col("words"), F.lit(1))))
    order = stored(order.select("source", "block", "words", "passes", F.when(F.col("rest") > 0, part).otherwise(0.0).alias("part"), (F.col("rest") - F.col("below")).alias("left")))
    # A ticket for each block of each pass; the partial pass has those blocks of which something is taken.
    tickets = order.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).where((F.col("pass") <= F.col("passes")) | ((F.col("pass") == F.col("passes") + 1) & (F.col("part") > 0)))
    dealt = split_tree(tickets.select("source", "pass", "block"), ["source", "pass", "block"], shards, seed)
    dealt = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("all"))  # at most ``repeats`` a block
    dealt = dealt.select(F.col("source").alias("s"), F.col("block").alias("b"), F.transform("all", lambda x: x["shard"]).alias("all"))
    per_block = order.join(dealt, same(order["source"], F.col("s")) & (order["block"] == F.col("b"))).select(F.col("source").alias("s"), F.col("block").alias("b"), "passes", "part", "left", "all")
    per_block = stored(per_block)
    # Within a block taken in part the documents go by hash, up to the one that brings the words nearest to what is left.
    m = per_block.count()
    cut = per_block.where("part > 0 AND part < 1").select("s", "b", "left")
    cut = small_side(cut, n)
    inside = rows.join(cut, same(rows["source"], cut["s"]) & (rows["block"] == cut["b"])).drop("s", "b")
    inside = running(inside.withColumn("turn", F.xxhash64("h")), ["source", "block"], ["turn", "h"], "size", bits=4)
    inside = stored(inside.where(F.col("below") + F.col("size") / 2.0 < F.col("left")).select("same", "nth", F.lit(True).alias("within")))
    out = rows.join(small_side(per_block, m), same(rows["source"], F.col("s")) & (rows["block"] == F.col("b")), "left").drop("s", "b")
    out = out.join(small_side(inside, inside.count()), ["same", "nth"], "left")
    copies = F.coalesce(F.col("passes") + F.when((F.col("part") >= 1) | F.coalesce("within", F.lit(False)), 1).otherwise(0), F.lit(0))
    none = F.array().cast("array<int>")
    got = F.when(copies > 0, F.slice(F.coalesce("all", none), F.lit(1), F.greatest(copies, F.lit(1)))).otherwise(none)
    return out.select("doc_id", "source", "size", "same", "nth", got.alias("shards")), plan.select(F.col("s").alias("source"), "source_size", "target")


def mix(docs: DataFrame, **how) -> DataFrame:
    """What the mix takes of each row (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken, shards.

    size: words of the text (null: 0); copies: how often the mix holds the row (0 to ``repeats``); taken = copies x size;
    shards: an array with one output shard for each copy. A source's taken words differ from its target by at most half of
    one document. Sources without words get nothing; null is a source; an empty table gives no rows; texts are counted whole, whatever
    their length; other columns are not looked at. Rows that repeat are rows of their own, told apart by a running number, so a group of equal
    rows is cut where the target demands it. The draw depends on doc_id, source, text, number and seed alone, so
    runs agree, whatever the partitions.
    """
    rows, targets = plan_mix(docs, **how)
    targets = targets.withColumnRenamed("source", "s")
    out = rows.join(small_side(targets, targets.count()), same(rows["source"], F.col("s"))).withColumn("copies", F.size("shards"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 3, 1, 2 repeating, 150% of all words, no source above twice its words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def mixed_documents(docs: DataFrame, seed: int = 9, shards: int = 16, rows_a_task: int = 50_000, **how) -> DataFrame:
    """docs as the mix holds them: a row for each copy that the tree dealt, with the columns of docs, in the tree's shards.

    Each shard is one run of partitions; in it the copies stand in the order of a keyed hash (the local shuffle).
    """
    names = docs.columns
    rows, _ = plan_mix(docs, seed=seed, shards=shards, **how)
    dealt = rows.where(F.size("shards") > 0).select("same", "nth", "shards")
    n = dealt.count()
    copies = dealt.agg(F.sum(F.size("shards"))).first()[0] or 0
    own = docs.select(F.struct(*names).alias("row"), _identity(seed).alias("same"))
    again = rows.where("nth > 1").select("same").distinct()
    c = again.count()
    if c:  # rows that repeat, by their other columns, take the numbers of their identity
        again = small_side(again, c)
        several = stored(own.join(again, "same", "left_semi").withColumn("spread", F.xxhash64(F.to_json("row"))).withColumn("at", F.monotonically_increasing_id()))
        several = running(several, ["same"], ["spread", "at"]).select("row", "same", F.col("rank").cast("long").alias("nth"))
        own = own.join(again, "same", "left_anti").withColumn("nth", F.lit(1).cast("long")).unionByName(several)
    else:
        own = own.withColumn("nth", F.lit(1).cast("long"))
    out = own.join(small_side(dealt, n), ["same", "nth"]).select("row", "same", "nth", F.posexplode("shards").alias("copy", "shard"))
    bins = max(1, -(-copies // (shards * rows_a_task)))
    out = out.withColumn("place", keyed(seed, "same", "nth", "copy")).withColumn("bin", F.shiftright("place", 40) % bins)
    return out.repartition(shards * bins, "shard", "bin").sortWithinPartitions("shard", "place").select("row.*").toDF(*names)
