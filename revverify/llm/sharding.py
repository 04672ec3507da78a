"""Operator 6: dealing rows to shards of near equal bytes by histogram sort.

Rows are ordered by a 128-bit key: the hash of the text, then the hash of the doc_id. Each round counts the
exact bytes (and rows) below many candidate key boundaries over all partitions, then looks only between the two
candidates around each wanted splitter, with probes 2^10 times finer, until every splitter meets the
tolerance or the key's bits end. Only sums per probe reach the driver: at most 2^10 for each splitter. With the
splitters fixed, rows move once, to the bin of their shard in which they get their place.

Equal texts are neighbours in the key order, so a group of copies stays together unless a splitter must cut
through it; then the doc_id's hash cuts it, and a group larger than a shard is spread over several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import stored

_BITS = 10


def _prefix(level: int) -> tuple[str, int]:
    """Which half of the key a level refines, and how far that half is shifted. Each half has 64 bits: six levels of ten and one of four."""
    half, step = divmod(level, 7)
    return ("h1", "h2")[half], max(0, 64 - _BITS * (step + 1))


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Key bounds (h1, h2) that cut rows (h1, h2, size) into ``shards`` runs of near equal total size.

    Shard k holds the rows at or above bound k and below bound k + 1 (k from 1). The search of a splitter ends when
    a candidate's exact count is within ``tolerance`` of a shard's mean size from the wanted count.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = {k: total * k / shards for k in range(1, shards)}
    allowed, found = tolerance * total / shards, {}
    # An open splitter looks between candidates in one parent: what lies below it, and the prefix so far.
    parents: dict[tuple, tuple[int, list[int]]] = {(): (0, list(wanted))}
    for level in range(14):
        if not parents or not total:
            break
        half, shift = _prefix(level)
        now = rows.withColumn("probe", F.shiftright(half, shift))
        if level:
            up_half, up_shift = _prefix(level - 1)
            tests = [
                (F.col("h1") == p[0]) & (F.shiftright("h2", up_shift) == p[1]) if up_half == "h2" else (F.shiftright("h1", up_shift) == p[0])
                for p in parents
            ]
            label = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])
            now = now.withColumn("parent", label).where("parent IS NOT NULL")
        else:
            now = now.withColumn("parent", F.lit(0))
        sums: dict[int, list] = {}
        for x in now.groupBy("parent", "probe").agg(F.sum("size").alias("s")).collect():
            sums.setdefault(x["parent"], []).append((x["probe"], x["s"]))
        after: dict[tuple, tuple[int, list[int]]] = {}
        for i, (parent, (below, open_)) in enumerate(parents.items()):
            for k in open_:
                at, best, last = below, None, None
                for probe, s in sorted(sums[i]):
                    bound = (probe << shift, -(1 << 63)) if half == "h1" else (parent[0], probe << shift)
                    if best is None or abs(at - wanted[k]) < best[0]:
                        best = (abs(at - wanted[k]), bound)
                    if at <= wanted[k]:
                        last = (probe, at, s)
                    at += s
                probe, start, s = last if last else (min(sums[i])[0], below, 0)
                found[k] = min(found.get(k, best), best)
                if found[k][0] > allowed and s:
                    child = (probe,) if half == "h1" else (parent[0], probe)
                    after.setdefault(child, (start, []))[1].append(k)
        parents = after
    low = (-(1 << 63), -(1 << 63))
    return sorted(found[k][1] if k in found else low for k in wanted)


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.005) -> DataFrame:
    """Shard and place of each row (doc_id, text): doc_id, size, text_crc32, shard, slot.

    size: the text's UTF-8 bytes (none for a null) plus 8. Shards' total sizes differ from their mean by the tolerance
    plus at most one row. slot numbers a shard's rows from 0 without gaps. Rows that agree in doc_id and
    text stay in one shard; null ids and texts are ordinary values. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("h1"),
            F.xxhash64(F.col("doc_id"), F.lit(6)).alias("h2"),
        )
    )
    bounds = splitters(rows, shards, tolerance)
    shard = F.lit(0)
    for a, b in bounds:
        shard = shard + F.when((F.col("h1") > F.lit(a)) | ((F.col("h1") == F.lit(a)) & (F.col("h2") >= F.lit(b))), 1).otherwise(0)
    # A shard's rows are numbered bin by bin, so that no task sorts a whole shard; bins follow the number of rows.
    n = rows.count()
    bins = max(1, n // shards // 20_000)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn("bin", F.pmod(F.xxhash64("h1", "h2"), F.lit(bins)))
    before = dealt.groupBy("shard", "bin").agg(F.count("*").alias("c"))
    run = W.Window.partitionBy("shard").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)
    before = before.select("shard", "bin", F.coalesce(F.sum("c").over(run), F.lit(0)).alias("base"))
    place = F.row_number().over(W.Window.partitionBy("shard", "bin").orderBy("h1", "h2", "doc_id"))
    out = dealt.withColumn("k", place).join(before, ["shard", "bin"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id") -> None:
    """Write whole rows as one Parquet folder for each shard, rows ordered by slot within their files. doc_id must be unique."""
    placed = histogram_shards(docs.select(F.col(key).alias("doc_id"), "text"), shards).select(F.col("doc_id").alias(key), "shard", "slot")
    docs.join(placed, key).repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = histogram_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
