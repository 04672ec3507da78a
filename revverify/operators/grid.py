"""Change regions on grids: cells that differ, tiles, coalesced regions, coverage by boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def vector_cells(embeddings: DataFrame, width: int = 8) -> DataFrame:
    """Cells (page_id, x, y, value) of vectors read as grids: 0 to 255 from absolute components."""
    c = embeddings.select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("at", "v"))
    return c.select("page_id", (F.col("at") % width).alias("x"), F.floor(F.col("at") / width).cast("int").alias("y"), F.least(F.lit(255), F.floor(F.abs(F.col("v").cast("double")) * 255)).cast("int").alias("value"))


def changed_cells(before: DataFrame, after: DataFrame, threshold: int) -> DataFrame:
    """AGG-23, cells: those whose values differ by more than the threshold (0 to 255), and those on one side only."""
    t = max(0, min(255, threshold))
    j = before.withColumnRenamed("value", "v").join(after.withColumnRenamed("value", "w"), ["page_id", "x", "y"], "full_outer")
    return j.where((F.abs(F.col("v") - F.col("w")) > t) | F.col("v").isNull() | F.col("w").isNull()).select("page_id", "x", "y")


def grid_change(before: DataFrame, after: DataFrame, threshold: int) -> DataFrame:
    """AGG-23: share of the common canvas that changed, for each page."""
    size = before.union(after).groupBy("page_id").agg(((F.max("x") + 1) * (F.max("y") + 1)).alias("area"))
    n = changed_cells(before, after, threshold).groupBy("page_id").agg(F.count("*").alias("n"))
    return size.join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("changed"), (F.coalesce("n", F.lit(0)) / F.col("area")).alias("ratio"))


def changed_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """AGG-24: tiles with a changed cell, and the bounds of the changed cells in them."""
    return cells.groupBy("page_id", F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def coalesce_tiles(tiles: DataFrame) -> DataFrame:
    """WIN-09: neighbours in a row merged, then spans of equal ends in rows that follow one another: regions (page_id, x0, y0, x1, y1) in tiles."""
    run = F.col("tx") - F.row_number().over(W.Window.partitionBy("page_id", "ty").orderBy("tx"))
    spans = tiles.withColumn("run", run).groupBy("page_id", "ty", "run").agg(F.min("tx").alias("x0"), (F.max("tx") + 1).alias("x1"))
    pile = F.col("ty") - F.row_number().over(W.Window.partitionBy("page_id", "x0", "x1").orderBy("ty"))
    return spans.withColumn("pile", pile).groupBy("page_id", "x0", "x1", "pile").agg(F.min("ty").alias("y0"), (F.max("ty") + 1).alias("y1")).select("page_id", "x0", "y0", "x1", "y1")


def weighted_change(pages: DataFrame) -> DataFrame:
    """AGG-07: area-weighted change of each pair (pair_id, ratio, area); a page without partner (null ratio) counts whole."""
    return pages.groupBy("pair_id").agg(F.try_divide(F.sum(F.coalesce("ratio", F.lit(1.0)) * F.col("area")), F.sum("area")).alias("ratio"))


def covered_by_union(changed: DataFrame, boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    """WIN-15: rectangles (pair_id, rect_id, x0, y0, x1, y1) with ``covered``: no part lies outside the union of the padded boxes (pair_id, x0 .. y1).

    Box edges cut the rectangle into slabs; a slab is covered when the boxes that span it leave no gap from top to bottom.
    """
    b = boxes.select("pair_id", (F.col("x0") - pad).alias("bx0"), (F.col("y0") - pad).alias("by0"), (F.col("x1") + pad).alias("bx1"), (F.col("y1") + pad).alias("by1"))
    j = changed.join(b, "pair_id").where("bx0 < x1 AND bx1 > x0 AND by0 < y1 AND by1 > y0")
    keys = ["pair_id", "rect_id"]
    cuts = changed.select(*keys, F.col("x0").alias("cut"), "x1").union(changed.select(*keys, F.col("x1"), "x1")).union(j.select(*keys, F.greatest("bx0", "x0"), "x1")).union(j.select(*keys, F.least("bx1", "x1"), "x1")).distinct()
    slabs = cuts.withColumn("next", F.lead("cut").over(W.Window.partitionBy(*keys).orderBy("cut"))).where("next IS NOT NULL").select(*keys, "cut", "next")
    over = slabs.join(j, keys).where("bx0 <= cut AND bx1 >= next").select(*keys, "cut", "y0", "y1", "by0", "by1")
    w = W.Window.partitionBy(*keys, "cut").orderBy("by0", "by1")
    top = F.coalesce(F.max("by1").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.col("y0"))
    full = over.withColumn("gap", F.col("by0") > top).groupBy(*keys, "cut", "y1").agg(F.max("gap").alias("gap"), F.max("by1").alias("low"), F.min("by0").alias("high"), F.min("y0").alias("y0"))
    good = full.where("NOT gap AND low >= y1 AND high <= y0").groupBy(*keys).agg(F.count("*").alias("good"))
    total = slabs.groupBy(*keys).agg(F.count("*").alias("total"))
    out = changed.join(total, keys, "left").join(good, keys, "left")
    flat = (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))
    return out.select(*changed.columns, (~flat & F.coalesce(F.col("good") == F.col("total"), F.lit(False))).alias("covered"))


def region_outcome(changed: DataFrame, expected: DataFrame, protected: DataFrame, pad: float) -> DataFrame:
    """RUL-16: fail for an overlap with a protected box, pass when the expected boxes cover the region, else review."""
    p = protected.select("pair_id", *[F.col(c).alias("p" + c) for c in ("x0", "y0", "x1", "y1")])
    hit = changed.join(p, "pair_id").where("px0 < x1 AND px1 > x0 AND py0 < y1 AND py1 > y0").select("pair_id", "rect_id", F.lit(True).alias("hit")).distinct()
    c = covered_by_union(changed, expected, pad).join(hit, ["pair_id", "rect_id"], "left")
    return c.withColumn("outcome", F.when(F.col("hit"), "fail").when(F.col("covered"), "pass").otherwise("review")).drop("hit", "covered")
