"""Links between the blocks of a document and those of its rendering: a similarity join with mutual uniqueness."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ratio_bound, ratio_from
from ..plans.materialize import kept
from ..sources.corpus import spread

#: Least similarity of a link, in hundredths (fixed value), and signs of a gram.
LEAST, GRAM = 98, 3


def _edits(length: Column, least: int) -> Column:
    """The most signs that can differ between a text of that length and one similar to it: of both together 100 - least in a hundred, the other at most (200 - least) / least as long."""
    return F.floor(2 * (100 - least) * length / least).cast("int")


def gram_keys(text: str) -> np.ndarray:
    """The grams of a text as 64-bit keys, repeats told apart by their number. Grams that share a key only bring more texts together, which are compared afterwards."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(signs) - GRAM + 1, 0)
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = grams << np.uint64(21) | signs[i : i + n]  # 21 bits a sign
    grams.sort()
    new = np.r_[True, grams[1:] != grams[:-1]] if n else np.zeros(0, bool)
    at = np.arange(n, dtype=np.uint64)
    occ = at - np.maximum.accumulate(np.where(new, at, np.uint64(0))) if n else at
    keys = (grams ^ (occ * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def rare_keys(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """Of each text of a document the rarest grams in that document, one more than its edits can destroy."""
    out, inner, outer = [], [0], [0]
    for i in range(len(texts)):
        keys = [gram_keys(t or "") for t in texts[i].as_py()]
        all_, often = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        for own, n in zip(keys, edits[i].as_py(), strict=True):
            rare = own[np.lexsort((own, often[np.searchsorted(all_, own)]))[: GRAM * n + 1]]
            out.append(rare)
            inner.append(inner[-1] + len(rare))
        outer.append(outer[-1] + len(keys))
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), lists)


def _signature(texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, side, id, len, key): the rarest grams of each text, one more than its edits can destroy.

    An edit destroys at most ``GRAM`` grams, so similar texts share all but GRAM x edits of them (repeats are told apart by their number), and of both texts' rarest
    GRAM x edits + 1 at least one is common. Texts too short for a single edit have no signature: they are similar only to their equals. A document's texts come together, as it came; only
    the rare grams leave it.
    """
    t = spread(texts.withColumn("edits", _edits(F.col("len"), least)).where("edits > 0").select("doc_id", "side", "id", "len", "edits", "norm"), "doc_id")
    g = t.groupBy("doc_id").agg(F.collect_list(F.struct("side", "id", "len", "edits", "norm")).alias("rows"))
    g = g.withColumn("keys", rare_keys(F.transform("rows", lambda r: r["norm"]), F.transform("rows", lambda r: r["edits"])))
    rows = F.transform("rows", lambda r: F.struct(r["side"].alias("side"), r["id"].alias("id"), r["len"].alias("len")))
    g = g.select("doc_id", F.explode(F.arrays_zip(rows.alias("row"), F.col("keys"))).alias("x"))
    return g.select("doc_id", "x.row.*", F.explode("x.keys").alias("key"))


def similar_texts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, l, r, similarity): texts (doc_id, side 0 or 1, id, norm, len) of both sides of one document whose matching-block ratio is at least so many hundredths.

    Equal texts meet by equality, others by a rare gram; lengths and then the ratio itself decide. No document's texts are paired with all of the other side.
    """
    side = lambda k, name: texts.where(F.col("side") == k).select("doc_id", F.col("id").alias(name), F.col("norm").alias(f"{name}_norm"))
    left, right = side(0, "l"), side(1, "r")
    equal = left.join(right.withColumnRenamed("r_norm", "l_norm"), ["doc_id", "l_norm"]).select("doc_id", "l", "r", F.lit(1.0).alias("similarity"))
    s = kept(_signature(texts, least))
    a = s.where("side = 0").select("doc_id", "key", F.col("id").alias("l"), F.col("len").alias("l_len"))
    b = s.where("side = 1").select("doc_id", "key", F.col("id").alias("r"), F.col("len").alias("r_len"))
    short, both = F.least("l_len", "r_len"), F.col("l_len") + F.col("r_len")
    near = a.join(b, ["doc_id", "key"]).where(200 * short >= least * both).select("doc_id", "l", "r").distinct()
    near = near.join(left, ["doc_id", "l"]).join(right, ["doc_id", "r"]).where("l_norm <> r_norm")
    near = spread(near.where(ratio_bound(F.col("l_norm"), F.col("r_norm")) >= least / 100), "doc_id", "l", "r").withColumn("similarity", ratio_from(least / 100)(F.col("l_norm"), F.col("r_norm")))
    return equal.union(near.where(F.col("similarity") >= least / 100).select("doc_id", "l", "r", "similarity"))


def link_rendered(logical: DataFrame, rendered: DataFrame, least: int = LEAST) -> DataFrame:
    """JN-11: each logical block (doc_id, ordinal, norm) with the rendered one (doc_id, ordinal, norm, page_index, x0, y0, x1, y1) that is its only similar one, and whose only similar one it is.

    Rows (doc_id, ordinal, rendered, similarity, page_index, x0, y0, x1, y1, eligible): the link is null where there are no or several similar blocks on either side, or the rendered
    block has no place. ``eligible`` counts similar rendered blocks. Repeated texts are counted, never paired with one another.
    """
    blocks = logical.select("doc_id", "ordinal", "norm", F.lit(0).alias("side")).union(rendered.select("doc_id", "ordinal", "norm", F.lit(1)))
    texts = blocks.groupBy("doc_id", "side", "norm").agg(F.count("*").alias("n"), F.min("ordinal").alias("id"))
    texts = kept(texts.withColumn("len", F.length("norm")))
    pairs = kept(similar_texts(texts, least))
    n = lambda k, name: texts.where(F.col("side") == k).select("doc_id", F.col("id").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = pairs.join(n(0, "l"), ["doc_id", "l"]).join(n(1, "r"), ["doc_id", "r"])
    of_l = pairs.groupBy("doc_id", "l").agg(F.sum("n_r").alias("eligible"), F.max("n_l").alias("n_l"), F.min("r").alias("r"), F.max("similarity").alias("similarity"))
    of_r = pairs.groupBy("doc_id", "r").agg(F.sum("n_l").alias("back"))
    place = ["page_index", "x0", "y0", "x1", "y1"]
    placed = rendered.where(" AND ".join(f"{c} IS NOT NULL" for c in place)).select("doc_id", F.col("ordinal").alias("r"), *place)
    link = of_l.where("eligible = 1 AND n_l = 1").join(of_r.where("back = 1"), ["doc_id", "r"]).join(placed, ["doc_id", "r"])
    link = link.select("doc_id", F.col("l").alias("ordinal"), F.col("r").alias("rendered"), "similarity", *place)
    text_of = texts.where("side = 0").select("doc_id", "norm", F.col("id").alias("l"))
    out = logical.select("doc_id", "ordinal", "norm").join(text_of, ["doc_id", "norm"], "left").join(of_l.select("doc_id", "l", "eligible"), ["doc_id", "l"], "left").join(link, ["doc_id", "ordinal"], "left")
    return out.select("doc_id", "ordinal", "rendered", "similarity", *place, F.coalesce("eligible", F.lit(0)).alias("eligible"))


def link_status(links: DataFrame, rendered: DataFrame) -> DataFrame:
    """(doc_id, blocks, linked, rendered, incomplete): a document's links are incomplete when a block of either side has none."""
    of_logical = links.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count("rendered").alias("linked"))
    of_rendered = rendered.groupBy("doc_id").agg(F.count("*").alias("rendered"))
    both = of_logical.join(of_rendered, "doc_id", "full_outer").na.fill(0, ["blocks", "linked", "rendered"])
    return both.withColumn("incomplete", (F.col("linked") < F.col("blocks")) | (F.col("linked") < F.col("rendered")))
