"""Operator 11: cheapest repair of a conversation's turns, the least edit script by prefix-doubling path ranking.

A repaired conversation's role initials are ``(s?(ua)+)?``. Each row is kept (0), given the other role (2) or deleted (3, required where it is blank or repeats role and text),
and empty turns of user or assistant may be inserted anywhere (2); a truncated row that stays adds 1. The audit is the initials of the edits (K, R, D, I) in order; of the cheapest scripts the
one with the ASCII-least audit counts.

1. *Cost DP* over (row, state of the role grammar). A row is a 4 x 4 matrix of costs, blocks of rows are products in (min, +), and blocks of blocks again, so a
   conversation of any length is a tree of blocks of 256; costs to come and to go descend the same tree. No task holds more than blocks of 256.
2. *Path ranking.* Arcs on some cheapest script make a graph whose nodes are (row, state). Each round ranks all nodes by the least audit of the next 2^k edits: the pair of a node's
   own rank and that of the node 2^k edits ahead, sorted over all nodes, gives the ranks of twice the length, and the pointers double. Only candidates of least rank stay, so at the end the pointers
   of each node follow its least path. A conversation leaves the rounds when twice its longest possible script is reached.
3. *Selection.* From each start the doubled pointers are followed from the largest power down, which gives every node of the path with its place.

Rows are ordered once by (conversation, turn with nulls first, role, text), so rows of equal turn have a defined order. Null roles and texts count as one space: such a text is blank, such a role is none. A null
conv_id is a conversation of its own. Blank rows are not also duplicates, nor duplicates truncated. Other columns are not read; an empty table gives no rows. The hash of a repaired
conversation is one stream over its lines in order, read block by block: that one step is sequential in a conversation, with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, settled, shared_dir, table

#: Rows of a block, as a power of two; rows that one Python call takes, about.
SHIFT, TOGETHER = 8, 50_000
FAR = 1 << 40
#: States of the grammar: nothing yet, after a first system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = ("s", "u", "a")
_NEXT = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Faults of a row; the first that fits counts.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_BLANK = r"[^\x20\x09-\x0D]"
_INSERT = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}


def _moves(kind: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of what can be done with a row; kind is 4 * (initial: 0 to 2, 3 for others) + fault."""
    initial, fault = divmod(kind, 4)
    out = [("D", q, q, 3) for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = int(fault == TRUNCATED)
        if initial < 3:
            out += [("K", q, to, more) for (i, q), to in _NEXT.items() if i == INITIALS[initial]]
        out += [("R", q, to, 2 + more) for (i, q), to in _NEXT.items() if i != "s"]
    return out


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(min, +) products of stacked matrices."""
    return (x[..., :, :, None] + y[..., None, :, :]).min(axis=-2)


_INSERTS = np.full((4, 4), FAR, np.int64)
for _q in range(4):
    _INSERTS[_q, _q] = 0
    _INSERTS[_q, _INSERT[_q]] = 2
_INSERTS = np.minimum(_INSERTS, _product(_INSERTS, _INSERTS))
_ROWS = np.full((16, 4, 4), FAR, np.int64)
for _kind in range(16):
    for _, _q, _to, _cost in _moves(_kind):
        _ROWS[_kind, _q, _to] = min(_ROWS[_kind, _q, _to], _cost)
#: Inserts, then a row.
_STEPS = _product(np.broadcast_to(_INSERTS, (16, 4, 4)), _ROWS)
#: Cost to go after the last row: a script may end in NONE or ASSISTANT, after inserts.
_LAST = np.minimum(_INSERTS[:, NONE], _INSERTS[:, ASSISTANT])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32(``conv_id:turn``) mod 20 decides; nulls in it, in roles and in texts are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20)).alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def ordered(rows: DataFrame, path: str) -> DataFrame:
    """Rows with ``g``, their places in the order of all rows, without gaps, stored."""
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("also")]
    spark, first = rows.sparkSession, shared_dir(rows.sparkSession)
    x = settled(rows.withColumn("also", F.monotonically_increasing_id()).orderBy(*by).drop("also").withColumn("m", F.monotonically_increasing_id()), first)
    sizes = x.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    offset, below = {}, 0
    for r in sizes:
        offset[r["part"]], below = below, below + r["n"]
    begins = spark.createDataFrame(list(offset.items()), "part long, below long")
    g = F.col("below") + F.col("m").bitwiseAND((1 << 33) - 1)
    out = settled(x.withColumn("part", F.shiftright("m", 33)).join(F.broadcast(begins), "part").withColumn("g", g).drop("m", "part", "below"), path)
    dropped(spark, first)
    return out


def _fault(rows: DataFrame) -> DataFrame:
    """Rows (root: the conversation's first g, conv_id, pos, g, kind) of ordered rows."""
    firsts = rows.groupBy("conv_id").agg(F.min("g").alias("root"))
    seen = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    x = rows.select("conv_id", "g", "role", F.sha2("text", 256).alias("digest"), (~F.col("text").rlike(_BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut")).alias("x")
    same = F.col("x.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("x.role") == F.col("s.role")) & (F.col("x.digest") == F.col("s.digest"))
    x = x.join(seen.alias("s"), same, "left").select("x.*", F.coalesce(F.col("s.first") < F.col("x.g"), F.lit(False)).alias("again")).alias("x")
    x = x.join(firsts.alias("f"), F.col("x.conv_id").eqNullSafe(F.col("f.conv_id"))).select("x.*", "f.root")
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(3))
    return x.select("root", (F.col("g") - F.col("root")).alias("pos"), (4 * initial + fault).cast("int").alias("kind"))


def _dealt(rows: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """Rows with a bucket of whole groups of ``by``."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(max(8, n // TOGETHER))))


_MATRIX = [f"m{q}{to}" for q in range(4) for to in range(4)]
_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal"]
_BLOCK = "root long, pos long, head int, tail int, " + ", ".join(f"{c} long" for c in [*_COUNTS, *_MATRIX])
#: Neighbouring initials that a conversation may have.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def _runs(frame: pd.DataFrame, shift: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order, where each group (root, pos >> shift) begins, and the groups' sizes."""
    frame = frame.sort_values(["root", "pos"], kind="stable").reset_index(drop=True)
    root, block = frame["root"].to_numpy(), frame["pos"].to_numpy() >> shift
    first = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (block[1:] != block[:-1])))
    return frame, first, np.diff(np.append(first, len(frame)))


def _matrices(frame: pd.DataFrame) -> np.ndarray:
    return _STEPS[frame["kind"].to_numpy()] if "kind" in frame else frame[_MATRIX].to_numpy(np.int64).reshape(-1, 4, 4)


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Blocks of rows, or of blocks, as one row each."""
    frame, first, size = _runs(frame, SHIFT)
    if "kind" in frame:
        kind = frame["kind"].to_numpy()
        frame["head"] = frame["tail"] = kind // 4
        frame["rows"], frame["illegal"] = 1, 0
        for i, c in enumerate(("blank", "duplicate", "truncated")):
            frame[c] = (kind % 4 == i + 1).astype(np.int64)
    m = _matrices(frame)
    product = m[first]
    for k in range(1, int(size.max())):
        more = size > k
        product[more] = np.minimum(_product(product[more], m[first[more] + k]), FAR)
    head, tail = frame["head"].to_numpy(), frame["tail"].to_numpy()
    inner = np.append(False, ~_LEGAL[tail[:-1], head[1:]])
    inner[first] = False
    out = pd.DataFrame({"root": frame["root"].to_numpy()[first], "pos": frame["pos"].to_numpy()[first] >> SHIFT, "head": head[first].astype(np.int32), "tail": tail[first + size - 1].astype(np.int32)})
    for c in _COUNTS:
        out[c] = np.add.reduceat(frame[c].to_numpy(np.int64) + (inner if c == "illegal" else 0), first)
    out[_MATRIX] = product.reshape(-1, 16)
    return out


_WAYS = [f"{way}{q}" for way in ("come", "go") for q in range(4)]


def _swept(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Items of groups in order, with the cost to come before each and to go after each; and the groups' sizes for each item."""
    frame, first, size = _runs(frame, SHIFT)
    m = _matrices(frame)
    come, go = np.empty((len(frame), 4), np.int64), np.empty((len(frame), 4), np.int64)
    given = frame[_WAYS].to_numpy(np.int64)[first]
    now = given[:, :4]
    for k in range(int(size.max())):
        here = size > k
        at = first[here] + k
        come[at] = now[here]
        now[here] = np.minimum((now[here][:, :, None] + m[at]).min(axis=1), FAR)
    now = given[:, 4:]
    for k in range(1, int(size.max()) + 1):
        here = size >= k
        at = first[here] + size[here] - k
        go[at] = now[here]
        now[here] = np.minimum((m[at] + now[here][:, None, :]).min(axis=2), FAR)
    return frame, m, come, go


def _descend(frame: pd.DataFrame) -> pd.DataFrame:
    """The items of a block with their own costs to come and to go."""
    frame, _, come, go = _swept(frame)
    out = frame[["root", "pos", "total", "need"]].copy()
    out[_WAYS] = np.concatenate([come, go], axis=1)
    return out


def _arcs(frame: pd.DataFrame) -> pd.DataFrame:
    """Arcs (src, dst or null at the end, letter, need) on some cheapest script. A node is 8 * (g of the next row) + state; after the last row 8 * (its g) + 4 + state."""
    frame, _, come, go = _swept(frame)
    frame = frame.reset_index(drop=True)
    g = (frame["root"] + frame["pos"]).to_numpy()
    last = (frame["pos"] + 1 == frame["size"]).to_numpy()
    total, need, kind = (frame[c].to_numpy() for c in ("total", "need", "kind"))
    after = go
    before = np.minimum((_STEPS[kind] + go[:, None, :]).min(axis=2), FAR)
    come = np.minimum((come[:, :, None] + _INSERTS).min(axis=1), FAR)
    out = []

    def add(at: np.ndarray, src: np.ndarray, dst: np.ndarray, ends: np.ndarray, letter: str) -> None:
        out.append(pd.DataFrame({"src": src[at], "dst": pd.array(np.where(ends, 0, dst)[at], dtype="Int64").copy(), "letter": ord(letter), "need": need[at]}))
        out[-1].loc[ends[at], "dst"] = pd.NA

    none = np.zeros(len(g), bool)
    done = np.minimum((come[:, :, None] + _ROWS[kind]).min(axis=1), FAR)
    done = np.minimum((done[:, :, None] + _INSERTS).min(axis=1), FAR)
    for q in range(4):
        to = _INSERT[q]
        add(np.flatnonzero((come[:, q] + 2 + before[:, to] == total)), 8 * g + q, 8 * g + to, none, "I")
        # After the last row a script ends where it may; otherwise it inserts.
        if q in (SYSTEM, USER):
            add(np.flatnonzero(last & (done[:, q] + 2 + _LAST[to] == total)), 8 * g + 4 + q, 8 * g + 4 + to, np.full(len(g), to == ASSISTANT), "I")
    for k in range(16):
        mine = kind == k
        if not mine.any():
            continue
        for letter, q, to, cost in _moves(k):
            at = np.flatnonzero(mine & (come[:, q] + cost + after[:, to] == total))
            dst = np.where(last, 8 * g + 4 + to, 8 * (g + 1) + to)
            add(at, 8 * g + q, dst, last & (to in (NONE, ASSISTANT)), letter)
    return pd.concat(out, ignore_index=True)


def _in_pandas(f):
    return lambda key, frame: f(frame.drop(columns="bucket"))


def cheapest_arcs(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of rows (root, pos, kind): a row for each conversation with its counts and ``cost``, the arcs of its cheapest scripts, and the folders of both."""
    spark, n = rows.sparkSession, rows.count()
    level, levels, paths = rows, [rows], []
    most = rows.agg(F.max("pos")).first()[0]
    while True:
        paths.append(shared_dir(spark))
        blocks = _dealt(level, n, "root", F.shiftright("pos", SHIFT)).groupBy("bucket").applyInPandas(_in_pandas(_merged), _BLOCK)
        level = settled(blocks, paths[-1])
        most = (most or 0) >> SHIFT
        if not most:
            break
        levels.append(level)
    cost = F.least(*[F.col(f"m{NONE}{q}") + int(_LAST[q]) for q in range(4)])
    tops = level.withColumn("cost", cost)
    # Rounds that the conversation's longest cheapest script needs: a letter for each row, and an insert for each two of cost.
    known = tops.select("root", "pos", F.col("cost").alias("total"), (F.length(F.bin(F.col("rows") + F.floor(F.col("cost") / 2)))).alias("need"), F.col("rows").alias("size"), *[F.lit(0 if w == "come0" else FAR if w[0] == "c" else int(_LAST[int(w[2])])).cast("long").alias(w) for w in _WAYS])
    sizes = known.select("root", "size")
    ways = known.drop("size")
    for below in reversed(levels[1:]):
        up = ways.withColumnRenamed("pos", "up")
        items = below.select("root", "pos", *_MATRIX, F.shiftright("pos", SHIFT).alias("up")).join(up, ["root", "up"]).drop("up")
        found = _dealt(items, n, "root", F.shiftright("pos", SHIFT)).groupBy("bucket").applyInPandas(_in_pandas(_descend), "root long, pos long, total long, need int, " + ", ".join(f"{w} long" for w in _WAYS))
        paths.append(shared_dir(spark))
        ways = settled(found, paths[-1])
    items = rows.withColumn("up", F.shiftright("pos", SHIFT)).join(ways.withColumnRenamed("pos", "up"), ["root", "up"]).drop("up").join(sizes, "root")
    arcs = _dealt(items, n, "root", F.shiftright("pos", SHIFT)).groupBy("bucket").applyInPandas(_in_pandas(_arcs), "src long, dst long, letter int, need int")
    paths.append(shared_dir(spark))
    return tops, settled(arcs, paths[-1]), paths


def _least(candidates: DataFrame) -> DataFrame:
    """Of candidates (src, need, x, y, dst) those of each src's least (x, y)."""
    least = candidates.groupBy("src").agg(F.min(F.struct("x", "y")).alias("best"), F.min("need").alias("need"), F.collect_set(F.struct(F.struct("x", "y").alias("key"), "dst")).alias("all"))
    return least.select("src", "need", F.col("best.x").alias("x"), F.col("best.y").alias("y"), F.array_distinct(F.transform(F.filter("all", lambda c: c["key"] == F.col("best")), lambda c: c["dst"])).alias("dsts"))


def _ranked(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes (src, need, rank, dsts): the order of (x, y) over all nodes, as numbers; the sort is by ranges, so no task has all."""
    spark, first = nodes.sparkSession, shared_dir(nodes.sparkSession)
    nodes = settled(nodes, first)
    ranks = nodes.select("x", "y").distinct().orderBy("x", "y").withColumn("rank", F.monotonically_increasing_id())
    second = shared_dir(spark)
    ranks = settled(ranks, second)
    out = settled(nodes.join(ranks, ["x", "y"]).select("src", "need", "rank", "dsts"), path)
    dropped(spark, first, second)
    return out


def ranked_paths(arcs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """Of arcs (src, dst or null at an end, letter, need): the letter of each node's least arc, the pointers (src, dst) over 1, 2, 4, ... letters along least
    paths, and their folders. The arcs of one node have different letters, as edits do. ``need``: rounds after which the node's graph is done. Shorter audits come before longer ones that they begin."""
    spark = arcs.sparkSession
    paths = [shared_dir(spark)]
    top = arcs.agg(F.max("need")).first()[0] or 0
    nodes = _ranked(_least(arcs.select("src", "need", F.col("letter").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "dst")), paths[0])
    pointers = [nodes]
    for k in range(top):
        live = nodes.where(F.col("need") > k)
        ahead = live.select(F.col("src").alias("dst"), F.col("rank").alias("y"), F.col("dsts").alias("on"))
        moves = live.select("src", "need", F.col("rank").alias("x"), F.explode("dsts").alias("dst")).join(ahead, "dst", "left")
        moves = moves.select("src", "need", "x", F.coalesce("y", F.lit(-1)).alias("y"), F.explode(F.coalesce("on", F.array(F.lit(None).cast("long")))).alias("dst"))
        paths.append(shared_dir(spark))
        nodes = _ranked(_least(moves), paths[-1])
        pointers.append(nodes)
    letters = arcs.groupBy("src").agg(F.min("letter").alias("letter"))
    return letters, [p.select("src", F.col("dsts")[0].alias("dst")).where("dst IS NOT NULL") for p in pointers], paths


def followed(starts: DataFrame, pointers: list[DataFrame]) -> DataFrame:
    """Rows (root, node, at): every node of the least path of each start (root, node), with its place."""
    rows = starts.select("root", "node", F.lit(0).cast("long").alias("at"))
    for k in reversed(range(len(pointers))):
        both = rows.join(pointers[k].select(F.col("src").alias("node"), "dst"), "node", "left")
        here, there = F.struct("node", "at"), F.struct(F.col("dst").alias("node"), (F.col("at") + (1 << k)).alias("at"))
        rows = both.select("root", F.explode(F.when(F.col("dst").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")).select("root", "x.node", "x.at")
    return rows


_LINES = 128


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each root of blocks in order: the audit, and the hash of all lines."""
    root, audit, digest, begun = None, [], None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([root], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["root", "audit", "repaired_sha256"])

    for batch in batches:
        for r, letters, lines in zip(*(batch[c].to_pylist() for c in ("root", "letters", "lines")), strict=True):
            if digest is None or r != root:
                if digest is not None:
                    yield row()
                root, audit, digest, begun = r, [], hashlib.sha256(), False
            audit.append(letters)
            for line in lines:
                digest.update(("\n" if begun else "").encode() + line.encode())
                begun = True
    if digest is not None:
        yield row()


def repaired(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of rows (conv_id, turn, role, text) that get damaged first."""
    spark, kept = conversations.sparkSession, [shared_dir(conversations.sparkSession) for _ in range(2)]
    rows = ordered(damaged(conversations), kept[0])
    kinds = settled(_fault(rows), kept[1])
    tops, arcs, paths = cheapest_arcs(kinds)
    letters, pointers, more = ranked_paths(arcs)
    path = followed(tops.select("root", (8 * F.col("root")).alias("node")), pointers).join(letters.withColumnRenamed("src", "node"), "node")
    state = F.pmod(F.col("node"), F.lit(4))
    path = path.select("root", "at", F.chr("letter").alias("letter"), F.when(F.col("letter") != ord("I"), F.shiftright("node", 3)).alias("g"), F.when(state == USER, "assistant").otherwise("user").alias("given"))
    texts = rows.select("g", "role", "text")
    lines = path.join(texts, "g", "left").select(
        "root", "at", "letter",
        F.when(F.col("letter") == "K", F.concat("role", F.lit(":"), "text")).when(F.col("letter") == "R", F.concat("given", F.lit(":"), "text")).when(F.col("letter") == "I", F.concat("given", F.lit(":"))).alias("line"),
    )
    blocks = lines.groupBy("root", F.floor(F.col("at") / _LINES).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "letter", "line"))).alias("x"))
    blocks = blocks.select("root", "block", F.concat_ws("", F.transform("x", lambda v: v["letter"])).alias("letters"), F.filter(F.transform("x", lambda v: v["line"]), lambda v: v.isNotNull()).alias("lines"))
    told = blocks.repartition("root").sortWithinPartitions("root", "block").mapInArrow(_hashed, "root long, audit string, repaired_sha256 string")
    turns = rows.groupBy("conv_id", "turn").agg(F.min("g").alias("g")).groupBy("conv_id").agg(F.min("g").alias("root"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = turns.join(tops.select("root", "blank", "duplicate", "truncated", "illegal", "cost"), "root").join(told, "root", "left").alias("f")
    every = conversations.select("conv_id").distinct().alias("e")
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c)
    out = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "e.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
    out = settled(out)
    dropped(spark, *kept, *paths, *more)
    return out


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The same by a recursion from each conversation's last row, with the cheapest, then least, script of each state."""
    best = lambda options: "list_min([" + ", ".join(options) + "])"
    script = lambda cost, letter, line, to: f"{{'c': {cost} + s[{to + 1}].c, 'a': '{letter}' || s[{to + 1}].a, 'o': {line}s[{to + 1}].o{')' if line else ''}}}"
    done = []
    for q in range(4):
        options = [script("3", "D", "", q)]
        for i, to in ((i, to) for (i, from_), to in _NEXT.items() if from_ == q):
            options.append(script(f"CASE WHEN fault IN ('fine', 'truncated') AND role[1:1] = '{i}' THEN CAST(fault = 'truncated' AS BIGINT) ELSE 1000000000 END", "K", "list_concat([role || ':' || text], ", to))
            if i != "s":
                name = {"u": "user", "a": "assistant"}[i]
                options.append(script("CASE WHEN fault IN ('fine', 'truncated') THEN 2 + CAST(fault = 'truncated' AS BIGINT) ELSE 1000000000 END", "R", f"list_concat(['{name}:' || text], ", to))
        done.append(best(options))
    role_of = {USER: "user", ASSISTANT: "assistant"}
    states = []
    for q in range(4):
        one, two = _INSERT[q], _INSERT[_INSERT[q]]
        first, second = role_of[one], role_of[two]
        states.append(best([
            f"d[{q + 1}]",
            f"{{'c': 2 + d[{one + 1}].c, 'a': 'I' || d[{one + 1}].a, 'o': list_concat(['{first}:'], d[{one + 1}].o)}}",
            f"{{'c': 4 + d[{two + 1}].c, 'a': 'II' || d[{two + 1}].a, 'o': list_concat(['{first}:', '{second}:'], d[{two + 1}].o)}}",
        ]))
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_concat([n], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)
  )
),
keyed AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda h: CAST(ord(h) AS BIGINT))) AS name
  FROM conversations
),
cases AS (SELECT keyed.*, xor(list_reduce(name, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS k FROM keyed, crc),
damaged AS (
  SELECT conv_id, cid, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM cases WHERE k <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
judged AS (
  SELECT cid, pos, turn, role, text, lead(role) OVER (PARTITION BY cid ORDER BY pos) AS following,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE 'fine' END AS fault
  FROM placed
),
facts AS (
  SELECT cid, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE following IS NOT NULL AND role[1:1] || following[1:1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY cid
),
scripts AS (
  SELECT cid, n AS pos, [{{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}}, {{'c': 4, 'a': 'II', 'o': ['user:', 'assistant:']}}, {{'c': 2, 'a': 'I', 'o': ['assistant:']}}, {{'c': 0, 'a': '', 'o': []}}] AS s FROM facts
  UNION ALL
  SELECT cid, pos, [{", ".join(states)}] FROM (
    SELECT j.cid, j.pos - 1 AS pos, [{", ".join(done)}] AS d FROM scripts JOIN judged j ON j.cid = scripts.cid AND j.pos = scripts.pos
  )
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s[1].c, 0) AS cost, coalesce(s[1].a, '') AS audit, sha256(coalesce(array_to_string(s[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM keyed) LEFT JOIN facts USING (cid) LEFT JOIN (SELECT * FROM scripts WHERE pos = 0) USING (cid)
"""


ORACLE_OP11 = _oracle()
