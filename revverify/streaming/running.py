"""The running verdict of streamed decision logs with keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "bundle_id long, event_id long, sequence long, error string, approved long, rejected long"
_HEAD = "next long, digest string, approved long, rejected long"
_EVENT = "event_id long, finding_id long, decision string, previous_digest string, event_digest string, expires long"
#: The store that keyed lists, maps and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunningVerdict(StatefulProcessor):
    """A bundle's chain: a value (next number, last digest, counts), a map of decided findings, and a map of events held back for their predecessor.

    Only what an event touches is read and written: a chain of any length costs its events, not its history. An event too early waits until the watermark
    passes it, as nothing older than that comes any more; then it is an error, and nothing after the gap counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.decided = handle.getMapState("decided", "finding_id long", "event_id long")
        self.held = handle.getMapState("held", "sequence long", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (bundle,) = key
        nxt, digest, approved, rejected = self.head.get() if self.head.exists() else (1, "", 0, 0)
        out = []

        def error(e, sequence: int, what: str) -> None:
            out.append((bundle, e.event_id, sequence, what, None, None))

        def follows(e, sequence: int) -> bool:
            """Take an event whose turn it is; False where its digest does not fit."""
            nonlocal nxt, digest, approved, rejected
            if digest and e.previous_digest != digest:
                error(e, sequence, "previous-digest")
                return False
            nxt, digest = nxt + 1, e.event_digest
            if self.decided.containsKey((e.finding_id,)):
                error(e, sequence, "repeated-finding")
                return True
            self.decided.updateValue((e.finding_id,), (e.event_id,))
            approved, rejected = approved + (e.decision == "approve"), rejected + (e.decision != "approve")
            out.append((bundle, e.event_id, sequence, None, approved, rejected))
            return True

        for r in sorted(rows, key=lambda r: (r.sequence, r.event_id)):
            if r.sequence == nxt:
                ok = follows(r, r.sequence)
                while ok and self.held.containsKey((nxt,)):
                    sequence = nxt
                    e = self.held.getValue((sequence,))
                    self.held.removeKey((sequence,))
                    ok = follows(Row(*_names(_EVENT))(*e), sequence)
            elif r.sequence < nxt or self.held.containsKey((r.sequence,)):
                error(r, r.sequence, "sequence")
            else:
                expires = r.at + 1
                self.held.updateValue((r.sequence,), (r.event_id, r.finding_id, r.decision, r.previous_digest, r.event_digest, expires))
                self.handle.registerTimer(expires)
        self.head.update((nxt, digest, approved, rejected))
        for x in out:
            yield Row(*_names(OUTPUT))(*x)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        late = sorted((k[0], Row(*_names(_EVENT))(*e)) for k, e in self.held.iterator() if e[-1] <= due)
        for sequence, e in late:
            self.held.removeKey((sequence,))
            yield Row(*_names(OUTPUT))(key[0], e.event_id, sequence, "sequence", None, None)

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def running_verdicts(log: DataFrame, wait: int) -> DataFrame:
    """STR-02: each event of a streamed decision log (bundle_id, sequence, event_id, finding_id, decision, previous_digest, event_digest, ts) with its error, or with its bundle's counts up to it.

    Errors: sequence (its number is taken, or its predecessor did not come within ``wait`` milliseconds of event time), previous-digest, repeated-finding. Events may come in any order;
    those later than ``wait`` are dropped by the watermark. The session needs ``STORE``.
    """
    rows = log.withColumn("at", F.unix_millis("ts")).withWatermark("ts", f"{wait} milliseconds")
    return rows.groupBy("bundle_id").transformWithState(RunningVerdict(), OUTPUT, "Append", "EventTime")


def effective_log(log: DataFrame) -> DataFrame:
    """The same fold over a whole log, without waiting: (bundle_id, event_id, sequence, error, approved, rejected)."""
    from pyspark.sql import window as W

    order = W.Window.partitionBy("bundle_id").orderBy("sequence")
    so_far = order.rowsBetween(W.Window.unboundedPreceding, 0)
    first = F.row_number().over(W.Window.partitionBy("bundle_id", "sequence").orderBy("event_id")) == 1
    x = log.withColumn("first", first)
    taken = x.where("first").withColumn("gap", F.row_number().over(order) != F.col("sequence"))
    taken = taken.withColumn("broken", F.coalesce(F.col("previous_digest") != F.lag("event_digest").over(order), F.lit(False)))
    taken = taken.withColumn("stop", F.min(F.when(F.col("gap") | F.col("broken"), F.col("sequence"))).over(W.Window.partitionBy("bundle_id")))
    good = F.col("stop").isNull() | (F.col("sequence") < F.col("stop"))
    again = F.row_number().over(W.Window.partitionBy("bundle_id", "finding_id", good).orderBy("sequence")) > 1
    taken = taken.withColumn("good", good).withColumn("again", again & good)
    counts = F.col("good") & ~F.col("again")
    error = F.when(F.col("good"), F.when(F.col("again"), "repeated-finding")).when((F.col("sequence") == F.col("stop")) & ~F.col("gap"), "previous-digest").otherwise("sequence")
    n = lambda what: F.when(counts, F.sum((counts & what).cast("long")).over(so_far))
    done = taken.select("bundle_id", "event_id", "sequence", error.alias("error"), n(F.col("decision") == "approve").alias("approved"), n(F.col("decision") != "approve").alias("rejected"))
    none = F.lit(None).cast("long")
    return done.union(x.where("NOT first").select("bundle_id", "event_id", "sequence", F.lit("sequence"), none, none))
