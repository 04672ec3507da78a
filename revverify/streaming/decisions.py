"""Structured Streaming: verdicts of revisions as they arrive, and the running verdict of decision logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rules import verdicts


def stream_verdicts(candidates: DataFrame, base: DataFrame, edits: DataFrame, path: str, checkpoint: str):
    """STR-01: a streaming query that judges each micro-batch of candidate paragraphs and writes verdicts below ``path``, one folder a batch.

    All paragraphs of a candidate must arrive in one batch. A batch that runs again after a failure overwrites its own folder.
    """

    def judge(batch: DataFrame, number: int) -> None:
        pairs = batch.select("pair_id").distinct()
        _, v = verdicts(base.join(pairs, "pair_id", "left_semi"), batch, edits.join(pairs, "pair_id", "left_semi"))
        v.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "next long, digest string, decided array<long>, approved long, rejected long"
OUTPUT = "bundle_id long, event_id long, sequence long, error string, approved long, rejected long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The next sequence number, the last digest and the decided findings are the state; an event that does not follow is an error row and changes nothing."""
    nxt, digest, decided, approved, rejected = state.get if state.exists else (1, "", [], 0, 0)
    seen = set(decided)
    rows = pd.concat(list(batches)).sort_values(["sequence", "event_id"])
    out = []
    for r in rows.itertuples():
        error = None
        if r.sequence != nxt:
            error = "sequence"
        elif digest and r.previous_digest != digest:
            error = "previous-digest"
        elif r.finding_id in seen:
            error = "repeated-finding"
        if error in (None, "repeated-finding"):
            nxt, digest = nxt + 1, r.event_digest
        if error is None:
            seen.add(int(r.finding_id))
            approved += r.decision == "approve"
            rejected += r.decision != "approve"
        out.append((key[0], r.event_id, r.sequence, error, approved, rejected))
    state.update((nxt, digest, sorted(seen), int(approved), int(rejected)))
    yield pd.DataFrame(out, columns=["bundle_id", "event_id", "sequence", "error", "approved", "rejected"])


def stream_effective(log: DataFrame) -> DataFrame:
    """STR-02, UDF-04: each event of a streamed decision log with its error or null and its bundle's counts so far."""
    return log.groupBy("bundle_id").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
