"""Hash-chained event streams folded as they arrive: the same states as the batch operators give.

Event order is the sequence number, not event time; there is nothing to be late by, so no watermark
takes part in the result. Each key keeps its next number, last hash and state, so a stream can stop
and go on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from tallyproof.sources.shared import ship_code

OUT = "stream string, seq bigint, hash string, state string, error string"
STATE = "next bigint, last string, state string, error string"


def advance(state: tuple, seq: int, digest: str, previous: str | None, kind: str, setting: tuple, clearing: tuple) -> tuple:
    """(next number, last hash, state, error) after one event; the first error of a stream stays."""
    wanted, last, now, error = state
    if error is None:
        if seq != wanted:
            error = "SEQUENCE_NOT_CONTIGUOUS"
        elif (previous or None) != (last or None):
            error = "CHAIN_MISMATCH"
    if kind in setting:
        now = "set"
    elif kind in clearing and now == "set":
        now = "cleared"
    return seq + 1, digest, now, error


def fold_stream(events: DataFrame, setting: tuple[str, ...], clearing: tuple[str, ...]) -> DataFrame:
    """events: streaming (stream, seq, hash, previous_sha256, kind). One row a micro-batch and stream: its newest state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else (1, "", "never_set", None)
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples(index=False):
            state = advance(tuple(state), int(r.seq), r.hash, r.previous_sha256, r.kind, setting, clearing)
        held.update(state)
        yield pd.DataFrame([(key[0], state[0] - 1, state[1], state[2], state[3])], columns=[c.split()[0] for c in OUT.split(", ")])

    ship_code(events.sparkSession)
    return events.groupBy("stream").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def recover(journal: DataFrame) -> DataFrame:
    """Runs of a journal (run_id, sequence, event, work_id) that were begun and have no end: to be begun again or marked lost."""
    begun = journal.where("event = 'work_started'").select("run_id", "work_id")
    ended = journal.where("event in ('work_completed', 'work_failed', 'work_abstained', 'work_timeout')").select("run_id", "work_id")
    return begun.join(ended, ["run_id", "work_id"], "left_anti").distinct()
