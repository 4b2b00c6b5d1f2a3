"""The job log as a stream with state: every event once and in its job's order, however files repeat, cut or mix them.

A job's state is the number up to which all its events have been seen, what the last of these said, and the events that
came before their turn; so it grows with jobs and with gaps, not with events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.runs import STATES

ENTRY = "job_id bigint, seq bigint, state string, before string, allowed boolean, ts timestamp"
_STATE = "mark bigint, last string, early string"


def is_allowed(before: str, state: str) -> bool:
    """Whether a job may go from one state to another; the first must be pending."""
    return state in STATES.get(before, ()) if before else state == "pending"


def _in_order(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    mark, last, early = state.get if state.exists else (0, "", "{}")
    waiting = {int(k): tuple(v) for k, v in json.loads(early).items()}
    for batch in batches:
        for seq, name, ts in zip(batch["seq"], batch["state"], batch["ts"], strict=True):
            if seq > mark:
                waiting.setdefault(int(seq), (name, pd.Timestamp(ts).isoformat()))
    rows = []
    while mark + 1 in waiting:
        mark += 1
        name, ts = waiting.pop(mark)
        rows.append((key[0], mark, name, last, is_allowed(last, name), pd.Timestamp(ts)))
        last = name
    state.update((mark, last, json.dumps(waiting)))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])


def in_order(events: DataFrame) -> DataFrame:
    """job_id, seq, state, before, allowed and ts of a stream of events (job_id, seq from 1, state, ts), each event once.

    An event waits until all before it in its job have come; repeated deliveries are dropped. before is the state of the
    event before it, '' for the first. Rows without job_id, seq or state are left out.
    """
    known = events.where("job_id IS NOT NULL AND seq IS NOT NULL AND state IS NOT NULL").select("job_id", "seq", "state", F.col("ts").cast("timestamp").alias("ts"))
    return known.groupBy("job_id").applyInPandasWithState(_in_order, ENTRY, _STATE, "append", GroupStateTimeout.NoTimeout)


def last_events(events: DataFrame) -> DataFrame:
    """job_id, seq, state and ts of the last event of each job, and heard, the latest ts of any of its events.

    Of a stream (in update mode) as of a table, in any order and with repeated deliveries: the state is a row for each job.
    Events that are missing before the last one do not matter. Rows without job_id, seq or state are left out.
    """
    known = events.where("job_id IS NOT NULL AND seq IS NOT NULL AND state IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    return known.groupBy("job_id").agg(F.max_by(F.struct("seq", "state", "ts"), "seq").alias("e"), F.max("ts").alias("heard")).select("job_id", "e.*", "heard")


def orphans(last: DataFrame, idle: str = "1 day") -> DataFrame:
    """job_id, seq and state of the jobs of last_events whose last event leaves them at work, and is older than idle before the latest of all."""
    latest = last.agg(F.max("heard").alias("latest"))  # one row
    return last.where(F.col("state").isin("pending", "running")).join(F.broadcast(latest)).where(F.col("ts") < F.col("latest") - F.expr(f"INTERVAL {idle}")).select("job_id", "seq", "state")
