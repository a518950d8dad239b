"""Bounded priority queues and idle sessions as keyed state."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUEUE_SCHEMA = "queue string, event_id long, request_id long, status int, place int"


def bounded_queue(events: DataFrame, size: int = 16) -> DataFrame:
    """(queue, event_id, request_id, status, place) of a stream of (queue, event_id, at seconds, kind, request_id, priority).

    ``kind`` submit: 202 with the request's place among those that wait, from 1 by priority,
    time and id; 429 where ``size`` wait already. ``take``: 200 with the first of them, which leaves,
    or 204 without any. Events of one trigger go by time and id; the state is at most
    ``size`` waiting requests."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable").itertuples(index=False):
            request, status, place = None, 204, None
            if row.kind == "submit":
                request, status = int(row.request_id), 429
                if len(waiting) < size:
                    entry = (int(row.priority), float(row.at), request)
                    bisect.insort(waiting, entry)
                    status, place = 202, waiting.index(entry) + 1
            elif waiting:
                request, status = waiting.pop(0)[2], 200
            out.append((key[0], row.event_id, request, status, place))
        state.update((json.dumps(waiting),))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in QUEUE_SCHEMA.split(", ")])
        yield frame.astype({"request_id": "Int64", "place": "Int32"})

    return events.groupBy("queue").applyInPandasWithState(step, QUEUE_SCHEMA, "waiting string", "append", GroupStateTimeout.NoTimeout)


def idle_sessions(touches: DataFrame, hours: float = 24, late: str = "10 minutes") -> DataFrame:
    """(session_id, updated_at) of sessions that nothing has touched for ``hours``, as event time passes.

    ``touches``: a stream of (session_id, at). Each touch moves the session's timer; when the
    watermark passes it, the session is given out to be removed and its state goes."""
    ttl_ms = int(hours * 3_600_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "updated_at": pd.to_datetime([last], unit="ms", utc=True)})
            return
        last = max([state.get[0] if state.exists else 0, *(int(b["ms"].max()) for b in batches)])
        state.update((last,))
        # a touch that is older than the watermark can't set a timer in the past
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))

    rows = touches.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, updated_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
