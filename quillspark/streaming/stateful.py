"""Stateful behaviour as Structured Streaming: login blocks, token buckets, receipts, rates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from quillspark.functions import constants as C
from quillspark.operators.components import components
from quillspark.scratch import Scratch


Counters = dict[str, tuple[int, float]]


def _fold_logins(state: Counters, events: list, limit: int, window: float) -> list[dict]:
    """Attempts (named tuples) in order against the counters of subjects and addresses, which are changed.

    A counter ends ``window`` after its first failure. An attempt whose subject or address
    has reached ``limit`` is refused and counts nothing; a success clears both; a failure
    counts for both, and the one that reaches the limit is itself answered as blocked."""
    out = []
    for row in events:
        keys = (f"subject:{row.subject}", f"address:{row.address}")
        live = {k: state[k] for k in keys if k in state and state[k][1] > row.at}
        blocked = max((n for n, _ in live.values()), default=0) >= limit
        if not blocked:
            for k in keys:
                state.pop(k, None)
            if not row.success:
                live = {k: (live[k][0] + 1, live[k][1]) if k in live else (1, row.at + window) for k in keys}
                state.update(live)
                blocked = max(n for n, _ in live.values()) >= limit
            else:
                live = {}
        out.append({"event_id": row.event_id, "failures": max((n for n, _ in live.values()), default=0), "blocked": blocked})
    if events:
        now = events[-1].at
        for k in [k for k, (_, ends) in state.items() if ends <= now]:
            del state[k]
    return out


LOGIN_SCHEMA = "event_id long, failures int, blocked boolean"


def login_blocks(events: DataFrame, limit: int = C.LOGIN_LIMIT, window: float = C.LOGIN_WINDOW) -> DataFrame:
    """(event_id, failures, blocked) of a stream of (realm, event_id, at seconds, subject, address, success).

    Subject and address count together, so both belong to one ``realm``, the part of the
    stream that is followed in order; its state is the counters that have not ended.
    Events of one trigger go by time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        counters = {k: (n, ends) for k, n, ends in json.loads(state.get[0])} if state.exists else {}
        out = _fold_logins(counters, list(events.itertuples(index=False)), limit, window)
        state.update((json.dumps([[k, n, ends] for k, (n, ends) in counters.items()]),))
        yield pd.DataFrame(out)

    rows = events.withColumn("subject", F.lower(F.trim("subject")))
    return rows.groupBy("realm").applyInPandasWithState(step, LOGIN_SCHEMA, "counters string", "append", GroupStateTimeout.NoTimeout)


def _episodes(rows: DataFrame, window: float) -> DataFrame:
    """(key, slot, episode): which attempts of a key can act on each other.

    A counter ends ``window`` after its first failure, so a pause of that length ends
    whatever it held. Attempts are reduced to a row for each key and slot of ``window``
    seconds before they are put in order, so a key that is a third of all rows is short."""
    slots = rows.select(F.explode(F.array(_subject(), _address())).alias("key"), "slot", "at").groupBy("key", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("key").orderBy("slot")
    apart = F.coalesce(F.col("first") - F.lag("last").over(order) >= window, F.lit(True))
    return slots.withColumn("new", apart.cast("int")).withColumn("episode", F.sum("new").over(order)).select("key", "slot", "episode")


def _subject() -> Column:
    return F.concat(F.lit("s"), F.col("subject"))


def _address() -> Column:
    return F.concat(F.lit("a"), F.col("address"))


def login_groups(rows: DataFrame, window: float, scratch: Scratch) -> DataFrame:
    """``rows`` with ``component``: attempts that subjects and addresses connect while a counter can last."""
    rows = rows.withColumn("slot", F.floor(F.col("at") / window))
    known = scratch.save(_episodes(rows, window), "episodes")
    node = lambda key: F.concat_ws("#", F.col("episode"), key)
    of = lambda rows, key, name: rows.join(known.withColumnRenamed("key", "__key"), (F.col("__key") == key) & (rows["slot"] == known["slot"])).select(rows["*"], node(key).alias(name))
    rows = scratch.save(of(of(rows, _subject(), "a"), _address(), "b"), "attempts")
    found = components(rows.select("a", "b").distinct(), scratch)
    return rows.join(found, F.col("a") == F.col("node")).drop("a", "b", "node", "slot")


def _followed(batches: Iterator[pd.DataFrame], limit: int, window: float) -> Iterator[pd.DataFrame]:
    """Attempts sorted by ``component`` and time, each component with counters of its own; one frame a
    batch, however many components, most of which are a few rows, it holds."""
    last, counters = None, {}
    for batch in batches:
        out, components, rows = [], batch["component"].to_numpy(), list(batch.itertuples(index=False))
        starts = [0, *(np.flatnonzero(components[1:] != components[:-1]) + 1).tolist(), len(rows)]
        for begin, end in zip(starts, starts[1:]):
            if begin < end and components[begin] != last:
                last, counters = components[begin], {}
            out += _fold_logins(counters, rows[begin:end], limit, window)
        yield pd.DataFrame(out, columns=["event_id", "failures", "blocked"])


def login_blocks_batch(events: DataFrame, limit: int = C.LOGIN_LIMIT, window: float = C.LOGIN_WINDOW) -> DataFrame:
    """The same over a finished table (event_id, at, subject, address, success); it needs no realm.

    Subjects and addresses that attempts connect, without a pause in which all counters
    end, are followed together in order of time.
    Spark shuffles and sorts them; a task reads its rows batch after batch and holds the
    counters that have not ended, so no history is held whole. Null subjects or addresses
    count as empty ones."""
    scratch = Scratch(events.sparkSession, "logins")
    subject, address = F.coalesce(F.lower(F.trim("subject")), F.lit("")), F.coalesce(F.col("address").cast("string"), F.lit(""))
    rows = events.select("event_id", F.col("at").cast("double").alias("at"), subject.alias("subject"), address.alias("address"), "success")
    keyed = login_groups(rows, window, scratch)

    run = lambda batches: _followed(batches, limit, window)
    return keyed.repartition("component").sortWithinPartitions("component", "at", "event_id").mapInPandas(run, LOGIN_SCHEMA)


def token_buckets(requests: DataFrame, size: float = C.BUCKET_SIZE, refill: float = C.BUCKET_REFILL) -> DataFrame:
    """(key, event_id, wait) of a stream of (key, event_id, at seconds, tokens): seconds until the
    bucket of the key can serve each, in order of arrival."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, clock = state.get if state.exists else (size, None)
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable").itertuples(index=False):
            now = row.at if clock is None else max(row.at, clock)
            level = min(size, level + (0.0 if clock is None else (now - clock) * refill))
            wait = max(0.0, (row.tokens - level) / refill)
            level, clock = level + wait * refill - row.tokens, now + wait
            out.append({"key": key[0], "event_id": row.event_id, "wait": round(clock - row.at, 6)})
        state.update((level, clock))
        yield pd.DataFrame(out)

    return requests.groupBy("key").applyInPandasWithState(step, "key string, event_id long, wait double", "level double, clock double", "append", GroupStateTimeout.NoTimeout)


def first_receipts(receipts: DataFrame, key: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """The first receipt of each key; keys are remembered for ``late``."""
    return receipts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def request_rate(events: DataFrame, time: str = "ts", size: str = "5 minutes", seconds: int = 300, step: str = "5 minutes", late: str | None = None) -> DataFrame:
    """(start, requests, per_second) by window; of a stream with a watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    counted = rows.groupBy(F.window(time, size, step)).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "requests", F.round(F.col("requests") / seconds, 6).alias("per_second"))


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data) of each answer (query_id, references, deltas, error): status,
    references, status, the deltas, then done or error."""
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    head = F.array(event("status", F.lit("retrieving")), event("references", F.col("references")), event("status", F.lit("generating")))
    middle = F.transform("deltas", lambda d: F.struct(F.lit("content").alias("event"), d.alias("data")))
    tail = F.array(F.when(F.col("error").isNull(), event("done", F.lit(""))).otherwise(event("error", F.col("error"))))
    rows = answers.select("query_id", F.posexplode(F.concat(head, middle, tail)).alias("seq", "x"))
    return rows.select("query_id", "seq", "x.event", "x.data")
