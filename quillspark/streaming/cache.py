"""Embeddings remembered by the hash of their content for seven days, as a table and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.governance import to_embed

DAYS = 7
Embed = Callable[[DataFrame], DataFrame]


def remembered(cache: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """(sha256, vector): the latest of each content that is younger than ``days`` at ``now``."""
    live = cache.where(F.col("at") > now - F.make_interval(days=F.lit(days)))
    return live.groupBy("sha256").agg(F.max_by("vector", "at").alias("vector"))


def fresh(chunks: DataFrame, cache: DataFrame, embed: Embed, now: Column, days: int = DAYS) -> DataFrame:
    """(sha256, vector, at) to add to the cache: each content that it lacks, embedded once.

    ``embed`` turns (sha256, content) into (sha256, vector)."""
    found = embed(to_embed(chunks, remembered(cache, now, days)))
    return found.select("sha256", "vector", now.alias("at"))


def with_vectors(chunks: DataFrame, cache: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """``chunks`` with their vectors, each where it was; null for contents that the cache lacks."""
    return chunks.join(remembered(cache, now, days), "sha256", "left").select(*chunks.columns, "vector")


def embedded_stream(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], days: float = DAYS, late: str = "10 minutes") -> DataFrame:
    """(id, sha256, vector, hit) of a stream of (id long, at, content): a content is embedded when it first
    comes, and again when it comes ``days`` later or more. Repeats in one trigger share one vector.

    Time is that of the events, so a run over the same events gives the same hits; a content's
    state goes when the watermark passes the end of its vector."""
    ttl_ms = int(days * 86_400_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        vector, made = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ms", "id"], kind="stable")
        vectors, hits = [], []
        for ms, content in zip(rows["ms"], rows["content"]):
            hits.append(vector is not None and ms < made + ttl_ms)
            if not hits[-1]:
                vector, made = [float(x) for x in embed([content])[0]], int(ms)
            vectors.append(list(vector))
        state.update((list(vector), made))
        state.setTimeoutTimestamp(max(made + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"], "sha256": key[0], "vector": vectors, "hit": hits})

    rows = chunks.select("id", F.col("at").cast("timestamp").alias("at"), "content", F.sha2("content", 256).alias("sha256")).withWatermark("at", late)
    rows = rows.withColumn("ms", F.unix_millis("at"))
    out = "id long, sha256 string, vector array<double>, hit boolean"
    return rows.groupBy("sha256").applyInPandasWithState(step, out, "vector array<double>, made long", "append", GroupStateTimeout.EventTimeTimeout)
