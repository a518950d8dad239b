"""What the learners share: a bounded sample dealt to shards, and states averaged over them.

Shards learn side by side.  Their states come back as packed arrays, one row of
bytes for each range of coordinates, are averaged range by range in tasks, and
reach the driver once, as one row a range.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import pieces, small_batches
from quillspark.scratch import Scratch

RANGE_SCHEMA = "range int, state binary"


def row_key(rows: DataFrame, seed: int) -> F.Column:
    """A hash of the text, and of doc_id where there is one: copies under other ids are other rows."""
    return F.xxhash64(*(c for c in ("doc_id", "text") if c in rows.columns), F.lit(seed))


def share_of(key: F.Column, rows: int, total: int) -> F.Column:
    """Whether a key is among about ``rows`` of ``total``."""
    return F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, total))) + 1


def packed_sample(rows: DataFrame, sample: int, seed: int, shard_rows: int, pack: Callable[[pa.Array], list[bytes]], scratch: Scratch) -> DataFrame | None:
    """(label, key, places, shard) of about ``sample`` different rows of (text, label), as a
    table, dealt to shards of about ``shard_rows``; None without rows.  Rows alike in all that counts are one, so a text that is most
    of the rows can't fill the sample."""
    total = rows.count()
    if not total:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(0)):
                label, key = (batch.column(k).slice(start, len(part)) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([label, key, pa.array(pack(part), pa.binary())], names=["label", "key", "places"])

    chosen = small_batches(rows).select("text", F.col("label").cast("int").alias("label"), row_key(rows, seed).alias("key")).where(share_of(F.col("key"), sample, total))
    packed = chosen.mapInArrow(run, "label int, key long, places binary").groupBy("key", "label").agg(F.first("places").alias("places"))
    shards = -(-min(total, sample) // shard_rows)
    return scratch.save(packed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), "sample")


def range_rows(ranges: Sequence[Sequence[np.ndarray]]) -> pd.DataFrame:
    """A shard's state: one row for each range, its arrays end to end."""
    return pd.DataFrame({"range": range(len(ranges)), "state": [zlib.compress(np.concatenate(x).tobytes(), 1) for x in ranges]})


def mean_of_ranges(states: DataFrame) -> list[np.ndarray]:
    """The means over shards of all ranges, in order; rounded, so that the order of sums doesn't show."""

    def mean(one: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(zlib.decompress(x), np.float64) for x in one["state"]]
        return pd.DataFrame({"range": one["range"].iloc[:1], "state": [zlib.compress((np.sum(arrays, axis=0) / len(arrays)).round(9).tobytes(), 1)]})

    rows = states.groupBy("range").applyInPandas(mean, RANGE_SCHEMA).collect()
    return [np.frombuffer(zlib.decompress(r["state"]), np.float64) for r in sorted(rows, key=lambda r: r["range"])]
