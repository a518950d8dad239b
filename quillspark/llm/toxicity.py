"""Toxicity by FTRL-proximal logistic regression over hashed words, pairs and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps the weights
sparse.  A fit runs a few rounds; in each, every shard of the labelled sample
passes over its rows from the shared state, and the states are averaged range by
range of coordinates.  The state is 2 ** bits coordinates whatever the data; it
travels as packed arrays, a few rows of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shards import RANGE_SCHEMA, mean_of_ranges, packed_sample, range_rows
from quillspark.llm.text import MARKS, U64, grams, pieces, small_batches, words
from quillspark.scratch import Scratch


@dataclass(frozen=True)
class FtrlParams:
    """``sample``: different labelled rows of a fit, about, chosen by a hash of the row.
    ``bits``: log2 of the coordinates, summed in ``ranges``. ``shard_rows``: rows of
    a shard, about; shards pass over their rows side by side. ``rounds``: passes. alpha, beta, l1, l2: the usual
    FTRL-proximal constants."""

    sample: int = 30_000
    bits: int = 18
    ranges: int = 64
    shard_rows: int = 4_000
    rounds: int = 6
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1e-3
    seed: int = 13


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, coordinate) of all words, neighbour pairs and pairs with one word between."""
    found, shift = words(texts, MARKS), U64(64 - bits)
    parts = [grams(found, 1), grams(found, 2), grams(found, 2, step=2)]
    owner = np.concatenate([o for _, o in parts])
    return owner, np.concatenate([(h >> shift).astype(np.int64) for h, _ in parts])


def _distinct(owner: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((owner << bits) | place)
    return keys >> bits, keys & ((1 << bits) - 1)


def _gaps(place: np.ndarray) -> bytes:
    """Ascending coordinates as 16-bit gaps; 65535 adds itself to the next."""
    whole, rest = np.divmod(np.diff(place, prepend=0), 65_535)
    out = np.full(int(whole.sum()) + len(place), 65_535, np.uint16)
    out[np.cumsum(whole + 1) - 1] = rest
    return out.tobytes()


def _places(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65_535]


def _sparse(texts: pa.Array, bits: int) -> list[bytes]:
    """The distinct coordinates of each text, packed."""
    owner, place = _distinct(*features(texts, bits), bits)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [_gaps(place[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]


def _weights(z: np.ndarray, n: np.ndarray, p: FtrlParams) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0.0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def _pass(rows: pd.DataFrame, z: np.ndarray, n: np.ndarray, bias: np.ndarray, p: FtrlParams) -> None:
    """One pass over a shard's rows; changes the state in place. bias is (z, n) of a
    coordinate that every row has and L1 doesn't shrink."""
    for label, packed in zip(rows["label"], rows["places"]):
        at = _places(packed)
        zi, ni = z[at], n[at]
        w = _weights(zi, ni, p)
        base = -bias[0] / ((p.beta + bias[1] ** 0.5) / p.alpha)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + base, -35, 35))) - label
        new = ni + g * g
        z[at] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / p.alpha * w
        n[at] = new
        fresh = bias[1] + g * g
        bias[0] += g - (fresh**0.5 - bias[1] ** 0.5) / p.alpha * base
        bias[1] = fresh


@dataclass
class Toxic:
    """Sparse weights and the intercept."""

    weights: np.ndarray
    intercept: float
    bits: int


def fit(labelled: DataFrame, params: FtrlParams = FtrlParams()) -> Toxic:
    """Train on rows (text, label 0/1); a null label teaches nothing, a null text is empty.

    Rows alike in text and label (and doc_id, where there is one) teach once.
    Without rows all weights and the intercept are 0: every text scores 0.5.
    """
    spark, scratch, p = labelled.sparkSession, Scratch(labelled.sparkSession, "ftrl"), params
    packed = packed_sample(labelled.where(F.col("label").isNotNull()), p.sample, p.seed, p.shard_rows, lambda part: _sparse(part, p.bits), scratch)
    z, n, bias = np.zeros(1 << p.bits), np.zeros(1 << p.bits), np.zeros(2)
    for _ in range(p.rounds if packed else 0):
        state = spark.sparkContext.broadcast((z, n, bias))

        def learn(shard: pd.DataFrame) -> pd.DataFrame:
            z0, n0, b0 = (x.copy() for x in state.value)
            _pass(shard.sort_values(["key", "label"], kind="stable"), z0, n0, b0, p)
            return range_rows([*zip(np.split(z0, p.ranges), np.split(n0, p.ranges)), (b0,)])

        merged = mean_of_ranges(packed.groupBy("shard").applyInPandas(learn, RANGE_SCHEMA))
        bias = merged.pop()
        z, n = (np.concatenate(x) for x in zip(*(np.split(m, 2) for m in merged)))
        state.destroy()
    if packed:
        scratch.drop(packed)
    intercept = -bias[0] / ((p.beta + bias[1] ** 0.5) / p.alpha)
    return Toxic(_weights(z, n, p).astype(np.float32), float(intercept), p.bits)


def score(docs: DataFrame, model: Toxic, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add ``into`` (0 to 1) to every row; null, empty and wordless texts get the intercept's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(column: pd.Series) -> pd.Series:
        model, out = shared.value, []
        for _, part in pieces(pa.array(column, pa.string())):
            owner, place = features(part, model.bits)
            some = np.flatnonzero(model.weights[place])
            owner, place = _distinct(owner[some], place[some], model.bits)
            total = np.bincount(owner, weights=model.weights[place], minlength=len(part)) + model.intercept
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return small_batches(docs).withColumn(into, toxicity(F.col(text)))
