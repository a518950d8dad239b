"""Ordinal quality: a cumulative-link model over hashed text.

One weight vector is shared by all grades; ordered thresholds cut its line, so
``P(grade <= k) = logistic(threshold[k] - score)``.  The score of a text is the mean
weight of its words' features: the word, its ending and its shape.  It gives an
expected grade, and the chance of a grade at least as high as one asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shards import RANGE_SCHEMA, mean_of_ranges, packed_sample, range_rows
from quillspark.llm.text import SPACES, U64, mix, pieces, small_batches, words
from quillspark.scratch import Scratch


@dataclass(frozen=True)
class OrdinalParams:
    """``grades``: grades 0 to grades - 1. ``sample``: different labelled rows of a fit, about,
    chosen by a hash of the row. ``bits``: log2 of the weights, summed in ``ranges``.
    Shards of about ``shard_rows`` learn side by side and are averaged after each of
    ``rounds``, of ``steps`` AdaGrad steps each."""

    grades: int = 3
    sample: int = 12_000
    bits: int = 16
    ranges: int = 16
    shard_rows: int = 4_000
    rounds: int = 3
    steps: int = 25
    rate: float = 1.0
    l2: float = 1e-6
    seed: int = 17


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, coordinate): of each word its case-folded hash, its last two bytes and its last byte."""
    owners, places, shift = [], [], U64(64 - bits)
    for k, (fold, tail) in enumerate(((True, 0), (False, 2), (False, 1))):
        found = words(texts, SPACES, fold, tail)
        owners.append(found.owner)
        places.append((mix((found.tails if tail else found.hashes) + U64(k)) >> shift).astype(np.int64))
    return np.concatenate(owners), np.concatenate(places)


def _all_places(texts: pa.Array, bits: int) -> list[bytes]:
    """The coordinates of each text, repeats included, packed."""
    owner, place = features(texts, bits)
    order = np.argsort(owner, kind="stable")
    place, cut = place[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [place[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(texts))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def thresholds(cuts: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first as it is, each next by a positive step."""
    return cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])


def _learn(rows: pd.DataFrame, w: np.ndarray, cuts: np.ndarray, p: OrdinalParams) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch AdaGrad on the negative log likelihood of one shard."""
    w, cuts = w.copy(), cuts.copy()
    parts = [np.frombuffer(x, np.int32) for x in rows["places"]]
    lengths = np.maximum(1, np.array([len(x) for x in parts]))
    flat = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    grade = rows["label"].to_numpy()
    gw, gc = np.full(len(w), 1e-12), np.full(len(cuts), 1e-12)
    for _ in range(p.steps):
        score = np.bincount(owner, weights=w[flat], minlength=len(parts)) / lengths
        edges = np.concatenate([[-np.inf], thresholds(cuts), [np.inf]])
        low, high = _sigmoid(edges[grade] - score), _sigmoid(edges[grade + 1] - score)
        chance = np.maximum(high - low, 1e-9)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        by_score = (slope_high - slope_low) / chance / len(parts)
        grad_w = np.bincount(flat, weights=(by_score / lengths)[owner], minlength=len(w)) + p.l2 * w
        by_edge = np.zeros(p.grades + 1)
        np.add.at(by_edge, grade + 1, -slope_high / chance / len(parts))
        np.add.at(by_edge, grade, slope_low / chance / len(parts))
        inner = by_edge[1:-1]
        grad_c = np.array([inner[k:].sum() * (1.0 if k == 0 else np.exp(cuts[k])) for k in range(len(cuts))])
        gw += grad_w**2
        gc += grad_c**2
        w -= p.rate * grad_w / np.sqrt(gw)
        cuts -= 0.1 * p.rate * grad_c / np.sqrt(gc)
    return w, cuts


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int


def fit(labelled: DataFrame, params: OrdinalParams = OrdinalParams()) -> Ordinal:
    """Train on rows (text, label 0 .. grades - 1); other and null labels teach nothing.

    Rows alike in text and label (and doc_id, where there is one) teach once.
    Without rows the weights are 0 and all grades stand where the first thresholds put them.
    """
    spark, scratch, p = labelled.sparkSession, Scratch(labelled.sparkSession, "ordinal"), params
    packed = packed_sample(labelled.where(F.col("label").between(0, p.grades - 1)), p.sample, p.seed, p.shard_rows, lambda part: _all_places(part, p.bits), scratch)
    w, cuts = np.zeros(1 << p.bits), np.zeros(p.grades - 1)
    for _ in range(p.rounds if packed else 0):
        state = spark.sparkContext.broadcast((w, cuts))

        def learn(shard: pd.DataFrame) -> pd.DataFrame:
            w1, c1 = _learn(shard.sort_values(["key", "label"], kind="stable"), *state.value, p)
            return range_rows([*((x,) for x in np.split(w1, p.ranges)), (c1,)])

        *ranges, cuts = mean_of_ranges(packed.groupBy("shard").applyInPandas(learn, RANGE_SCHEMA))
        w = np.concatenate(ranges)
        state.destroy()
    if packed:
        scratch.drop(packed)
    return Ordinal(w.astype(np.float32), thresholds(cuts), p.bits)


def grade(docs: DataFrame, model: Ordinal, at_least: int = 1, text: str = "text", into: str = "grade") -> DataFrame:
    """Add one column ``into`` to every row: a struct of expected_grade and tail_prob, P(grade >= at_least).

    Null, empty and wordless texts have score 0: the thresholds alone decide.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_prob double")
    def graded(column: pd.Series) -> pd.DataFrame:
        model, out = shared.value, [np.zeros(0)]
        for _, part in pieces(pa.array(column, pa.string())):
            owner, place = features(part, model.bits)
            n = np.maximum(1, np.bincount(owner, minlength=len(part)))
            out.append(np.bincount(owner, weights=model.weights[place], minlength=len(part)) / n)
        above = 1 - _sigmoid(model.thresholds[None, :] - np.concatenate(out)[:, None])
        return pd.DataFrame({"expected_grade": above.sum(axis=1), "tail_prob": above[:, at_least - 1]})

    return small_batches(docs).withColumn(into, graded(F.col(text)))
