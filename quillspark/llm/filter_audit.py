"""Interaction audit of text filters: what every order of them removes at each step.

A document is reduced to a mask of the filters that it fails, and documents to counts
by (part, mask): 2 ** k cells a part, whatever the input.  All orders are then visited
by swaps of two neighbours (plain changes).  A swap leaves the set of filters before
and after the two alone, so only these two steps are counted anew, from the cells; the
Shapley sums grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.expressions import ascii_words, count_of, let, same_text
from quillspark.scratch import Scratch

OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
#: Parts that one step of a task holds with all their orders.
_PARTS = 64


def plain_changes(k: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of ``k`` things, each by one swap of places (i, i + 1) from the last; the first has None."""
    order, left = list(range(k)), [True] * k
    yield order, None
    while True:
        for thing in reversed(range(k)):
            at = order.index(thing)
            to = at - 1 if left[thing] else at + 1
            if 0 <= to < k and order[to] < thing:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        left[thing + 1 :] = [not x for x in left[thing + 1 :]]
        yield order, min(at, to)


def orders(cells: np.ndarray, letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Counts of every order over ``cells`` (part, mask, [documents, good, toxic]).

    Names of the orders; (part, order, step, [kept, removed, redundant, good lost, toxic lost]);
    Shapley sums (part, filter)."""
    k, masks = len(letters), np.arange(1 << len(letters))
    names, steps = [], np.zeros((len(cells), k, 5), np.int64)
    out = np.zeros((len(cells), *_shape(k)), np.int64)
    shapley = np.zeros((len(cells), k), np.int64)

    def count(order: list[int], i: int) -> None:
        before, bit = sum(1 << f for f in order[:i]), 1 << order[i]
        passed, fails = masks & before == 0, masks & bit != 0
        gone = cells[:, passed & fails].sum(axis=1)
        steps[:, i, 0] = cells[:, passed & ~fails, 0].sum(axis=1)
        steps[:, i, 1] = gone[:, 0]
        steps[:, i, 2] = cells[:, ~passed & fails, 0].sum(axis=1)
        steps[:, i, 3:] = gone[:, 1:]

    for n, (order, swapped) in enumerate(plain_changes(k)):
        for i in range(k) if swapped is None else (swapped, swapped + 1):
            count(order, i)
        names.append("".join(letters[f] for f in order))
        out[:, n] = steps
        shapley[:, order] += steps[:, :, 1]
    return names, out, shapley


def _shape(k: int) -> tuple[int, int, int]:
    return int(np.prod(np.arange(1, k + 1))), k, 5


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """Every order and step of each part of ``cells`` (part, mask, n, good, toxic).

    A part has one row of at most 2 ** k cells, so parts are dealt over all tasks.
    """
    k = len(letters)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), _PARTS):
                rows = frame.iloc[at : at + _PARTS]
                table = np.zeros((len(rows), 1 << k, 3), np.int64)
                for i, found in enumerate(rows["cells"]):
                    for c in found:
                        table[i, c["mask"]] += (c["n"], c["good"], c["toxic"])
                names, steps, shapley = orders(table, letters)
                of = np.array([[letters.index(x) for x in name] for name in names])
                alone = table[:, [1 << f for f in range(k)], 0]
                each = len(names) * k
                columns = dict(zip(("kept", "removed", "redundant", "good_lost", "toxic_lost"), np.moveaxis(steps, -1, 0).reshape(5, -1)))
                yield pd.DataFrame(
                    {
                        "part": np.repeat(rows["part"].to_numpy(), each),
                        "filter_order": np.tile(np.repeat(names, k), len(rows)),
                        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows) * len(names)),
                        "unique_fails": alone[:, of].reshape(-1),
                        "shapley": shapley[:, of].reshape(-1),
                        **columns,
                    }
                )[[c.split()[0] for c in OUT.split(", ")]]

    return parts.mapInPandas(walk, OUT)


#: Letters of the filters, in the order of their bits.
LETTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A under 50 words, B under 65 % distinct words,
    C over 5 % capitals, D any of # $ % & * |."""

    def bits(t: Column, n: Column, distinct: Column) -> Column:
        fails = (n < 50, 100 * distinct < 65 * n, 100 * count_of(t, _CAPITALS) > 5 * F.length(t), t.rlike("[#$%&*|]"))
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    counted = lambda t: let(ascii_words(t), lambda w: bits(t, F.size(w), F.size(F.array_distinct(w))))
    return let(text, counted).cast("int")


def cells(docs: DataFrame, labels: DataFrame, most_hot: int = 100_000) -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, text, source) under the five filters.

    E: a smaller doc_id has the same text.  Texts travel as digests.  Of each repeated text
    the smallest id is joined back; texts so frequent that a join would be uneven are at
    most ``most_hot`` by their share of the rows, and those alone are broadcast.
    ``labels`` (doc_id, quality, toxic): a document is good (toxic) if any of its labels is 1.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", part.alias("part"), text_mask(text).alias("mask"), same_text(text).alias("digest"))
    rows = scratch.save(rows, "masks")
    total = rows.count()
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = scratch.save(first.where("n > 1"), "first")
    frequent = F.col("n") > max(1_000, total // most_hot)  # at most ``most_hot`` texts have so many rows
    rows = rows.join(F.broadcast(first.where(frequent).select("digest", F.col("first").alias("hot"))), "digest", "left")
    hot = rows.where(F.col("hot").isNotNull()).withColumn("first", F.col("hot"))
    rest = rows.where(F.col("hot").isNull()).join(first.where(~frequent).select("digest", "first"), "digest", "left")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    whole = hot.unionByName(rest).select("doc_id", "part", (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask"))
    counted = whole.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # rows that repeat an id meet labels once
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality"), one("toxic"))
    labelled = counted.join(rated.where("quality + toxic > 0"), "doc_id", "left")
    share = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("quality").alias("good"), share("toxic").alias("toxic"))
