"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (expected copies).  Among all rates under which every
source gives its target of words, entropy balancing takes those nearest, in
relative entropy, to equal ones.  The dual has one variable a source and its
optimum is an exponential tilt, ``rate = min(most, exp(tilt * size / scale))``.
Newton steps, safeguarded by a bracket, find the tilts of all sources together;
each step is one distributed aggregation over a histogram (source, size, rows),
which is all that the sums depend on.

Rates become copies: the whole part, and for the rest one more copy or none.
Within a block of bounded size the choice runs from the longest document to the
shortest and carries the error along, so that short documents make up for long
ones; a source of any size is many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in order.  ``share``: words of the mix as a part
    of all words.  ``most``: copies of a document at most, and the target of a source as
    a multiple of its words.  ``block``: rows that are rounded together, about."""

    weights: Sequence[float] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block: int = 2_000
    steps: int = 60
    tolerance: float = 1e-5


def sized(docs: DataFrame) -> DataFrame:
    """Add __size: words of the whole text, 0 for null."""
    return docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: Sequence[int], params: MixParams) -> list[float]:
    """Targets of sources with ``sizes`` words, given in order.

    What exceeds ``most`` times a source goes to the others by weight, until none
    is above; sources without words get nothing.  Where even all caps together
    are below the total, every target is its cap.
    """
    caps = [params.most * n for n in sizes]
    weights = [params.weights[i % len(params.weights)] for i in range(len(sizes))]
    left, free, out = params.share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / total > caps[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = caps[i]
        left = max(0.0, left - sum(caps[i] for i in over))
        free -= set(over)
    return out


def _small(sources: DataFrame, n: int, most: int = 50_000) -> DataFrame:
    """Sent to all tasks up to ``most`` sources, a plain join beyond."""
    return F.broadcast(sources) if n <= most else sources


def _tilts(histogram: DataFrame, plan: pd.DataFrame, params: MixParams) -> pd.DataFrame:
    """Newton on the dual: the tilt of every source; one aggregation a step."""
    spark = histogram.sparkSession
    plan = plan.assign(low=-np.inf, high=np.inf, tilt=np.log(np.maximum(plan["target"], 1e-300) / np.maximum(plan["source_size"], 1)))
    plan["done"] = (plan["target"] >= params.most * plan["source_size"]) | (plan["target"] <= 0)
    for _ in range(params.steps):
        if plan["done"].all():
            break
        now = _small(spark.createDataFrame(plan.loc[~plan["done"], ["part", "tilt", "scale"]]), len(plan))
        z = F.col("__size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        words = F.col("rows") * F.col("__size")
        sums = {
            r["part"]: (r["value"], r["slope"])
            for r in histogram.join(now, "part")
            .groupBy("part")
            .agg(
                F.sum(F.least(rate, F.lit(params.most)) * words).alias("value"),
                F.sum(F.when(rate < params.most, rate * z * words).otherwise(0.0)).alias("slope"),
            )
            .collect()
        }
        for i in plan.index[~plan["done"]]:
            value, slope = sums[plan.at[i, "part"]]
            gap, tilt = value - plan.at[i, "target"], plan.at[i, "tilt"]
            if abs(gap) <= params.tolerance * plan.at[i, "target"]:
                plan.at[i, "done"] = True
                continue
            plan.at[i, "high" if gap > 0 else "low"] = tilt
            low, high = plan.at[i, "low"], plan.at[i, "high"]
            step = tilt - gap / slope if slope > 0 else np.nan
            if not (low < step < high):  # outside the bracket: halve or widen it
                step = (low + high) / 2 if np.isfinite(low) and np.isfinite(high) else (tilt + 1 + abs(tilt) if gap < 0 else tilt - 1 - abs(tilt))
            plan.at[i, "tilt"] = round(step, 12)
    return plan


def _round_block(block: pd.DataFrame, most: float) -> pd.DataFrame:
    """Copies of the rows of one block, longest first, the error carried along.

    A row stands for ``rows`` that are alike: each has ``copies``, and ``more`` of them one more."""
    block = block.sort_values(["size", "__id", "__row"], ascending=[False, True, True], na_position="last", kind="stable")
    sizes, rates, rows = block["size"].to_numpy(), block["rate"].to_numpy(), block["rows"].to_numpy()
    whole = np.floor(rates + 1e-9)
    copies, more, error = whole.astype("int64"), np.zeros(len(block), np.int64), 0.0
    for i in np.flatnonzero((rates - whole > 1e-9) & (whole < most)):
        error += rows[i] * (rates[i] - whole[i]) * sizes[i]
        more[i] = min(max(int(np.floor(error / sizes[i] + 0.5)), 0), rows[i])
        error -= more[i] * sizes[i]
    return block.assign(copies=copies, more=more)


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Rows (doc_id, __row, size, source, source_size, target, rate, copies) of all documents.

    Null sources are one source, last in order.  Null, empty and wordless texts
    have size 0, rate 0 and no copy.  Rows that repeat a doc_id count each on
    their own; ``__row``, a hash of the text, tells them apart, and full repeats
    are one row with a count until their copies are known.  The number of sources is taken to fit in the driver:
    their sizes and targets are collected, nothing else.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    rows = sized(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.xxhash64("text").alias("__row"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("part"), "source", "__size"
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    rows = scratch.save(rows, "sizes")
    histogram = scratch.save(rows.groupBy("part", "source", "__size").agg(F.sum("rows").alias("rows")), "histogram")
    totals = histogram.groupBy("part", "source").agg(F.sum(F.col("rows") * F.col("__size")).alias("n"), F.sum("rows").alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = pd.DataFrame({"part": [r["part"] for r in totals], "source_size": [int(r["n"]) for r in totals], "rows": [int(r["rows"]) for r in totals]})
    plan["target"] = targets(plan["source_size"].tolist(), params)
    plan["scale"] = np.maximum(plan["source_size"] / np.maximum(plan["rows"], 1), 1.0)
    plan["full"] = plan["target"] >= params.most * plan["source_size"]
    plan = _tilts(histogram, plan, params) if len(plan) else plan.assign(tilt=0.0)
    plan["blocks"] = np.maximum(1, np.ceil(plan["rows"] / params.block)).astype("int64")
    schema = "part string, source_size long, target double, scale double, full boolean, tilt double, blocks long"
    by_source = spark.createDataFrame(plan[[c.split()[0] for c in schema.split(", ")]], schema)
    rate = F.when(F.col("__size") == 0, 0.0).when(F.col("target") <= 0, 0.0).when(F.col("full"), F.lit(float(params.most)))
    rate = rate.otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("__size") / F.col("scale"), F.lit(50.0))), F.lit(float(params.most))))
    rated = rows.join(_small(by_source.withColumnRenamed("rows", "all"), len(plan)), "part").withColumn("rate", rate)
    rated = rated.withColumn("__block", F.pmod(F.xxhash64("doc_id", "__row"), F.col("blocks")))
    most = params.most
    schema = "__id string, __row long, source string, size long, source_size long, target double, rate double, rows long, copies long, more long"
    names = [c.split()[0] for c in schema.split(", ")]
    rated = rated.select("part", "__block", F.col("doc_id").cast("string").alias("__id"), "__row", "source", F.col("__size").alias("size"), "source_size", "target", "rate", "rows")
    out = rated.groupBy("part", "__block").applyInPandas(lambda block: _round_block(block, most)[names], schema)
    each = out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = (F.col("copies") + F.when(F.col("k") <= F.col("more"), 1).otherwise(0)).alias("copies")
    return each.select(F.col("__id").cast("long").alias("doc_id"), *names[1:7], copies)
