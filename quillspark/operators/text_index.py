"""A kept full-text index: blocks of postings by term, written once, added to by generations.

Under one folder: ``postings`` by generation and bucket of the term, sorted by term;
``documents`` (id, length) and ``gone`` (id and generation that no longer count) by
generation; ``totals``, a row a generation.  A search reads the buckets of its terms alone
and never the documents' text.  Replacing documents writes a generation of its own and a
note of the versions that it replaces, and touches nothing that is there; writing a
generation again gives the same folders, so a batch that failed can be run again.

A block holds up to 128 postings of a term whose weights are alike, with the bounds of
what any of them can add to a score.  So blocks that can't lift a text into the first
``k`` are skipped by their bounds, and the hits are those of a full evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.retrieval import MOST_QUERIES, MOST_TERMS, postings, query_terms, top_k
from quillspark.scratch import Scratch

BUCKETS, BLOCK = 64, 128


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(rows: DataFrame, id_type: str) -> DataFrame:
    """Runs of postings of one term and class, cut every ``BLOCK`` rows.

    ``rows`` are sorted in their partitions, so a task cuts as it reads and holds one open block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            whole, new = table.to_batches()[0], np.ones(table.num_rows, bool)
            for name in ("term", "class"):
                column = whole.column(name)
                differs = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                new[1:] = differs if name == "term" else new[1:] | differs
            starts = np.flatnonzero(new)
            place = np.arange(len(new)) - starts[np.cumsum(new) - 1]
            begins = np.flatnonzero(place % BLOCK == 0)
            if begins[-1]:
                yield pack(whole.slice(0, begins[-1]), begins[:-1])
            held = whole.slice(begins[-1])
        if held is not None:
            yield pack(held, np.zeros(1, np.int64))

    def pack(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        values = {name: batch.column(name) for name in ("weight", "length")}
        ends, weight, length = pa.array(np.append(begins, batch.num_rows), pa.int32()), *(v.to_numpy(zero_copy_only=False) for v in values.values())
        columns = [
            batch.column("bucket").take(pa.array(begins)), batch.column("term").take(pa.array(begins)), pa.array(np.diff(np.append(begins, batch.num_rows)), pa.int64()),
            pa.array(np.maximum.reduceat(weight, begins)), pa.array(np.minimum.reduceat(length, begins)),
            *(pa.ListArray.from_arrays(ends, pa.concat_arrays([batch.column(name)])) for name in ("id", "weight", "length")),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "term", "n", "most_weight", "least_length", "ids", "weights", "lengths"])

    return rows.mapInArrow(cut, _SCHEMA.format(id_type))


_SCHEMA = "bucket int, term string, n long, most_weight double, least_length double, ids array<{}>, weights array<double>, lengths array<double>"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks, with the generation of each."""
    kind = dict(spark.read.parquet(f"{path}/documents").dtypes)["id"]
    return spark.read.schema(_SCHEMA.format(kind) + ", generation int").parquet(f"{path}/postings")


def _write(postings: DataFrame, path: str, generation: int) -> None:
    """Blocks of ``postings`` (id, term, weight, length). They are sorted by ranges, so no term, however
    frequent, is one task's; classes part what can add much to a score from what can't."""
    grade = F.floor(8 * F.col("weight") / (F.col("weight") + 1 + F.col("length") / 256)).cast("int")
    order = ["bucket", "term", F.desc("class"), "id"]
    rows = postings.select(bucket().alias("bucket"), "term", grade.alias("class"), "id", "weight", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    _blocks(rows, dict(postings.dtypes)["id"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")


def _read(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame | None:
    """A side table, of generations before one where that is given; None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return None
    rows = spark.read.parquet(f"{path}/{name}")
    return rows if before is None else rows.where(F.col("generation") < before)


def add(corpus: DataFrame, path: str, generation: int = 0, removed: DataFrame | None = None) -> None:
    """Index ``corpus`` (id, low; one row an id) as one generation; its ids, and those of ``removed`` (id),
    no longer count in older generations. Generations are added in order; 0 begins an index.
    Texts without a term are no documents."""
    with Scratch(corpus.sparkSession, "indexing") as scratch:
        _add(corpus, path, generation, removed, scratch)


def _add(corpus: DataFrame, path: str, generation: int, removed: DataFrame | None, scratch: Scratch) -> None:
    spark = corpus.sparkSession
    index = postings(corpus)
    each = index.select("id", "length", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    _write(each.select("id", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"), "length"), path, generation)
    index.select("id", "length").write.mode("overwrite").parquet(f"{path}/documents/generation={generation}")
    scratch.drop(index)

    ids = corpus.select("id") if removed is None else corpus.select("id").unionByName(removed.select("id"))
    older = _read(spark, path, "documents", generation)
    gone = spark.createDataFrame([], f"id {dict(corpus.dtypes)['id']}, of int, length double")
    if older is not None:
        gone = older.select("id", F.col("generation").cast("int").alias("of"), "length").join(ids.distinct(), "id", "left_semi")
        if (before := _read(spark, path, "gone", generation)) is not None:
            gone = gone.join(before.select("id", "of"), ["id", "of"], "left_anti")
    gone.write.mode("overwrite").parquet(f"{path}/gone/generation={generation}")
    sums = lambda t: t.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length")).first()
    new, old = sums(spark.read.parquet(f"{path}/documents/generation={generation}")), sums(spark.read.parquet(f"{path}/gone/generation={generation}"))
    totals = spark.createDataFrame([(new["n"] - old["n"], new["length"] - old["length"])], "n long, length double")
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/generation={generation}")


def _live(rows: DataFrame, path: str) -> DataFrame:
    """Postings (id, generation) whose version of the document still counts."""
    gone = _read(rows.sparkSession, path, "gone").select("id", F.col("of").alias("generation"))
    return rows if gone.isEmpty() else rows.join(gone, ["id", "generation"], "left_anti")


def _exploded(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("x", F.explode(F.arrays_zip("ids", "weights", "lengths"))).select("*", F.col("x.ids").alias("id"), F.col("x.weights").alias("weight"), F.col("x.lengths").alias("length")).drop("x", "ids", "weights", "lengths")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write what counts as one generation of a new index."""
    live = _live(_exploded(blocks(spark, path)), path).select("id", "term", "weight", "length")
    _write(live, into, 0)
    documents = live.sparkSession.read.schema(_SCHEMA.format(dict(live.dtypes)["id"])).parquet(f"{into}/postings").select(F.explode(F.arrays_zip("ids", "lengths")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg(F.first("x.lengths").alias("length"))
    documents.write.mode("overwrite").parquet(f"{into}/documents/generation=0")
    spark.createDataFrame([], f"id {dict(live.dtypes)['id']}, of int, length double").write.mode("overwrite").parquet(f"{into}/gone/generation=0")
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{into}/totals/generation=0")


def search(queries: DataFrame, path: str, k: int, k1: float = 1.2, b: float = 0.75, first: int = 4) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of the index for each of ``queries`` (query_id, query) by BM25.

    The ``first`` blocks of each term, those that can add most, give each question a score that
    ``k`` documents have at least; other blocks are read only if, with all that the question's
    other terms can add, they reach it."""
    spark, scratch = queries.sparkSession, Scratch(queries.sparkSession, "bm25")
    rows = queries.limit(MOST_QUERIES + 1)
    if rows.count() > MOST_QUERIES:
        raise ValueError(f"a batch holds {MOST_QUERIES} queries at most")
    asked = scratch.save(query_terms(queries).select("query_id", F.explode("query_terms").alias("term")), "asked")
    terms = asked.select("term", bucket().alias("bucket")).distinct().limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} different terms in one batch")
    named = F.broadcast(spark.createDataFrame([(r["term"],) for r in terms], "term string"))
    table = blocks(spark, path).where(F.col("bucket").isin(sorted({r["bucket"] for r in terms})))
    if len(terms) <= 200:  # few terms are looked up in the files' own statistics
        table = table.where(F.col("term").isin([r["term"] for r in terms]))
    table = table.join(named, "term", "left_semi")
    whole = _read(spark, path, "totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    mean = F.lit(max(whole["length"] or 0.0, 1e-9) / max(1, whole["n"] or 0))
    part = lambda w, size: F.col(w) * (k1 + 1) / (F.col(w) + k1 * (1 - b + b * F.col(size) / mean))
    heads = scratch.save(table.select("term", "generation", F.get("ids", F.lit(0)).alias("head"), "n", part("most_weight", "least_length").alias("most")), "heads")
    counted = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("top"))
    gone = _read(spark, path, "gone")
    if not gone.isEmpty():
        held = _exploded(table.select("term", "generation", "ids", "weights", "lengths"))
        dead = held.join(gone.select("id", F.col("of").alias("generation")), ["id", "generation"], "left_semi").groupBy("term").agg(F.count("*").alias("dead"))
        counted = counted.join(dead, "term", "left").withColumn("df", F.col("df") - F.coalesce("dead", F.lit(0)))
    df = F.col("df")
    idf = F.log1p((F.lit(whole["n"] or 0) - df + 0.5) / (df + 0.5))
    weighed = asked.join(counted, "term").select("query_id", "term", idf.alias("idf"), (idf * F.col("top")).alias("top"))
    every = weighed.groupBy("query_id").agg(F.sum("top").alias("every"))
    weighed = scratch.save(weighed.join(every, "query_id").select("query_id", "term", "idf", (F.col("every") - F.col("top")).alias("others")), "weights")

    def scores(blocks: DataFrame, by: DataFrame, could: Column | None = None) -> DataFrame:
        rows = blocks.join(F.broadcast(by), "term")  # a row a question and term
        rows = rows if could is None else rows.where(could)
        rows = _live(_exploded(rows), path)
        return rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * part("weight", "length")), 6).alias("score"))

    best = top_k(heads, first, ["term"], [F.desc("most"), F.asc("generation"), F.asc("head")]).select("term", "generation", "head")
    begun = table.withColumn("head", F.get("ids", F.lit(0))).join(F.broadcast(best), ["term", "generation", "head"], "left_semi")  # ``first`` a term
    least = top_k(scores(begun, weighed), k, ["query_id"], [F.desc("score"), F.asc("id")]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    by = scratch.save(weighed.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - 2e-6), "least")
    could = F.col("idf") * part("most_weight", "least_length") + F.col("others") >= F.col("least")
    return top_k(scores(table, by, could), k, ["query_id"], [F.desc("score"), F.asc("id")])
