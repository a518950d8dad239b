"""Preparation of a training corpus: five stages, each a table to the next.

Every stage but the last returns the columns of ``documents``: those rows that it
keeps.  The last returns how many copies of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language_id, minhash_dedup, mixing, queries, toxicity
from quillspark.llm.text import unused
from quillspark.scratch import Scratch


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter or fit two languages about equally well.

    Repeated rows are judged alike; other columns stay, whatever their names.
    Very long texts are judged whole; ties go to the first language by name; no rows give none."""
    dictionaries = language_id.fit(docs.where(queries.fold("doc_id", 4) != 2))
    into = unused(docs.columns, "__language")
    return language_id.identify(docs, dictionaries, into=into).where(F.col(into)["sure"]).drop(into)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose toxicity is 0.7 or more; learns from the labels of those that it is given.

    Null and empty texts have the intercept's; repeated rows are judged alike; other columns stay.
    Very long texts are scored whole; a score at the threshold goes; no rows give none."""
    model = queries.toxicity_model(docs, queries.read(spark, sf_dir, "labels"))
    into = unused(docs.columns, "__toxicity")
    return toxicity.score(docs, model, into=into).where(F.col(into) < 0.7).drop(into)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays.

    Null and wordless texts, and rows without a doc_id, all stay; of full repeats one does.
    Very long texts are compared whole; a similarity at the threshold links; other columns stay,
    whatever their names; no rows give none."""
    return minhash_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that hold a test item; a text is known by its hash, with an id or without.

    Null and empty texts hold none; repeated rows go or stay together; other columns stay.
    Very long texts are asked whole; an overlap at the threshold counts; no rows on either side give
    what they should: none, or all documents."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.matches(keyed, queries.read(spark, sf_dir, "benchmark")).where("leaked")
    leak = unused(docs.columns, "__leak")
    leaks = Scratch(spark, "leaks").save(found.select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    small = F.broadcast(leaks) if leaks.count() <= 1_000_000 else leaks  # 8 bytes each
    return docs.join(small, F.xxhash64("text") == F.col(leak), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document, and the words that they come to.

    Null, empty and wordless texts have size 0 and no copy; repeated rows each count; null
    sources are one source, the last.
    Very long texts count whole; rows of equal size go by hash; columns other than those read are
    ignored; no rows give none."""
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", keep_civil),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Compression, learned weights and error-carrying rounding have no SQL form; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
