"""Ingest jobs as a resumable state machine over micro-batches of documents.

A batch goes through nine steps, each a Spark job over all of its documents that are
still alive.  A step writes its table in the batch's own folder, over what an earlier
try left there, and then the receipts of its jobs: that folder is the commit.  A batch that
is run again skips the steps whose receipts are there, so it goes on where it was killed
and ends with the same tables.

A job is asked for before each step whether it is cancelled; a document that a step
can't take is that job's failure and stops nothing else.  What users read is each
document's rows of its latest finished job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.operators import governance as G
from quillspark.operators import text_index
from quillspark.streaming import cache as EC

STEPS = tuple(step for step, _, _ in C.INGEST_STEPS)
RECEIPT = "job_id long, id long, status string, error string, sha256 string"
TABLES = {
    "sources": "job_id long, id long, text string",
    "texts": "id long, text string, error string",
    "chunks": "id long, chunk_index int, content string, section_path array<string>, section_id string, page_start int, page_end int, content_type string, tokens int, sha256 string",
    "cache": "sha256 string, vector array<double>, at timestamp",
    "vectors": "id long, chunk_index int, sha256 string, vector array<double>",
    "pages": "id long, page_no int, sections array<struct<section_id:string,section_path:array<string>,chunk_index:int>>, block_count int, text string",
    "assets": "id long, n int, name string",
    "results": "id long, page_count int, chunk_count long, asset_count long, sha256 string",
}
Recognise = Callable[[DataFrame], DataFrame]


def as_it_is(sources: DataFrame) -> DataFrame:
    """The text of a source as it was sent; a null one can't be read."""
    return sources.select("id", "text", F.when(F.col("text").isNull(), "no content").alias("error"))


def each_text(read: Callable[[str | None], str]) -> Recognise:
    """A reader of single texts as a step: what it raises is the error of that document alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame["id"], frame["text"]):
                try:
                    out.append((i, read(text), None))
                except Exception as error:  # noqa: BLE001  the step goes on with the other documents
                    out.append((i, None, f"{type(error).__name__}: {error}"[:4000]))
            yield pd.DataFrame(out, columns=["id", "text", "error"])

    return lambda sources: sources.select("id", "text").mapInPandas(run, TABLES["texts"])


def by_characters(contents: DataFrame) -> DataFrame:
    """The vector of characters as the embedding of (sha256, content)."""
    return D.char_vectors(contents.select(F.col("sha256").alias("id"), F.col("content").alias("text"))).select(F.col("id").alias("sha256"), "vector")


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All batches of a table; empty where none has come."""
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], f"{TABLES[name]}, batch int")
    return spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{path}/{name}")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, id, status, error, sha256, batch, step): what each step said of each job that came to it."""
    schema = f"{RECEIPT}, batch int, step string"
    return spark.read.schema(schema).parquet(f"{path}/receipts") if _exists(spark, f"{path}/receipts") else spark.createDataFrame([], schema)


class Batch:
    """One micro-batch of (job_id, id, text) on its way through the steps."""

    def __init__(self, docs: DataFrame, number: int, path: str, recognise: Recognise, embed: EC.Embed, after: Callable[[int, str], None] | None):
        self.spark, self.docs, self.number, self.path = docs.sparkSession, docs, number, path
        self.recognise, self.embed, self.after = recognise, embed, after

    def write(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in _fields(TABLES[name])]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={self.number}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/batch={self.number}")

    def folder(self, step: str) -> str:
        return f"{self.path}/receipts/batch={self.number}/step={step}"

    def run(self) -> None:
        for n, step in enumerate(STEPS):
            if not _exists(self.spark, f"{self.folder(step)}/_SUCCESS"):
                self.take(step, STEPS[n - 1] if n else None)
                if self.after:
                    self.after(self.number, step)

    def take(self, step: str, before: str | None) -> None:
        """One step of the jobs that the step before let pass, and its receipts."""
        if before is None:  # of several jobs of a document the last counts
            first = F.max("job_id").over(_of("id"))
            rows = self.docs.select("job_id", "id").distinct().withColumn("error", F.when(F.col("job_id") < first, "a later job of the document came with it"))
        else:
            rows = self.spark.read.schema(RECEIPT).parquet(self.folder(before)).where("status = 'succeeded'").select("job_id", "id", F.lit(None).cast("string").alias("error"))
        cancels = f"{self.path}/cancels"
        if _exists(self.spark, cancels):
            asked = self.spark.read.schema("job_id long").parquet(cancels).select("job_id", F.lit(True).alias("asked")).distinct()
            rows = rows.join(asked, "job_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("asked"), "cancelled by request"))).drop("asked")
        rows = rows.withColumnRenamed("error", "stopped")
        alive = rows.where("stopped is null").select("job_id", "id")
        said = getattr(self, step)(alive)  # (id, error, sha256) of documents that it has something to say of
        out = rows.join(said, "id", "left") if said is not None else rows.withColumns({"error": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string")})
        status = F.when(F.col("stopped").isNotNull(), "cancelled").when(F.col("error").isNotNull(), "failed").otherwise("succeeded")
        out = out.select("job_id", "id", status.alias("status"), F.left(F.coalesce("stopped", "error"), F.lit(4000)).alias("error"), "sha256")
        out.write.mode("overwrite").parquet(self.folder(step))

    # the steps: each writes its table and may say (id, error, sha256)

    def upload_to_ocr(self, jobs: DataFrame) -> DataFrame:
        self.write("sources", self.docs.join(jobs, ["job_id", "id"], "left_semi").dropDuplicates(["job_id", "id"]))
        return self.read("sources").select("id", F.lit(None).cast("string").alias("error"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))

    def poll_and_fetch_ocr(self, jobs: DataFrame) -> DataFrame:
        self.write("texts", self.recognise(self.read("sources").join(jobs, ["job_id", "id"], "left_semi")))
        return self.read("texts").select("id", "error", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))

    def _texts(self, jobs: DataFrame) -> DataFrame:
        return self.read("texts").join(jobs.select("id"), "id", "left_semi").select("id", "text")

    def parse_outline(self, jobs: DataFrame) -> DataFrame:
        found = D.outline(self._texts(jobs))
        found.write.mode("overwrite").parquet(f"{self.path}/sections/batch={self.number}")
        return None

    def section_aware_chunk(self, jobs: DataFrame) -> None:
        sections = self.spark.read.parquet(f"{self.path}/sections/batch={self.number}")
        self.write("chunks", D.chunks(sections.join(jobs.select("id"), "id", "left_semi")))

    def _chunks(self, jobs: DataFrame) -> DataFrame:
        return self.read("chunks").join(jobs.select("id"), "id", "left_semi")

    def embed_batch(self, jobs: DataFrame) -> None:
        known = table(self.spark, self.path, "cache").where(F.col("batch") < self.number)
        self.write("cache", EC.fresh(self._chunks(jobs), known, self.embed, F.current_timestamp()))

    def track_a_write(self, jobs: DataFrame) -> None:
        chunks = self._chunks(jobs)
        known = table(self.spark, self.path, "cache").where(F.col("batch") <= self.number)
        self.write("vectors", EC.with_vectors(chunks.select("id", "chunk_index", "sha256"), known, F.current_timestamp()))
        older = table(self.spark, self.path, "chunks").where(F.col("batch") < self.number).join(jobs.select("id"), "id", "left_semi")
        corpus = chunks.select(_chunk_id().alias("id"), F.lower(T.clean(F.col("content"))).alias("low"))
        text_index.add(corpus, f"{self.path}/index", self.number, removed=older.select(_chunk_id().alias("id")))

    def track_b_write(self, jobs: DataFrame) -> None:
        self.write("pages", D.page_index(self._chunks(jobs)))

    def asset_register(self, jobs: DataFrame) -> None:
        names = F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(images/([^)\s]+)\)"), F.lit(1))
        self.write("assets", self._texts(jobs).select("id", F.posexplode(names).alias("n", "name")))

    def finalize(self, jobs: DataFrame) -> DataFrame:
        count = lambda name, c: self.read(name).groupBy("id").agg(c)
        rows = self._texts(jobs).select("id", F.sha2("text", 256).alias("sha256"))
        rows = rows.join(count("chunks", F.count("*").alias("chunk_count")), "id", "left").join(count("assets", F.count("*").alias("asset_count")), "id", "left")
        pages = self.spark.read.parquet(f"{self.path}/sections/batch={self.number}").groupBy("id").agg(F.max("page_end").alias("page_count"))
        rows = rows.join(pages, "id", "left")
        self.write("results", rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunk_count", "asset_count")}))
        return self.read("results").select("id", F.lit(None).cast("string").alias("error"), "sha256")


def _fields(schema: str) -> list[str]:
    """The fields of a schema's text at its top level."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        out = [*out, ""] if ch == "," and depth == 0 else [*out[:-1], out[-1] + ch]
    return [x.strip() for x in out]


def _of(*columns: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*columns)


def _chunk_id() -> Column:
    return F.concat_ws(":", "id", "chunk_index")


def cancel(spark: SparkSession, path: str, jobs: list[int]) -> None:
    """Ask for jobs to stop before their next step."""
    spark.createDataFrame([(j,) for j in jobs], "job_id long").coalesce(1).write.mode("append").parquet(f"{path}/cancels")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, id, batch, status, last_error, step): dead after a failure, cancelled, succeeded, or running after ``step``."""
    place = F.array_position(F.array(*(F.lit(s) for s in STEPS)), F.col("step"))
    last = receipts(spark, path).groupBy("job_id", "id", "batch").agg(F.max_by(F.struct("status", "error", "step"), place).alias("x"))
    done = (F.col("x.status") == "succeeded") & (F.col("x.step") == STEPS[-1])
    status = F.when(F.col("x.status") == "failed", "dead").when(F.col("x.status") == "cancelled", "cancelled").when(done, "succeeded").otherwise("running")
    return last.select("job_id", "id", "batch", status.alias("status"), F.col("x.error").alias("last_error"), F.col("x.step").alias("step"))


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of ``name`` of each document's latest finished job."""
    last = jobs(spark, path).where("status = 'succeeded'").groupBy("id").agg(F.max("batch").alias("batch"))
    return table(spark, path, name).join(last, ["id", "batch"], "left_semi").drop("batch")


def dead_letters(spark: SparkSession, path: str, uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, jobs and audit rows after the failures; ``uploads`` (document_id, uploader, status)."""
    found = jobs(spark, path).select("job_id", F.col("id").alias("document_id"), "status", "last_error")
    errors = found.where("status = 'dead'").select("job_id", F.col("last_error").alias("error"))
    return G.dead_letters(uploads, found, errors)


def start(stream: DataFrame, path: str, checkpoint: str, recognise: Recognise = as_it_is, embed: EC.Embed = by_characters, after: Callable[[int, str], None] | None = None):
    """Run over a stream of (job_id, id, text) until what is there has been taken."""

    def take(docs: DataFrame, number: int) -> None:
        docs = docs.persist()
        try:
            Batch(docs, number, path, recognise, embed, after).run()
        finally:
            docs.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
