"""Sources and sinks: parquet tables, golden cases, uploads, byte ranges, exports, assets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import display as D
from quillspark.operators.governance import doc_kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table in fewer parts than there are cores is dealt over all of them; a large one is left as it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


GOLDEN = "id string, question string, reference_answer string, expected_citations_keywords array<string>, knowledge_base_hint string"


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """An array of cases in one JSON file, or one such file each."""
    return spark.read.schema(GOLDEN).json(path, multiLine=True)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(path)


def upload_fault(name: Column, mime: Column, content: Column, most_bytes: int = 200 * 1024 * 1024) -> Column:
    """Why a file is refused, the first reason that holds: extension, size, signature, type. Null if it is taken."""
    return (
        F.when(~F.endswith(F.lower(name), F.lit(".pdf")), "extension")
        .when(F.octet_length(content) > most_bytes, "size")
        .when(~F.startswith(content.cast("binary"), F.lit(b"%PDF-")), "signature")
        .when(~F.coalesce(mime, F.lit("")).isin("application/pdf", "application/x-pdf", "application/octet-stream", ""), "type")
    )


def staged(files: DataFrame) -> DataFrame:
    """(name, title, doc_kind, sha256, path) of uploads (name, title, doc_kind, content, uploaded_at):
    title as given or the name's stem; a path by date and digest."""
    base = F.regexp_extract("name", r"([^/\\]+)$", 1)
    digest = F.sha2("content", 256)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace(base, r"\.[^.]*$", ""))
    path = F.concat(F.date_format("uploaded_at", "yyyy/MM/dd"), F.lit("/"), digest, F.lit(".pdf"))
    return files.select(base.alias("name"), title.alias("title"), doc_kind(F.col("doc_kind")).alias("doc_kind"), digest.alias("sha256"), path.alias("path"))


def ranges(requests: DataFrame) -> DataFrame:
    """Adds status and body to requests (header, content): the bytes that a Range header asks for."""
    size = F.octet_length("content").cast("long")
    rows = requests.withColumn("r", D.byte_range(F.col("header"), size))
    body = F.substring(F.col("content"), (F.col("r.start") + 1).cast("int"), (F.col("r.end") - F.col("r.start") + 1).cast("int"))
    return rows.withColumn("status", F.col("r.status")).withColumn("body", F.when(F.col("status") != 416, body)).drop("r")


def export_rows(hits: DataFrame) -> DataFrame:
    """Ten columns of text, numbered from 1 by score; the path joined by " > ", the score to 4 places.

    Ranking all exported rows is global: an export is a bounded result of one search."""
    n = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id")))
    return hits.select(
        n.alias("index"), F.col("id").alias("chunk_id"), "document_id", "document_title", F.col("kb").alias("knowledge_base_id"),
        F.array_join("section_path", " > ").alias("section_path"), "page_start", "page_end", "snippet", F.format_string("%.4f", "score").alias("score"),
    )


def export_csv(hits: DataFrame, path: str) -> None:
    export_rows(hits).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(hits: DataFrame, filters: dict[str, object], path: str) -> None:
    """results of twelve fields, with the text and box of each section where ``hits`` has them
    (section_text, bbox), and one row of metadata: the filters that are set, as JSON, and the
    number of results."""
    more = [(F.col(c) if c in hits.columns else F.lit(None).cast("string")).alias(c) for c in ("section_text", "bbox")]
    rows = export_rows(hits).join(hits.select(F.col("id").alias("chunk_id"), *more), "chunk_id")
    order = ["index", "chunk_id", "document_id", "document_title", "knowledge_base_id", "section_path", "section_text", "page_start", "page_end", "bbox", "snippet", "score"]
    rows.select(*order).write.mode("overwrite").json(f"{path}/results")
    kept = {k: v for k, v in filters.items() if v not in (None, "")}
    count = hits.agg(F.count("*").alias("result_count"))
    count.select(F.lit(json.dumps(kept, ensure_ascii=False, sort_keys=True)).alias("filters"), "result_count").write.mode("overwrite").json(f"{path}/metadata")


def assets(payloads: DataFrame) -> DataFrame:
    """(document_id, n, name, page_no, content) of payloads (document_id, images array of
    name, base64, page_no as text): base name alone, image_n.jpg if empty, page null if no number."""
    rows = payloads.select("document_id", F.posexplode("images").alias("n", "image"))
    base = F.regexp_extract(F.coalesce("image.name", F.lit("")), r"([^/\\]*)$", 1)
    name = F.when(base == "", F.concat(F.lit("image_"), F.col("n"), F.lit(".jpg"))).otherwise(base)
    return rows.select("document_id", "n", name.alias("name"), F.col("image.page_no").try_cast("int").alias("page_no"), F.unbase64("image.base64").alias("content"))


def replace_documents(current: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """``current`` with all rows of the documents in ``new`` replaced: delete, then insert."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
