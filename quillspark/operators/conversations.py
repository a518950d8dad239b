"""Sessions, turns, references and streamed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import boxes, display

ROLE_ORDER = ("user", "assistant")


def role_rank(role: Column) -> Column:
    return F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)


def detail(messages: DataFrame, session: str = "session_id", time: str = "created_at", key: str = "message_id") -> DataFrame:
    """Messages with their place in the session: by time, users before assistants, then by id."""
    order = Window.partitionBy(session).orderBy(time, role_rank(F.col("role")), key)
    return messages.withColumn("n", F.row_number().over(order))


def with_citations(messages: DataFrame, cited: DataFrame) -> DataFrame:
    """Messages with the ordered array of their citations, empty without any."""
    fields = [c for c in cited.columns if c != "message_id"]
    kept = cited.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("index", *(c for c in fields if c != "index")))).alias("citations"))
    return messages.join(kept, "message_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast(kept.schema["citations"].dataType)))


def turns(answers: DataFrame) -> DataFrame:
    """Two messages of each answer (session_id, question, answer, asked_at): the assistant's a microsecond later."""
    late = F.col("asked_at") + F.expr("INTERVAL 1 MICROSECOND")
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.col("asked_at").alias("created_at")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), late.alias("created_at")),
    )
    return answers.select("session_id", F.explode(pair).alias("m")).select("session_id", "m.*")


def session_title(question: Column, default: str = "新会话", most: int = 40) -> Column:
    return F.coalesce(F.nullif(F.left(F.trim(question), F.lit(most)), F.lit("")), F.lit(default))


def deltas(events: DataFrame) -> DataFrame:
    """(query_id, seq, kind, text) of raw stream lines (query_id, seq, data): JSON deltas become
    reasoning and content rows, in that order; what is no such JSON yields nothing."""
    schema = "choices array<struct<delta:struct<reasoning_content:string,content:string>>>"
    parsed = F.from_json("data", schema)
    delta = F.try_element_at(parsed["choices"], F.lit(1))["delta"]
    both = F.array(F.struct(F.lit("reasoning").alias("kind"), delta["reasoning_content"].alias("text")), F.struct(F.lit("content").alias("kind"), delta["content"].alias("text")))
    rows = events.select("query_id", "seq", F.explode(F.filter(both, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("x"))
    return rows.select("query_id", "seq", "x.kind", "x.text")


def references(cited: DataFrame) -> DataFrame:
    """Adds reference_id, page (1 by default) and url with the box as fragment. ``box``: map of names to numbers."""
    page = F.coalesce("page_start", F.lit(1))
    url = F.concat(F.lit("/documents/"), F.url_encode(F.col("document_id").cast("string")), F.lit("/pdf?page="), page, boxes.fragment(F.col("box")))
    return cited.withColumn("reference_id", F.concat(F.lit("ref-"), F.col("index"))).withColumn("page", page).withColumn("url", url)


def document_clauses(cited: DataFrame) -> DataFrame:
    """(query_id, document_id, clauses, reference): distinct clauses of a document's citations in natural order."""
    clause = display.citation_clause(F.col("section_path"), F.col("snippet"))
    rows = cited.select("query_id", "document_id", clause.alias("clause"))
    keyed = F.when(F.col("clause").isNotNull(), F.struct(display.clause_key(F.col("clause")).alias("key"), F.col("clause").alias("clause")))
    grouped = rows.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_set(keyed)).alias("x"))
    out = grouped.select("query_id", "document_id", F.transform("x", lambda r: r["clause"]).alias("clauses"))
    return out.withColumn("reference", display.document_reference(F.col("document_id").cast("string"), F.col("clauses")))


def by_clause(cited: DataFrame) -> DataFrame:
    """Adds place: citations of a document by clause, those without one last, then by index."""
    key = display.clause_key(display.citation_clause(F.col("section_path"), F.col("snippet")))
    order = Window.partitionBy("query_id", "document_id").orderBy(F.asc_nulls_last("__key"), "index")
    return cited.withColumn("__key", key).withColumn("place", F.row_number().over(order)).drop("__key")


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Neither revoked nor expired, with the whole seconds that are left."""
    left = F.greatest(F.lit(0), F.floor(F.unix_micros(F.col("expires_at").cast("timestamp")) / 1_000_000 - F.unix_micros(now.cast("timestamp")) / 1_000_000))
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).withColumn("seconds_left", left.cast("long"))


def expires_at(created_at: Column, hours: int = 24) -> Column:
    """When an export ends."""
    return created_at + F.expr(f"INTERVAL {hours} HOURS")


def recognition_status(status: Column) -> Column:
    """Recognition service states as running, succeeded or failed; other text is pending."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin("processing", "running"), "running").when(s.isin("completed", "done", "succeeded"), "succeeded").when(s.isin("failed", "error"), "failed").otherwise("pending")


def image_mime(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(suffix.isin(".jpg", ".jpeg"), "image/jpeg").when(suffix.isin(".png", ".gif", ".webp"), F.concat(F.lit("image/"), F.substr(suffix, F.lit(2)))).otherwise("application/octet-stream")
