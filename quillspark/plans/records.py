"""Queries over what readers are shown: records, hits, traces, headers, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import governance as G, records, retrieval as R
from quillspark.plans import bindings as B
from quillspark.plans.registry import query
from quillspark.plans.search import rrf_search
from quillspark.sources.files import table
from quillspark.streaming import stateful

K = 6


def iso_sql(c: str) -> str:
    return f"coalesce(strftime({c} + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') || '+08:00', '')"


TITLES = "title AS (SELECT doc_id AS document_id, 'T' || doc_id AS title FROM documents WHERE doc_id % 10 <> 3)"


def titles(spark: SparkSession, d: str) -> DataFrame:
    """document_id, title: nine of ten documents have one."""
    return table(spark, d, "documents").where("doc_id % 10 <> 3").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("T"), "doc_id").alias("title"))


@query(
    f"""WITH {B.DOC}, {B.USR} SELECT d.id, d.kb AS knowledge_base_id, d.id % 200 AS uploader_id, coalesce(u.username, '') AS uploader_name, 'T' || d.id AS title, d.id || '.pdf' AS filename, 'application/pdf' AS mime,
octet_length(encode(d.text)) AS size_bytes, sha256(d.text) AS sha256, CASE WHEN d.doc_kind IN ('plan','spec','drawing','quantity','other') THEN d.doc_kind ELSE 'other' END AS doc_kind, d.doc_kind AS scheme_type, d.n_chars % 2 = 0 AS is_standard_clause,
CASE WHEN d.status = 'disabled' THEN 'disabled' ELSE ['ready','embedding','vector_indexing','failed'][1 + d.id % 4] END AS status, len(string_split(d.text, chr(10))) AS page_count, {iso_sql("d.created_at")} AS created_at,
{iso_sql("CASE WHEN d.id % 3 = 0 THEN d.created_at + INTERVAL 90 SECONDS END")} AS updated_at FROM doc d LEFT JOIN usr u ON u.user_id = d.id % 200"""
)
def document_records(spark: SparkSession, d: str) -> DataFrame:
    stored = F.element_at(F.array(*(F.lit(x) for x in ("ready", "parsing", "indexing", "failed"))), (1 + F.col("id") % 4).cast("int"))
    docs = B.docs(spark, d).select(
        "id", "kb", (F.col("id") % 200).alias("uploader_id"), F.concat(F.lit("T"), "id").alias("title"), F.concat("id", F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("mime"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), G.doc_kind(F.col("doc_kind")).alias("doc_kind"), F.col("doc_kind").alias("scheme_type"),
        (F.col("n_chars") % 2 == 0).alias("is_standard_clause"), F.when(F.col("status") == "disabled", "disabled").otherwise(stored).alias("status"),
        F.size(F.split("text", "\n")).cast("long").alias("page_count"), "created_at", F.when(F.col("id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 90 SECONDS")).alias("updated_at"),
    )
    return records.document_records(docs, B.users(spark, d))


@query(
    f"""WITH {B.JOB}, cur AS (SELECT * FROM job QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) = 1)
SELECT d.doc_id AS document_id, job_id, status, CAST(job_id % 3 AS INTEGER) AS attempt, CASE WHEN job_id IS NOT NULL THEN {iso_sql("created_at")} END AS available_at, CASE WHEN status = 'failed' THEN 'e' || job_id END AS last_error,
'trace-' || job_id AS trace_id, CASE WHEN job_id IS NOT NULL THEN {iso_sql("created_at")} END AS created_at, CASE WHEN job_id IS NOT NULL THEN '' END AS updated_at FROM documents d LEFT JOIN cur c ON c.document_id = d.doc_id"""
)
def job_records(spark: SparkSession, d: str) -> DataFrame:
    more = {
        "attempt": (F.col("job_id") % 3).cast("int"), "available_at": F.col("created_at"), "last_error": F.when(F.col("status") == "failed", F.concat(F.lit("e"), "job_id")),
        "trace_id": F.concat(F.lit("trace-"), "job_id"), "updated_at": F.lit(None).cast("timestamp_ntz"),
    }
    rows = records.job_records(table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), B.jobs(spark, d).withColumns(more))
    return rows.select("document_id", F.col("job.id").alias("job_id"), *(f"job.{c}" for c in ("status", "attempt", "available_at", "last_error", "trace_id", "created_at", "updated_at")))


@query(
    f"""SELECT page_id AS id, 'ocr-' || (page_id % 50) AS ocr_session_id, url AS markdown_path, sha256(html) AS markdown_sha256, '[{{"level":1,"title":"p' || page_id || '"}}]' AS outline,
'{{"characters":' || length(html) || '}}' AS stats, {iso_sql("ts")} AS created_at FROM pages LEFT JOIN events ON event_id = page_id"""
)
def parse_records(spark: SparkSession, d: str) -> DataFrame:
    times = table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("created_at"))
    outline = F.to_json(F.array(F.struct(F.lit(1).alias("level"), F.concat(F.lit("p"), "page_id").alias("title"))))
    return records.parse_records(
        table(spark, d, "pages").join(times, "page_id", "left").select(
            F.col("page_id").alias("id"), F.concat(F.lit("ocr-"), F.col("page_id") % 50).alias("ocr_session_id"), F.col("url").alias("markdown_path"), F.sha2("html", 256).alias("markdown_sha256"),
            outline.alias("outline"), F.to_json(F.struct(F.length("html").alias("characters"))).alias("stats"), "created_at",
        )
    )


@query(f"SELECT event_id AS id, user_id AS actor_user_id, event_type AS action, 'base' AS target_type, 'src' || (event_id % 25) AS target_id, '192.0.2.' || (user_id % 250) AS ip_address, CASE WHEN event_id % 4 = 0 THEN '{{}}' ELSE props END AS details, {iso_sql('ts')} AS created_at FROM events")
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    details = F.when(F.col("audit_id") % 4 != 0, F.col("details"))
    rows = B.audit(spark, d).withColumns({"target_type": F.lit("base"), "ip_address": F.concat(F.lit("192.0.2."), F.col("actor") % 250), "user_agent": F.lit("browser"), "details": details})
    return records.audit_records(rows.withColumnRenamed("ts", "created_at"))


@query(
    f"""WITH {B.DOC}, {B.LINE}, c AS (SELECT l.kb, l.id AS document_id, l.pos AS chunk_index, d.doc_kind, l.content, CASE WHEN starts_with(ltrim(l.content), '|') THEN 'table' WHEN starts_with(ltrim(l.content), '![](') THEN 'image'
WHEN contains(l.content, '$$') THEN 'formula' WHEN regexp_matches(l.content, '(?m)^\\s*[-*]\\s+') THEN 'list' ELSE 'paragraph' END AS content_type FROM line l JOIN doc d USING (id) WHERE d.status NOT IN ('disabled', 'deleting'))
SELECT kb, document_id, chunk_index, content FROM c WHERE doc_kind = 'en' AND content_type = 'paragraph' QUALIFY row_number() OVER (PARTITION BY kb ORDER BY document_id, chunk_index) <= 5000"""
)
def filtered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """English paragraphs of live documents; a filter that is empty, and one that is no text, don't count."""
    docs = B.docs(spark, d)
    chunks = docs.select("kb", F.col("id").alias("document_id"), "doc_kind", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    chunks = chunks.withColumns({"content_type": T.content_type(F.col("content")), "scheme_type": F.lit("a")})
    found = records.chunk_scan(chunks, docs.select(F.col("id").alias("document_id"), "status"), {"doc_kind": "en", "scheme_type": "", "content_type": "paragraph", "kb": 3})
    return found.select("kb", "document_id", "chunk_index", "content")


_TRACKS = f"WITH {B.DOC}, {B.SEARCH}, {{dense}}, {{lexical}}, {{fused}}"


def _fused_sql(k: int) -> str:
    return _TRACKS.format(dense=B.DENSE.format(k=2 * k), lexical=B.LEXICAL.format(k=2 * k), fused=B.FUSED.format(raw="true", k=k))


@query(
    f"""{_fused_sql(K)}, {TITLES} SELECT f.query_id, f.rank::INTEGER AS rank, f.id AS chunk_id, f.id AS document_id, coalesce(t.title, '') AS document_title, d.kb AS knowledge_base_id, d.kb || ' > ' || d.doc_kind AS section_path, d.text AS section_text,
CAST(f.id % 4 AS INTEGER) AS page_start, CAST(f.id % 4 + 1 AS INTEGER) AS page_end, '[0,0,1,' || f.id || ']' AS bbox, left({B.clean_sql("d.text")}, 200) AS snippet, f.score FROM fused f JOIN doc d USING (id) LEFT JOIN title t ON t.document_id = f.id"""
)
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    page = (F.col("id") % 4).cast("int")
    chunks = B.docs(spark, d).select(
        "id", F.col("id").alias("document_id"), "kb", F.array("kb", "doc_kind").alias("section_path"), F.col("text").alias("content"), page.alias("page_start"), (page + 1).alias("page_end"),
        F.concat(F.lit("[0,0,1,"), "id", F.lit("]")).alias("bbox"),
    )
    return records.hits(rrf_search(spark, d), chunks, titles(spark, d)).withColumn("section_path", F.array_join("section_path", " > "))


@query(
    f"""{_fused_sql(50)}, {B.USR}, req AS (SELECT item_id AS query_id, item_id % 53 AS k, CASE WHEN coalesce(length(text) BETWEEN 1 AND 1024, false) AND item_id % 53 BETWEEN 1 AND 50 THEN CASE WHEN u.role = 'admin' THEN 200 ELSE 403 END ELSE 422 END AS decision
  FROM benchmark LEFT JOIN usr u ON u.user_id = item_id % 3 * 50 - 49 * CAST(item_id % 7 = 0 AS INTEGER)),
hit AS (SELECT r.query_id, f.id AS chunk_id, 0 AS chunk_index, f.rank::INTEGER AS place, f.score FROM fused f JOIN req r USING (query_id) WHERE r.decision = 200 AND f.rank <= r.k)
SELECT r.query_id, r.decision, (SELECT count(*) FROM hit h WHERE h.query_id = r.query_id) AS total, h.chunk_id, h.chunk_index, h.place, h.score FROM req r LEFT JOIN hit h USING (query_id)"""
)
def debug_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Traces that administrators ask for, each at a depth of its own; the others are refused."""
    asked, corpus = B.questions(spark, d), B.searchable(spark, d)
    user = F.col("query_id") % 3 * 50 - 49 * (F.col("query_id") % 7 == 0).cast("int")
    roles = B.users(spark, d).select("user_id", "role")
    requests = asked.select("query_id", "query", (F.col("query_id") % 53).alias("k"), user.alias("user_id")).join(roles, "user_id", "left")
    return records.debug_trace(requests, R.fuse(R.dense_track(asked, corpus, 100), R.lexical_track(asked, corpus, 100), 50))


@query("SELECT start, count(*) AS requests, round(count(*) / 300.0, 6) AS per_second FROM (SELECT time_bucket(INTERVAL 15 SECONDS, ts) - unnest(range(20)) * INTERVAL 15 SECONDS AS start FROM events) GROUP BY 1")
def sliding_request_rate(spark: SparkSession, d: str) -> DataFrame:
    """Requests of five minutes, anew every 15 seconds."""
    return stateful.request_rate(table(spark, d, "events"), step="15 seconds")


@query("SELECT page_id, 'inline; filename*=UTF-8''''' || url_encode(CASE WHEN name IN ('', '.') THEN 'document.pdf' ELSE name END) AS header FROM (SELECT page_id, regexp_extract(regexp_replace(coalesce(url, ''), '(/\\.?)+$', ''), '([^/]*)$', 1) AS name FROM pages)")
def download_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", records.content_disposition(F.lit("inline"), F.col("url")).alias("header"))


@query(f"WITH {B.JOB} SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'https://192.0.2.1/api/v2/ocr/callback?job_id=' || job_id || '&document_id=doc+' || document_id END AS url FROM job")
def callback_urls(spark: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("job_id") % 2 == 0, " https://192.0.2.1// ")
    return B.jobs(spark, d).select("job_id", records.callback_url(base, F.col("job_id"), F.concat(F.lit("doc "), "document_id")).alias("url"))
