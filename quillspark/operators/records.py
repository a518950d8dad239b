"""What readers are shown: documents, jobs, parse results, assets, hits and the trace of one retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import display
from quillspark.functions import text as T
from quillspark.operators.governance import canonical_status, latest, live, only
from quillspark.operators.retrieval import top_k


def _times(*columns: str) -> list[Column]:
    """UTC times as ISO text at the readers' offset, empty for null."""
    return [display.iso_offset(display.at_offset(F.col(c))).alias(c) for c in columns]


def document_records(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Sixteen fields of ``docs``: the uploader's name from ``users`` (user_id, username) or "", a status of today's names."""
    names = users.select(F.col("user_id").alias("uploader_id"), F.col("username").alias("uploader_name"))
    return docs.join(names, "uploader_id", "left").select(
        "id", F.col("kb").alias("knowledge_base_id"), "uploader_id", F.coalesce("uploader_name", F.lit("")).alias("uploader_name"), "title", "filename", "mime", "size_bytes", "sha256",
        "doc_kind", "scheme_type", "is_standard_clause", canonical_status(F.col("status")).alias("status"), "page_count", *_times("created_at", "updated_at"),
    )


def job_records(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, job): each of ``docs`` (document_id) with its latest job's fields, null without a job."""
    last = latest(jobs, "document_id", [F.desc("created_at"), F.desc("job_id")])
    shown = F.struct(F.col("job_id").alias("id"), "status", "attempt", *_times("available_at"), "last_error", "trace_id", *_times("created_at", "updated_at"))
    return docs.select("document_id").join(last.select("document_id", shown.alias("job")), "document_id", "left")


def parse_records(results: DataFrame) -> DataFrame:
    """Seven fields of parse results; outline and stats as the JSON that they are."""
    return results.select("id", "ocr_session_id", "markdown_path", "markdown_sha256", "outline", "stats", *_times("created_at"))


def audit_records(audit: DataFrame) -> DataFrame:
    """Audit rows as administrators list them: with the address, without the agent; missing details are {}."""
    details = F.coalesce("details", F.lit("{}"))
    return audit.select(F.col("audit_id").alias("id"), F.col("actor").alias("actor_user_id"), "action", "target_type", "target_id", "ip_address", details.alias("details"), *_times("created_at"))


def chunk_scan(chunks: DataFrame, docs: DataFrame, filters: dict[str, object] | None = None, most: int = C.SCAN_CHUNKS) -> DataFrame:
    """``chunks`` (kb, document_id, chunk_index and what ``filters`` name) of live ``docs`` (document_id, status),
    the first ``most`` of each base by document and place; filters that are no text, or empty, don't count."""
    kept = chunks.join(docs.where(live(F.col("status"))).select("document_id"), "document_id", "left_semi")
    kept = only(kept, **{name: value for name, value in (filters or {}).items() if isinstance(value, str)})
    return top_k(kept, most, ["kb"], [F.asc("document_id"), F.asc("chunk_index")], rank="__n").drop("__n")


def hits(fused: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """The twelve fields of each row of ``fused`` (query_id, id, score, rank): ``chunks`` (id, document_id, kb,
    section_path, content, page_start, page_end, bbox) with the title from ``titles`` (document_id, title), "" if it has none.

    A hit whose chunk is gone goes, too. The snippet is the first 200 characters of the display text."""
    rows = fused.join(chunks, "id").join(titles, "document_id", "left")
    return rows.select(
        "query_id", "rank", F.col("id").alias("chunk_id"), "document_id", F.coalesce("title", F.lit("")).alias("document_title"), F.col("kb").alias("knowledge_base_id"),
        "section_path", F.col("content").alias("section_text"), "page_start", "page_end", "bbox", F.substring(T.clean(F.col("content")), 1, 200).alias("snippet"), "score",
    )


def debug_decision(query: Column, k: Column, role: Column) -> Column:
    """422 for a question of no or too many characters or a depth out of bounds, else 403 for all but administrators, else 200."""
    low, high = C.DEBUG_DEPTH
    good = F.length(query).between(1, C.DEBUG_CHARACTERS) & k.between(low, high)
    return F.when(~F.coalesce(good, F.lit(False)), 422).when(F.coalesce(role != "admin", F.lit(True)), 403).otherwise(200)


def debug_trace(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, decision, total, chunk_id, chunk_index, place, score) of ``requests`` (query_id, query, k, role): a row for each
    of the ``k`` best of ``found`` (query_id, id, score, rank), and one without a hit where there is none or it is refused."""
    judged = requests.select("query_id", "k", debug_decision(F.col("query"), F.col("k"), F.col("role")).alias("decision"))
    shown = found.join(judged.where("decision = 200"), "query_id").where("rank <= k").select("query_id", F.col("id").alias("chunk_id"), F.col("rank").alias("place"), "score")
    totals = shown.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = judged.select("query_id", "decision").join(totals, "query_id", "left").na.fill(0, ["total"]).join(shown, "query_id", "left")
    return rows.select("query_id", "decision", "total", "chunk_id", F.when(F.col("chunk_id").isNotNull(), 0).alias("chunk_index"), "place", "score")


def percent_encoded(c: Column, space: str = "%20") -> Column:
    """All but letters, digits and -_.~ as percent codes; ``space`` for a space (+ in forms)."""
    out = F.url_encode(c)
    for code, char in (("+", space), ("%7E", "~"), ("*", "%2A")):  # where Java's encoder differs
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def content_disposition(kind: Column, filename: Column) -> Column:
    """Header of a download: the name without folders, percent-encoded; document.pdf where none is left."""
    path = F.regexp_replace(F.coalesce(filename, F.lit("")), r"(/\.?)+$", "")
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(kind, F.lit("; filename*=UTF-8''"), percent_encoded(F.when(base.isin("", "."), "document.pdf").otherwise(base)))


def callback_url(base: Column, job_id: Column, document_id: Column) -> Column:
    """Where recognition reports to; null without a base."""
    stem = F.regexp_replace(F.trim(F.coalesce(base, F.lit(""))), "/+$", "")
    field = lambda c: percent_encoded(c.cast("string"), "+")
    return F.when(stem != "", F.concat(stem, F.lit("/api/v2/ocr/callback?job_id="), field(job_id), F.lit("&document_id="), field(document_id)))
