"""The document model over the parquet tables, for Spark and as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.files import spread, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    """id, kb, doc_kind, status, created_at, n_chars, text: disabled if labelled toxic; created at its event."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("source").alias("kb"), F.col("lang").alias("doc_kind"), "n_chars", "text")
    status = F.when(F.col("toxic") == 1, "disabled").otherwise("ready")
    return rows.join(labels, "id", "left").join(events, "id", "left").withColumn("status", status).drop("toxic")


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """id, kb, status, pos, content: a row a line."""
    rows = docs(spark, d)
    return rows.select("id", "kb", "status", F.posexplode(F.split("text", "\n")).alias("pos", "content"))


def kbs(spark: SparkSession, d: str) -> DataFrame:
    """kb, name, is_active: the sources; those that end in 7 are not active."""
    rows = table(spark, d, "documents").select(F.col("source").alias("kb")).distinct()
    return rows.select("kb", F.concat(F.lit("Base "), "kb").alias("name"), (~F.endswith("kb", F.lit("7"))).alias("is_active"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """user_id, username, role, is_active, segment."""
    role = F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), role.alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"), F.col("c_mktsegment").alias("segment"))


def permissions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, kb, role: the strongest that the user's orders give for the base."""
    rank = F.when(F.col("o_orderpriority").startswith("1"), 3).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(1)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("src"), F.col("o_orderkey") % 20).alias("kb"), rank.alias("r"))
    best = rows.groupBy("user_id", "kb").agg(F.max("r").alias("r"))
    return best.select("user_id", "kb", F.when(F.col("r") == 3, "owner").when(F.col("r") == 2, "editor").otherwise("viewer").alias("role"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    """audit_id, actor, action, ts, target_id, details."""
    rows = table(spark, d, "events")
    target = F.concat(F.lit("src"), F.col("event_id") % 25)
    return rows.select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), "ts", target.alias("target_id"), F.col("props").alias("details"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """job_id, document_id, status, created_at: orders as ingest jobs."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 500).alias("document_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """job_id, step, status, ts, line: order lines as step receipts."""
    from quillspark.functions.constants import INGEST_STEPS

    step = F.element_at(F.array(*(F.lit(s) for s, _, _ in INGEST_STEPS)), F.col("l_linenumber"))
    status = F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), step.alias("step"), status.alias("status"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query, query_vector: all benchmark items with the vectors of the same ids."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows.join(vectors, "query_id", "left")


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """id, kb, doc_kind, created_at, low, vector of live documents: text cleaned and lower-cased once."""
    from quillspark.operators.governance import live

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = docs(spark, d).where(live(F.col("status")))
    return rows.select("id", "kb", "doc_kind", "created_at", F.lower(T.clean(F.col("text"), every=False)).alias("low")).join(vectors, "id", "left")


# SQL of the same views

DOC = """doc AS (
  SELECT d.doc_id AS id, d.source AS kb, d.lang AS doc_kind, d.n_chars, d.text, e.ts AS created_at,
         CASE WHEN l.toxic = 1 THEN 'disabled' ELSE 'ready' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id)"""
KB = """kb AS (SELECT DISTINCT source AS kb, 'Base ' || source AS name, NOT ends_with(source, '7') AS is_active FROM documents)"""
USR = """usr AS (
  SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
         c_acctbal >= 0 AS is_active, c_mktsegment AS segment FROM customer)"""
PERM = """perm AS (
  SELECT user_id, kb, CASE max(r) WHEN 3 THEN 'owner' WHEN 2 THEN 'editor' ELSE 'viewer' END AS role FROM (
    SELECT o_custkey AS user_id, 'src' || (o_orderkey % 20) AS kb,
           CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END AS r FROM orders) GROUP BY 1, 2)"""
LINE = """line AS (
  SELECT id, kb, status, CAST(pos - 1 AS INTEGER) AS pos, list_extract(parts, pos) AS content
  FROM (SELECT id, kb, status, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT *, string_split(text, chr(10)) AS parts FROM doc)))"""
JOB = """job AS (
  SELECT o_orderkey AS job_id, o_orderkey % 500 AS document_id, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)"""
RECEIPT = """receipt AS (
  SELECT l_orderkey AS job_id, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS status,
         ['upload_to_ocr','poll_and_fetch_ocr','parse_outline','section_aware_chunk','embed_batch','track_a_write','track_b_write','asset_register','finalize'][l_linenumber] AS step,
         l_shipdate AS ts, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


def clean_sql(c: str) -> str:
    """The display text of a column."""
    x = f"coalesce({c}, '')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '</?[A-Za-z][^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[\\s ]+', ' ', 'g'))"


SEARCH = f"""live AS (
  SELECT d.id, d.kb, d.doc_kind, d.created_at, lower({clean_sql('d.text')}) AS low, CAST(v.embedding AS DOUBLE[]) AS vector
  FROM doc d LEFT JOIN embeddings v ON v.vec_id = d.id WHERE d.status NOT IN ('disabled', 'deleting')),
ask AS (
  SELECT b.item_id AS query_id, lower({clean_sql('b.text')}) AS phrase, CAST(v.embedding AS DOUBLE[]) AS query_vector
  FROM benchmark b LEFT JOIN embeddings v ON v.vec_id = b.item_id),
ask_term AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(phrase, '[a-z0-9_]+')) AS term FROM ask)"""
DENSE = """dense AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, round(list_cosine_similarity(query_vector, vector), 6) AS score FROM live, ask WHERE len(vector) = len(query_vector))
  WHERE score > 0 QUALIFY rank <= {k})"""
LEXICAL = """lexical AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, CAST(sum(n) + any_value(phrase_score) AS DOUBLE) AS score FROM (
      SELECT a.query_id, l.id, CASE WHEN contains(l.low, a.phrase) THEN 3 ELSE 0 END AS phrase_score,
             (length(l.low) - length(replace(l.low, t.term, ''))) // length(t.term) AS n
      FROM live l, ask a JOIN ask_term t ON t.query_id = a.query_id) GROUP BY 1, 2)
  WHERE score > 0 QUALIFY rank <= {k})"""
FUSED = """fused AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank FROM (
    SELECT query_id, id, r1, r2, round(CASE WHEN {raw} AND tracks = 1 THEN raw ELSE s / (tracks / 61.0) END, 6) AS score FROM (
      SELECT query_id, id, sum(1.0 / (60 + rank)) AS s, max(score) AS raw, max(CASE WHEN track = 1 THEN rank END) AS r1, max(CASE WHEN track = 2 THEN rank END) AS r2
      FROM (SELECT 1 AS track, * FROM dense UNION ALL SELECT 2 AS track, * FROM lexical) GROUP BY 1, 2) m
    JOIN (SELECT query_id, count(DISTINCT track) AS tracks FROM (SELECT 1 AS track, query_id FROM dense UNION ALL SELECT 2, query_id FROM lexical) GROUP BY 1) a USING (query_id))
  QUALIFY rank <= {k})"""
