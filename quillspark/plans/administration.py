"""Queries over listings, life cycle, accounts, uploads and what readers see of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.operators import analytics, conversations as V, governance as G
from quillspark.plans import bindings as B
from quillspark.plans.registry import query
from quillspark.plans.sessions import cited_lines
from quillspark.sources.files import replace_documents, table


@query(f"WITH {B.USR}, f AS (SELECT * FROM usr WHERE role = 'user' AND is_active AND username ILIKE '%1%') SELECT user_id, username, role, is_active, (SELECT count(*) FROM f) AS total FROM f ORDER BY user_id DESC LIMIT 20")
def user_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = G.only(B.users(spark, d), role="user", is_active=True).where(G.containing("1", "username"))
    return G.page(rows.select("user_id", "username", "role", "is_active"), [F.desc("user_id")], 1, 20)


@query(f"WITH {B.USR} SELECT count(*) AS users, count(*) FILTER (is_active) AS active, count(*) FILTER (role = 'admin') AS admins FROM usr")
def user_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.user_counts(B.users(spark, d))


@query(
    f"""WITH {B.DOC}, {B.KB}, {B.PERM}, f AS (SELECT * FROM kb WHERE is_active AND name ILIKE '%src1%') SELECT f.kb, f.name, coalesce(documents, 0) AS documents, coalesce(live_documents, 0) AS live_documents,
coalesce(permissions, 0) AS permissions, (SELECT count(*) FROM f) AS total FROM f LEFT JOIN (SELECT kb, count(*) AS documents, count(*) FILTER (status NOT IN ('disabled', 'deleting')) AS live_documents FROM doc GROUP BY 1) a USING (kb)
LEFT JOIN (SELECT kb, count(*) AS permissions FROM perm GROUP BY 1) b USING (kb) ORDER BY f.kb LIMIT 20"""
)
def base_listing(spark: SparkSession, d: str) -> DataFrame:
    shown = G.page(G.bases(B.kbs(spark, d), text="src1"), [F.asc("kb")], 1, 20)
    return shown.select("kb", "name", "total").join(analytics.archive_counts(B.kbs(spark, d), B.docs(spark, d), B.permissions(spark, d)), "kb")


@query(f"WITH {B.USR}, {B.PERM} SELECT p.kb, p.user_id, p.role, coalesce(u.username, '') AS username FROM perm p LEFT JOIN usr u USING (user_id)")
def permission_listing(spark: SparkSession, d: str) -> DataFrame:
    named = B.permissions(spark, d).join(B.users(spark, d).select("user_id", "username"), "user_id", "left")
    return named.select("kb", "user_id", "role", F.coalesce("username", F.lit("")).alias("username"))


@query(f"WITH {B.USR} SELECT user_id, username FROM usr WHERE is_active AND username ILIKE '%2%' ORDER BY user_id DESC LIMIT 500")
def permission_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = B.users(spark, d).where("is_active").where(G.containing("2", "username"))
    return rows.orderBy(F.desc("user_id")).limit(500).select("user_id", "username")


@query(
    """WITH s AS (SELECT conv_id AS session_id, conv_id % 10 AS user_id, max(turn) AS updated, count(*) AS messages FROM conversations GROUP BY 1, 2)
SELECT user_id, session_id, messages, place::INTEGER AS place, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, session_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM s) WHERE place <= 20"""
)
def session_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 10).alias("user_id"))
    rows = rows.agg(F.max("turn").alias("updated"), F.count("*").alias("messages"))
    return G.page_of_each(rows, ["user_id"], [F.desc("updated"), F.asc("session_id")], 1, 20).drop("updated")


@query(
    f"""WITH {B.DOC}, req AS (SELECT l_orderkey AS request_id, 'src' || (l_orderkey % 20) AS kb, ['owner','admin','editor'][1 + l_orderkey % 3] AS role, l_partkey AS document_id FROM lineitem),
e AS (SELECT DISTINCT * FROM req), g AS (SELECT request_id, any_value(role) AS role, count(*) AS n, count(d.id) AS found FROM e LEFT JOIN doc d ON d.id = e.document_id AND d.kb = e.kb GROUP BY 1)
SELECT request_id, CASE WHEN role = 'editor' THEN 403 WHEN found < n THEN 404 ELSE 200 END AS decision, CASE WHEN role <> 'editor' AND found = n THEN n ELSE 0 END AS deleted FROM g"""
)
def batch_deletions(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(F.lit("owner"), F.lit("admin"), F.lit("editor")), (1 + F.col("l_orderkey") % 3).cast("int"))
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("src"), F.col("l_orderkey") % 20).alias("kb"), role.alias("role"), F.col("l_partkey").alias("document_id"))
    return G.batch_deletions(asked, B.docs(spark, d).select(F.col("id").alias("document_id"), "kb"))


@query(
    f"""WITH {B.DOC}, {B.JOB} SELECT job_id, document_id, status FROM job UNION ALL SELECT -1 - id, id, 'queued' FROM doc WHERE status = 'disabled'"""
)
def retried_jobs(spark: SparkSession, d: str) -> DataFrame:
    docs = B.docs(spark, d).select(F.col("id").alias("document_id"), "status")
    asked = docs.where("status = 'disabled'").select("document_id", (-1 - F.col("document_id")).alias("job_id"), F.lit("2024-01-06").cast("date").alias("created_at"))
    return G.retry(docs, B.jobs(spark, d).withColumn("created_at", F.col("created_at").cast("date")), asked)[1].select("job_id", "document_id", "status")


@query(f"WITH {B.DOC} SELECT id AS document_id, CASE WHEN status = 'disabled' THEN 'pending' ELSE status END AS status FROM doc")
def retried_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = B.docs(spark, d).select(F.col("id").alias("document_id"), "status")
    asked = docs.where("status = 'disabled'").select("document_id", F.lit(0).alias("job_id"), F.lit("2024-01-06").cast("date").alias("created_at"))
    return G.retry(docs, B.jobs(spark, d).withColumn("created_at", F.col("created_at").cast("date")), asked)[0]


@query(
    f"""WITH {B.USR} SELECT user_id AS actor, 'document.retry' AS action, 'document' AS target_type, CAST(user_id * 2 AS VARCHAR) AS target_id,
CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE '192.0.2.' || (user_id % 250) END AS ip_address, left(repeat(username, 40), 512) AS user_agent, '{{"kb":"' || segment || '"}}' AS details FROM usr"""
)
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    fwd = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(" 192.0.2."), F.col("user_id") % 250, F.lit(", 10.1.1.1")))
    rows = B.users(spark, d).select(F.col("user_id").alias("actor"), (F.col("user_id") * 2).alias("target_id"), fwd.alias("forwarded"), F.lit(None).cast("string").alias("peer"), F.repeat("username", F.lit(40)).alias("agent"), "segment")
    return G.audit_rows(rows, "document.retry", "document", F.struct(F.col("segment").alias("kb")))


def _dead(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    jobs = B.jobs(spark, d).select("job_id", "document_id", "status", F.lit(None).cast("string").alias("last_error"))
    errors = jobs.where("status = 'failed'").select("job_id", F.concat(F.lit("e"), "job_id").alias("error"))
    docs = B.docs(spark, d).select(F.col("id").alias("document_id"), (F.col("id") % 7).alias("uploader"), "status")
    return G.dead_letters(docs, jobs, errors, text=F.repeat("error", F.lit(700)))


@query(f"WITH {B.JOB} SELECT job_id, CASE WHEN status = 'failed' THEN 'dead' ELSE status END AS status, CASE WHEN status = 'failed' THEN left(repeat('e' || job_id, 700), 4000) END AS last_error FROM job")
def dead_jobs(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d)[1].select("job_id", "status", "last_error")


@query(f"WITH {B.DOC}, {B.JOB} SELECT id AS document_id, CASE WHEN id IN (SELECT document_id FROM job WHERE status = 'failed') THEN 'failed' ELSE status END AS status FROM doc")
def dead_documents(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d)[0].select("document_id", "status")


@query(
    f"""WITH {B.DOC}, {B.JOB} SELECT d.id % 7 AS actor, 'ingest.step_failed' AS action, CAST(j.document_id AS VARCHAR) AS target_id, 'worker' AS ip_address, 'celery' AS user_agent,
'{{"job_id":' || job_id || ',"error":"' || left(repeat('e' || job_id, 700), 1000) || '"}}' AS details FROM job j LEFT JOIN doc d ON d.id = j.document_id WHERE j.status = 'failed'"""
)
def dead_letter_audit(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d)[2].drop("target_type")


def _kept(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(" CUSTOMER#000000001 ", "admin"), ("operator", "user")], "username string, role string")


@query(f"WITH {B.USR} SELECT lower(username) AS key, 'remove' AS action FROM usr WHERE lower(username) <> 'customer#000000001' UNION ALL SELECT 'customer#000000001', 'update' UNION ALL SELECT 'operator', 'insert'")
def seed_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = G.seed_users(B.users(spark, d), _kept(spark))
    return plan["write"].select("key", "action").union(plan["remove"].select(F.lower("username"), F.lit("remove")))


@query(
    """WITH gone AS (SELECT c_custkey AS u FROM customer WHERE c_custkey <> 1), s AS (SELECT DISTINCT conv_id, conv_id % 10 AS u FROM conversations)
SELECT 'documents of heir' AS name, count(*) AS n FROM documents WHERE doc_id % 10 = 1 OR doc_id % 10 IN (SELECT u FROM gone) UNION ALL SELECT 'audit without actor', count(*) FROM events WHERE user_id IN (SELECT u FROM gone)
UNION ALL SELECT 'sessions', count(*) FROM s WHERE u NOT IN (SELECT u FROM gone) UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id % 10 NOT IN (SELECT u FROM gone)
UNION ALL SELECT 'permissions', count(DISTINCT o_orderkey % 20) FROM orders WHERE o_custkey NOT IN (SELECT u FROM gone)"""
)
def pruned_users(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10).alias("uploader"))
    kbs = B.kbs(spark, d).withColumn("creator", F.lit(2).cast("long"))
    messages = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    sessions = messages.select("session_id", (F.col("session_id") % 10).alias("user_id")).distinct()
    removed = G.seed_users(B.users(spark, d), _kept(spark))["remove"]
    left = G.prune_users(removed, 1, docs, kbs, B.audit(spark, d), sessions, messages, {"permissions": B.permissions(spark, d)})
    named = {"documents of heir": left["documents"].where("uploader = 1"), "audit without actor": left["audit"].where("actor IS NULL")}
    return analytics.table_counts(named | {name: left[name] for name in ("sessions", "messages", "permissions")})


@query("SELECT c_custkey AS target, CASE WHEN c_custkey % 5 = c_custkey AND c_custkey % 2 = 0 THEN 'own_role' WHEN c_custkey % 5 = c_custkey AND c_custkey % 3 = 0 THEN 'own_state' END AS reason FROM customer")
def account_protection(spark: SparkSession, d: str) -> DataFrame:
    target = F.col("c_custkey")
    role, active = F.when(target % 2 == 0, "user").otherwise("admin"), target % 3 != 0
    return table(spark, d, "customer").select(target.alias("target"), G.protected(target % 5, target, role, active).alias("reason"))


@query("SELECT DISTINCT path FROM (SELECT p_name AS path FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT nullif(url, '') FROM pages) WHERE path IS NOT NULL AND path <> ''")
def artifact_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.artifact_paths((table(spark, d, "part"), "p_name"), (table(spark, d, "supplier"), "s_name"), (table(spark, d, "pages"), "url"))


@query(
    """SELECT conv_id, turn, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS citations, count(l_linenumber) AS n
FROM conversations LEFT JOIN lineitem ON l_orderkey = conv_id * 100 + turn AND role = 'assistant' GROUP BY 1, 2"""
)
def cited_messages(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("role") == "assistant", F.col("conv_id") * 100 + F.col("turn"))
    cited = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("index"), F.col("l_partkey").alias("part"))
    rows = V.with_citations(table(spark, d, "conversations").select("conv_id", "turn", key.alias("message_id")), cited)
    shown = F.array_join(F.transform("citations", lambda c: F.concat(c["index"], F.lit(":"), c["part"])), ",")
    return rows.select("conv_id", "turn", shown.alias("citations"), F.size("citations").cast("long").alias("n"))


@query(
    """WITH c AS (SELECT l_orderkey, l_partkey % 9 AS document_id, l_linenumber AS index, CASE WHEN l_linenumber <> 7 THEN [l_linenumber, CAST(l_quantity AS INTEGER)] END AS k FROM lineitem)
SELECT l_orderkey, document_id, index, row_number() OVER (PARTITION BY l_orderkey, document_id ORDER BY k[1] NULLS LAST, k[2], index)::INTEGER AS place FROM c"""
)
def citation_order(spark: SparkSession, d: str) -> DataFrame:
    rows = cited_lines(spark, d).withColumn("query_id", F.col("l_orderkey"))
    return V.by_clause(rows).select("l_orderkey", "document_id", "index", "place")


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'failed' WHEN 3 THEN 'succeeded' ELSE 'pending' END AS state,
CASE p_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/gif' ELSE 'application/octet-stream' END AS mime,
CASE WHEN p_size * 100000 >= 1048576 THEN printf('%.1f MB', floor(p_size * 1000000 / 1048576.0 + 0.5) / 10) ELSE printf('%.1f KB', floor(p_size * 1000000 / 1024.0 + 0.5) / 10) END AS size, left(p_name, 8) AS short FROM part"""
)
def display_values(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (1 + F.col("p_partkey") % 6).cast("int"))
    state = pick(" Running", "DONE", "error", "completed", "queued", None)
    name = pick("a.JPG", "b.c.png", "noext", "d.webp", "e.gif", "f.pdf")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), V.recognition_status(state).alias("state"), V.image_mime(name).alias("mime"),
        display.size_label(F.col("p_size") * 100000).alias("size"), display.short_id(F.col("p_name")).alias("short"),
    )


@query("SELECT c_custkey AS request_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 50 THEN 'too_many' END AS fault FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey")
def upload_arity(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("request_id"))
    return G.arity_faults(files, table(spark, d, "customer").select(F.col("c_custkey").alias("request_id")))


@query(
    """WITH r AS (SELECT event_id AS request_id, user_id % 3 AS priority, ts FROM events), w AS (SELECT * FROM r ORDER BY ts, request_id LIMIT 16),
p AS (SELECT request_id, row_number() OVER (ORDER BY priority, ts, request_id)::INTEGER AS place FROM w) SELECT request_id, CASE WHEN place IS NULL THEN 429 ELSE 202 END AS status, place FROM r LEFT JOIN p USING (request_id)"""
)
def recognition_queue(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("at"))
    return G.queue(asked).select("request_id", "status", "place")


@query(f"WITH {B.DOC}, {B.LINE} SELECT id, pos, content FROM line WHERE id % 5 <> 0 UNION ALL SELECT id, 0, upper(kb) FROM doc WHERE id % 5 = 0")
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    new = B.docs(spark, d).where("id % 5 = 0").select("id", F.lit(0).alias("pos"), F.upper("kb").alias("content"))
    return replace_documents(B.chunk_lines(spark, d).select("id", "pos", "content"), new, "id")


@query(f"""WITH {B.RECEIPT} SELECT DISTINCT job_id, step, job_id || ':' || step || ':' || sha256('{{"part": ' || part || ', "status": "' || status || '"}}') AS key FROM receipt""")
def receipt_keys(spark: SparkSession, d: str) -> DataFrame:
    return B.receipts(spark, d).select("job_id", "step", G.receipt_key(F.col("job_id"), F.col("step"), F.struct("status", "part")).alias("key")).distinct()


@query("SELECT event_id, ts + INTERVAL 24 HOURS AS expires_at FROM events")
def export_expiry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.expires_at(F.col("ts")).alias("expires_at"))
