"""Queries over accounts, bases, jobs, audit and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display, text as T
from quillspark.operators import analytics, conversations as V, governance as G, lifecycle
from quillspark.plans import bindings as B
from quillspark.plans.registry import query
from quillspark.sources.files import table
from quillspark.streaming import stateful

NOW = "2024-01-06 12:00:00"


@query(f"WITH {B.DOC} SELECT id, kb, doc_kind, created_at FROM doc WHERE status NOT IN ('disabled', 'deleting')")
def live_docs(spark: SparkSession, d: str) -> DataFrame:
    return B.docs(spark, d).where(G.live(F.col("status"))).select("id", "kb", "doc_kind", "created_at")


@query(f"WITH {B.DOC}, f AS (SELECT * FROM doc WHERE doc_kind = 'en' AND (text ILIKE '%thin%' OR kb ILIKE '%src1%')) SELECT id, kb, n_chars, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def doc_search_page(spark: SparkSession, d: str) -> DataFrame:
    rows = G.only(B.docs(spark, d), doc_kind="en", status=None).where(G.containing("thin", "text") | G.containing("src1", "kb"))
    return G.page(rows.select("id", "kb", "n_chars", "created_at"), [F.desc("created_at"), F.asc("id")], 2, 20).drop("created_at")


@query(
    f"""WITH {B.DOC}, t AS (SELECT id, strftime(created_at + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS iso FROM doc)
SELECT id, iso FROM t WHERE NOT (iso < '2024-01-01T10') AND NOT (iso > '2024-01-02T23:59:59')"""
)
def date_window(spark: SparkSession, d: str) -> DataFrame:
    rows = B.docs(spark, d).select("id", display.iso_offset(display.at_offset(F.col("created_at"))).alias("iso"))
    return rows.where(G.within_dates(F.col("iso"), "2024-01-01T10", "2024-01-02"))


@query(f"WITH {B.DOC}, {B.KB}, {B.USR}, {B.PERM} SELECT doc_kind, count(*) AS n FROM doc WHERE status NOT IN ('disabled', 'deleting') AND kb IN (SELECT p.kb FROM perm p JOIN kb USING (kb) WHERE p.user_id = 7 AND kb.is_active) GROUP BY 1")
def doc_types(spark: SparkSession, d: str) -> DataFrame:
    seen = G.accessible(B.users(spark, d).where("user_id = 7"), B.kbs(spark, d), B.permissions(spark, d))
    rows = B.docs(spark, d).where(G.live(F.col("status"))).join(F.broadcast(seen), "kb", "left_semi")
    return analytics.counts_by(rows, "doc_kind")


@query(f"WITH {B.DOC} SELECT status, count(*) AS n FROM doc GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts_by(B.docs(spark, d), "status")


@query(f"WITH {B.JOB} SELECT status, count(*) AS n FROM job GROUP BY 1")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts_by(B.jobs(spark, d), "status")


@query("SELECT CASE WHEN lang IN ('plan','spec','drawing','quantity','other') THEN lang ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(G.doc_kind(F.col("lang")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.DOC}, {B.KB}, {B.PERM} SELECT kb.kb, coalesce(documents, 0) AS documents, coalesce(live_documents, 0) AS live_documents, coalesce(permissions, 0) AS permissions FROM kb
LEFT JOIN (SELECT kb, count(*) AS documents, count(*) FILTER (status NOT IN ('disabled', 'deleting')) AS live_documents FROM doc GROUP BY 1) a USING (kb)
LEFT JOIN (SELECT kb, count(*) AS permissions FROM perm GROUP BY 1) b USING (kb)"""
)
def kb_archive_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.archive_counts(B.kbs(spark, d), B.docs(spark, d), B.permissions(spark, d))


@query(
    f"""WITH {B.DOC}, {B.KB}, {B.USR} SELECT 'users' AS name, count(*) AS n FROM usr UNION ALL SELECT 'kbs', count(*) FROM kb UNION ALL SELECT 'active_kbs', count(*) FROM kb WHERE is_active
UNION ALL SELECT 'documents', count(*) FROM doc UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'messages', count(*) FROM conversations
UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'chunks', sum(len(string_split(text, chr(10))))::BIGINT FROM documents"""
)
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    kbs, conversations = B.kbs(spark, d), table(spark, d, "conversations")
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")))
    tables = {"users": B.users(spark, d), "kbs": kbs, "active_kbs": kbs.where("is_active"), "documents": B.docs(spark, d), "sessions": conversations.select("conv_id").distinct()}
    return analytics.table_counts(tables | {"messages": conversations, "pages": table(spark, d, "pages"), "chunks": lines})


@query(
    f"""WITH {B.DOC}, days AS (SELECT CAST(unnest(range(DATE '2023-12-31', DATE '2024-01-07', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS sessions FROM days
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM doc WHERE created_at >= TIMESTAMP '2023-12-31 12:00:00' GROUP BY 1) a USING (day)
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2023-12-31 12:00:00' GROUP BY 1) b USING (day)"""
)
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    signups = table(spark, d, "events").where("event_type = 'signup'")
    return analytics.daily_trend({"documents": (B.docs(spark, d), "created_at"), "sessions": (signups, "ts")}, NOW, 7)


@query(
    f"""WITH {B.KB}, {B.USR} SELECT e.event_id AS audit_id, e.ts, e.event_type AS action, coalesce(u.username, '') AS username,
coalesce(nullif(trim(json_extract_string(e.props, '$.name')), ''), kb.name, '') AS kb_name
FROM events e LEFT JOIN usr u ON u.user_id = e.user_id LEFT JOIN kb ON kb.kb = 'src' || (e.event_id % 25) ORDER BY e.ts DESC, e.event_id DESC LIMIT 20"""
)
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return analytics.activity(B.audit(spark, d), B.users(spark, d), B.kbs(spark, d))


@query(f"WITH {B.USR} SELECT audit_id, actor, action FROM (SELECT event_id AS audit_id, user_id AS actor, event_type AS action, ts FROM events WHERE event_type ILIKE '%i%' AND user_id IN (SELECT user_id FROM usr WHERE is_active)) ORDER BY ts DESC, audit_id LIMIT 50")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    rows = B.audit(spark, d).where(G.containing("i", "action")).join(B.users(spark, d).where("is_active").select(F.col("user_id").alias("actor")), "actor", "left_semi")
    return rows.orderBy(F.desc("ts"), "audit_id").limit(50).select("audit_id", "actor", "action")


@query(
    f"""WITH {B.KB}, {B.USR}, {B.PERM} SELECT u.user_id, kb.kb FROM usr u, kb WHERE u.role = 'admin' AND kb.is_active
UNION SELECT p.user_id, p.kb FROM perm p JOIN usr u USING (user_id) JOIN kb ON kb.kb = p.kb WHERE u.role <> 'admin' AND kb.is_active"""
)
def accessible_kbs(spark: SparkSession, d: str) -> DataFrame:
    return G.accessible(B.users(spark, d), B.kbs(spark, d), B.permissions(spark, d))


@query(
    f"""WITH {B.KB}, {B.USR}, {B.PERM}, req AS (SELECT c_custkey AS user_id, 'src' || (c_custkey % 23) AS kb, ['viewer','editor','owner','admin'][1 + c_custkey % 4] AS needs FROM customer)
SELECT r.*, CASE WHEN kb.kb IS NULL THEN 404 WHEN (CASE WHEN u.role = 'admin' THEN 4 ELSE coalesce(CASE p.role WHEN 'viewer' THEN 1 WHEN 'editor' THEN 2 WHEN 'owner' THEN 3 END, 0) END)
  < list_position(['viewer','editor','owner','admin'], r.needs) THEN 403 ELSE 200 END AS decision
FROM req r LEFT JOIN (SELECT kb FROM kb WHERE is_active) kb ON kb.kb = r.kb LEFT JOIN perm p ON p.user_id = r.user_id AND p.kb = r.kb LEFT JOIN usr u ON u.user_id = r.user_id"""
)
def access_decisions(spark: SparkSession, d: str) -> DataFrame:
    needs = F.element_at(F.array(*(F.lit(x) for x in ("viewer", "editor", "owner", "admin"))), (1 + F.col("c_custkey") % 4).cast("int"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("src"), F.col("c_custkey") % 23).alias("kb"), needs.alias("needs"))
    return G.decision(asked, B.permissions(spark, d), B.kbs(spark, d), B.users(spark, d))


@query(
    f"""WITH {B.PERM}, nxt AS (SELECT kb, user_id, CASE WHEN user_id % 5 = 0 THEN 'editor' ELSE role END AS role FROM perm WHERE user_id % 7 <> 0 UNION ALL SELECT DISTINCT kb, -1 - user_id % 3, 'viewer' FROM perm)
SELECT kb, user_id, p.role AS old_role, n.role AS new_role, CASE WHEN p.role IS NULL THEN 'insert' WHEN n.role IS NULL THEN 'delete' WHEN p.role <> n.role THEN 'update' ELSE 'keep' END AS action
FROM perm p FULL JOIN nxt n USING (kb, user_id)"""
)
def permission_reconcile(spark: SparkSession, d: str) -> DataFrame:
    now = B.permissions(spark, d).select("kb", "user_id", "role")
    role = F.when(F.col("user_id") % 5 == 0, "editor").otherwise(F.col("role"))
    more = now.select("kb", (-1 - F.col("user_id") % 3).alias("user_id"), F.lit("viewer").alias("role")).distinct()
    return G.reconcile(now, now.where("user_id % 7 <> 0").withColumn("role", role).union(more))


@query(
    f"""WITH {B.USR}, {B.PERM}, inc AS (SELECT kb, CASE WHEN kb = 'src3' THEN -user_id ELSE user_id END AS user_id, CASE WHEN kb = 'src4' THEN 'viewer' ELSE role END AS role FROM perm
  UNION ALL SELECT kb, user_id, role FROM perm WHERE kb = 'src5')
SELECT kb, fault FROM (SELECT i.kb, CASE WHEN count(i.user_id) > count(DISTINCT i.user_id) THEN 'duplicate_user' WHEN bool_or(u.user_id IS NULL) THEN 'unknown_user' WHEN NOT bool_or(i.role = 'owner') THEN 'no_owner' END AS fault
FROM inc i LEFT JOIN usr u ON u.user_id = i.user_id GROUP BY 1) WHERE fault IS NOT NULL"""
)
def permission_faults(spark: SparkSession, d: str) -> DataFrame:
    now = B.permissions(spark, d).select("kb", "user_id", "role")
    changed = now.select("kb", F.when(F.col("kb") == "src3", -F.col("user_id")).otherwise(F.col("user_id")).alias("user_id"), F.when(F.col("kb") == "src4", "viewer").otherwise(F.col("role")).alias("role"))
    return G.permission_faults(changed.union(now.where("kb = 'src5'")), B.users(spark, d))


@query(
    """WITH ex AS (SELECT p_brand AS kb, lower(trim(p_name)) AS k FROM part WHERE p_partkey % 2 = 0), inc AS (SELECT p_brand AS kb, upper(p_name) AS name, p_partkey AS pos FROM part WHERE p_partkey % 2 = 1)
SELECT kb, name, pos FROM (SELECT *, row_number() OVER (PARTITION BY kb, lower(trim(name)) ORDER BY pos) AS n FROM inc WHERE (kb, lower(trim(name))) NOT IN (SELECT kb, k FROM ex)) WHERE n = 1"""
)
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("kb"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return G.new_names(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1").withColumn("name", F.upper("name")), T.casefold(F.trim("name")))


@query(f"WITH {B.JOB} SELECT document_id, job_id, status, created_at FROM job QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) = 1")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(B.jobs(spark, d), "document_id", [F.desc("created_at"), F.desc("job_id")]).select("document_id", "job_id", "status", "created_at")


@query(
    f"""WITH {B.JOB}, {B.RECEIPT}, doc AS (SELECT doc_id AS document_id, ['pending','ocr','parsing','embedding','indexing','vector_indexing','ready','failed','disabled','odd'][1 + doc_id % 10] AS status FROM documents),
cur AS (SELECT * FROM job QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) = 1),
done AS (SELECT job_id, max(n) AS last, max([15,35,45,55,70,82,90,96,100][n]) AS reached FROM receipt WHERE status = 'succeeded' GROUP BY 1),
j AS (SELECT d.document_id, d.status, CASE d.status WHEN 'parsing' THEN 'embedding' WHEN 'indexing' THEN 'vector_indexing' ELSE d.status END AS canon, c.status AS job_status, last, reached FROM doc d LEFT JOIN cur c USING (document_id) LEFT JOIN done USING (job_id)),
p AS (SELECT *, CASE WHEN canon IN ('pending','ocr','embedding','vector_indexing','ready') THEN canon ELSE 'pending' END AS base, ['ocr','ocr','embedding','embedding','embedding','vector_indexing','vector_indexing','vector_indexing','ready'][last] AS step_phase FROM j)
SELECT document_id, CASE WHEN canon IN ('ready','failed','disabled','deleting') THEN canon WHEN job_status = 'succeeded' OR last = 9 THEN 'ready' WHEN job_status IN ('dead','failed') THEN 'failed'
  WHEN list_position(['pending','ocr','embedding','vector_indexing','ready'], step_phase) > list_position(['pending','ocr','embedding','vector_indexing','ready'], base) THEN step_phase ELSE base END AS phase,
CAST(CASE WHEN status = 'ready' OR coalesce(job_status = 'succeeded', false) THEN 100 WHEN status = 'pending' THEN 0 WHEN reached IS NULL THEN (CASE status WHEN 'ocr' THEN 8 WHEN 'embedding' THEN 40 WHEN 'vector_indexing' THEN 75 ELSE 0 END)
  ELSE least(greatest(reached, CASE status WHEN 'ocr' THEN 8 WHEN 'embedding' THEN 40 WHEN 'vector_indexing' THEN 75 ELSE 0 END), 99) END AS INTEGER) AS percent FROM p"""
)
def ingest_progress(spark: SparkSession, d: str) -> DataFrame:
    names = ("pending", "ocr", "parsing", "embedding", "indexing", "vector_indexing", "ready", "failed", "disabled", "odd")
    status = F.element_at(F.array(*(F.lit(x) for x in names)), (1 + F.col("doc_id") % 10).cast("int"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), status.alias("status"))
    return G.progress(docs, B.jobs(spark, d), B.receipts(spark, d).select("job_id", "step", "status"))


@query(f"WITH {B.RECEIPT} SELECT job_id, step, ts, part FROM receipt QUALIFY row_number() OVER (PARTITION BY job_id, step ORDER BY ts, part, supp) = 1")
def receipt_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = B.receipts(spark, d).withColumn("key", F.concat_ws(":", "job_id", "step"))
    return G.first_of_each(rows, "key", [F.asc("ts"), F.asc("part"), F.asc("supp")]).select("job_id", "step", "ts", "part")


_EIGHT = f"""{B.JOB}, {B.RECEIPT}, t_documents AS (SELECT doc_id AS document_id, source AS kb FROM documents), t_chunks AS (SELECT doc_id AS document_id, source AS kb, unnest(string_split(text, chr(10))) AS line FROM documents),
t_pages AS (SELECT DISTINCT doc_id AS document_id, unnest(range(len(string_split(text, chr(10))) // 10 + 1)) AS page_no FROM documents), t_assets AS (SELECT page_id % 700 AS document_id FROM pages),
t_results AS (SELECT doc_id AS document_id FROM labels), t_citations AS (SELECT event_id % 900 AS document_id, 'src' || (event_id % 25) AS kb FROM events)"""


def _eight(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Documents and the seven tables that hang on them."""
    docs = table(spark, d, "documents")
    own = [F.col("doc_id").alias("document_id"), F.col("source").alias("kb")]
    lines = F.split("text", "\n")
    return {
        "documents": docs.select(*own), "jobs": B.jobs(spark, d), "receipts": B.receipts(spark, d), "chunks": docs.select(*own, F.explode(lines).alias("line")),
        "pages": docs.select(own[0], F.explode(F.sequence(F.lit(0), F.floor(F.size(lines) / 10).cast("int"))).alias("page_no")).distinct(),
        "assets": table(spark, d, "pages").select((F.col("page_id") % 700).alias("document_id")), "results": table(spark, d, "labels").select(own[0]),
        "citations": table(spark, d, "events").select((F.col("event_id") % 900).alias("document_id"), F.concat(F.lit("src"), F.col("event_id") % 25).alias("kb")),
    }


def _counts_sql(gone: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER (NOT ({test})) AS kept, count(*) FILTER ({test}) AS deleted FROM {source}" for name, (source, test) in gone.items())


def _gone_sql(documents: str, bases: str | None = None) -> dict[str, tuple[str, str]]:
    of = f"coalesce(document_id IN ({documents}), false)"
    base = f" OR coalesce(kb IN ({bases}), false)" if bases else ""
    out = {name: (f"t_{name}", of) for name in ("documents", "pages", "assets", "results")}
    out |= {name: (f"t_{name}", of + base) for name in ("chunks", "citations")}
    return out | {"jobs": ("job", of), "receipts": ("receipt", f"job_id IN (SELECT job_id FROM job WHERE {of})")}


@query(f"WITH {_EIGHT} {_counts_sql(_gone_sql('SELECT doc_id FROM documents WHERE doc_id % 3 = 0'))}")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A third of the documents deleted, with all that hangs on them: rows kept and deleted by table."""
    tables = _eight(spark, d)
    return lifecycle.deleted_counts(tables, lifecycle.cascade(tables, "documents", tables["documents"].where("document_id % 3 = 0")))


@query(
    f"""WITH {_EIGHT}, {B.KB}, {B.PERM}, t_sessions AS (SELECT event_id AS session_id, 'src' || (event_id % 25) AS kb FROM events WHERE event_type = 'signup'), gone AS (SELECT kb FROM kb WHERE NOT is_active)
{_counts_sql(_gone_sql("SELECT document_id FROM t_documents WHERE kb IN (SELECT kb FROM gone)", "SELECT kb FROM gone"))}
UNION ALL SELECT 'permissions', count(*) FILTER (kb NOT IN (SELECT kb FROM gone)), count(*) FILTER (kb IN (SELECT kb FROM gone)) FROM perm UNION ALL SELECT 'bases', count(*) FILTER (is_active), count(*) FILTER (NOT is_active) FROM kb
UNION ALL SELECT 'sessions', count(*), 0 FROM t_sessions UNION ALL SELECT 'attached sessions', count(*) FILTER (kb NOT IN (SELECT kb FROM gone)), count(*) FILTER (kb IN (SELECT kb FROM gone)) FROM t_sessions"""
)
def base_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The inactive bases deleted: their documents and permissions go, sessions stay without a base."""
    bases = B.kbs(spark, d)
    sessions = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), F.concat(F.lit("src"), F.col("event_id") % 25).alias("kb"))
    tables = _eight(spark, d) | {"permissions": B.permissions(spark, d), "bases": bases, "sessions": sessions}
    left = lifecycle.cascade(tables, "bases", bases.where("NOT is_active"), lifecycle.BASE_KEYS)
    attached = {"attached sessions": sessions.where("kb IS NOT NULL")}
    return lifecycle.deleted_counts(tables | attached, left | {"attached sessions": left["sessions"].where("kb IS NOT NULL")})


@query(f"WITH {B.JOB} SELECT job_id, CASE WHEN document_id % 4 = 0 AND status NOT IN ('succeeded','dead','failed','cancelled') THEN 'cancel_requested' ELSE status END AS status FROM job")
def deletion_requests(spark: SparkSession, d: str) -> DataFrame:
    jobs = B.jobs(spark, d)
    docs = jobs.select("document_id", F.lit("ready").alias("status")).distinct()
    return G.request_deletion(docs, jobs, docs.where("document_id % 4 = 0"))[1].select("job_id", "status")


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn)::INTEGER AS n FROM conversations")
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("half", F.floor(F.col("turn") / 2))
    return V.detail(rows, "conv_id", "half", "turn").drop("half")


@query("SELECT user_id AS session_id, coalesce(n, 0) AS messages FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = user_id")
def messages_per_session(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("messages"))
    return table(spark, d, "events").select(F.col("user_id").alias("session_id")).distinct().join(counted, "session_id", "left").na.fill(0, ["messages"])


@query("SELECT ts_bucket AS start, count(*) AS requests, round(count(*) / 300.0, 6) AS per_second FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS ts_bucket FROM events) GROUP BY 1")
def request_rate(spark: SparkSession, d: str) -> DataFrame:
    return stateful.request_rate(table(spark, d, "events"))


@query()
def login_blocks(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = table(spark, d, "events").select("event_id", at.alias("at"), F.col("user_id").cast("string").alias("subject"), F.floor(F.col("user_id") / 8).cast("string").alias("address"), (F.col("event_type") != "error").alias("success"))
    return stateful.login_blocks_batch(rows)


@query("SELECT doc_id AS id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 25) AS BIGINT) AS batch FROM documents")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    return G.batches(table(spark, d, "documents").select(F.col("doc_id").alias("id")), [F.asc("id")])


@query(f"WITH {B.USR} SELECT user_id, coalesce(nullif(trim(split_part(fwd, ',', 1)), ''), '10.0.0.1') AS ip, lower(trim(username)) AS key FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN '' ELSE ' 192.0.2.' || (user_id % 250) || ', 10.1.1.1' END AS fwd FROM usr)")
def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    fwd = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit(" 192.0.2."), F.col("user_id") % 250, F.lit(", 10.1.1.1")))
    return B.users(spark, d).select("user_id", G.client_ip(fwd, F.lit("10.0.0.1")).alias("ip"), F.lower(F.trim("username")).alias("key"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS iso, CAST(ts + INTERVAL 8 HOURS AS DATE) AS day, round(value / 1000 * 0.7, 6) AS yuan, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def offset_times(spark: SparkSession, d: str) -> DataFrame:
    local = display.at_offset(F.col("ts"))
    return table(spark, d, "events").select("event_id", display.iso_offset(local).alias("iso"), F.to_date(local).alias("day"), F.round(display.cost(F.col("value"), F.lit(0.7)), 6).alias("yuan"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))
