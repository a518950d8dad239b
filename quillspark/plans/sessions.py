"""Queries over conversations, references and streamed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import conversations as V
from quillspark.plans.registry import query
from quillspark.sources.files import table


@query(
    """SELECT conv_id AS session_id, role, content, created_at FROM (
  SELECT a.conv_id, unnest([{'role': 'user', 'content': a.text, 'created_at': TIMESTAMP '2024-01-01' + to_minutes(a.turn)},
    {'role': 'assistant', 'content': b.text, 'created_at': TIMESTAMP '2024-01-01' + to_minutes(a.turn) + INTERVAL 1 MICROSECOND}], recursive := true)
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
)
def turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    return V.turns(asked.join(said, ["conv_id", "turn"]).select(F.col("conv_id").alias("session_id"), "question", "answer", at.alias("asked_at")))


@query("SELECT conv_id AS session_id, coalesce(nullif(left(trim(arg_min(text, turn)), 40), ''), '新会话') AS title FROM conversations GROUP BY 1")
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("text", "turn").alias("question"))
    return first.select("session_id", V.session_title(F.col("question")).alias("title"))


def cited_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as citations: a path with a clause, a box."""
    rows = table(spark, d, "lineitem")
    path = F.array(F.concat(F.lit("Part "), F.col("l_suppkey")), F.concat(F.lit("Clause "), F.col("l_linenumber"), F.lit("."), F.col("l_quantity").cast("int")))
    path = F.when(F.col("l_linenumber") == 7, F.array(F.lit("none"))).otherwise(path)
    box = F.create_map(F.lit("x"), F.col("l_linenumber").cast("double"), F.lit("y"), F.lit(2.0), F.lit("width"), F.lit(3.5), F.lit("height"), F.col("l_quantity"))
    return rows.select(
        (F.col("l_orderkey") % 50).alias("query_id"), (F.col("l_partkey") % 9).alias("document_id"), F.col("l_linenumber").alias("index"),
        path.alias("section_path"), F.col("l_returnflag").alias("snippet"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("page_start"), box.alias("box"), "l_orderkey", "l_partkey", "l_suppkey",
    )


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey % 50 AS query_id, l_partkey % 9 AS document_id, CASE WHEN l_linenumber <> 7 THEN l_linenumber || '.' || CAST(l_quantity AS INTEGER) END AS clause, l_linenumber AS a, CAST(l_quantity AS INTEGER) AS b FROM lineitem)
SELECT query_id, document_id, coalesce(string_agg(clause, '、' ORDER BY a, b), '') AS clauses, document_id || coalesce(' ' || string_agg(clause, '、' ORDER BY a, b), '') AS reference FROM c GROUP BY 1, 2"""
)
def document_clauses(spark: SparkSession, d: str) -> DataFrame:
    return V.document_clauses(cited_lines(spark, d)).withColumn("clauses", F.array_join("clauses", "、"))


@query(
    """SELECT l_orderkey, l_linenumber AS index, l_partkey, l_suppkey, 'ref-' || l_linenumber AS reference_id, CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 1 END AS page,
'/documents/' || (l_partkey % 9) || '/pdf?page=' || (CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 1 END) || '#bbox=' || l_linenumber || ',2,3.5,' || CAST(l_quantity AS INTEGER) AS url FROM lineitem"""
)
def reference_urls(spark: SparkSession, d: str) -> DataFrame:
    return V.references(cited_lines(spark, d)).select("l_orderkey", "index", "l_partkey", "l_suppkey", "reference_id", "page", "url")


@query(
    """SELECT event_id AS query_id, event_id AS seq, 'content' AS kind, event_type || ' ' AS text FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, event_id, 'reasoning', event_type FROM events WHERE event_id % 3 = 1"""
)
def answer_deltas(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 3
    delta = F.struct(F.when(kind == 1, F.col("event_type")).alias("reasoning_content"), F.concat("event_type", F.lit(" ")).alias("content"))
    data = F.when(kind == 0, "[DONE").otherwise(F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"))))
    return V.deltas(table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("event_id").alias("seq"), data.alias("data")))


@query(
    """SELECT o_orderkey AS token_id, CAST(floor(epoch_us(o_orderdate) / 1000000.0 - epoch_us(TIMESTAMP '2000-01-01') / 1000000.0) AS BIGINT) AS seconds_left FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '2000-01-01'"""
)
def valid_tokens(spark: SparkSession, d: str) -> DataFrame:
    revoked = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_id"), F.col("o_orderdate").alias("expires_at"), revoked.alias("revoked_at"))
    return V.valid_tokens(rows, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("token_id", "seconds_left")
