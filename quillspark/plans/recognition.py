"""Queries over uploads, byte ranges, assets and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display, text as T
from quillspark.operators import documents as D, governance as G
from quillspark.plans.registry import query
from quillspark.sources import files
from quillspark.sources.files import table


def _pick(key: str, *values: str | None) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (1 + F.col(key) % len(values)).cast("int"))


_UPLOAD = """up AS (SELECT doc_id AS id, ['a/Plan.v1.pdf','b\\Note.PDF','c.txt','.pdf','d.pdf'][1 + doc_id % 5] AS name, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN ' T ' END AS title,
['application/pdf', NULL, 'text/html', 'application/octet-stream'][1 + doc_id % 4] AS mime, CASE WHEN doc_id % 7 = 0 THEN text ELSE '%PDF-' || text END AS body, lang, ts FROM documents LEFT JOIN events ON event_id = doc_id)"""


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    times = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("uploaded_at"))
    body = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-"), "text"))
    return table(spark, d, "documents").join(times, "doc_id", "left").select(
        F.col("doc_id").alias("id"), _pick("doc_id", "a/Plan.v1.pdf", "b\\Note.PDF", "c.txt", ".pdf", "d.pdf").alias("name"), _pick("doc_id", " ", " T ", None).alias("title"),
        _pick("doc_id", "application/pdf", None, "text/html", "application/octet-stream").alias("mime"), body.cast("binary").alias("content"), F.col("lang").alias("doc_kind"), "uploaded_at",
    )


@query(
    f"""WITH {_UPLOAD} SELECT id, CASE WHEN NOT ends_with(lower(name), '.pdf') THEN 'extension' WHEN octet_length(encode(body)) > 5000 THEN 'size' WHEN NOT starts_with(body, '%PDF-') THEN 'signature'
WHEN coalesce(mime, '') NOT IN ('application/pdf', 'application/x-pdf', 'application/octet-stream', '') THEN 'type' END AS fault FROM up"""
)
def upload_faults(spark: SparkSession, d: str) -> DataFrame:
    fault = files.upload_fault(F.col("name"), F.col("mime"), F.col("content"), most_bytes=5000)
    return _uploads(spark, d).select("id", fault.alias("fault"))


@query(
    f"""WITH {_UPLOAD}, b AS (SELECT *, regexp_extract(name, '([^/\\\\]+)$', 1) AS base, sha256(body) AS digest FROM up)
SELECT base AS name, coalesce(nullif(trim(title), ''), regexp_replace(base, '\\.[^.]*$', '')) AS title, CASE WHEN lang IN ('plan','spec','drawing','quantity','other') THEN lang ELSE 'other' END AS doc_kind, digest AS sha256,
strftime(ts, '%Y/%m/%d') || '/' || digest || '.pdf' AS path FROM b"""
)
def staged_uploads(spark: SparkSession, d: str) -> DataFrame:
    return files.staged(_uploads(spark, d))


@query(
    """WITH r AS (SELECT doc_id AS id, doc_id % 6 AS c, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
s AS (SELECT *, CASE c WHEN 1 THEN 3 WHEN 2 THEN greatest(0, n - 7) WHEN 3 THEN 5 ELSE 0 END AS a, CASE c WHEN 1 THEN least(9, n - 1) ELSE n - 1 END AS b FROM r)
SELECT id, CAST(CASE WHEN c = 0 THEN 200 WHEN c IN (1, 2, 3) AND a <= b THEN 206 ELSE 416 END AS INTEGER) AS status, CASE WHEN c = 0 OR (c IN (1, 2, 3) AND a <= b) THEN substr(h, 2 * a + 1, 2 * (b - a + 1)) END AS body FROM s"""
)
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _pick("doc_id", None, "bytes=3-9", "bytes=-7", "bytes=5-", "bytes=999999999-", "bytes=x").alias("header"), F.col("text").cast("binary").alias("content"))
    return files.ranges(asked).select("id", "status", F.hex("body").alias("body"))


@query(
    """WITH a AS (SELECT page_id AS document_id, 0 AS n, coalesce(url, '') AS raw, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS INTEGER) END AS page_no, html AS content FROM pages
UNION ALL SELECT page_id, 1, '', 7, url FROM pages), b AS (SELECT *, regexp_extract(raw, '([^/\\\\]*)$', 1) AS base FROM a)
SELECT document_id, CAST(n AS INTEGER) AS n, CASE WHEN base = '' THEN 'image_' || n || '.jpg' ELSE base END AS name, page_no, sha256(content) AS content FROM b"""
)
def page_assets(spark: SparkSession, d: str) -> DataFrame:
    image = lambda name, content, no: F.struct(name.alias("name"), F.base64(content.cast("binary")).alias("base64"), no.alias("page_no"))
    number = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise("p")
    rows = table(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.array(image(F.col("url"), F.col("html"), number), image(F.lit(None).cast("string"), F.col("url"), F.lit("7"))).alias("images"))
    return files.assets(rows).withColumn("content", F.sha2("content", 256))


@query(
    """SELECT doc_id AS document_id, coalesce(n, sha256(text)) AS digest FROM documents LEFT JOIN (SELECT page_id % 300 AS k, sha256(html) AS n FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 300 ORDER BY page_id DESC) = 1) ON k = doc_id
UNION ALL SELECT k, n FROM (SELECT page_id % 300 AS k, sha256(html) AS n FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 300 ORDER BY page_id DESC) = 1) WHERE k NOT IN (SELECT doc_id FROM documents)"""
)
def parse_results(spark: SparkSession, d: str) -> DataFrame:
    """One result a document: the latest of the new ones in the place of the old."""
    now = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("digest"))
    new = table(spark, d, "pages").select((F.col("page_id") % 300).alias("document_id"), F.sha2("html", 256).alias("digest"), "page_id")
    return G.upsert(now, new, ["document_id"], [F.desc("page_id")])


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Parts as recognised pages: a tag, the name, a line with a mark alone."""
    label = F.when(F.col("p_partkey") % 3 == 0, "image").otherwise(F.col("p_name"))
    box = F.when(F.col("p_partkey") % 5 == 0, "oops").otherwise(F.concat(F.lit("[["), "p_size", F.lit(", 2, 3.5, 4]]")))
    tag = F.concat(F.lit("<|ref|>"), label, F.lit("<|/ref|><|det|>"), box, F.lit("<|/det|>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", tag.alias("tag"), F.concat(F.lit("see "), tag, F.lit("\n"), "p_name", F.lit("\n<|det|>\nend")).alias("text"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'image' ELSE p_name END AS label, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS x, CASE WHEN p_partkey % 5 <> 0 THEN 3.5::DOUBLE END AS width, p_partkey % 3 = 0 AS is_image FROM part")
def grounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = _marked(spark, d).select("id", F.explode(D.grounding_tags(F.col("text"))).alias("t"))
    return rows.select("id", "t.label", F.col("t.box")[0][0].alias("x"), F.col("t.box")[0][2].alias("width"), "t.is_image")


@query("SELECT p_partkey AS id, p_name || chr(10) || 'end' AS text FROM part")
def ungrounded(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("id", D.strip_grounding(F.col("text")).alias("text"))


@query("SELECT doc_id AS id, length(regexp_replace(text, '\\s+', '', 'g')) >= 20 AND doc_id % 7 <> 0 AS usable FROM documents")
def usable_texts(spark: SparkSession, d: str) -> DataFrame:
    """Which texts are usable where one in seven ends in a loop of headings."""
    loop = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("\n1.1 the same title"), F.lit(9))).otherwise("")
    return D.usable(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("text", loop).alias("text")))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || l || chr(10) || '图 ' || p_size ELSE l || chr(10) || p_name || CASE WHEN p_partkey % 3 = 1 THEN chr(10) || p_size ELSE '图' END END AS text
FROM (SELECT *, '![](images/' || p_partkey || '.jpg)' || chr(10) || '![](images/b.jpg)' AS l FROM part)"""
)
def image_links(spark: SparkSession, d: str) -> DataFrame:
    figure = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\n图 "), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("\n"), "p_size")).otherwise("图")
    names = F.array(F.concat("p_partkey", F.lit(".jpg")), F.lit("b.jpg"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), D.insert_images(F.concat("p_name", figure), names).alias("text"))


@query(
    """SELECT p_partkey AS id, CAST(n AS INTEGER) AS n, CAST(level AS INTEGER) AS level, title FROM (SELECT p_partkey, 1 AS n, 2 AS level, p_brand AS title FROM part UNION ALL SELECT p_partkey, 2, 1, '第' || p_size || '章 x' FROM part
UNION ALL SELECT p_partkey, 3, 1, p_size || '.' || (p_partkey % 12) || ' ' || p_name FROM part)"""
)
def simple_outlines(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat("p_size", F.lit("."), F.col("p_partkey") % 12)
    text = F.concat_ws("\n", F.concat(F.lit("## "), "p_brand"), F.col("p_name"), F.concat(F.lit("  第"), "p_size", F.lit("章 x")), F.concat(number, F.lit(" "), "p_name"), F.concat("p_size", F.lit(" y")))
    return D.simple_outline(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand END AS label FROM part")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    blank = F.lit(" ")
    path = F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", "p_name", blank)).when(F.col("p_partkey") % 3 == 1, F.array(blank, F.col("p_brand"))).otherwise(F.array(blank))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), display.source_label(path).alias("label"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS no_evidence FROM conversations")
def no_evidence(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" 未在 知识库\n中找到依据。"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.no_evidence(said).alias("no_evidence"))
