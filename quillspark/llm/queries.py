"""The ten operators over the whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import conversation_repair, decision_list, decontaminate, embedding_dedup, filter_audit, hmm, language_id, minhash_dedup, mixing, quality, toxicity, url_filter, warc
from quillspark.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, else by the method. Null and odd urls have an empty host and
    path and are allowed; repeated rows are each judged, ties at the cut are allowed, no rows give none.
    Very long urls are judged whole; columns other than those read are ignored."""
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Null, empty, zero and non-finite ones link with nothing;
    equal vectors link with each other, rows that repeat a vec_id each count, a null vec_id stays alone.
    Vectors of any length are compared with those of their own length; columns other than those read are
    ignored; an empty table gives no rows."""
    found = embedding_dedup.classes(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document. Null, empty and wordless texts have size 0 and take
    nothing; repeated rows each count, ties in size go by hash; null sources are the last source.
    Very long texts count whole; columns other than those read are ignored; an empty table gives no rows."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of whole texts. Null and empty texts are their end alone; repeated rows
    each count and score alike; without training rows (N = 0) the base spreads over unknown words.
    Very long texts are scored whole; columns other than those read are ignored; an empty table gives no rows."""
    return hmm.language_model(read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents. Null, empty and wordless texts link with nothing; repeated
    rows share their component; a row without a doc_id has none and a null kept.
    Very long texts are compared whole; a similarity at the threshold links; columns other than those read are
    ignored; an empty table gives no rows."""
    found = minhash_dedup.classes(read(spark, sf_dir, "documents"), minhash_dedup.DedupParams(words=4))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, read back. A null html is an empty payload; of equal payloads the smallest
    page_id is the response; rows that repeat it are responses too; no pages give no rows.
    Very long payloads are one record; columns other than those read are ignored."""
    path = f"{Scratch(spark, 'archives').root}/warc"
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.scan(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Null texts and those without a letter are ``und`` with score 0; of
    equal sizes the first language by name counts; repeated rows are judged alike.
    Very long texts are judged whole, in segments; columns other than those read are ignored; an empty
    table gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    dictionaries = language_id.fit(docs.where(~F.col("held_out")))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), dictionaries)
    return found.select("doc_id", "held_out", "language.*")


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, held_out, label): grade 0 is low quality, 1 good but toxic, 2 good and not toxic.

    Of labels that repeat a doc_id the lowest quality and the highest toxicity count.
    """
    rated = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    return docs.select("doc_id", "text").join(rated.select("doc_id", grade.alias("label")), "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document. Null and empty texts have score 0, so the
    thresholds decide; repeated rows are graded alike; a tail probability of 0.5 is kept.
    Very long texts are graded whole; columns other than those read are ignored; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 2).alias("held_out"))
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 2)
    model = quality.fit(graded(docs, sampled(labels, "quality", 16_000)))
    rows = quality.grade(docs, model)
    return rows.select("doc_id", "held_out", "grade.*", (F.col("grade.tail_prob") >= 0.5).alias("kept"))


def sampled(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """About ``rows`` labelled ids at most, chosen by a hash of the id; small enough to be
    sent to all tasks, so that fitting never shuffles the texts."""
    labels = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    total = max(1, labels.count())
    share = min(1.0, rows / total)
    return F.broadcast(labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * share) + 1))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, item) of all leaks. Null and empty texts leak nothing, nor do such items; rows that
    repeat a doc_id are each judged, full repeats of an item count once; an overlap at the
    threshold counts.
    Very long texts are asked whole, in windows; columns other than those read are ignored; an
    empty table on either side gives no rows."""
    found = decontaminate.matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.where("leaked").drop("leaked")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. Null, empty and wordless texts have the intercept's; a score of 0.7
    is predicted toxic; repeated rows score alike; without labels all have one score.
    Very long texts are scored whole; columns other than those read are ignored; an empty table
    gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    rows = toxicity.score(docs, toxicity_model(docs.where(~F.col("held_out")), read(spark, sf_dir, "labels")))
    return rows.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Toxic:
    """Fitted on labelled rows of ``docs`` whose id is of the learning folds."""
    labels = labels.where(fold("doc_id", 3) != 1)
    rated = sampled(labels, "toxic", 30_000).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults and cheapest repair of every conversation. A null conv_id is a conversation of its own;
    null roles and texts are one space; null turns come first; different rows of one turn stand by
    role and then digest of the text; repeated rows are duplicates; very long texts count whole; columns
    other than those read are ignored; no rows give none."""
    rows = conversation_repair.damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_repair.summary(rows, conversation_repair.edits(rows))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text, base rules, then the learned list. Null, empty and wordless texts
    have no words and fail the base rules; a share at a limit passes; repeated rows are judged
    alike; without labels of both kinds nothing but the base rules rejects; columns other than
    those read are ignored; no documents give no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", decision_list.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    docs = Scratch(spark, "statistics").save(docs.withColumn("base_failed", base), "statistics")
    grades = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    rules = decision_list.learn(docs.where(~F.col("base_failed")).join(grades, "doc_id"))
    kept = ~F.col("base_failed") & rules.verdict()
    deciding = F.when(F.col("base_failed"), "base").otherwise(rules.rule())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return docs.select("doc_id", *counts, "base_failed", kept.alias("kept"), deciding.alias("deciding_rule"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of five filters, for each source. Null texts are empty, and so alike; a null
    source is the empty one; a row without a doc_id repeats no text and has no label; rows that
    repeat a doc_id each count, none of them repeats another; very long texts count whole; a share
    at a limit passes; columns other than those read are ignored; no documents give no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audit(filter_audit.cells(docs, labels), filter_audit.LETTERS)


def queries() -> dict[str, Query]:
    found = (op1_url_filter, op2_embedding_dedup, op3_mixing, op4_hmm, op5_minhash_dedup, op6_warc_revisits, op7_quality, op8_language_id, op9_decontamination, op10_toxicity, op11_conversation_repair, op12_quality_rules, op13_filter_audit)
    return {f.__name__: f for f in found}


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.original <> p.page_id THEN g.original END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100
"""


_NEVER = "{'c': 1099511627776, 'a': '', 't': ''}"


def _with(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """SQL of a state after an edit: cost, audit and repaired lines."""
    lines = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {edit}, 't': {lines}}}"


_STAYS = "(CASE WHEN kind = 'T' THEN 5 ELSE 0 END)"
OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)),
         lambda c, b: list_reduce(range(8), lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) % 20 AS k
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)
), damaged AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0
), placed AS (
  SELECT *, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '') AS solid, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM damaged
), r AS (
  SELECT id, turn, role, text, n, role[1:1] AS x, lag(role[1:1]) OVER (PARTITION BY id ORDER BY n) AS before,
         CASE WHEN solid = '' THEN 'B' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY n) > 1 THEN 'D' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE 'G' END AS kind FROM placed
), facts AS (
  SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, sum(CASE kind WHEN 'B' THEN 1 ELSE 0 END) AS blank, sum(CASE kind WHEN 'D' THEN 1 ELSE 0 END) AS duplicate,
         sum(CASE kind WHEN 'T' THEN 1 ELSE 0 END) AS truncated, sum(CASE WHEN before || x NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM r GROUP BY 1
), fold AS (
  SELECT id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS e, {_NEVER} AS s, {{'c': CAST(5 AS BIGINT), 'a': 'I', 't': 'user:'}} AS u, {{'c': CAST(10 AS BIGINT), 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a FROM facts
  UNION ALL
  SELECT id, n, e, s, u, least(a, {_with("u", "5", "'I'", "'assistant:'")}) AS a FROM (
    SELECT id, n, e, s, least(u, {", ".join(_with(x, "5", "'I'", "'user:'") for x in "esa")}) AS u, a FROM (
      SELECT id, n, {_with("e", "2", "'D'")} AS e, least({_with("s", "2", "'D'")}, CASE WHEN stays AND x = 's' THEN {_with("e", _STAYS, "'K'", "role || ':' || text")} ELSE {_NEVER} END) AS s,
             least({_with("u", "2", "'D'")}, CASE WHEN stays THEN least({", ".join(_with(y, f"{_STAYS} + CASE x WHEN 'u' THEN 0 ELSE 1 END", "CASE x WHEN 'u' THEN 'K' ELSE 'R' END", "CASE x WHEN 'u' THEN role ELSE 'user' END || ':' || text") for y in "esa")}) ELSE {_NEVER} END) AS u,
             least({_with("a", "2", "'D'")}, CASE WHEN stays THEN {_with("u", f"{_STAYS} + CASE x WHEN 'a' THEN 0 ELSE 1 END", "CASE x WHEN 'a' THEN 'K' ELSE 'R' END", "CASE x WHEN 'a' THEN role ELSE 'assistant' END || ':' || text")} ELSE {_NEVER} END) AS a
      FROM (SELECT r.*, e, s, u, a, kind IN ('T', 'G') AS stays FROM fold JOIN r ON r.id = fold.id AND r.n = fold.n + 1)))
), best AS (SELECT facts.*, least(e, a) AS best FROM fold JOIN facts USING (id, n))
SELECT CAST(nullif(c.id, '') AS BIGINT) AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), '') AS id FROM conversations) c LEFT JOIN best USING (id)
"""


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (SELECT text, min(doc_id) AS first FROM t GROUP BY 1),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM t JOIN first USING (text) LEFT JOIN l ON l.doc_id = t.doc_id
), cell AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, o, step, f, n, good, toxic, fails, contains(fails, f) AS now, length(translate(fails, before, '')) < length(fails) AS earlier FROM cell, s
), g AS (
  SELECT part, o, step, f, sum(CASE WHEN NOT now AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN now AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN now AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN now AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": OP6_SQL, "op11_conversation_repair": OP11_SQL, "op13_filter_audit": OP13_SQL}
