"""Retrieval queries: tracks, fusion, citations, search over bases, evaluation, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display, text as T
from quillspark.operators import analytics, governance as G, retrieval as R, text_index, vector_index
from quillspark.operators.documents import char_vectors
from quillspark.plans import bindings as B
from quillspark.plans.registry import query
from quillspark.scratch import Scratch
from quillspark.sources import files

K = 6
DEPTH = 5_000  # results of one base
_VIEWS = f"WITH {B.DOC}, {B.SEARCH}"
_TRACKS = f"{_VIEWS}, {B.DENSE.format(k=2 * K)}, {B.LEXICAL.format(k=2 * K)}"


@query(f"{_VIEWS}, {B.DENSE.format(k=K)} SELECT query_id, id, score, rank::INTEGER AS rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_track(B.questions(spark, d), B.searchable(spark, d), K)


@query(f"{_VIEWS}, {B.LEXICAL.format(k=K)} SELECT query_id, id, score, rank::INTEGER AS rank FROM lexical")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_track(B.questions(spark, d), B.searchable(spark, d), K)


@query(
    f"""{_VIEWS}, post AS (SELECT id, term, count(*) AS w FROM (SELECT id, unnest(regexp_extract_all(low, '[a-z0-9_]+')) AS term FROM live) GROUP BY 1, 2),
len AS (SELECT id, sum(w) AS l FROM post GROUP BY 1), st AS (SELECT count(*) AS n, avg(l) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)
SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM post JOIN ask_term USING (term) JOIN df USING (term) JOIN len USING (id), st GROUP BY 1, 2)) WHERE rank <= {K}"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Answered from a kept index alone; it is written here as an ingest would write it."""
    path = f"{Scratch(spark, 'text').root}/index"
    text_index.add(B.searchable(spark, d).select("id", "low"), path)
    return text_index.search(B.questions(spark, d), path, K)


@query()
def approximate_vectors(spark: SparkSession, d: str) -> DataFrame:
    """About the nearest vectors, from an inverted file with coded residuals; tests assert its recall."""
    path = f"{Scratch(spark, 'vectors').root}/index"
    vector_index.build(files.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path)
    return vector_index.search(B.questions(spark, d).select("query_id", "query_vector"), path, K)


@query()
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.sparse_track(B.questions(spark, d), R.postings(B.searchable(spark, d)), K)


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked, corpus = B.questions(spark, d), B.searchable(spark, d)
    return R.dense_track(asked, corpus, 2 * K), R.lexical_track(asked, corpus, 2 * K)


@query(f"{_TRACKS}, {B.FUSED.format(raw='true', k=K)} SELECT query_id, id, score, rank::INTEGER AS rank FROM fused")
def rrf_search(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(*_tracks(spark, d), K)


@query(f"{_TRACKS}, {B.FUSED.format(raw='false', k=2 * K)} SELECT query_id, id, score, rank::INTEGER AS rank FROM fused")
def rrf_chat(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(*_tracks(spark, d), 2 * K, raw_single=False)


def _cited(spark: SparkSession, d: str) -> DataFrame:
    fused = rrf_chat(spark, d)
    docs = B.docs(spark, d).select("id", "kb", F.substring("text", 1, 200).alias("snippet"))
    page = (F.col("id") % 4).cast("int")
    rows = fused.join(docs, "id").select("query_id", "id", F.col("kb").alias("document_id"), F.array("kb").alias("section_path"), page.alias("page_start"), "snippet", "score", "rank")
    return R.citations(rows, K)


_CITED = f"""{_TRACKS}, {B.FUSED.format(raw='false', k=2 * K)}, cand AS (SELECT f.query_id, f.id, d.kb AS document_id, (f.id % 4)::INTEGER AS page_start, left(d.text, 200) AS snippet, f.score, f.rank FROM fused f JOIN doc d USING (id)),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, document_id, page_start ORDER BY score DESC, rank) = 1),
cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INTEGER AS index FROM one QUALIFY index <= {K})"""


@query(f"{_CITED} SELECT query_id, index, id, document_id, page_start, snippet, score FROM cited")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("query_id", "index", "id", "document_id", "page_start", "snippet", "score")


@query(f"{_CITED} SELECT a.query_id, coalesce(max(c.score) >= 0.05, false) AS has_hit FROM ask a LEFT JOIN cited c USING (query_id) GROUP BY 1")
def answerable(spark: SparkSession, d: str) -> DataFrame:
    return R.answerable(_cited(spark, d), B.questions(spark, d), 0.05)


@query(
    f"""{_CITED}, {B.KB}, line AS (SELECT query_id, index, '[cite:' || index || '] 文档《' || coalesce(kb.name, document_id) || '》 | 章节: ' || document_id || ' | 页: ' || (CASE WHEN page_start = 0 THEN '?' ELSE page_start::VARCHAR END) || chr(10) || snippet AS line
FROM cited LEFT JOIN kb ON kb.kb = document_id AND kb.is_active)
SELECT a.query_id, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY index), '(无检索结果)') AS context FROM ask a LEFT JOIN line USING (query_id) GROUP BY 1"""
)
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """Active bases give the titles; a citation of another has its id in the title's place."""
    titles = B.kbs(spark, d).where("is_active").select(F.col("kb").alias("document_id"), F.col("name").alias("document_title"))
    cited = _cited(spark, d).join(titles, "document_id", "left").na.fill("", ["document_title"])
    return R.contexts(cited, B.questions(spark, d))


_GOLDEN = f"""{_CITED}, kw AS (SELECT query_id, list_distinct(regexp_extract_all(phrase, '[a-z0-9_]+')) AS k0, phrase FROM ask),
kws AS (SELECT query_id, list_sort(k0)[1:5] AS keywords FROM kw), blob AS (SELECT a.query_id, lower('' || coalesce(chr(10) || string_agg(c.snippet, chr(10) ORDER BY c.index), '')) AS blob, count(c.id) AS n FROM ask a LEFT JOIN cited c USING (query_id) GROUP BY 1)
SELECT query_id, round(len(list_filter(keywords, lambda k: contains(blob, k))) / len(keywords), 4) AS keyword_hit_ratio, n AS citation_count FROM kws JOIN blob USING (query_id)"""


@query(_GOLDEN)
def golden_eval(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.lower(T.clean(F.col("query")))
    keywords = F.slice(F.array_sort(F.array_distinct(F.transform(T.terms(phrase), lambda t: t["term"]))), 1, 5)
    cases = B.questions(spark, d).select("query_id", F.lit("").alias("answer"), keywords.alias("keywords"))
    return analytics.evaluation(cases, _cited(spark, d))


@query(
    f"""SELECT count(*) AS cases, round(avg(CASE WHEN citation_count > 0 THEN 1 ELSE 0 END), 4) AS coverage, round(avg(keyword_hit_ratio), 4) AS keyword_hit_ratio,
round(avg(citation_count), 3) AS citations FROM ({_GOLDEN})"""
)
def golden_summary(spark: SparkSession, d: str) -> DataFrame:
    return analytics.evaluation_summary(golden_eval(spark, d))


_RUN = f"""WITH g AS ({_GOLDEN}), h AS ({_CITED} SELECT a.query_id, coalesce(max(c.score) >= 0.05, false) AS has_hit FROM ask a LEFT JOIN cited c USING (query_id) GROUP BY 1), r AS (SELECT * FROM g JOIN h USING (query_id))"""
_RUN_ROW = "SELECT '{key}' AS run_key, 'benchmark' AS golden_file, count(*) AS cases, round(avg(CASE WHEN has_hit THEN 1 ELSE 0 END), 4) AS hit_coverage, round(avg(keyword_hit_ratio), 4) AS avg_keyword_hit, round(avg(citation_count), 3) AS avg_citation_count FROM r{where}"


@query(f"{_RUN} {_RUN_ROW.format(key='all', where='')} UNION ALL {_RUN_ROW.format(key='even', where=' WHERE query_id % 2 = 0')}")
def golden_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs that are kept, of all cases and of every other one; each evaluates its own cases."""
    phrase = F.lower(T.clean(F.col("query")))
    keywords = F.slice(F.array_sort(F.array_distinct(F.transform(T.terms(phrase), lambda t: t["term"]))), 1, 5)
    asked, scratch = B.questions(spark, d), Scratch(spark, "runs")
    cases = asked.select(F.col("query_id").alias("id"), F.col("query").alias("question"), F.lit(None).cast("string").alias("reference_answer"), keywords.alias("expected_citations_keywords"))
    cited = scratch.save(_cited(spark, d).select("query_id", "index", "snippet", "score"), "cited")
    answered = R.answerable(cited, asked, 0.05)
    for key, some in (("all", cases), ("even", cases.where("id % 2 = 0"))):
        analytics.keep_run(analytics.case_results(some, cited, answered), f"{scratch.root}/kept", key, "benchmark")
    return analytics.kept_runs(spark, f"{scratch.root}/kept").drop("run_id", "summary_json")


def _by_kb(spark: SparkSession, d: str) -> DataFrame:
    """Fused tracks within each base that user 7 may read, merged without rescaling."""
    seen = G.accessible(B.users(spark, d).where("user_id = 7"), B.kbs(spark, d), B.permissions(spark, d)).select("kb")
    corpus = B.searchable(spark, d).join(F.broadcast(seen), "kb", "left_semi")
    asked = B.questions(spark, d)
    dense, lexical = R.dense_track(asked, corpus, 2 * DEPTH, by=("kb",)), R.lexical_track(asked, corpus, 2 * DEPTH, by=("kb",))
    return R.fuse(dense, lexical, DEPTH, by=("query_id", "kb"))


_BY_KB = f"""WITH {B.DOC}, {B.KB}, {B.USR}, {B.PERM}, seen AS (SELECT p.kb FROM perm p JOIN kb USING (kb) WHERE p.user_id = 7 AND kb.is_active), {B.SEARCH},
d AS (SELECT * FROM (SELECT a.query_id, l.kb, l.id, round(list_cosine_similarity(a.query_vector, l.vector), 6) AS score FROM live l, ask a WHERE l.kb IN (SELECT kb FROM seen)) WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, id) <= {2 * DEPTH}),
x AS (SELECT * FROM (SELECT a.query_id, l.kb, l.id, CAST(sum((length(l.low) - length(replace(l.low, t.term, ''))) // length(t.term)) + any_value(CASE WHEN contains(l.low, a.phrase) THEN 3 ELSE 0 END) AS DOUBLE) AS score
  FROM live l, ask a JOIN ask_term t ON t.query_id = a.query_id WHERE l.kb IN (SELECT kb FROM seen) GROUP BY 1, 2, 3) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, id) <= {2 * DEPTH}),
t AS (SELECT 1 AS track, *, row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, id) AS rank FROM d UNION ALL SELECT 2, *, row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, id) FROM x),
n AS (SELECT query_id, kb, count(DISTINCT track) AS tracks FROM t GROUP BY 1, 2),
m AS (SELECT query_id, kb, id, round(CASE WHEN any_value(tracks) = 1 THEN max(score) ELSE sum(1.0 / (60 + rank)) / (any_value(tracks) / 61.0) END, 6) AS score, max(CASE WHEN track = 1 THEN rank END) AS r1, max(CASE WHEN track = 2 THEN rank END) AS r2
  FROM t JOIN n USING (query_id, kb) GROUP BY 1, 2, 3),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) <= {DEPTH})"""


@query(f"{_BY_KB} SELECT query_id, id, kb, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 10")
def multi_kb_search(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(_by_kb(spark, d).drop("rank"), 10, ["query_id"], [F.desc("score"), F.asc("id")]).select("query_id", "id", "kb", "score", "rank")


@query(
    f"""{_BY_KB} SELECT query_id, id, kb, score, total, place::INTEGER AS place FROM (SELECT f.query_id, f.id, f.kb, f.score, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY d.created_at DESC, f.id) AS place
FROM f JOIN doc d USING (id) WHERE d.created_at >= TIMESTAMP '2023-12-31 17:00:00' AND d.created_at < TIMESTAMP '2024-01-03 16:00:00') WHERE place BETWEEN 6 AND 10"""
)
def multi_kb_page(spark: SparkSession, d: str) -> DataFrame:
    """The search over bases between two days, latest first: the second page of five, with totals."""
    seen = G.accessible(B.users(spark, d).where("user_id = 7"), B.kbs(spark, d), B.permissions(spark, d)).select("kb")
    iso = display.iso_offset(display.at_offset(F.col("created_at")))
    return R.search_bases(B.questions(spark, d), B.searchable(spark, d), seen, sort_by="date", number=2, size=5, depth=DEPTH, shown=G.within_dates(iso, "2024-01-01T01", "2024-01-03"))


@query(
    f"""{_BY_KB.replace("WHERE l.kb IN (SELECT kb FROM seen)", "WHERE l.kb IN (SELECT kb FROM seen) AND l.doc_kind = 'en'")}
SELECT query_id, id, kb, score, total, place::INTEGER AS place FROM (SELECT f.*, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM f) WHERE place <= 20"""
)
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """English documents alone, by relevance; an empty filter and one that is no text don't count."""
    seen = G.accessible(B.users(spark, d).where("user_id = 7"), B.kbs(spark, d), B.permissions(spark, d)).select("kb")
    return R.search_bases(B.questions(spark, d), B.searchable(spark, d), seen, filters={"doc_kind": "en", "kb": "", "id": 3}, depth=DEPTH)


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with BM25 and sparse hits; a question without those is answered by occurrences."""
    asked, corpus = B.questions(spark, d), B.searchable(spark, d)
    dense, lexical = R.dense_track(asked, corpus, 2 * K), R.lexical_track(asked, corpus, 2 * K)
    index = R.postings(corpus)
    native = R.fuse(R.bm25_track(asked, index, 2 * K), R.sparse_track(asked, index, 2 * K), 2 * K)
    return R.fuse(*R.laddered((dense, native), (dense, lexical), corpus), K)


@query(
    f"""{_VIEWS}, ch AS (SELECT 'd' AS side, id, low AS t FROM live UNION ALL SELECT 'q', query_id, phrase FROM ask), c AS (SELECT side, id, ascii(c) % 256 AS m FROM (SELECT side, id, unnest(string_split(t, '')) AS c FROM ch) WHERE c <> ''),
n AS (SELECT side, id, m, count(*) AS n FROM c GROUP BY 1, 2, 3), v AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS v FROM n)
SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT q.id AS query_id, d.id, round(sum(q.v * d.v), 6) AS score FROM v q JOIN v d ON d.m = q.m AND d.side = 'd' WHERE q.side = 'q' GROUP BY 1, 2)
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K}""".replace("rank::INTEGER AS rank", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank")
)
def text_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest texts by their vectors of characters, for questions without a vector."""
    texts = B.searchable(spark, d).select("id", F.col("low").alias("text"))
    asked = B.questions(spark, d).select(F.col("query_id").alias("id"), F.lower(T.clean(F.col("query"))).alias("text"))
    return R.dense_track(char_vectors(asked).withColumnsRenamed({"id": "query_id", "vector": "query_vector"}), char_vectors(texts), K)


@query(
    f"""{_VIEWS}, a AS (SELECT query_id, query_vector[1:48] AS q FROM ask WHERE query_vector IS NOT NULL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
  SELECT query_id, id, round(list_dot_product(q, vector[1:48]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(vector, vector))), 6) AS score FROM a, live WHERE vector IS NOT NULL) WHERE score > 0 QUALIFY rank <= {K}"""
)
def chat_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The looser rule of chats: a shorter question vector, norms of the whole ones."""
    asked = B.questions(spark, d).withColumn("query_vector", F.slice("query_vector", 1, 48))
    return R.dense_track(asked, B.searchable(spark, d), K, same_length=False)


@query(
    f"""{_TRACKS}, {B.FUSED.format(raw='true', k=K)} SELECT row_number() OVER (ORDER BY f.score DESC, f.id)::INTEGER AS index, f.id AS chunk_id, f.id AS document_id, 'T' || f.id AS document_title, d.kb AS knowledge_base_id,
d.kb || ' > ' || d.doc_kind AS section_path, 1 AS page_start, 1 AS page_end, left({B.clean_sql('d.text')}, 200) AS snippet, printf('%.4f', f.score) AS score FROM fused f JOIN doc d USING (id) WHERE f.query_id = 1"""
)
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = B.docs(spark, d).select("id", "kb", F.array("kb", "doc_kind").alias("section_path"), F.substring(T.clean(F.col("text"), every=False), 1, 200).alias("snippet"))
    hits = rrf_search(spark, d).where("query_id = 1").join(docs, "id")
    hits = hits.withColumns({"document_id": F.col("id"), "document_title": F.concat(F.lit("T"), F.col("id")), "page_start": F.lit(1), "page_end": F.lit(1)})
    return files.export_rows(hits)


@query(
    f"""{_VIEWS} SELECT query_id, vec_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (
  SELECT a.query_id, e.vec_id, round(list_cosine_similarity(a.query_vector, CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, ask a WHERE len(e.embedding) = len(a.query_vector))
WHERE score > 0 QUALIFY rank <= {K}"""
)
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The index scan without joins: whole table of vectors, exact."""
    asked = B.questions(spark, d).select("query_id", "query_vector")
    corpus = files.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.dense_track(asked, corpus, K)
