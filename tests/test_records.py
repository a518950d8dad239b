"""Records, hits, traces and headers on small odd rows."""

from datetime import datetime

from pyspark.sql import functions as F

from quillspark.operators import records


def test_documents_and_jobs(spark):
    at = datetime(2024, 1, 1, 20)
    schema = "id long, kb string, uploader_id long, title string, filename string, mime string, size_bytes long, sha256 string, doc_kind string, scheme_type string, is_standard_clause boolean, status string, page_count long, created_at timestamp_ntz, updated_at timestamp_ntz"
    docs = spark.createDataFrame([(1, "k", 5, "t", "f", "m", 1, "s", "plan", None, None, "parsing", 1, at, None), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None)], schema)
    rows = {r["id"]: r for r in records.document_records(docs, spark.createDataFrame([(5, "ann")], "user_id long, username string")).collect()}
    assert (rows[1]["uploader_name"], rows[1]["status"], rows[1]["created_at"], rows[1]["updated_at"]) == ("ann", "embedding", "2024-01-02T04:00:00+08:00", "")
    assert (rows[2]["uploader_name"], rows[2]["status"], rows[2]["created_at"]) == ("", None, "") and len(rows[1]) == 16
    jobs = spark.createDataFrame(
        [(1, 7, "failed", 1, at, "e", "t", at, at), (1, 8, "queued", 0, None, None, "u", at, None)],
        "document_id long, job_id long, status string, attempt int, available_at timestamp_ntz, last_error string, trace_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    got = {r["document_id"]: r["job"] for r in records.job_records(docs.select(F.col("id").alias("document_id")), jobs).collect()}
    assert got[2] is None and (got[1]["id"], got[1]["available_at"], got[1]["updated_at"]) == (8, "", "")


def test_chunk_scan(spark):
    chunks = spark.createDataFrame([("k", d, i, kind) for d in (3, 1, 2) for i in (1, 0) for kind in ("plan",)] + [("j", 4, 0, "spec")], "kb string, document_id long, chunk_index int, doc_kind string")
    docs = spark.createDataFrame([(1, "ready"), (2, "deleting"), (3, "ready"), (4, None)], "document_id long, status string")
    scan = lambda filters, most: [tuple(r) for r in records.chunk_scan(chunks, docs, filters, most).select("kb", "document_id", "chunk_index").orderBy("document_id", "chunk_index").collect()]
    assert scan({}, 3) == [("k", 1, 0), ("k", 1, 1), ("k", 3, 0)]
    assert scan({"doc_kind": "spec"}, 3) == [] and len(scan({"doc_kind": ["spec"], "kb": ""}, 9)) == 4
    assert records.chunk_scan(chunks.limit(0), docs).count() == 0


def test_hits(spark):
    fused = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2), (1, 99, 0.3, 3)], "query_id int, id int, score double, rank int")
    chunks = spark.createDataFrame([(10, "d", "k", ["a"], "<b>x</b> &lt; " + "y" * 300, 1, 2, None), (11, "e", "k", None, None, None, None, "[1]")], "id int, document_id string, kb string, section_path array<string>, content string, page_start int, page_end int, bbox string")
    rows = {r["chunk_id"]: r for r in records.hits(fused, chunks, spark.createDataFrame([("d", "D")], "document_id string, title string")).collect()}
    assert set(rows) == {10, 11} and rows[10]["snippet"] == "x < " + "y" * 196 and (rows[10]["document_title"], rows[11]["document_title"], rows[11]["snippet"]) == ("D", "", "")


def test_debug_traces(spark):
    asked = spark.createDataFrame([(1, "q", 1, "admin"), (2, "q", 50, "user"), (3, "", 5, "admin"), (4, "q" * 1025, 5, "admin"), (5, "q", 51, "admin"), (6, "q", 50, None), (7, "q" * 1024, 50, "admin"), (8, None, 5, "admin")], "query_id int, query string, k int, role string")
    found = spark.createDataFrame([(q, 10 + r, 1.0 / r, r) for q in range(1, 7) for r in (1, 2)], "query_id int, id int, score double, rank int")
    rows = records.debug_trace(asked, found).collect()
    assert sorted((r["query_id"], r["decision"], r["total"], r["chunk_id"], r["chunk_index"]) for r in rows if r["query_id"] != 7 or r["chunk_id"] is None) == [
        (1, 200, 1, 11, 0), (2, 403, 0, None, None), (3, 422, 0, None, None), (4, 422, 0, None, None), (5, 422, 0, None, None), (6, 403, 0, None, None), (7, 200, 0, None, None), (8, 422, 0, None, None),
    ]


def test_headers(spark):
    from pathlib import PurePosixPath
    from urllib.parse import quote, urlencode

    names = ["a b.pdf", "x/y~*+(1).pdf", "图 1.pdf", "", None, "dir/", "a/.", ".", "..", "'q'&.pdf", "/"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", records.content_disposition(F.lit("inline"), F.col("n")).alias("h")).collect()
    for r in rows:
        assert r["h"] == "inline; filename*=UTF-8''" + quote(PurePosixPath(r["n"] or "").name or "document.pdf")
    one = spark.createDataFrame([(" http://h// ", "a b*~", 1), (" ", "j", 2), (None, "j", 3)], "b string, j string, d int")
    urls = [r["u"] for r in one.orderBy("d").select(records.callback_url(F.col("b"), F.col("j"), F.col("d")).alias("u")).collect()]
    assert urls == ["http://h/api/v2/ocr/callback?" + urlencode({"job_id": "a b*~", "document_id": 1}), None, None]


def test_golden_file_and_kept_runs(spark, tmp_path):
    import json

    from quillspark.operators import analytics
    from quillspark.sources import files

    cases = [
        {"id": "a", "question": "q", "reference_answer": "r", "expected_citations_keywords": ["Bolt", "nut", "图"], "knowledge_base_hint": "k"},
        {"id": "b", "question": "q", "expected_citations_keywords": []}, {"id": "c", "question": "q"},
    ]
    (tmp_path / "golden.json").write_text(json.dumps(cases, indent=1, ensure_ascii=False))
    golden = files.golden_cases(spark, f"{tmp_path}/golden.json")
    cited = spark.createDataFrame([("a", 1, "a bolt"), ("a", 2, "图 3"), ("b", 1, "x")], "query_id string, index int, snippet string")
    answered = spark.createDataFrame([("a", True), ("b", False)], "query_id string, has_hit boolean")
    results = analytics.case_results(golden, cited, answered)
    got = {r["id"]: (r["has_hit"], r["keyword_hit_ratio"], r["citation_count"], r["reference_answer"]) for r in results.collect()}
    assert got == {"a": (True, 0.6667, 2, "r"), "b": (False, 1.0, 1, ""), "c": (False, 1.0, 0, "")}
    first = analytics.keep_run(results, f"{tmp_path}/runs", "one", "golden.json")
    second = analytics.keep_run(results.limit(0), f"{tmp_path}/runs", "none", "golden.json")
    rows = {r["run_id"]: r for r in analytics.kept_runs(spark, f"{tmp_path}/runs").collect()}
    assert set(rows) == {first, second} and json.loads(rows[first]["summary_json"]) == {"cases": 3, "hit_coverage": 0.3333, "avg_keyword_hit": 0.8889, "avg_citation_count": 1.0}
    assert (rows[second]["cases"], rows[second]["hit_coverage"], rows[second]["avg_citation_count"]) == (0, 0.0, 0.0)
    assert spark.read.parquet(f"{tmp_path}/runs/cases").where(F.col("run_id") == first).count() == 3
