import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import display, text as T
from quillspark.operators import analytics, governance as G, lifecycle
from quillspark.sources import files


def progress(spark, status, steps, job="running"):
    docs = spark.createDataFrame([(1, status)], "document_id int, status string")
    jobs = spark.createDataFrame([(9, 1, job, datetime.datetime(2024, 1, 2)), (8, 1, "failed", datetime.datetime(2024, 1, 1))], "job_id int, document_id int, status string, created_at timestamp")
    done = spark.createDataFrame([(9, s, "succeeded") for s in steps], "job_id int, step string, status string")
    return tuple(G.progress(docs, jobs, done).first())[1:]


@pytest.mark.parametrize(
    "status, steps, job, expect",
    [
        ("embedding", ["parse_outline", "section_aware_chunk"], "running", ("embedding", 55)),
        ("vector_indexing", ["track_a_write"], "running", ("vector_indexing", 82)),
        ("ocr", ["upload_to_ocr"], "running", ("ocr", 15)),
        ("pending", [], "queued", ("pending", 0)),
        ("pending", ["embed_batch"], "running", ("embedding", 0)),
        ("parsing", [], "running", ("embedding", 0)),
        ("ready", [], "running", ("ready", 100)),
        ("embedding", ["finalize"], "running", ("ready", 99)),
        ("ocr", [], "failed", ("failed", 8)),
        ("embedding", [], "succeeded", ("ready", 100)),
    ],
)
def test_progress(spark, status, steps, job, expect):
    assert progress(spark, status, steps, job) == expect


def test_live_documents(spark):
    rows = spark.createDataFrame([("ready",), ("disabled",), ("deleting",), (None,)], "status string")
    assert [r[0] for r in rows.where(G.live(F.col("status"))).collect()] == ["ready"]


def test_cascades(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {"documents": make([(1,), (2,)], "document_id int"), "jobs": make([(9, 1), (8, 2)], "job_id int, document_id int"), "receipts": make([(9,), (8,), (9,)], "job_id int")}
    out = lifecycle.cascade(tables, "documents", make([(1,), (1,)], "document_id int"))
    assert {k: v.count() for k, v in out.items()} == {"documents": 1, "jobs": 1, "receipts": 1}
    assert {r["name"]: (r["kept"], r["deleted"]) for r in lifecycle.deleted_counts(tables, out).collect()} == {"documents": (1, 1), "jobs": (1, 1), "receipts": (1, 2)}
    tables |= {"documents": make([(1, "a"), (2, "b")], "document_id int, kb string"), "sessions": make([(1, "a"), (2, "b"), (3, None)], "id int, kb string"), "chunks": make([(1, "a"), (2, "b"), (1, "b"), (None, None)], "document_id int, kb string")}
    out = lifecycle.cascade(tables, "bases", make([("a",)], "kb string"), lifecycle.BASE_KEYS)
    assert {r["id"]: r["kb"] for r in out["sessions"].collect()} == {1: None, 2: "b", 3: None}
    assert sorted((tuple(r) for r in out["chunks"].collect()), key=repr) == [(2, "b"), (None, None)]
    assert [r[0] for r in out["receipts"].collect()] == [8] and out["documents"].count() == 1
    with pytest.raises(ValueError):
        lifecycle.order_of([lifecycle.Key("a", "x", "b"), lifecycle.Key("b", "x", "a")])


def test_payload_hashes_of_any_shape(spark):
    texts = ['{"b": [1, {"z": "é", "a": null}], "a": 1.50}', '{ "a":1.5,"b":[1,{"a":null,"z":"\\u00e9"}]}', "[]", "no json", None]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.canonical_json("t")).collect()]
    assert rows == ['{"a": 1.5, "b": [1, {"a": null, "z": "é"}]}'] * 2 + ["[]", None, None]
    own = spark.createDataFrame([(2, "x")], "part int, status string").select(G.receipt_key(F.lit("j"), F.lit("s"), F.struct("status", "part")).alias("a"), G.receipt_key(F.lit("j"), F.lit("s"), F.struct("part", "status")).alias("b")).first()
    assert own["a"] == own["b"] == "j:s:" + hashlib.sha256(json.dumps({"part": 2, "status": "x"}, sort_keys=True).encode()).hexdigest()


def test_deletion_requests(spark):
    docs = spark.createDataFrame([(1, "ready"), (2, "ready")], "document_id int, status string")
    jobs = spark.createDataFrame([(9, 1, "running"), (8, 1, "succeeded"), (7, 2, "queued")], "job_id int, document_id int, status string")
    d, j = G.request_deletion(docs, jobs, docs.where("document_id = 1"))
    assert {r["document_id"]: r["status"] for r in d.collect()} == {1: "deleting", 2: "ready"}
    assert {r["job_id"]: r["status"] for r in j.collect()} == {9: "cancel_requested", 8: "succeeded", 7: "queued"}


def test_reconcile_and_faults(spark):
    schema = "kb string, user_id int, role string"
    now = spark.createDataFrame([("a", 1, "owner"), ("a", 2, "viewer"), ("a", 3, "editor")], schema)
    new = spark.createDataFrame([("a", 1, "owner"), ("a", 2, "editor"), ("a", 4, "viewer")], schema)
    assert {r["user_id"]: r["action"] for r in G.reconcile(now, new).collect()} == {1: "keep", 2: "update", 3: "delete", 4: "insert"}
    users = spark.createDataFrame([(1,), (2,), (4,)], "user_id int")
    bad = spark.createDataFrame([("d", 1, "owner"), ("d", 1, "owner"), ("u", 9, "owner"), ("n", 1, "viewer"), ("ok", 1, "owner")], schema)
    assert {r["kb"]: r["fault"] for r in G.permission_faults(bad, users).collect()} == {"d": "duplicate_user", "u": "unknown_user", "n": "no_owner"}


def test_names_are_new_once(spark):
    schema = "kb string, name string, pos int"
    old = spark.createDataFrame([("a", "Plan.pdf", 0)], schema)
    new = spark.createDataFrame([("a", "PLAN.pdf", 1), ("a", "x.pdf", 2), ("a", "X.PDF", 3), ("b", "plan.pdf", 4)], schema)
    assert sorted(r["pos"] for r in G.new_names(old, new, F.lower("name")).collect()) == [2, 4]


def test_batches_of_25(spark):
    rows = G.batches(spark.range(26), [F.asc("id")]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in rows] == [25, 1]


def test_only_misses_are_embedded(spark):
    chunks = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "b")], "sha256 string, content string")
    cache = spark.createDataFrame([("s2", [1.0])], "sha256 string, vector array<double>")
    assert [r["sha256"] for r in G.to_embed(chunks, cache).collect()] == ["s1"]


def test_activity_names(spark):
    at = datetime.datetime(2024, 1, 1)
    audit = spark.createDataFrame([(1, 1, "x", at, "a", '{"name": " "}'), (2, 9, "y", at, "z", '{"name": "Deleted KB"}'), (3, 1, "z", at, "q", None)], "audit_id int, actor int, action string, ts timestamp, target_id string, details string")
    users, kbs = spark.createDataFrame([(1, "u")], "user_id int, username string"), spark.createDataFrame([("a", "KB1")], "kb string, name string")
    rows = {r["audit_id"]: (r["username"], r["kb_name"]) for r in analytics.activity(audit, users, kbs).collect()}
    assert rows == {1: ("u", "KB1"), 2: ("", "Deleted KB"), 3: ("u", "")}


def test_times(spark):
    row = spark.sql("select timestamp_ntz'2026-05-13 01:30:00' t, cast(null as timestamp_ntz) n")
    assert row.select(display.iso_offset(display.at_offset(F.col("t")))).first()[0] == "2026-05-13T09:30:00+08:00"
    assert row.select(display.iso_offset(F.col("n"))).first()[0] == ""


def test_the_last_second_is_out(spark):
    rows = spark.createDataFrame([("2024-01-02T23:59:58+08:00",), ("2024-01-02T23:59:59+08:00",), ("2024-01-01T00:00:00+08:00",)], "iso string")
    assert rows.where(G.within_dates(F.col("iso"), "2024-01-02", "2024-01-02")).count() == 1


def test_uploads(spark):
    rows = [("a.pdf", "application/pdf", b"%PDF-1"), ("a.txt", None, b"%PDF-"), ("b.PDF", "text/html", b"%PDF-"), ("c.pdf", "", b"PK"), ("d.pdf", "application/pdf", b"%PDF-" + b"x" * 60)]
    found = spark.createDataFrame(rows, "name string, mime string, content binary")
    out = found.select("name", files.upload_fault(F.col("name"), F.col("mime"), F.col("content"), most_bytes=50).alias("f")).collect()
    assert [r["f"] for r in out] == [None, "extension", "type", "signature", "size"]


def test_ranges(spark):
    rows = spark.createDataFrame([(None, b"abcdef"), ("bytes=1-2", b"abcdef"), ("bytes=-2", b"abcdef"), ("bytes=9-", b"abcdef")], "header string, content binary")
    assert [(r["status"], None if r["body"] is None else bytes(r["body"])) for r in files.ranges(rows).collect()] == [(200, b"abcdef"), (206, b"bc"), (206, b"ef"), (416, None)]


def test_assets(spark):
    rows = [(1, [("../x/a.png", "aGk=", "3"), ("", "aGk=", "p")])]
    out = files.assets(spark.createDataFrame(rows, "document_id int, images array<struct<name:string,base64:string,page_no:string>>")).orderBy("n").collect()
    assert [(r["name"], r["page_no"], bytes(r["content"])) for r in out] == [("a.png", 3, b"hi"), ("image_1.jpg", None, b"hi")]


def test_exports(spark, tmp_path):
    hits = spark.createDataFrame([("a", "d", "T", "k", ["x", "y"], 1, 2, 's, "q"', 0.5), ("b", "d", "T", "k", [], 1, 2, "t", 0.75)], "id string, document_id string, document_title string, kb string, section_path array<string>, page_start int, page_end int, snippet string, score double")
    files.export_csv(hits, f"{tmp_path}/csv")
    files.export_json(hits, {"kb": "k", "none": None}, f"{tmp_path}/json")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").orderBy("index").collect()
    assert [(r["index"], r["chunk_id"], r["section_path"] or "", r["score"]) for r in back] == [("1", "b", "", "0.7500"), ("2", "a", "x > y", "0.5000")]
    assert back[1]["snippet"] == 's, "q"' and spark.read.json(f"{tmp_path}/json/results").count() == 2


def test_upsert_and_staging(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in G.upsert(now, new, ["k"], [F.desc("n")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    up = spark.createDataFrame([("x/Plan.v1.pdf", " ", "weird", b"%PDF-", datetime.datetime(2024, 3, 5))], "name string, title string, doc_kind string, content binary, uploaded_at timestamp")
    r = files.staged(up).first()
    assert (r["name"], r["title"], r["doc_kind"]) == ("Plan.v1.pdf", "Plan.v1", "other") and r["path"].startswith("2024/03/05/")


def test_error_texts_are_made_after_the_joins(spark):
    docs = spark.createDataFrame([(1, 5, "ready"), (2, 6, "ready")], "document_id long, uploader long, status string")
    jobs = spark.createDataFrame([(10, 1, "failed", None), (11, 2, "running", "old")], "job_id long, document_id long, status string, last_error string")
    errors = spark.createDataFrame([(10, "e")], "job_id long, error string")
    marked, updated, audit = G.dead_letters(docs, jobs, errors, most=6, note=3, text=F.repeat("error", F.lit(9)))
    assert sorted(map(tuple, marked.collect())) == [(1, 5, "failed"), (2, 6, "ready")]
    assert sorted(map(tuple, updated.collect())) == [(10, 1, "dead", "eeeeee"), (11, 2, "running", "old")]
    assert [(r["actor"], r["target_id"], r["details"]) for r in audit.collect()] == [(5, "1", '{"job_id":10,"error":"eee"}')]
    plan = updated._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "repeat" not in plan[plan.index("SortMergeJoin") :]


def test_batch_deletions_fold_no_strings(spark):
    asked = spark.createDataFrame([(1, "k", "owner", 7), (1, "k", "owner", 7), (2, "k", "editor", 7), (3, "k", "admin", 8)], "request_id long, kb string, role string, document_id long")
    there = spark.createDataFrame([(7, "k")], "document_id long, kb string")
    rows = G.batch_deletions(asked, there)
    assert sorted(map(tuple, rows.collect())) == [(1, 200, 1), (2, 403, 0), (3, 404, 0)]
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
