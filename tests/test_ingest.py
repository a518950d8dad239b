"""Ingest jobs, the embedding cache, bounded queues and idle sessions."""

import datetime
import heapq
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import events, run

from quillspark import scratch
from quillspark.operators import text_index
from quillspark.streaming import cache as EC
from quillspark.streaming import ingest as I
from quillspark.streaming import queues

DOCS = "job_id long, id long, text string"
ROWS = [
    (1, 1, "# A\nalpha beta\n\n![](images/a.png)"), (2, 2, "plain text\n<--- Page Split --->\nmore"), (3, 3, None), (4, 4, "boom"), (5, 5, ""),
    (6, 1, "# B\ngamma alpha"), (7, 6, "plain text\n<--- Page Split --->\nmore"), (8, 7, "stop me"), (9, 8, "first"), (10, 8, "second"),
]


def _reader():
    def read(text):
        if text is None or "boom" in text:
            raise ValueError(f"can't read {text}")
        return text

    return I.each_text(read)


class Killed(Exception):
    pass


def _tables(spark, path):
    out = {name: sorted(map(repr, (tuple(r) for r in I.current(spark, path, name).drop("at").collect()))) for name in ("texts", "chunks", "vectors", "pages", "assets", "results")}
    out["jobs"] = sorted(tuple(r) for r in I.jobs(spark, path).collect())
    out["receipts"] = sorted(map(repr, (tuple(r) for r in I.receipts(spark, path).collect())))
    asked = spark.createDataFrame([(1, "alpha"), (2, "plain text"), (3, "second first")], "query_id int, query string")
    out["hits"] = sorted(tuple(r) for r in text_index.search(asked, f"{path}/index", 5).collect())
    return out


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A run that nothing stops; job 8 is cancelled before it begins."""
    root = tmp_path_factory.mktemp("ingest")
    I.cancel(spark, f"{root}/a/out", [8])
    live = len(scratch._LIVE)
    _ingest(spark, root, "a")
    assert len(scratch._LIVE) == live  # a batch leaves no intermediate table
    return _tables(spark, f"{root}/a/out")


def _ingest(spark, root, name, after=None):
    q = I.start(events(spark, f"{root}/{name}", ROWS, DOCS), f"{root}/{name}/out", f"{root}/{name}/cp", _reader(), after=after)
    q.awaitTermination(400)
    return q


def test_jobs_end_as_they_should(spark, whole):
    status = {r[0]: r[3] for r in whole["jobs"]}
    assert status == {1: "succeeded", 2: "succeeded", 3: "dead", 4: "dead", 5: "succeeded", 6: "succeeded", 7: "succeeded", 8: "cancelled", 9: "cancelled", 10: "succeeded"}
    errors = {r[0]: r[4] for r in whole["jobs"]}
    assert errors[4] == "ValueError: can't read boom" and errors[1] is None and errors[8] == "cancelled by request"
    assert [t for t in whole["texts"] if t.startswith("(1,")] == [repr((1, "# B\ngamma alpha", None))]
    assert {h[1] for h in whole["hits"] if h[0] == 1} == {"1:0"} and {h[1] for h in whole["hits"] if h[0] == 2} == {"2:0", "6:0"}
    assert {h[1] for h in whole["hits"] if h[0] == 3} == {"8:0"}
    vectors = [v.split("[")[1] for v in whole["vectors"] if v.startswith(("(2, 0", "(6, 0"))]
    assert len(vectors) == 2 and len(set(vectors)) == 1  # one content, one vector
    assert whole["assets"] == []  # the newer text has no image


@pytest.mark.parametrize("where", [(0, "embed_batch"), (1, "track_a_write")])
def test_a_killed_run_goes_on(spark, tmp_path, whole, where):
    I.cancel(spark, f"{tmp_path}/a/out", [8])
    ran = []

    def kill(batch, step):
        ran.append((batch, step))
        if (batch, step) == where:
            raise Killed

    with pytest.raises(Exception, match="Killed"):
        _ingest(spark, tmp_path, "a", after=kill)
    n = len(ran)
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/a/in")
    I.start(stream, f"{tmp_path}/a/out", f"{tmp_path}/a/cp", _reader(), after=lambda b, s: ran.append((b, s))).awaitTermination(400)
    assert len(ran) == len(set(ran)) == 2 * len(I.STEPS) and ran[:n] + ran[n:] == ran  # no step ran twice
    assert _tables(spark, f"{tmp_path}/a/out") == whole


def test_dead_letters_of_a_run(spark, tmp_path):
    I.start(events(spark, tmp_path / "a", ROWS[:4], DOCS), f"{tmp_path}/out", f"{tmp_path}/cp", _reader()).awaitTermination(400)
    uploads = spark.createDataFrame([(i, 70 + i, "pending") for i in range(1, 5)], "document_id long, uploader long, status string")
    marked, jobs, audit = I.dead_letters(spark, f"{tmp_path}/out", uploads)
    assert {r["document_id"]: r["status"] for r in marked.collect()} == {1: "pending", 2: "pending", 3: "failed", 4: "failed"}
    assert {r["target_id"]: r["actor"] for r in audit.collect()} == {"3": 73, "4": 74} and jobs.where("status = 'dead'").count() == 2


def test_cache_as_a_table(spark):
    now = datetime.datetime(2024, 1, 10)
    at = lambda d: datetime.datetime(2024, 1, d)
    cache = spark.createDataFrame([("a", [1.0], at(4)), ("b", [2.0], at(2)), ("a", [9.0], at(1)), ("b", [3.0], at(3))], "sha256 string, vector array<double>, at timestamp")
    chunks = spark.createDataFrame([(2, "b", "bb"), (0, "a", "aa"), (1, "c", "cc"), (3, "c", "cc"), (4, "b", "bb")], "n int, sha256 string, content string")
    asked = []
    made = EC.fresh(chunks, cache, lambda x: x.select("sha256", F.array(F.length("content").cast("double")).alias("vector")), F.lit(now))
    asked = sorted((r["sha256"], r["vector"]) for r in made.collect())
    assert asked == [("b", [2.0]), ("c", [2.0])]  # the 3rd is seven days before the 10th: no longer remembered
    rows = EC.with_vectors(chunks, cache.unionByName(made), F.lit(now)).orderBy("n").collect()
    assert [(r["n"], r["vector"]) for r in rows] == [(0, [1.0]), (1, [2.0]), (2, [2.0]), (3, [2.0]), (4, [2.0])]


def test_cache_as_a_stream(spark, tmp_path):
    """Embedded once within seven days, whatever the triggers; the eighth day's is new."""
    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    rows = [(1, at(0), "aa"), (2, at(0), "aa"), (3, at(1), "bbb"), (4, at(6.9), "aa"), (5, at(7), "aa"), (6, at(8), "bbb"), (7, at(13.9), "aa"), (8, at(40), "c"), (9, at(41), "aa"), (10, at(41), "c")]
    for parts in (1, 5):
        stream = events(spark, tmp_path / str(parts), rows, "id long, at timestamp, content string", parts)
        found = run(spark, EC.embedded_stream(stream, lambda texts: [[float(len(t))] for t in texts]), f"cache_{parts}")
        got = {r["id"]: (r["vector"], r["hit"]) for r in found}
        assert {i: v for i, (v, _) in got.items()} == {i: [float(len(t))] for i, _, t in rows}
        assert {i for i, (_, hit) in got.items() if hit} == {2, 4, 7, 10}


def test_bounded_queue_equals_a_heap(spark, tmp_path):
    rng, rows = random.Random(7), []
    for i in range(1_000):
        kind = "submit" if rng.random() < 0.6 else "take"
        rows.append(("q" if i % 3 else "r", i, float(i // 2), kind, 10_000 + i if kind == "submit" else None, rng.randint(0, 3) if kind == "submit" else None))
    schema = "queue string, event_id long, at double, kind string, request_id long, priority int"
    got = {r["event_id"]: (r["request_id"], r["status"], r["place"]) for r in run(spark, queues.bounded_queue(events(spark, tmp_path, rows, schema, 3), 8), "queue")}
    heaps, expect = {"q": [], "r": []}, {}
    for queue, event, at, kind, request, priority in rows:
        heap = heaps[queue]
        if kind == "submit" and len(heap) >= 8:
            expect[event] = (request, 429, None)
        elif kind == "submit":
            heapq.heappush(heap, (priority, at, request))
            expect[event] = (request, 202, sorted(heap).index((priority, at, request)) + 1)
        else:
            expect[event] = (heapq.heappop(heap)[2], 200, None) if heap else (None, 204, None)
    assert got == expect and {s for _, s, _ in expect.values()} == {200, 202, 204, 429}


def test_idle_sessions_end_and_touched_ones_stay(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [("a", at(0)), ("b", at(0)), ("b", at(20)), ("c", at(22)), ("d", at(30)), ("d", at(31)), ("e", at(60)), ("e", at(60.5))]
    found = run(spark, queues.idle_sessions(events(spark, tmp_path, rows, "session_id string, at timestamp", 4), late="1 minute"), "idle")
    ended = {r["session_id"]: r["updated_at"] for r in found}
    assert ended == {"a": at(0), "b": at(20), "c": at(22), "d": at(31)}
    before = [r for r in found if r["session_id"] == "b"]
    assert len(before) == 1  # it woke after 20 hours: its first touch ended nothing
