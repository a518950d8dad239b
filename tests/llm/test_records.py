"""Decontamination, mixing, archives and the pipeline on small fixtures."""

import gzip
import hashlib
import io
import random
import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, mixing, queries, warc
from quillspark.llm.text import MARKS, words
from quillspark.scratch import Scratch

SETTINGS = decontaminate.DecontaminationParams()


def _sentences(rng, n, vocabulary):
    return " ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(n))


def _items(n=60):
    rng, vocabulary = random.Random(8), [f"v{i}" for i in range(400)]
    return [(i, _sentences(rng, rng.randint(1, 14), vocabulary)) for i in range(n)]


def test_wand_finds_all_above_the_threshold():
    index = decontaminate.Index(_items(), SETTINGS)
    rng = random.Random(2)
    for least in (0.05, 0.2, 0.6):
        for _ in range(60):
            own = np.array(sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, 60))))
            full: dict[int, float] = {}
            for t in own:
                for k in range(index.at[t], index.at[t + 1]):
                    full[index.segment_of[k]] = full.get(index.segment_of[k], 0.0) + index.impact[k]
            expect = {s: v for s, v in full.items() if v >= least - 1e-9}
            got = dict(index.retrieve(own, least))
            assert got.keys() == expect.keys()
            assert all(abs(got[s] - v) < 1e-9 for s, v in expect.items())


def test_a_segment_scores_one_against_itself():
    items = _items()
    index = decontaminate.Index(items, SETTINGS)
    for i, text in items[:20]:
        terms = np.unique(index.terms(words(pa.array([text]), MARKS).hashes))
        hit = {index.item_of[s]: v for s, v in index.retrieve(terms, 0.6)}
        assert hit[i] > 0.999


def _shingles(text):
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_leaks_against_brute_force(spark):
    rng, items = random.Random(4), _items()
    vocabulary = [f"v{i}" for i in range(3000)]
    docs, holds = [], {}
    for i in range(150):
        text = _sentences(rng, rng.randint(1, 60), vocabulary)
        if i % 3 == 0:
            item = rng.choice(items)
            body = item[1].upper().replace(" ", "  ") if i % 2 else item[1]
            if i % 9 == 0:
                body = body[: len(body) // 2]
            text = text[: len(text) // 2] + "\n" + body + "\n" + text[len(text) // 2 :]
        docs.append((i, text))
    for i, text in docs:
        own = _shingles(text)
        holds[i] = {j for j, t in items if len(_shingles(t) & own) >= 0.8 * len(_shingles(t))}
    docs += [(900, None), (901, ""), (902, "?!")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items + [(990, None), (991, ""), (992, items[3][1])], "item_id long, text string")
    for params in (SETTINGS, decontaminate.DecontaminationParams(items=20), decontaminate.DecontaminationParams(items=25, together=1)):
        found: dict[int, set] = {}
        for r in decontaminate.matches(table, tests, params).where("leaked").collect():
            found.setdefault(r["doc_id"], set()).add(3 if r["item_id"] == 992 else r["item_id"])
        for i, expect in holds.items():
            assert expect <= found.get(i, set()), i
        extra = {(i, j) for i, js in found.items() for j in js - holds.get(i, set())}
        assert not extra


def test_question_and_answer_far_apart(spark):
    rng, items, docs = random.Random(12), [], []
    for i in range(30):
        question, answer = (" ".join(f"t{rng.randrange(4000)}" for _ in range(n)) for n in (21, 20))
        items.append((i, f"{question}? {answer}."))
        filler = [" ".join(f"f{rng.randrange(4000)}" for _ in range(200)) for _ in range(3)]
        docs.append((i, f"{filler[0]} {question}? {filler[1]} {answer}. {filler[2]}"))
        docs.append((100 + i, f"{filler[0]} {question}? {filler[1]}"))
    table, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(table, tests).where("leaked").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i in range(30)]


def test_windows_cover_every_half_pair():
    ends = np.array([0, 10, 10, 55, 200])
    docs, begins, stops = decontaminate._windows(ends, np.diff(ends, prepend=0), 16)
    for d, (end, n) in enumerate(zip(ends, np.diff(ends, prepend=0))):
        own = [(b, s) for x, b, s in zip(docs, begins, stops) if x == d]
        for at in range(end - n, max(end - n, end - 16) + 1):
            assert any(b <= at and min(at + 16, end) <= s for b, s in own)


def test_no_items_no_leaks(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_questions_and_answers():
    assert decontaminate.question_and_answer("What is it? It is this. Yes.") == ("What is it? It is this.", "Yes.")
    assert decontaminate.question_and_answer("One only") == ("One only", "One only")


def test_targets_share_what_exceeds_the_caps():
    params = mixing.MixParams()
    assert mixing.targets([100, 100, 100], params) == pytest.approx([200, 450 - 200 - 250 / 3, 250 / 3])
    assert mixing.targets([10, 0, 1000], params) == pytest.approx([20, 0, 1495])
    assert mixing.targets([0, 0], params) == [0, 0] and mixing.targets([], params) == []
    for sizes in ([5, 80, 3, 900, 40, 41], [1] * 7):
        out = mixing.targets(sizes, params)
        assert sum(out) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * n + 1e-9 for t, n in zip(out, sizes))


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * int(rng.expovariate(1 / 60) + 1)), rng.choice(["b", "a", "c", "ä", None, "B"])) for i in range(900)]
    rows += [(2000, "w " * 4000, "c"), (2001, None, "a"), (2002, " \t ", "empty"), (None, "w w w", "a"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    params = mixing.MixParams(block=150)
    out = mixing.mix(docs, params)
    found = sorted(out.collect(), key=str)
    assert found == sorted(mixing.mix(docs.repartition(7), params).collect(), key=str)
    assert len(found) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expect = dict(zip(order, mixing.targets([sizes[s] for s in order], params)))
    for s in order:
        own = [r for r in found if r["source"] == s]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(expect[s])
        assert abs(taken - expect[s]) <= 0.01 * expect[s] + 20
        assert all(0 <= r["copies"] <= 2 for r in own)


def test_archives_are_bounded_and_dated(spark, tmp_path):
    path = str(tmp_path / "large")
    rows = [(i, f"http://a/{i}", chr(97 + i % 26) * 400_000 + str(i)) for i in range(12)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, warc.WarcParams(megabytes=1))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    sizes = [len(gzip.decompress(bytes(f["content"]))) for f in files]
    assert max(sizes) <= 1_000_000 and len(sizes) >= 6 and warc.scan(spark, path).count() == 12
    when = re.search(rb"WARC-Date: (\S+)\r\n", gzip.decompress(bytes(files[0]["content"])))[1].decode()
    assert abs(datetime.strptime(when, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) - datetime.now(timezone.utc)) < timedelta(minutes=10)


def test_mix_of_rows_alike(spark):
    """Repeated rows are one row with a count in the rounding, and come back as many."""
    rows = [(7, "w " * 9, "a")] * 30_000 + [(i, "w " * (i % 50 + 1), "abc"[i % 3]) for i in range(100, 2_100)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target", "doc_id", "size", "copies").count().collect()
    assert sum(r["count"] for r in mixed) == len(rows) and all(0 <= r["copies"] <= 2 for r in mixed)
    assert sum(r["count"] for r in mixed if r["doc_id"] == 7) == 30_000
    for source in "abc":
        mine = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["count"] * r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 60
    block = mixing._round_block(pd.DataFrame({"size": [9], "rate": [1.25], "rows": [1_000_000], "__id": ["7"], "__row": [1]}), 2.0)
    assert (block["copies"].item(), block["more"].item()) == (1, 250_000)


def test_mix_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def _pages():
    long_ = "<p>é\r\n\r\nWARC/1.1 is no record</p>" * 20
    rows = [(7, "http://a/", long_), (3, "http://b/\r\nX: y", long_), (9, None, long_), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (8, "u", "")]
    return rows + [(3, "again", long_), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100), (None, "n", "z" * 200), (14, "u", "z" * 200)]


def test_archives_round_trip(spark):
    path = f"{Scratch(spark, 'test').root}/warc"
    warc.write(spark.createDataFrame(_pages(), "page_id long, url string, html string"), path, warc.WarcParams(records=3))
    found = warc.scan(spark, path).collect()
    expect = []
    for page, _, html in _pages():
        data = (html or "").encode()
        same = [p for p, _, h in _pages() if (h or "").encode() == data and p is not None]
        first = min(same)
        revisit = len(data) >= 100 and page != first
        expect.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=str) == sorted(expect, key=str)


def test_every_file_is_a_warc(spark):
    path = f"{Scratch(spark, 'test').root}/warc"
    warc.write(spark.createDataFrame(_pages(), "page_id long, url string, html string"), path, warc.WarcParams(written=datetime(2031, 5, 6, 7, 8, 9)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    seen = 0
    for f in files:
        data = gzip.decompress(bytes(f["content"]))
        for fields, block in warc.parse(io.BytesIO(data)):
            assert fields["warc-date"] == "2031-05-06T07:08:09Z"
            seen += 1
            assert int(fields["content-length"]) == len(block) and fields["warc-record-id"].startswith("<urn:")
            assert (fields["warc-type"] == "revisit") == ("warc-refers-to" in fields)
    assert seen == len(_pages())


def test_no_pages(spark):
    path = f"{Scratch(spark, 'test').root}/warc"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.scan(spark, path).count() == 0


SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.count()
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, docs, SMALL), name)
        assert after.columns == docs.columns
        assert after.join(docs, docs.columns, "left_anti").count() == 0
        assert after.count() <= docs.count()
        docs = after
    kept = docs.count()
    assert 0.5 * rows < kept < rows
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = [r["text"] for r in docs.collect()]
    assert not any(i in t for i in items for t in texts)
    assert len({" ".join(t.lower().split()) for t in texts}) == len(texts)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(mixed) == kept and all(r["taken"] == r["copies"] * r["size"] for r in mixed)


def test_stages_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, "the same words here", None, None, 19), (2, "the same words here", None, None, 19)]
    docs = spark.createDataFrame(rows, schema).withColumn("toxicity", F.lit(1)).withColumn("language", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() <= 4


def test_folds_are_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", queries.fold("id", 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    items = [(i, f"what is item number {i} about and why . it is about thing{i} and thing{i + 1}") for i in range(30)]
    docs = [(i, f"some words before {items[i][1]} and some after") for i in range(0, 30, 3)] + [(99, "nothing of the kind here"), (100, None)]
    asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.matches(*asked, decontaminate.DecontaminationParams(items=n)).collect())) for n in (20_000, 7))
    assert one == many and {(r[0], r[1]) for r in one if r[-1]} >= {(i, i) for i in range(0, 30, 3)}
