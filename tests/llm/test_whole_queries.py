"""Every query of the ten operators and the pipeline as a whole, over odd tables and empty ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import queries
from test_rules import cheapest, counts, damaged

CLASHES = "n kind digest row part segment audit cost first hot mask label_ n_words kept base_failed host path rule verdict score size copies target taken language toxicity grade label held_out component_id node rep __text_hash __id __hash __language __toxicity __leak __size __row __block __page vec_id".split()
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def _text(rng, lang, n):
    parts = {"aa": ["ba", "do", "mi", "tal"], "bb": ["sch", "ung", "ein", "pf"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    docs = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        docs.append((i, _text(rng, lang, rng.randint(30, 90)) + (" filth muck" * 4 if i % 4 == 0 else ""), lang, f"s{i % 3}", 0))
    item = _text(rng, "aa", 30)
    docs += [(200, docs[0][1], "aa", "s0", 0), (201, docs[1][1] + " extra", None, None, 0), (202, None, "aa", "s0", 0), (203, "", "bb", None, 0), (204, " .. 12 \n", None, "s1", 0)]
    docs += [(205, _text(rng, "aa", 60_000), "aa", "s2", 0), (206, _text(rng, "bb", 20) + " " + item + " " + _text(rng, "bb", 20), "bb", "s1", 0), (None, "only words", "aa", "s0", 0), docs[2], docs[2]]
    vectors = [(i, [float(x) for x in np.random.default_rng(i // 2).normal(size=8)], 0) for i in range(60)]
    vectors += [(70, None, 0), (71, [0.0] * 8, 0), (72, [float("nan")] * 8, 0), (73, [], 0), (None, [1.0] * 8, 0), vectors[0]]
    pages = [(i, f"http://h{i % 9}.{rng.choice(['net', 'org', 'com'])}/fr/{i}", "<p>" + "x" * (50 + i % 7 * 30)) for i in range(60)]
    pages += [(70, None, None), (71, "no scheme", ""), (72, "http://a.net/" + "y" * 20_000, "z" * 300_000), pages[3]]
    labels = [(d[0], int(d[0] % 5 > 0), int(d[0] % 4 == 0)) for d in docs[:120]] + [(3, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 1)]
    turns = [(i // 4, i % 4, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(80)]
    turns += [(30, 0, None, None), (None, None, "user", "hello."), (31, None, "system", "x"), turns[2], turns[2], (32, 0, "user", "long. " * 60_000), (33, 1, "user", ""), (33, 1, "", "b.")]
    return {"conversations": turns, "documents": docs, "embeddings": vectors, "pages": pages, "benchmark": [(1, item), (1, item), (2, None), (None, item), (3, "")], "labels": labels}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, repeats, ties, a very long text and columns named like the operators' own."""
    root = tmp_path_factory.mktemp("odd")
    for name, rows in _rows().items():
        table = spark.createDataFrame(rows, SCHEMAS[name])
        more = [c for c in CLASHES if c not in table.columns] if name in ("documents", "embeddings", "pages", "conversations") else []
        table.selectExpr("*", *(f"'own' AS {c}" for c in more)).coalesce(2).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def _fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_op1(spark, odd):
    rows = queries.op1_url_filter(spark, odd).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(p[0] for p in _rows()["pages"])
    by_id = {r["page_id"]: r for r in rows}
    assert (by_id[70]["host"], by_id[70]["path"], by_id[70]["verdict"]) == ("", "", "allow")
    assert by_id[72]["rule"] == "net/" and by_id[72]["verdict"] == "block" and len(by_id[72]["path"]) == 20_001
    assert all(r["verdict"] in ("allow", "block") for r in rows)


def test_op2(spark, odd):
    rows = queries.op2_embedding_dedup(spark, odd).collect()
    assert len(rows) == len(_rows()["embeddings"])
    by_id = {r["vec_id"]: r for r in rows if r["vec_id"] is not None}
    assert all((by_id[v]["n_links"], by_id[v]["component_id"], by_id[v]["kept"]) == (0, v, True) for v in (70, 71, 72, 73))
    assert all(by_id[i]["component_id"] <= i - i % 2 and by_id[i]["n_links"] >= 1 for i in range(60))


def test_op3(spark, odd):
    rows = queries.op3_mixing(spark, odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in rows) == sorted(size(d[1]) for d in _rows()["documents"])
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_op4(spark, odd):
    rows = queries.op4_hmm(spark, odd).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(_rows()["documents"]) and by_id[202]["n_tokens"] == by_id[203]["n_tokens"] == 1
    assert by_id[205]["n_tokens"] == 60_001 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert all(r["held_out"] == (_fold(r["doc_id"], 7) == 2) for r in rows)
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) + 1 for d in _rows()["documents"] if _fold(d[0], 7) != 2]
    assert {r["train_tokens"] for r in rows} == {sum(tokens)}


def test_op5(spark, odd):
    rows = queries.op5_minhash_dedup(spark, odd).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(_rows()["documents"])
    assert by_id[200]["component_id"] == 0 and not by_id[200]["kept"] and by_id[201]["component_id"] == 1
    assert all(by_id[i]["kept"] and by_id[i]["n_shingles"] == 0 for i in (202, 203)) and by_id[205]["kept"]


def test_op6(spark, odd):
    rows = queries.op6_warc_revisits(spark, odd).collect()
    pages = {p[0]: (p[2] or "").encode() for p in _rows()["pages"]}
    assert len(rows) == len(_rows()["pages"])
    for r in rows:
        payload = pages[r["page_id"]]
        first = min(i for i, other in pages.items() if other == payload)
        revisit = len(payload) >= 100 and first != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))


def test_op7(spark, odd):
    rows = queries.op7_quality(spark, odd).collect()
    assert len(rows) == len(_rows()["documents"])
    assert all(r["held_out"] == (_fold(r["doc_id"], 5) == 2) and 0 <= r["tail_prob"] <= 1 and r["kept"] == (r["tail_prob"] >= 0.5) for r in rows)


def test_op8(spark, odd):
    rows = queries.op8_language_id(spark, odd).collect()
    known = {d[0]: d[2] for d in _rows()["documents"][:120]}
    assert len(rows) == len(_rows()["documents"])
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (202, 203, 204))
    held = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_op9(spark, odd):
    assert [(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, odd).collect()] == [(206, 1)]


def test_op10(spark, odd):
    rows = queries.op10_toxicity(spark, odd).collect()
    assert len(rows) == len(_rows()["documents"])
    assert all(r["held_out"] == (_fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    high = np.mean([r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 120 and r["doc_id"] % 4 == 0 and r["held_out"]])
    low = np.mean([r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 120 and r["doc_id"] % 4 and r["held_out"]])
    assert high > low
    same = {r["doc_id"]: r["score"] for r in rows}
    assert same[202] == same[203] == same[204]


def test_op11(spark, odd):
    rows = {r["conv_id"]: r for r in queries.op11_conversation_repair(spark, odd).collect()}
    turns = _rows()["conversations"]
    assert set(rows) == {t[0] for t in turns}
    for conv, table in damaged(turns).items():
        counts, lines = cheapest(table)
        r = rows[conv]
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == counts
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_op12(spark, odd):
    rows = queries.op12_quality_rules(spark, odd).collect()
    docs = _rows()["documents"]
    assert len(rows) == len(docs)
    texts = {d[0]: d[1] for d in docs}
    for r in rows:
        n = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r["base_failed"] and r["kept"])


def test_op13(spark, odd):
    rows = queries.op13_filter_audit(spark, odd).collect()
    docs = _rows()["documents"]
    assert {r["part"] for r in rows} == {d[3] or "" for d in docs} and len(rows) == 600 * len({r["part"] for r in rows})
    for part in {r["part"] for r in rows}:
        last = {r["kept"] for r in rows if r["part"] == part and r["step"] == 5}
        sizes = {r["kept"] + r["removed"] for r in rows if r["part"] == part and r["step"] == 1}
        assert len(last) == 1 and sizes == {sum((d[3] or "") == part for d in docs)}


def test_pipeline(spark, odd):
    docs, columns = spark.read.parquet(f"{odd}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or docs.columns
        docs = stage(spark, docs, odd)
        assert docs.columns == columns, name
        assert {r["__language"] for r in docs.select("__language").collect()} <= {"own"}
    kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
    mixed = corpus_pipeline.run(spark, odd).collect()
    assert sorted(r["doc_id"] or -1 for r in mixed) == sorted(k if k is not None else -1 for k in kept) and len(set(kept)) == len(kept)
    assert not {200, 201, 202, 203, 204, 206} & set(kept)
