"""Kept indexes of texts and vectors against full evaluation."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.operators import text_index as TI
from quillspark.operators import vector_index as VI
from quillspark.sources import files


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, low string")


def _texts(rng, ids):
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["施工方案", "洞身"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in ids]


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_text_index_gives_the_hits_of_full_evaluation(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "text")
    first = _texts(rng, range(900))
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(_texts(rng, range(12)))] + [(50, "施工 洞"), (51, "none"), (52, "")], "query_id int, query string")
    TI.add(_corpus(spark, first), path)
    assert _rows(TI.search(asked, path, 5)) == _rows(R.bm25_track(asked, R.postings(_corpus(spark, first)), 5))
    # other texts for some, new ones, and some gone: only these change
    before = _files(path)
    second = _texts(rng, [*range(0, 300, 7), *range(2_000, 2_050)])
    TI.add(_corpus(spark, second), path, 1, removed=spark.range(500, 540).select("id"))
    TI.add(_corpus(spark, _texts(rng, [7, 2_001])), path, 2)
    assert before.items() <= _files(path).items()
    TI.add(_corpus(spark, second[:3]), path, 2)  # a generation that is written again
    now = dict(first) | dict(second) | dict(second[:3])
    now = [(i, t) for i, t in now.items() if not 500 <= i < 540]
    expect = _rows(R.bm25_track(asked, R.postings(_corpus(spark, now)), 5))
    assert _rows(TI.search(asked, path, 5)) == expect
    assert _rows(TI.search(asked, path, 5, first=1)) == expect
    TI.compact(spark, path, str(tmp_path / "small"))
    assert _rows(TI.search(asked, str(tmp_path / "small"), 5)) == expect


def test_text_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "text")
    TI.add(_corpus(spark, [(i, f"t{i} t{i // 2} all") for i in range(500)]), path)
    asked = spark.createDataFrame([(1, "t7 all")], "query_id int, query string")
    found = TI.search(asked, path, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "documents" not in plan
    own = spark.createDataFrame([("t7",), ("all",)], "term string").select(TI.bucket().alias("b")).collect()
    for filters in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan):
        assert {int(x) for x in re.findall(r"\b\d+\b", re.sub(r"#\d+", "", filters))} <= {r["b"] for r in own}
    assert [r["id"] for r in found.orderBy("rank").collect()][0] == 7


def test_blocks_are_cut_and_bounded(spark, tmp_path):
    path = str(tmp_path / "text")
    TI.add(_corpus(spark, [(i, "hot " * (1 + i % 9) + "x" * (i % 5)) for i in range(3_000)]), path)
    rows = spark.read.parquet(f"{path}/postings").where("term = 'hot'").collect()
    assert sum(r["n"] for r in rows) == 3_000 and max(r["n"] for r in rows) <= TI.BLOCK and len({i for r in rows for i in r["ids"]}) == 3_000
    assert all(r["most_weight"] == max(r["weights"]) and r["least_length"] == min(r["lengths"]) and len(r["ids"]) == r["n"] for r in rows)


def _exact(asked, rows, k):
    out = set()
    for q, v in asked:
        near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w in rows)
        out |= {(q, i) for s, i in near[:k] if s < 0}
    return out


def test_vector_index_of_clusters_with_copies(spark, tmp_path):
    rng, path = np.random.default_rng(4), str(tmp_path / "vectors")
    centres = rng.normal(size=(30, 24)) * 4
    rows = [(i, (centres[i % 30] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(1_500)]
    rows += [(5_000 + i, rows[0][1]) for i in range(700)]  # a hot group of copies
    odd = [(9_000, None), (9_001, [0.0] * 24), (9_002, [float("nan")] * 24), (9_003, [1.0, 2.0]), (9_004, [])]
    VI.build(spark.createDataFrame(rows + odd, "id long, vector array<float>"), path, VI.IndexParams(cells=30, file_rows=100))
    assert spark.read.parquet(f"{path}/cells").count() == len(rows)
    asked = [(q, (centres[q] + rng.normal(size=24)).tolist()) for q in range(30)]
    queries = spark.createDataFrame([*asked, (90, None), (91, [1.0])], "query_id int, query_vector array<double>")
    found = VI.search(queries, path, 10)
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    expect = _exact(asked, rows, 10)
    assert len(got & expect) >= 0.95 * len(expect) and len(got) == len(expect)
    scores = {(r["query_id"], r["id"]): r["score"] for r in found.collect()}
    assert all(abs(s - np.dot(dict(asked)[q], dict(rows)[i]) / np.linalg.norm(dict(asked)[q]) / np.linalg.norm(dict(rows)[i])) < 1e-6 for (q, i), s in scores.items())
    assert VI._codec(spark, path)[1] < 30  # clusters need few probes


def test_vector_search_reads_the_probed_cells(spark, tmp_path):
    rng, path = np.random.default_rng(5), str(tmp_path / "vectors")
    VI.build(spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id long, vector array<double>"), path, VI.IndexParams(cells=20, runs=4))
    plan = VI.probed(spark, path, [3, 4])
    assert "PartitionFilters: [cell" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["cell"] for r in plan.select("cell").distinct().collect()} == {3, 4}
    assert VI.search(spark.createDataFrame([], "query_id int, query_vector array<double>"), path, 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_vectors(spark, tmp_path, sf):
    corpus = files.table(spark, f"/root/testdata/{sf}", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    VI.build(corpus, str(tmp_path / "v"))
    found, exact = VI.search(asked, str(tmp_path / "v"), 10), R.dense_track(asked, corpus, 10)
    assert VI.recall(found, exact) >= 0.95


def test_empty_indexes(spark, tmp_path):
    VI.build(spark.createDataFrame([], "id long, vector array<float>"), str(tmp_path / "v"))
    assert VI.search(spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<double>"), str(tmp_path / "v"), 3).count() == 0
    TI.add(_corpus(spark, []), str(tmp_path / "t"))
    assert TI.search(spark.createDataFrame([(1, "a")], "query_id int, query string"), str(tmp_path / "t"), 3).count() == 0


def test_repeated_ids_have_one_length_and_blocks_are_cut_in_order(spark, tmp_path):
    rows = [(i, "bolt " * (i % 3 + 1) + f"w{i}") for i in range(700)] + [(7, "nut nut"), (7, "bolt")]
    path = f"{tmp_path}/index"
    TI.add(spark.createDataFrame(rows, "id long, low string").repartition(4), path)
    lengths = [(r["id"], r["length"]) for r in spark.read.parquet(f"{path}/documents").orderBy("id").collect()]
    assert lengths == [(i, float(sum(len(low.split()) for j, low in rows if j == i))) for i in range(700)]
    found = [r for r in TI.blocks(spark, path).where("term = 'bolt'").collect()]
    assert sorted(i for r in found for i in r["ids"]) == list(range(700)) and len(found) < 16
    for r in found:
        assert r["n"] == len(r["ids"]) == len(r["weights"]) == len(r["lengths"]) <= TI.BLOCK and r["ids"] == sorted(r["ids"])
        assert r["most_weight"] == max(r["weights"]) and r["least_length"] == min(r["lengths"])
        assert all(w == sum(low.split().count("bolt") for j, low in rows if j == i) for i, w in zip(r["ids"], r["weights"]))
