"""Near duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import embedding_dedup, minhash_dedup
from quillspark.operators import components
from quillspark.scratch import Scratch


def _components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def _brute(rows, k):
    sets = {i: _shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {i: len(s) for i, s in sets.items()}, _components(ids, links)


def _texts(seed, groups, size, words):
    rng, vocabulary, rows = random.Random(seed), [f"w{i}" for i in range(3000)], []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("small", [50, 3])
def test_minhash_against_brute_force(spark, small):
    rows = _texts(3, 25, 9, 90) + _texts(4, 1, 60, 120)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "two one"), (1006, rows[0][1].upper())]
    params = minhash_dedup.DedupParams(words=4, small=small)
    found = minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    sizes, component = _brute(rows, 4)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert {r["doc_id"]: r["component_id"] for r in found} == component


def test_minhash_where_ids_repeat(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "AB"}
    rows = [(3, text["A"] + " x"), (5, text["A"]), (5, text["B"]), (9, text["B"] + " y"), (5, text["A"].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_dedup.classes(docs).join(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"]).collect()
    assert {(r["text"][:2].upper(), r["doc_id"], r["component_id"]) for r in found} == {("A0", 3, 3), ("A0", 5, 3), ("B0", 5, 5), ("B0", 9, 5)}
    kept = minhash_dedup.deduplicated(docs).collect()
    assert sorted((r["doc_id"], r["text"][:2]) for r in kept) == [(3, "A0"), (5, "B0")]


def test_minhash_in_a_node_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(900):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(80)] = f"x{i}"
        texts.append(copy)
    for i in range(500):  # texts of their own that share a passage of most of their words
        own = passage + [rng.choice(vocabulary) for _ in range(20)]
        texts.append(own)
        if i % 10 == 0:
            near = list(own)
            near[-4] = f"y{i}"
            texts.append(near + ["tail"])
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect = _brute(rows, 5)[1]
    params = minhash_dedup.DedupParams(small=10, rest=150, block=50)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.classes(docs, params).collect()} == expect


def test_minhash_where_most_near_copies_are_below_the_threshold(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):  # 5 or 6 changes leave two copies of one text below 0.8, a third of them with a partner
        copy = list(base)
        for k in rng.sample(range(0, 120, 6), rng.choice([5, 6])):
            copy[k] = f"x{i}_{k}"
        rows.append(" ".join(copy))
        if i % 3 == 0:
            rows.append(" ".join([*copy[:-2], f"y{i}"]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect = _brute(rows, 5)[1]
    assert len(set(expect.values())) == 700
    params = minhash_dedup.DedupParams(small=10, rest=100, block=40, wide=1)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.classes(docs, params).collect()} == expect


def test_minhash_of_a_very_long_text(spark):
    long_ = " ".join(f"v{i % 70_001}" for i in range(150_000))
    rows = [(1, long_), (2, long_ + " end"), (3, "short text of five words")]
    found = minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3}


def test_deduplicated_keeps_other_columns_and_odd_rows(spark):
    long_ = " ".join(f"a{i}" for i in range(40))
    rows = [(1, long_, 7), (2, long_ + " more", 8), (2, long_ + " more", 8), (3, "other words", 9), (3, "other words", 9), (None, long_, 1), (4, None, 2), (5, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = minhash_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out.collect()) == [(0, 1), (1, 7), (3, 9), (4, 2), (5, 3)]


def test_minhash_empty_table(spark):
    assert minhash_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (3, 2)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    expect = _components({x for e in links for x in e}, links)
    assert {r["node"]: r["component"] for r in found} == {n: c for n, c in expect.items()}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((base + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.3])).tolist())
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * 0.02).tolist() for _ in range(150)] + [hot.tolist()] * 30
    good = len(rows)
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    component = _components(range(good), np.argwhere(np.triu(close)).tolist())
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)] + [(None, [1.0] * 16)], "vec_id long, embedding array<double>")
    params = embedding_dedup.GraphParams(shard=90)
    found = {r["vec_id"]: r for r in embedding_dedup.classes(table, params).collect()}
    assert len(found) == len(rows) + 1
    links = np.array([found[i]["n_links"] for i in range(good)])
    assert (links <= close.sum(axis=1)).all()
    assert links.sum() >= 0.97 * close.sum()
    assert np.mean([found[i]["component_id"] == component[i] for i in range(good)]) > 0.97
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i in range(good, len(rows)))


def test_embeddings_of_a_dense_region(spark):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=16)
    x = np.vstack([rng.normal(size=(400, 16)), hot + rng.normal(size=(600, 16)) * 0.17 * np.abs(hot).mean()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    assert close.sum() > 300_000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.classes(table, embedding_dedup.GraphParams(shard=40)).collect()}
    links, truth = np.array([found[i] for i in range(len(x))]), close.sum(axis=1)
    assert (links <= truth).all()
    assert links.sum() >= 0.97 * truth.sum()


def test_embeddings_widen_until_the_audit_agrees(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(120, 8))
    x = np.vstack([base, base + rng.normal(size=base.shape) * 0.3])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    params = embedding_dedup.GraphParams(shard=8, overlap=1, recall=1.0)
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.classes(table, params).collect()}
    assert [found[i] for i in range(len(x))] == close.sum(axis=1).tolist()


def test_embeddings_empty_table(spark):
    assert embedding_dedup.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
