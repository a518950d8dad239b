"""URL filter, language, toxicity, quality and the language model on small fixtures."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hmm, language_id, quality, toxicity, url_filter
from quillspark.llm.queries import URL_RULES

RULES = {r.text: r.verdict for r in URL_RULES}


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_urls_by_rule(spark):
    urls = [None, "", "no scheme", "http://A.NET", "http://a.net/x?q", "https://x.Example.net/en/1#t", "https://example.com/de/", "ftp://b.org/fr/2", "http://notexample.com/de/1", "a://b://c.net/", "http://?x", "x://net/"]
    rows = [(i, u) for i, u in enumerate(urls * 20)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    for r in out:
        host, path, rule = _judge(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == RULES[rule])
        assert r["url"] is not None or r["verdict"] == "allow"


def test_character_models_tell_classes_apart(spark):
    rng = random.Random(1)
    good = [f"https://news{rng.randint(1, 99)}.example/{rng.choice(['science', 'history'])}/{i}" for i in range(300)]
    bad = [f"http://casino{rng.randint(1, 99)}.example/{rng.choice(['win', 'bonus'])}?id={i}" for i in range(300)]
    rows = [(u, True) for u in good] + [(u, False) for u in bad] + [(None, True), ("x", None)]
    ratio, cut = url_filter.fit(spark.createDataFrame(rows, "url string, good boolean"))
    assert sum(ratio.score(u) >= cut for u in good) > 290 and sum(ratio.score(u) < cut for u in bad) > 290
    for model in (ratio.accepted, ratio.rejected):
        chars = {g[-1] for g in model.counts}
        assert sum(math.exp(model.log_prob("new" + c)) for c in chars) <= 1.0001


def test_url_filter_without_urls(spark):
    assert url_filter.judge(spark.createDataFrame([], "url string"), URL_RULES).count() == 0


SYLLABLES = {"aa": ["ba", "do", "mi", "tal"], "bb": ["sch", "ung", "ein", "pf"], "cc": ["ção", "ñe", "qui", "ez"]}


def _language_rows(n, seed):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word(lang) for _ in range(rng.randint(20, 200))), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_language_by_compression(spark):
    learn = spark.createDataFrame(_language_rows(150, 1), "doc_id long, text string, lang string")
    found = language_id.fit(learn)
    assert set(found) == set(SYLLABLES) and all(len(v) <= 65_536 for v in found.values())
    rows = _language_rows(80, 2) + [(900, None, None), (901, "", None), (902, "12 !?", None), (903, "½ ² Ⅷ", None)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), found).select("*", "language.*").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out if r["lang"]]) > 0.97
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and not r["sure"] for r in out if not r["lang"])
    assert all(0 <= r["score"] <= 1 for r in out)


def test_no_language_is_dropped(spark):
    rows = [(i, f"{lang} " * 40, lang) for lang in ("aa", "bb") for i in range(400)] + [(900, "rare words " * 20, "zz")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.fit(labelled)) == {"aa", "bb", "zz"}


def test_segments_join_to_the_text():
    data = ("word " * 3000 + "x" * 9000 + "é" * 900).encode()
    assert b"".join(language_id.segments(data, 4096)) == data


def test_two_thousand_languages(spark):
    """None is dropped or refused; dictionaries shrink together."""
    rng = random.Random(9)
    own = {f"l{i}": [f"{chr(0x3400 + i * 3 + k)}{chr(97 + i % 26)}" for k in range(3)] for i in range(2_000)}
    rows = [(" ".join(rng.choice(w) for _ in range(40)), lang) for lang, w in own.items() for _ in range(3)] + [("x", "short"), ("", "bare")]
    found = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(found) == {*own, "short", "bare"} and all(8 <= len(v) <= 8_192 for v in found.values())
    asked = [(" ".join(rng.choice(own[lang]) for _ in range(30)), lang) for lang in ("l0", "l777", "l1999")]
    out = language_id.identify(spark.createDataFrame(asked, "text string, lang string"), found)
    assert [r["lang"] for r in out.collect()] == [r["lang_pred"] for r in out.select("language.lang_pred").collect()]


def test_dictionaries_hold_whole_texts_in_order_of_their_hash(spark):
    texts = [f"text number {i} " + "ab " * i for i in range(40)]
    found = language_id.fit(spark.createDataFrame([(t, "x") for t in texts * 2], "text string, lang string"), language_id.LangParams(dictionary=600))["x"]
    assert len(found) == 600 and found.count(b"text number") == len(set(found.split(b"text number ")) - {b""})
    whole = [t for t in texts if t.encode() + b" " in found]
    assert len(whole) >= found.count(b"text number") - 1


def test_language_against_plain_compression(spark):
    """Sizes, prediction and score by a loop of single compressions."""
    import zstandard

    docs = _language_rows(30, 5)
    found = language_id.fit(spark.createDataFrame(_language_rows(60, 6), "doc_id long, text string, lang string"))
    out = language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), found).select("doc_id", "language.*").collect()
    for r, (_, text, _) in zip(sorted(out, key=lambda r: r["doc_id"]), sorted(docs)):
        sizes = {}
        for lang, content in found.items():
            c = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(x)) for x in language_id.segments(text.lower().encode(), 4_096))
        (best, first), (second, _) = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert r["lang_pred"] == first and abs(r["score"] - min(1.0, (second - best) / (second - best + 0.01 * best + 1))) < 1e-12


def test_language_without_labels(spark):
    found = language_id.fit(spark.createDataFrame([("a b", None), (None, None)], "text string, lang string"))
    assert found == {}
    out = language_id.identify(spark.createDataFrame([("abc",)], "text string"), found).select("language.*").first()
    assert tuple(out) == ("und", 0.0, False)


def _labelled(n, seed, bad=("vile", "rotten", "awful")):
    rng, words, rows = random.Random(seed), [f"w{i}" for i in range(500)], []
    for i in range(n):
        label = int(rng.random() < 0.3)
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(2 * label):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), label))
    return rows


def test_toxicity(spark):
    schema = "doc_id long, text string, label int"
    model = toxicity.fit(spark.createDataFrame(_labelled(1500, 1) + [(None, None, 0), (5, "", None)], schema))
    out = toxicity.score(spark.createDataFrame(_labelled(400, 2), schema), model).collect()
    right = [(r["toxicity"] >= 0.5) == bool(r["label"]) for r in out]
    assert np.mean(right) > 0.97
    assert np.count_nonzero(model.weights) < 0.2 * len(model.weights)
    odd = toxicity.score(spark.createDataFrame([(None,), ("",), ("...",)], "text string"), model).collect()
    assert len({r["toxicity"] for r in odd}) == 1 and 0 < odd[0]["toxicity"] < 0.5


def test_toxicity_without_rows(spark):
    model = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert toxicity.score(spark.createDataFrame([("a",)], "text string"), model).first()["toxicity"] == 0.5


def test_quality_grades_are_ordered(spark):
    rng, rows = random.Random(3), []
    endings = ["!!", "~", "."]
    for i in range(900):
        g = rng.randrange(3)
        rows.append((" ".join(f"w{rng.randrange(400)}" + (endings[g] if rng.random() < 0.6 else "") for _ in range(rng.randint(20, 90))), g))
    model = quality.fit(spark.createDataFrame(rows[:700] + [("x", None), ("y", 9)], "text string, label int"))
    assert (np.diff(model.thresholds) > 0).all()
    out = quality.grade(spark.createDataFrame(rows[700:], "text string, label int"), model).select("label", "grade.*").collect()
    by = [np.mean([r["expected_grade"] for r in out if r["label"] == g]) for g in range(3)]
    assert by[0] < by[1] < by[2] and by[0] < 0.7 and by[2] > 1.3
    assert all(0 <= r["tail_prob"] <= 1 for r in out)


def test_quality_odd_texts(spark):
    model = quality.fit(spark.createDataFrame([], "text string, label int"))
    out = quality.grade(spark.createDataFrame([(None,), ("",), ("a b",)], "text string"), model).select("grade.*").collect()
    assert len({tuple(r) for r in out}) == 1


PARAMS = hmm.HmmParams(states=3, symbols=20, classes=5, head=60, sample=2_000, starts=4, segment=8)


def _hmm_rows():
    rows = [(i, t, i % 7 == 2) for i, t, _ in _language_rows(120, 4)]
    return rows + [(500, None, True), (501, "", False), (502, "never seen words", True), (503, rows[0][1].upper(), True)]


def test_hmm_base_counts_and_totals(spark):
    rows = _hmm_rows()
    out = {r["doc_id"]: r for r in hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), PARAMS).collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts: dict = {}
    for _, t, held in rows:
        for w in [] if held else tokens(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        r, own = out[i], tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in out.values() if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(2)
    k, m = 2, 4
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0))
    texts = [[0, 2, 1, 3], [3], [1, 3], [2, 2, 0, 1, 1, 3]]
    flat, ends = np.array([s for t in texts for s in t]), np.cumsum([len(t) for t in texts])
    got = hmm.forward(hmm.segments(flat, ends, m, 2), model)
    for i, seq in enumerate(texts):
        total = 0.0
        for path in np.ndindex(*(k,) * len(seq)):
            p = model.start[path[0]]
            for t, s in enumerate(path):
                p *= model.emit[seq[t], s] * (model.move[path[t - 1], s] if t else 1)
            total += p
        assert math.isclose(got[i], math.log10(total), rel_tol=1e-9)


def _uncut(seq, model):
    """Expected counts and log likelihood of one sequence, by the textbook recursions."""
    n, k = len(seq), len(model.start)
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        now = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[seq[t]]
        scale[t] = now.sum()
        alpha[t] = now / scale[t]
    beta, move, emit = np.ones(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for t in range(n - 1, -1, -1):
        emit[seq[t]] += alpha[t] * beta
        if t:
            ahead = model.emit[seq[t]] * beta / scale[t]
            move += alpha[t - 1][:, None] * model.move * ahead[None, :]
            beta = model.move @ ahead
    return alpha[0] * beta, move, emit, np.log(scale).sum()


def test_expected_counts_equal_those_of_uncut_texts():
    rng = np.random.default_rng(3)
    symbol, ends = rng.integers(0, 6, 3_000), np.array([1, 70, 134, 135, 3_000])
    params = hmm.HmmParams(states=3, prior=0.1)
    segs = hmm.segments(symbol, ends, 6, 16)
    assert (segs.rows < 6).sum() == 3_000
    model, last = hmm._beginning(np.bincount(symbol, minlength=6), params), -np.inf
    for _ in range(4):
        got = hmm.expect(segs, model, chunk=50)
        want = [sum(x) for x in zip(*(_uncut(symbol[a:b], model) for a, b in zip([0, *ends[:-1]], ends)))]
        assert all(np.allclose(x, y, rtol=1e-8) for x, y in zip(got, want))
        assert got[3] > last - 0.5
        model, last = hmm._maximise(*got[:3], params), got[3]


def test_hmm_repeated_rows_and_a_very_long_text(spark):
    rows = [(1, "same text here", False)] * 40 + [(2, " ".join(f"w{i % 97}" for i in range(60_000)), False), (3, "same other", True), (3, "same other", True)]
    out = hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), PARAMS).collect()
    assert len(out) == len(rows) and len({tuple(r) for r in out}) == 3
    assert all(np.isfinite(r["score"]) for r in out) and {r["n_tokens"] for r in out} == {4, 60_001, 3}


def test_hmm_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert hmm.language_model(empty, PARAMS).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    r = hmm.language_model(one, PARAMS).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)


def test_lookup():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * 2 + 1)
    look = hmm.Lookup(keys)
    assert (look.find(keys) == np.arange(500)).all() and (look.find(keys - np.uint64(1)) == -1).all()
    assert (hmm.Lookup(keys[:0]).find(keys) == -1).all()
