"""The learners against plain loops of the same updates, one row and one coordinate at a time."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality, toxicity, url_filter
from quillspark.llm.queries import URL_RULES
from quillspark.llm.shards import row_key


def _texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.randrange(3)
        rows.append((i, " ".join(rng.choice(["bad", "worse"] if label == 0 and rng.random() < 0.5 else ["a", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(30))), label))
    return rows + [(n, None, 0), (n + 1, "", 1), (n + 2, "... !!", 2), (n + 3, "bad bad bad", 0)]


def _logistic(x):
    return 1 / (1 + math.exp(-x))


def test_features_of_words_pairs_and_skips():
    texts = ["", "a", "a b", "a b c d", "a b a b", "B a. b"]
    owner, place = toxicity.features(pa.array(texts), 18)
    assert Counter(owner.tolist()) == {1: 1, 2: 3, 3: 4 + 3 + 2, 4: 4 + 3 + 2, 5: 3 + 2 + 1}
    assert len({*place[owner == 4].tolist()}) == 2 + 2 + 2 and set(place[owner == 2]) <= set(place[owner == 4])


def test_ftrl_equals_plain_updates(spark):
    p = toxicity.FtrlParams(rounds=3, l1=0.5, alpha=0.7)
    rows = [(i, t, int(y == 0)) for i, t, y in _texts(250, 1)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    keys = {r["doc_id"]: r["key"] for r in labelled.select("doc_id", row_key(labelled, p.seed).alias("key")).collect()}
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(j):
        return 0.0 if abs(z[j]) <= p.l1 else -(z[j] - math.copysign(p.l1, z[j])) / ((p.beta + math.sqrt(n[j])) / p.alpha + p.l2)

    for _ in range(p.rounds):
        for i, text, label in sorted(rows, key=lambda r: keys[r[0]]):
            own = sorted({*toxicity.features(pa.array([text or ""]), p.bits)[1].tolist()})
            base = -zb / ((p.beta + math.sqrt(nb)) / p.alpha)
            w = {j: weight(j) for j in own}
            g = _logistic(sum(w.values()) + base) - label
            for j in own:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / p.alpha * w[j]
                n[j] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / p.alpha * base
            nb += g * g
    model = toxicity.fit(labelled, p)
    expect = {j: weight(j) for j in list(z)}
    assert any(expect.values()) and 0 in expect.values()
    assert model.intercept == pytest.approx(-zb / ((p.beta + math.sqrt(nb)) / p.alpha), abs=1e-6)
    assert np.count_nonzero(model.weights) == sum(w != 0 for w in expect.values())
    assert max(abs(model.weights[j] - w) for j, w in expect.items()) < 1e-5
    for r in toxicity.score(labelled, model).collect():
        own = {*toxicity.features(pa.array([r["text"] or ""]), p.bits)[1].tolist()}
        assert r["toxicity"] == pytest.approx(_logistic(sum(expect[j] for j in own) + model.intercept), abs=1e-5)


def test_ordinal_equals_plain_updates(spark):
    p = quality.OrdinalParams(rounds=2, steps=4, rate=0.1, l2=1e-3)
    rows = _texts(120, 2)
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    w, cuts = defaultdict(float), [0.0] * (p.grades - 1)
    own = {i: quality.features(pa.array([t or ""]), p.bits)[1].tolist() for i, t, _ in rows}

    def edge(k):
        return -math.inf if k == 0 else math.inf if k == p.grades else cuts[0] + sum(math.exp(c) for c in cuts[1:k])

    def cdf(x):
        return 0.0 if x == -math.inf else 1.0 if x == math.inf else _logistic(x)

    for _ in range(p.rounds):
        sw, sc = defaultdict(lambda: 1e-12), [1e-12] * len(cuts)
        for _ in range(p.steps):
            gw, gc = defaultdict(float), [0.0] * len(cuts)
            for j in w:
                gw[j] += p.l2 * w[j]
            for i, _text, y in rows:
                length = max(1, len(own[i]))
                s = sum(w[j] for j in own[i]) / length
                lo, hi = cdf(edge(y) - s), cdf(edge(y + 1) - s)
                dlo, dhi = lo * (1 - lo), hi * (1 - hi)
                for j in own[i]:
                    gw[j] += (dhi - dlo) / (hi - lo) / len(rows) / length
                # an edge moves with the first cut, and with each step up to it
                for k in range(len(cuts)):
                    step = 1.0 if k == 0 else math.exp(cuts[k])
                    gc[k] += step * ((dlo if y >= k + 1 else 0.0) - (dhi if k + 1 <= y + 1 < p.grades else 0.0)) / (hi - lo) / len(rows)
            for j, g in gw.items():
                sw[j] += g * g
                w[j] -= p.rate * g / math.sqrt(sw[j])
            for k, g in enumerate(gc):
                sc[k] += g * g
                cuts[k] -= 0.1 * p.rate * g / math.sqrt(sc[k])
    model = quality.fit(labelled, p)
    assert model.thresholds.tolist() == pytest.approx([edge(k) for k in range(1, p.grades)], abs=1e-6)
    assert max(abs(model.weights[j] - v) for j, v in w.items()) < 1e-5
    for r in quality.grade(labelled, model, at_least=2).select("doc_id", "grade.*").collect():
        s = sum(w[j] for j in own[r["doc_id"]]) / max(1, len(own[r["doc_id"]]))
        above = [1 - _logistic(edge(k) - s) for k in range(1, p.grades)]
        assert (r["expected_grade"], r["tail_prob"]) == (pytest.approx(sum(above), abs=1e-5), pytest.approx(above[1], abs=1e-5))


def _witten_bell(counts, gram):
    """One character after its context: every order's share of seen ones, the rest from the shorter context."""
    if not gram:
        return 1 / 65_536
    follow = {c[-1]: n for c, n in counts.items() if c[:-1] == gram[:-1]}
    shorter = _witten_bell(counts, gram[1:])
    total = sum(follow.values())
    return (follow.get(gram[-1], 0) + len(follow) * shorter) / (total + len(follow)) if total else shorter


def test_url_verdicts_equal_plain_models(spark):
    rng, p = random.Random(4), url_filter.UrlParams()
    hosts = ["a.net", "b.example.com", "c.org", "example.net", "d.example.info", "e.io"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'en', 'x'])}/{rng.choice(['win', 'news', 'bonus', 'data'])}{rng.randrange(9)}" for _ in range(260)]
    rows = [(i, u) for i, u in enumerate(urls + ["", None, "no scheme", "http://", "é" * 40])]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(frame, URL_RULES, p).collect()}
    verdicts = {rule.text: rule.verdict for rule in URL_RULES}
    labels = {u: verdicts[out[i]["rule"]] == "allow" for i, u in rows if out[i]["rule"]}
    fold = {r["url"]: r["f"] for r in frame.where("url is not null").select("url", F.pmod(F.xxhash64("url", F.lit(p.seed + 1)), F.lit(p.calibrate)).alias("f")).distinct().collect()}
    kept = {}
    for good in (True, False):
        counts = Counter()
        for u in (u for u, g in labels.items() if g == good and fold[u]):
            text = url_filter.START + u + url_filter.END
            counts.update(text[i - k : i + 1] for i in range(1, len(text)) for k in range(p.order) if i - k >= 0)
        kept[good] = {g: n for g, n in counts.items() if len(g) < 3 or n >= p.least}
    memo = {}

    def score(u):
        text = url_filter.START + u + url_filter.END
        total = 0.0
        for i in range(1, len(text)):
            gram = text[max(0, i + 1 - p.order) : i + 1]
            if gram not in memo:
                memo[gram] = math.log(_witten_bell(kept[True], gram)) - math.log(_witten_bell(kept[False], gram))
            total += memo[gram]
        return total / (len(text) - 1)

    for i, u in rows:
        assert out[i]["score"] == (None if u is None else pytest.approx(score(u), abs=1e-9))
    held = [(score(u), g) for u, g in labels.items() if not fold[u]]
    good, bad = [s for s, g in held if g], [s for s, g in held if not g]
    assert good and bad and any(r["rule"] is None and r["url"] for r in out.values())

    def accuracy(cut):
        return sum(s >= cut for s in good) / len(good) + sum(s < cut for s in bad) / len(bad)

    ratio, cut = url_filter.fit(spark.createDataFrame(list(labels.items()), "url string, good boolean"), p)
    assert accuracy(cut) == pytest.approx(max(accuracy(s) for s in good + bad + [math.inf]))
    for i, u in rows:
        if u is not None and out[i]["rule"] is None:
            assert out[i]["verdict"] == ("allow" if ratio.score(u) >= cut else "block")
    assert out[261]["verdict"] == "allow"
