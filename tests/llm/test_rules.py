"""Conversation repair, learned decision lists and the filter audit against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import conversation_repair as R
from quillspark.llm import decision_list as D
from quillspark.llm import filter_audit as A

TURNS = "conv_id long, turn long, role string, text string"


def _space(v):
    return " " if v is None else str(v)


def damaged(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        k = zlib.crc32(f"{_space(conv)}:{_space(turn)}".encode()) % 20
        role, text = _space(role), _space(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return convs


def cheapest(rows):
    """Counts, cost, audit, repaired lines: a search by (cost, audit) over all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not solid else "again" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "e", ())], set()
    while heap:
        cost, audit, i, last, out = heappop(heap)
        if i == len(rows) and last in "ea":
            return (gaps, kinds.count("blank"), kinds.count("again"), kinds.count("cut"), illegal, cost, audit), [f"{r}:{t}" for r, t in out]
        if (i, last) in done:
            continue
        done.add((i, last))
        after = {"e": "su", "s": "u", "u": "a", "a": "u"}[last]
        names = [(x, {"u": "user", "a": "assistant"}[x]) for x in after if x != "s"]
        for x, name in names:
            heappush(heap, (cost + 5, audit + "I", i, x, (*out, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if kinds[i] not in ("blank", "again"):
                more = 5 if kinds[i] == "cut" else 0
                if role[:1] and role[:1] in after:
                    heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for x, name in names:
                    heappush(heap, (cost + more + 1, audit + "R", i + 1, x, (*out, (name, text))))


def _turns(rng, convs):
    roles, texts = ["user", "assistant", "system", "umpire", "", None, "Bot"], ["Yes.", "no", "  ", "", None, "Why?", "é!", "a\tb. ", "Go!\n"]
    table = []
    for conv in convs:
        for _ in range(rng.randint(1, 12)):
            turn = rng.choice([None, *range(-2, 9)])
            table.append((conv, turn, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
    return table


@pytest.mark.parametrize("segment", [512, 3])
def test_repair_is_the_cheapest(spark, segment):
    rng = random.Random(segment)
    table = _turns(rng, [None, *range(60)])
    table += [(100, i, ["user", "assistant"][i % 2], f"line {i}.") for i in range(300)] + [(101, 5, "user", "same.")] * 400
    table += [(102, i // 3, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"c{i}."])) for i in range(200)]
    rng.shuffle(table)
    rows = R.damaged(spark.createDataFrame(table, TURNS))
    found = R.edits(rows, segment)
    got = {r["conv_id"]: r for r in R.summary(rows, found).collect()}
    kept = defaultdict(list)
    for r in R.repaired(rows, found).orderBy("conv_id", "position").collect():
        kept[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert r["position"] == len(kept[r["conv_id"]])
    expect = damaged(table)
    assert set(got) == set(expect)
    for conv, turns in expect.items():
        counts, lines = cheapest(turns)
        assert tuple(got[conv][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == counts, conv
        assert kept[conv] == lines and got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_a_conversation_over_many_ranges(spark):
    """Counts at the borders of ranges and segments are those of the whole."""
    rng = random.Random(8)
    turns = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"x{i}.", f"y{i}", "."])) for i in range(1_500)]
    rows = spark.createDataFrame(turns, TURNS).withColumn("n", F.lit(1))
    found = R.edits(rows, 16)
    assert found.count() == 1
    counts, lines = cheapest([t[1:] for t in turns])
    got = R.summary(rows, found).first()
    assert tuple(got[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == counts
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    w, lines, seen, again = words(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            again += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def test_statistics_of_whole_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c d", "a b c d e", "a a a a a a", "x\ny\nx\n\n \n \nx", "é\x0bü\x0cA\rB # * <b>", "a b c d e f a b c d e", "1 2 3 4 5 1 2 3 4 5 1 2 3 4 5"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice(["ab", "c", "Dé", "#", "q."]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts.append(" ".join(str(rng.randint(0, 9_000)) for _ in range(70_000)))
    texts.append("spam " * 30_000)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", D.statistics(F.col("text")).alias("s")).select("id", "s.*")
    for r in rows.collect():
        text = texts[r["id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(text), r["id"]
        assert (r["n_chars"], r["n_different"]) == (len(text or ""), len(set(words(text))))


def _rated(spark, n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, symbols, caps = rng.randint(10, 500), rng.choice([0, 0, 0, rng.randint(0, 200)]), rng.choice([0, 0, rng.randint(0, 900)])
        bad = symbols / w >= 0.4 or (caps / 1000 >= 0.5 and w < 300)
        rows.append((i, w, 5 * w, symbols, 0, 0, 1000, w, caps, 10, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_different long, n_capitals long, n_lines long, label int")


def test_rules_are_learned_and_pruned(spark):
    found = D.learn(_rated(spark, 3_000))
    measures = {x.measure for rule in found.rules for x in rule}
    assert found.default and "symbols_per_word" in measures and "capitals" in measures
    judged = _rated(spark, 3_000, seed=1).select("label", found.verdict().alias("kept"), found.rule().alias("rule"), *(m().alias(k) for k, m in D.MEASURES.items())).collect()
    assert np.mean([r["kept"] == bool(r["label"]) for r in judged]) > 0.95
    lost = [r for r in judged if r["label"] and not r["kept"]]
    assert len(lost) < 0.02 * len(judged)
    for r in judged:  # the column is the list, read in order
        hit = next((rule for rule in found.rules if all((r[x.measure] >= x.threshold) == x.above for x in rule)), None)
        assert r["kept"] == (found.default if hit is None else False)
        assert r["rule"] == ("default" if hit is None else " and ".join(map(str, hit)))


def test_noise_gives_no_rule(spark):
    rows = _rated(spark, 1_200).withColumn("label", (F.xxhash64("doc_id") % 2 == 0).cast("int"))
    assert D.learn(rows).rules == ()


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_alone_gives_no_rule(spark, label):
    found = D.learn(_rated(spark, 60).withColumn("label", F.lit(label)))
    assert found.rules == () and found.default == bool(label)


def test_plain_changes():
    for k in (1, 2, 3, 5):
        orders = [(tuple(o), i) for o, i in A.plain_changes(k)]
        assert len({o for o, _ in orders}) == len(orders) == len(list(itertools.permutations(range(k))))
        for (a, _), (b, i) in itertools.pairwise(orders):
            c = list(a)
            c[i], c[i + 1] = c[i + 1], c[i]
            assert tuple(c) == b


def fails(text):
    text = text or ""
    w = words(text)
    tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)))
    return "".join(x for x, t in zip("ABCD", tests) if t)


def test_audit_against_all_orders(spark):
    rng = random.Random(4)
    make = lambda: rng.choice([None, "", " ".join(rng.choice(["one", "Two", "THREE", "4#", f"w{rng.random()}"]) for _ in range(rng.randint(1, 120)))])
    pool = [make() for _ in range(40)]
    docs = [(rng.choice([None, i, i // 2]), rng.choice(pool), rng.choice(["a", "b", None, ""])) for i in range(200)]
    docs += [(1_000 + i, "hot", "a") for i in range(1_500)]
    labels = [(rng.choice([None, rng.randint(0, 1_600)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    found = A.audit(A.cells(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 1), A.LETTERS)
    assert found.dtypes == [tuple(x.replace("long", "bigint").split()) for x in A.OUT.split(", ")]
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    rows = [(s or "", fails(t) + ("E" if i is not None and i > first[t or ""] else ""), i in good, i in toxic) for i, t, s in docs]
    expect, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left, before = mine, set()
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] and bool(before & set(r[1])) for r in mine)
                before.add(f)
                shapley[part, f] += len(gone)
                expect[part, "".join(order), step] = (len(left), len(gone), redundant, sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
    got = {(r["part"], r["filter_order"], r["step"]): r for r in found.collect()}
    assert set(got) == set(expect)
    for key, values in expect.items():
        r = got[key]
        assert tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == values
        assert r["shapley"] == shapley[key[0], key[1][key[2] - 1]]
