import time

from quillspark.scratch import Scratch
from quillspark.streaming import stateful


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name).collect()


def events(spark, tmp_path, rows, schema, parts=2):
    """Files of one trigger each, in order."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def attempts(events, limit=5, window=900.0):
    """Counters of subjects and addresses, one attempt after the other."""
    count, ends, out = {}, {}, []
    for _, _, event, at, subject, address, success in sorted((e[2], e[1], e[1], e[2], *e[3:]) for e in events):
        keys = [("s", subject.strip().lower()), ("a", address)]
        for k in keys:
            if k in ends and ends[k] <= at:
                del count[k], ends[k]
        most = max(count.get(k, 0) for k in keys)
        if most >= limit:
            out.append((event, most, True))
            continue
        for k in keys:
            if success:
                count.pop(k, None), ends.pop(k, None)
            else:
                ends.setdefault(k, at + window)
                count[k] = count.get(k, 0) + 1
        most = max(count.get(k, 0) for k in keys)
        out.append((event, most, most >= limit))
    return sorted(out)


LOGINS = "realm string, event_id long, at double, subject string, address string, success boolean"


def test_login_blocks_couple_subject_and_address(spark, tmp_path):
    rows = [("r", i, float(i), "Ann ", "x", False) for i in range(5)]
    rows += [("r", 5, 5.0, "ann", "y", True), ("r", 6, 6.0, "bob", "x", True), ("r", 7, 7.0, "bob", "z", False), ("r", 8, 8.0, "bob", "z", True)]
    rows += [("r", 9, 899.0, "ann", "y", True), ("r", 10, 900.0, "ann", "x", True), ("r", 11, 901.0, "ann", "x", False)]
    batch = sorted(tuple(r) for r in stateful.login_blocks_batch(spark.createDataFrame(rows, LOGINS)).collect())
    by_id = {r[0]: r[1:] for r in batch}
    assert by_id[3] == (4, False) and by_id[4] == (5, True)  # the fifth failure is itself blocked
    assert by_id[5] == (5, True) and by_id[6] == (5, True)  # by the subject, by the address
    assert by_id[7] == (1, False) and by_id[8] == (0, False) and by_id[9][1] and by_id[10] == (0, False) and by_id[11] == (1, False)
    assert batch == attempts(rows)
    streamed = run(spark, stateful.login_blocks(events(spark, tmp_path, rows, LOGINS)), "logins")
    assert sorted(tuple(r) for r in streamed) == batch


def test_login_blocks_over_many_attempts_equal_one_pass(spark):
    import random

    dice = random.Random(3)
    rows = [("r", i, dice.random() * 20_000, f"u{dice.randrange(60)}", f"a{dice.randrange(25)}", dice.random() < 0.2) for i in range(4_000)]
    found = stateful.login_blocks_batch(spark.createDataFrame(rows, LOGINS)).collect()
    assert sorted(tuple(r) for r in found) == attempts(rows)


def test_a_shared_address_over_a_year_is_many_groups(spark, tmp_path):
    """Pauses part what one address connects, and the answers stay those of one pass."""
    import random

    dice, rows, at = random.Random(5), [], 0.0
    for i in range(3_000):
        at += dice.choice([1.0, 30.0, 200.0, 899.0, 900.0, 901.0, 20_000.0]) if i % 3 == 0 else dice.random() * 60
        rows.append(("r", i, at, f"u{dice.randrange(200)}", "shared" if i % 10 else f"a{i}", dice.random() < 0.15))
    table = spark.createDataFrame(rows, LOGINS)
    found = stateful.login_blocks_batch(table).collect()
    assert sorted(tuple(r) for r in found) == attempts(rows)
    groups = stateful.login_groups(table.drop("realm"), 900.0, Scratch(spark, "test")).groupBy("component").count().collect()
    assert len(groups) > 300 and max(r["count"] for r in groups) < 300


def test_many_small_groups_of_logins_are_one_frame_a_batch():
    """Groups that end within a batch start anew, one that goes on into the next keeps its counters."""
    import pandas as pd

    rows = [(i, float(i), f"u{i // 7}", "x", False, f"c{i // 7}") for i in range(700)]
    table = pd.DataFrame(rows, columns=["event_id", "at", "subject", "address", "success", "component"])
    frames = list(stateful._followed(iter([table[:333], table[333:333], table[333:]]), 5, 900.0))
    assert [len(f) for f in frames] == [333, 0, 367]
    assert pd.concat(frames)["failures"].tolist() == [min(i % 7 + 1, 5) for i in range(700)]


def test_login_query_equals_one_pass(spark):
    from quillspark.plans import registry

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()
    rows = [("r", r["event_id"], r["ts"].timestamp(), str(r["user_id"]), str(r["user_id"] // 8), r["event_type"] != "error") for r in table]
    found = registry.queries()["login_blocks"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in found) == attempts(rows)


def test_token_buckets(spark, tmp_path):
    schema = "key string, event_id long, at double, tokens double"
    rows = [("m", 1, 0.0, 10.0), ("m", 2, 0.0, 5.0), ("m", 3, 0.1, 5.0), ("n", 4, 0.0, 1.0), ("m", 5, 9.0, 10.0)]
    waits = {r["event_id"]: r["wait"] for r in run(spark, stateful.token_buckets(events(spark, tmp_path, rows, schema)), "buckets")}
    assert waits == {1: 0.0, 2: 0.5, 3: 0.9, 4: 0.0, 5: 0.0}


def test_first_receipts(spark, tmp_path):
    schema = "job string, step string, ts timestamp"
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("j", "a", at(1)), ("j", "a", at(2)), ("j", "b", at(3)), ("j", "a", at(4))]
    found = run(spark, stateful.first_receipts(events(spark, tmp_path, rows, schema), ["job", "step"]), "receipts")
    assert sorted((r["job"], r["step"]) for r in found) == [("j", "a"), ("j", "b")]


def test_rates_of_stream_and_table(spark, tmp_path):
    import datetime

    rows = [(datetime.datetime(2024, 1, 1, 0, m),) for m in (0, 1, 4, 7, 50)]
    table = {str(r["start"]): r["requests"] for r in stateful.request_rate(spark.createDataFrame(rows, "ts timestamp")).collect()}
    streamed = run(spark, stateful.request_rate(events(spark, tmp_path, rows, "ts timestamp", 1), late="1 minute"), "rates")
    got = {str(r["start"]): r["requests"] for r in streamed}
    assert got.items() <= table.items() and table["2024-01-01 00:00:00"] == 3


def test_answer_events(spark):
    rows = [(1, "[]", ["a", "b"], None), (2, "[]", [], "failed")]
    out = stateful.answer_events(spark.createDataFrame(rows, "query_id int, references string, deltas array<string>, error string")).orderBy("query_id", "seq").collect()
    assert [r["event"] for r in out] == ["status", "references", "status", "content", "content", "done", "status", "references", "status", "error"]
