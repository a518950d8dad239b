"""Every query that has SQL against that SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

from quillspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expect = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pages_with_broken_entities_agree_with_sql(spark, tmp_path):
    rows = [(1, "u", "a &&&amp</title> &ampx &copy; &eacute; &amp;lt; &a</h1>b&nbsp;c"), (2, "u", None), (3, "u", "&am&#39;&#x41;&quot")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expect = con.execute(registry.oracle_sql()["clean_pages"]).fetchall()
    assert sorted(map(tuple, registry.queries()["clean_pages"](spark, str(tmp_path)).collect())) == sorted(expect)


@pytest.mark.parametrize("labels, events", [([], []), ([(1, 0, 0), (1, 1, 1)], []), ([], [(2, None)] * 3)])
def test_odd_lines_agree_with_sql(spark, tmp_path, labels, events):
    """Blank lines, other line ends, other white space, no text, and ids that several rows share or that are missing."""
    texts = ["a\n\n\nb\n\n \n\t\nc", "a\n\nb\n\nc\n\nd", "a\nb\n", "", None, "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\ni", "a b\na\u00a0b\na\u3000b\na\x0bb\nab\na\tb\na\fb\na\rb"]
    shared = ["long line\nab\nlong line\na b\n\nq", "q\nab\n\nq\n\nab", "q"]
    rows = [*enumerate(texts), *((id, text) for id in (50, None) for text in shared)]
    tables = {
        "documents": ([(id, text, "en", "src0", 0) for id, text in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"), "events": (events, "event_id long, ts timestamp_ntz"),
    }
    con = duckdb.connect()
    for name, (found, schema) in tables.items():
        spark.createDataFrame(found, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = registry.queries()["repeat_lines"](spark, str(tmp_path))
    expect = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()['repeat_lines']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expect, key=repr)
