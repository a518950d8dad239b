"""Counts, trends, activity and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import governance


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): one count a table, all in one plan."""
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


def counts_by(rows: DataFrame, column: str, missing: str = "other") -> DataFrame:
    """(column, n), largest first; null and "" count as ``missing`` before grouping."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    return rows.groupBy(value.alias(column)).agg(F.count("*").alias("n"))


def hot_terms(docs: DataFrame, k: int = 20, least: int = 2) -> DataFrame:
    """(term, n): the ``k`` heaviest terms of ``least`` characters over ``docs`` (text)."""
    rows = docs.select(F.explode(T.terms(T.clean(F.col("text")))).alias("t")).select("t.*")
    rows = rows.where(F.length("term") >= least)
    return rows.groupBy("term").agg(F.floor(F.sum("weight")).cast("long").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def term_sketches(docs: DataFrame, by: list[str], items: int = 10_000, least: int = 2) -> DataFrame:
    """(by, sketch): frequent terms of ``docs`` (by, text) as one mergeable sketch a group, of bounded size.

    A sketch holds ``items`` counters, so a term's count is too small by the group's terms
    over three quarters of that at most. Kept by base and day, new days are added without the old texts."""
    words = docs.select(*by, F.explode(T.terms(T.clean(F.col("text")))).alias("t")).where(F.length("t.term") >= least)
    return words.groupBy(*by).agg(F.call_function("approx_top_k_accumulate", F.col("t.term"), F.lit(items)).alias("sketch"))


def sketched_terms(sketches: DataFrame, k: int = 20, items: int = 10_000) -> DataFrame:
    """(term, n): about the ``k`` most frequent terms of all the sketches together, merged without any text."""
    whole = sketches.agg(F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(items)).alias("sketch"))
    found = whole.select(F.explode(F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(k))).alias("x"))
    return found.select(F.col("x.item").alias("term"), F.col("x.count").cast("long").alias("n"))


def archive_counts(kbs: DataFrame, docs: DataFrame, permissions: DataFrame) -> DataFrame:
    """(kb, documents, live_documents, permissions), 0 where there are none."""
    a = docs.groupBy("kb").agg(F.count("*").alias("documents"), F.count_if(governance.live(F.col("status"))).alias("live_documents"))
    b = permissions.groupBy("kb").agg(F.count("*").alias("permissions"))
    return kbs.select("kb").join(a, "kb", "left").join(b, "kb", "left").na.fill(0, ["documents", "live_documents", "permissions"])


def daily_trend(named: dict[str, tuple[DataFrame, str]], now: str, days: int) -> DataFrame:
    """(day, a count for each name): the last ``days`` days up to ``now``, days without rows as 0.

    Rows count from ``now`` less days - 1 on, time of day included, so the first day is partial.
    """
    spark = next(iter(named.values()))[0].sparkSession
    end = F.lit(now).cast("timestamp_ntz")
    start = end - F.expr(f"INTERVAL {days - 1} DAYS")
    calendar = spark.range(1).select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))
    for name, (rows, column) in named.items():
        part = rows.where(F.col(column) >= start).groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias(name))
        calendar = calendar.join(part, "day", "left").na.fill(0, [name])
    return calendar


def activity(audit: DataFrame, users: DataFrame, kbs: DataFrame, k: int = 20) -> DataFrame:
    """The latest audit rows with actor and base name; the name in the details comes first."""
    detail = F.nullif(F.trim(F.get_json_object("details", "$.name")), F.lit(""))
    rows = audit.join(users.select(F.col("user_id").alias("actor"), "username"), "actor", "left").join(kbs.select(F.col("kb").alias("target_id"), "name"), "target_id", "left")
    shown = F.coalesce(detail, F.col("name"), F.lit(""))
    return rows.select("audit_id", "ts", "action", F.coalesce("username", F.lit("")).alias("username"), shown.alias("kb_name")).orderBy(F.desc("ts"), F.desc("audit_id")).limit(k)


def evaluation(cases: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, keyword_hit_ratio, citation_count) of cases (query_id, answer, keywords)
    over the snippets of their citations."""
    snippets = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "snippet"))).alias("x"), F.count("*").alias("n"))
    rows = cases.join(snippets, "query_id", "left")
    blob = F.concat_ws("\n", F.coalesce("answer", F.lit("")), F.transform(F.coalesce("x", F.array().cast("array<struct<index:int,snippet:string>>")), lambda r: r["snippet"]))
    return rows.select("query_id", T.keyword_hits(blob, F.col("keywords")).alias("keyword_hit_ratio"), F.coalesce("n", F.lit(0)).alias("citation_count"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row: cases, share with a citation, mean hit ratio, mean citations; 0 without cases."""
    mean = lambda c, places: F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)
    return results.agg(
        F.count("*").alias("cases"),
        mean((F.col("citation_count") > 0).cast("int"), 4).alias("coverage"),
        mean(F.col("keyword_hit_ratio"), 4).alias("keyword_hit_ratio"),
        mean(F.col("citation_count"), 3).alias("citations"),
    )


def case_results(cases: DataFrame, cited: DataFrame, answered: DataFrame) -> DataFrame:
    """One row for each golden case (id, question, reference_answer, expected_citations_keywords): keyword_hit_ratio and
    citation_count over ``cited`` (query_id, index, snippet), has_hit from ``answered`` (query_id, has_hit).

    A case without citations has none; one without keywords hits all."""
    keywords = F.coalesce("expected_citations_keywords", F.array().cast("array<string>"))
    rows = evaluation(cases.select(F.col("id").alias("query_id"), F.lit("").alias("answer"), keywords.alias("keywords")), cited)
    rows = rows.join(answered.select("query_id", "has_hit"), "query_id", "left").withColumnRenamed("query_id", "id")
    kept = cases.select("id", "question", F.coalesce("reference_answer", F.lit("")).alias("reference_answer"))
    return kept.join(rows, "id").withColumn("has_hit", F.coalesce("has_hit", F.lit(False)))


def run_summary(results: DataFrame) -> DataFrame:
    """One row over :func:`case_results`: cases, hit_coverage, avg_keyword_hit, avg_citation_count; 0 without cases."""
    mean = lambda c, places: F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)
    return results.agg(
        F.count("*").alias("cases"), mean(F.col("has_hit").cast("int"), 4).alias("hit_coverage"),
        mean(F.col("keyword_hit_ratio"), 4).alias("avg_keyword_hit"), mean(F.col("citation_count"), 3).alias("avg_citation_count"),
    )


def keep_run(results: DataFrame, path: str, run_key: str, golden_file: str) -> str:
    """Append a run of :func:`case_results` to the tables ``cases`` and ``runs`` under ``path``; returns its id.

    The cases are written first and the summary is taken from what was written, so a run
    that ``runs`` lists is whole, and one that broke off is not listed."""
    spark, run = results.sparkSession, uuid.uuid4().hex
    place = f"{path}/cases/run_id={run}"
    results.write.mode("overwrite").parquet(place)
    written = spark.read.schema(results.schema).parquet(place)
    head = [F.lit(run).alias("run_id"), F.lit(run_key).alias("run_key"), F.lit(golden_file).alias("golden_file")]
    run_summary(written).select(*head, "*", F.to_json(F.struct("*")).alias("summary_json")).coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return run


def kept_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs that are whole, each with its summary as columns and as JSON."""
    return spark.read.parquet(f"{path}/runs")


def user_counts(users: DataFrame) -> DataFrame:
    """One row: all accounts, active ones, administrators."""
    return users.agg(F.count("*").alias("users"), F.count_if("is_active").alias("active"), F.count_if(F.col("role") == "admin").alias("admins"))
