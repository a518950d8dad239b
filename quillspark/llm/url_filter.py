"""URL filter: host and path rules first, else a ratio of two character models.

Both models are variable-order Markov models of the characters of a URL: one of
URLs that rules accept, one of those that rules reject.  The counts of all
n-grams up to ``order`` characters are made by one grouping; a model keeps those
that were seen often enough.  A character's probability interpolates all
orders that were seen in its context (Witten-Bell), so the order varies with the
context.  A URL's score is the difference of its two log likelihoods divided by
its length; the cut is calibrated on labelled URLs that neither model has seen.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``host/path`` text and what it says: block or allow."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class UrlParams:
    """``sample``: different labelled URLs that a fit may use, about, over both classes.
    ``order``: characters in the longest n-gram. ``least``: times that an n-gram of three
    characters or more occurs in the sample at least to be in a model; rarer ones are smoothed.
    ``calibrate``: one labelled URL in so many sets the cut and trains nothing."""

    sample: int = 20_000
    order: int = 6
    least: int = 2
    calibrate: int = 5
    seed: int = 7


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty if the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add host, path, rule (the longest that fits, else null) and rule_verdict.

    A rule fits its own host and every subdomain when the path starts with its
    path.  Of rules of equal length the first by text counts.  ``rules`` is a
    written list; each becomes one comparison inside the scan.
    """
    host, path = split_url(F.col("__url"))
    out = urls.withColumn("__url", F.col(url)).withColumn("host", host).withColumn("path", path).drop("__url")
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        at_host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        fits = at_host & F.startswith(F.col("path"), F.lit(rule.path))
        name = F.when(fits, rule.text).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return out.withColumn("rule", name).withColumn("rule_verdict", verdict)


def _grams(batches: Iterator[pd.DataFrame], order: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple[bool, str], int] = defaultdict(int)
        for url, good in zip(batch["url"], batch["good"]):
            text = START + url + END
            for i in range(1, len(text)):
                for k in range(min(order, i + 1)):
                    counts[good, text[i - k : i + 1]] += 1
        if counts:
            yield pd.DataFrame({"good": [g for g, _ in counts], "gram": [s for _, s in counts], "n": list(counts.values())})


class CharModel:
    """Interpolated n-gram model over the kept counts."""

    def __init__(self, counts: dict[str, int], order: int):
        self.counts, self.order = counts, order
        self.total: dict[str, int] = defaultdict(int)
        self.kinds: dict[str, int] = defaultdict(int)
        for gram, n in counts.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1

    def log_prob(self, gram: str) -> float:
        """Log probability of the last character after those before it."""
        p = 1.0 / 65_536
        for k in range(1, len(gram) + 1):
            part = gram[-k:]
            total = self.total.get(part[:-1], 0)
            if total:
                kinds = self.kinds[part[:-1]]
                p = (self.counts.get(part, 0) + kinds * p) / (total + kinds)
        return math.log(p)


class Ratio:
    """Length-normalised difference of log likelihoods, accepted minus rejected."""

    def __init__(self, accepted: CharModel, rejected: CharModel):
        self.accepted, self.rejected = accepted, rejected
        self.memo: dict[str, float] = {}

    def score(self, url: str) -> float:
        text, order, memo, total = START + url + END, self.accepted.order, self.memo, 0.0
        if len(memo) > 300_000:
            memo.clear()
        for i in range(1, len(text)):
            gram = text[max(0, i + 1 - order) : i + 1]
            if (value := memo.get(gram)) is None:
                value = memo[gram] = self.accepted.log_prob(gram) - self.rejected.log_prob(gram)
            total += value
        return total / (len(text) - 1)


def _cut(scores: Sequence[tuple[float, bool]]) -> float:
    """The cut that maximises the mean of both classes' accuracy; halfway to the next score below."""
    good, bad = sum(g for _, g in scores), sum(not g for _, g in scores)
    if not good or not bad:
        return 0.0
    ordered = sorted(scores)
    best, cut, passed_good, passed_bad = 0.5, ordered[0][0], 0, 0
    for i, (value, is_good) in enumerate(ordered):
        passed_good, passed_bad = passed_good + is_good, passed_bad + (not is_good)
        follows = ordered[i + 1][0] if i + 1 < len(ordered) else value + 1e-9
        if follows > value and (accuracy := 0.5 * (1 - passed_good / good + passed_bad / bad)) > best:
            best, cut = accuracy, (value + follows) / 2
    return cut


def fit(labelled: DataFrame, params: UrlParams = UrlParams()) -> tuple[Ratio, float] | None:
    """Train on (url, good); None unless both classes have URLs.

    Null URLs and labels teach nothing.  The labelled rows in use are bounded by
    ``params.sample``, chosen by a hash of the URL, the same share of each class
    at least up to half of the bound; a URL counts once, however often it occurs.
    """
    rows = labelled.select("url", F.col("good").cast("boolean").alias("good")).dropna()
    sizes = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    place = F.pmod(F.xxhash64("url", F.lit(params.seed)), F.lit(1 << 30)) / float(1 << 30)
    share = {g: min(1.0, params.sample / 2 / n) for g, n in sizes.items()}
    chosen = rows.where(place < F.when(F.col("good"), share[True]).otherwise(share[False])).distinct()
    fold = F.pmod(F.xxhash64("url", F.lit(params.seed + 1)), F.lit(params.calibrate))
    order = params.order
    counted = (
        chosen.where(fold != 0)
        .mapInPandas(lambda batches: _grams(batches, order), "good boolean, gram string, n long")
        .groupBy("good", "gram")
        .agg(F.sum("n").alias("n"))
        .where((F.length("gram") < 3) | (F.col("n") >= params.least))
    )
    kept: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for part in counted.toArrow().to_batches():  # of sample URLs
        for good, gram, n in zip(*(part.column(k).to_pylist() for k in range(3))):
            kept[good][gram] = n
    ratio = Ratio(CharModel(kept[True], order), CharModel(kept[False], order))
    held = chosen.where(fold == 0).select("url", "good").collect()  # at most sample rows
    return ratio, _cut([(ratio.score(r["url"]), r["good"]) for r in held])


def judge(urls: DataFrame, rules: Sequence[Rule], params: UrlParams = UrlParams(), url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score to every row of ``urls``; columns that have
    these names already are replaced.

    verdict is the rule's; without a rule it is block if the score is under the
    calibrated cut, else allow.  URLs that are null score 0 and are allowed; so
    is every URL without a rule while one of the classes has no labelled URL.
    """
    spark: SparkSession = urls.sparkSession
    ruled = with_rules(urls, rules, url)
    labelled = ruled.where(F.col("rule").isNotNull()).select(F.col(url).alias("url"), (F.col("rule_verdict") == "allow").alias("good"))
    fitted = fit(labelled, params)
    if fitted is None:
        scored = ruled.withColumn("score", F.lit(0.0)).withColumn("__cut", F.lit(0.0))
    else:
        shared, cut = spark.sparkContext.broadcast(fitted[0]), float(fitted[1])

        @F.pandas_udf("double")
        def ratio(column: pd.Series) -> pd.Series:
            model = shared.value
            return pd.Series([None if u is None else model.score(u) for u in column], dtype="float64")

        scored = ruled.withColumn("score", ratio(F.col(url))).withColumn("__cut", F.lit(cut))
    by_model = F.when(F.coalesce(F.col("score"), F.lit(0.0)) < F.when(F.col(url).isNull(), F.lit(0.0)).otherwise(F.col("__cut")), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("rule_verdict", by_model)).drop("rule_verdict", "__cut")
