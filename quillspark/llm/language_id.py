"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of labelled texts.  A text is cut into segments at white space, each segment is
compressed with each dictionary, and the language whose sizes sum to least wins.
Segments keep the dictionary in reach over the whole of a long text.  The margin
to the second language says how sure that is; narrow margins can be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.shards import row_key
from quillspark.llm.text import small_batches


@dataclass(frozen=True)
class LangParams:
    """``rows``: labelled rows that a language's dictionary is made of, about.
    ``dictionary``: bytes of a dictionary; ``together``: bytes of all of them, so that many
    languages have smaller ones, of ``least`` bytes at least.
    ``segment``: bytes compressed together. ``margin``: part by which the second language
    must be larger than the first, with one byte at least, for a sure answer."""

    rows: int = 300
    dictionary: int = 65_536
    together: int = 16_000_000
    least: int = 256
    segment: int = 4_096
    margin: float = 0.003
    level: int = 5
    seed: int = 11


def fit(labelled: DataFrame, params: LangParams = LangParams()) -> dict[str, bytes]:
    """Dictionaries by language of (text, lang) rows; rows with a null in either teach nothing.

    Every language is learned.  Of about ``rows`` rows of each, chosen by a hash of the row,
    the different texts follow one another whole, in order of their hash, until the
    dictionary is full; only the text at its end is cut there.  What is collected is the
    dictionaries, ``together`` bytes or ``least`` a language.
    """
    spark, p = labelled.sparkSession, params
    place = F.pmod(row_key(labelled, p.seed), F.lit(1 << 40)) / float(1 << 40)
    rows = labelled.select("text", "lang", place.alias("place")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not counts:
        return {}
    size = max(p.least, min(p.dictionary, p.together // len(counts)))
    shares = spark.createDataFrame([(r["lang"], min(1.0, p.rows / r["n"])) for r in counts], "lang string, share double")
    shares = F.broadcast(shares) if len(counts) <= 100_000 else shares
    content = F.concat(F.lower("text").cast("binary"), F.lit(b" "))
    chosen = rows.join(shares, "lang").where(F.col("place") < F.col("share")).select("lang", content.alias("content")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("content"), "content")  # ``rows`` a language, about
    before = F.coalesce(F.sum(F.octet_length("content").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = (F.lit(size) - F.col("before")).cast("int")
    parts = chosen.withColumn("before", before).where(F.col("before") < size).select("lang", "before", F.substring(F.col("content"), F.lit(1), room).alias("content"))
    out: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in parts.collect():
        out[r["lang"]].append((r["before"], bytes(r["content"])))
    joined = {lang: b"".join(x for _, x in sorted(found)) or b" " for lang, found in out.items()}
    return {lang: x * -(-8 // len(x)) for lang, x in joined.items()}  # a dictionary has 8 bytes at least


def segments(data: bytes, size: int) -> Iterator[bytes]:
    """Consecutive parts of about ``size`` bytes that end at white space where there is any."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            space = max(data.rfind(b" ", at + size // 2, end), data.rfind(b"\n", at + size // 2, end))
            end = space + 1 if space >= 0 else end
        yield data[at:end]
        at = end


class Judge:
    """Compressors of all languages; made once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], params: LangParams):
        self.languages, self.params, self.compressors = sorted(dictionaries), params, []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=params.level)
            self.compressors.append(zstandard.ZstdCompressor(level=params.level, dict_data=content, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.languages), np.int64)
        for part in segments(text.lower().encode("utf-8"), self.params.segment):
            total += [len(c.compress(part)) for c in self.compressors]
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, sure). Ties go to the first language by name."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = int(sizes[order[0]])
        if len(order) == 1:
            return self.languages[0], 1.0, True
        gap = int(sizes[order[1]]) - best
        sure = gap >= max(1.0, self.params.margin * best)
        return self.languages[order[0]], min(1.0, gap / (gap + 0.01 * best + 1.0)), bool(sure)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], params: LangParams = LangParams(), text: str = "text", into: str = "language") -> DataFrame:
    """Add one column ``into`` to every row: a struct of lang_pred, score (0 to 1, from the margin) and sure.

    A null text, or one without a letter, is ``und`` with score 0 and not sure; so
    is every text if nothing was learned.  The dictionaries are ``together`` bytes, or
    ``least`` a language, which bounds what is sent to tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((dictionaries, params))
    made: list[Judge] = []

    @F.pandas_udf("lang_pred string, score double, sure boolean")
    def judge(column: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Judge(*shared.value))
        return pd.DataFrame([made[0].predict(t) for t in column], columns=["lang_pred", "score", "sure"])

    return small_batches(docs).withColumn(into, judge(F.col(text)))
