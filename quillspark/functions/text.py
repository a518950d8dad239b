"""Text functions as column expressions; all of them stay inside the JVM unless said."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from quillspark.functions import constants as C


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unescape(c: Column) -> Column:
    """Decode every HTML entity. The common ones are decoded in the JVM, the ampersand last, so that
    nothing is decoded twice; texts with any other are decoded in Python, and only those travel."""
    other = F.when(F.regexp_like(c, F.lit(C.OTHER_ENTITY)), c)
    return F.coalesce(unescape_all(other), unescape_common(c))


def unescape_common(c: Column) -> Column:
    """Decode the common entities alone, those that end in a semicolon."""
    for entity, char in C.COMMON_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(StringType())
def unescape_all(c: pd.Series) -> pd.Series:
    """Decode every HTML entity there is (in Python, by Arrow batches)."""
    return c.map(lambda x: None if x is None else html.unescape(x))


def clean(c: Column, every: bool = True) -> Column:
    """Display text: entities decoded first, then tags become spaces, white space is collapsed
    and trimmed. Null becomes empty; comments and doctypes survive.

    ``every``: all entities there are, whole or not; else the common ones, as SQL can."""
    decoded = (unescape if every else unescape_common)(F.coalesce(c, F.lit("")))
    return strip(F.regexp_replace(F.regexp_replace(decoded, C.HTML_TAG, " "), r"(?U)\s+", " "))


def terms(c: Column) -> Column:
    """Array of (term, weight): ASCII words 1 each; of CJK runs every character 0.5 and every
    neighbouring pair 1. A term that occurs again is listed again."""
    low = F.lower(c)
    word = F.transform(F.regexp_extract_all(low, F.lit(C.ASCII_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))
    runs = F.regexp_extract_all(low, F.lit(C.CJK_RUN), F.lit(0))
    each = F.flatten(F.transform(runs, lambda r: F.transform(F.split(r, ""), lambda ch: F.struct(ch.alias("term"), F.lit(0.5).alias("weight")))))
    pair = F.flatten(
        F.transform(
            F.filter(runs, lambda r: F.length(r) >= 2),
            lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.struct(F.substr(r, i, F.lit(2)).alias("term"), F.lit(1.0).alias("weight"))),
        )
    )
    every = F.concat(word, F.filter(each, lambda x: x["term"] != ""), pair)
    return F.when(F.regexp_like(low, F.lit(C.CJK_RUN)), every).otherwise(word)


#: Runs of one kind of character, as ``constants`` has them for the JVM.
WORD = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", f"{C.ASCII_TOKEN}|{C.CJK_RUN}"))


def term_weights(low: str | None) -> dict[str, float]:
    """Each term of a lower-cased text with its weights summed, as :func:`terms` lists them (inside tasks)."""
    out: dict[str, float] = {}
    for run, n in Counter(WORD.findall(low or "")).items():
        if run < "\u4e00":
            out[run] = float(n)
            continue
        for i, character in enumerate(run):
            out[character] = out.get(character, 0.0) + 0.5 * n
            if i:
                pair = run[i - 1 : i + 1]
                out[pair] = out.get(pair, 0.0) + n
    return out


def count_tokens(c: Column) -> Column:
    """ASCII words, CJK characters, and a quarter of all other characters, rounded down."""
    words = F.regexp_count(c, F.lit("[A-Za-z0-9_]+"))
    other = F.length(F.regexp_replace(c, "[A-Za-z0-9_\\x{4e00}-\\x{9fff}]+", ""))
    cjk = F.regexp_count(c, F.lit("[\\x{4e00}-\\x{9fff}]"))
    return (words + cjk + F.floor(other / 4)).cast("int")


def content_type(c: Column) -> Column:
    """table, image, formula, list or paragraph, by the first rule that fits."""
    start = F.regexp_replace(c, r"(?U)^\s+", "")
    return (
        F.when(F.startswith(start, F.lit("|")), "table")
        .when(F.startswith(start, F.lit("![](")), "image")
        .when(F.contains(c, F.lit("$$")), "formula")
        .when(F.regexp_like(c, F.lit(r"(?mU)^\s*[-*]\s+")), "list")
        .otherwise("paragraph")
    )


def heading(line: Column) -> Column:
    """Struct (level, title) of a trimmed line, null if it is no heading."""
    part = lambda pattern, i: F.regexp_extract(line, pattern, i)
    chapter, number = part(C.CHAPTER_HEADING, 1), part(C.NUMBER_HEADING, 1)
    level = (
        F.when(part(C.HASH_HEADING, 1) != "", F.length(part(C.HASH_HEADING, 1)))
        .when(chapter != "", F.when(F.endswith(chapter, F.lit("节")), 2).otherwise(1))
        .when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    )
    title = (
        F.when(part(C.HASH_HEADING, 1) != "", strip(part(C.HASH_HEADING, 2)))
        .when(chapter != "", strip(F.concat(chapter, F.lit(" "), part(C.CHAPTER_HEADING, 2))))
        .when(number != "", F.concat(number, F.lit(" "), strip(part(C.NUMBER_HEADING, 2))))
    )
    return F.when(level.isNotNull(), F.struct(level.cast("int").alias("level"), title.alias("title")))


def lines(c: Column) -> Column:
    """Array of lines; every Unicode line end separates, one at the end closes the last line."""
    parts = F.split(c, C.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def path_id(path: Column) -> Column:
    return F.sha1(F.array_join(path, " / "))


def non_overlapping(text: Column, term: Column) -> Column:
    """How often the term occurs in the text, left to right without overlap."""
    n = F.length(term)
    return F.when(n > 0, F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / n)).otherwise(0).cast("int")


def drop_citations(c: Column) -> Column:
    """Without [cite:n], ^[n] and [^n]."""
    return F.regexp_replace(c, r"\[cite:\d+\]|\^\[\d+\]|\[\^\d+\]", "")


def no_evidence(c: Column) -> Column:
    """Whether the answer says, white space aside, that nothing was found."""
    packed, found = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""), F.lit(False)
    for phrase in C.NO_EVIDENCE:
        found = found | F.contains(packed, F.lit(phrase))
    return found


def keyword_hits(blob: Column, keywords: Column) -> Column:
    """Part of the keywords that occur in the text whatever their case, to 4 places; 1 without keywords."""
    low = F.lower(blob)
    hit = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, F.round(hit / F.size(keywords), 4)).otherwise(1.0)


def dimension(term: str) -> int:
    """Dimension of a term: 64 bits of BLAKE2b, which Spark hasn't."""
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big") % C.SPARSE_DIMENSIONS + 1


@F.pandas_udf(IntegerType())
def sparse_dimension(term: pd.Series) -> pd.Series:
    """:func:`dimension` of each. Use it on distinct terms."""
    return term.map(dimension).astype("int32")


@F.pandas_udf(StringType())
def casefold(c: pd.Series) -> pd.Series:
    return c.str.casefold()


def number_literal(x: Column) -> Column:
    """Eight significant digits, without zeros at the end; exponents as C writes them."""
    return _number_literal(x)


@F.pandas_udf(StringType())
def _number_literal(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{v:.8g}")


@F.pandas_udf(StringType())
def dense_literal(v: pd.Series) -> pd.Series:
    """[a,b,...] of the finite components, eight significant digits each."""
    import math

    return v.map(lambda x: None if x is None else "[" + ",".join(f"{y:.8g}" for y in x if y is not None and math.isfinite(y)) + "]")


@F.pandas_udf(StringType())
def canonical_json(c: pd.Series) -> pd.Series:
    """JSON of any shape with the names of all objects in order, at every depth; null if it is none.

    Characters stand as they are, and numbers as Python writes them."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return c.map(one)


def payload_hash(payload: Column, struct: bool = True) -> Column:
    """SHA-256 of a payload's canonical JSON; equal for any order of its fields."""
    return F.sha2(canonical_json(F.to_json(payload) if struct else payload), 256)
