"""What readers see: labels, clauses, references, plain mathematics, times and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as T

CLAUSE = r"\d+(?:\.\d+){1,4}"


def last_clause(c: Column) -> Column:
    """The last dotted number of the text, null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(CLAUSE), F.lit(0)), F.lit(-1))


def citation_clause(path: Column, *others: Column) -> Column:
    """The last clause of the deepest path segment that has one, else of the other texts in order."""
    in_path = F.transform(F.reverse(path), last_clause)
    return F.coalesce(F.try_element_at(F.filter(in_path, lambda x: x.isNotNull()), F.lit(1)), *(last_clause(o) for o in others))


def clause_key(clause: Column) -> Column:
    """Numbers of a clause, for natural order: 4.9 before 4.10."""
    return F.transform(F.split(clause, r"\."), lambda x: x.cast("int"))


def source_label(path: Column) -> Column:
    """The last path segment that isn't blank."""
    return F.try_element_at(F.filter(path, lambda x: F.trim(x) != ""), F.lit(-1))


def document_reference(label: Column, clauses: Column) -> Column:
    return F.when(F.size(clauses) > 0, F.concat(label, F.lit(" "), F.array_join(clauses, "、"))).otherwise(label)


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "—").when(end.isNull() | (end == start), F.concat(F.lit("p."), start)).otherwise(F.concat(F.lit("p."), start, F.lit("-"), end))


def size_label(size: Column) -> Column:
    mb = 1024 * 1024
    return F.when(size >= mb, F.format_string("%.1f MB", size / mb)).otherwise(F.format_string("%.1f KB", size / 1024))


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(8))


def score_label(score: Column) -> Column:
    return F.format_string("%.3f", score)


def plain_math(c: Column) -> Column:
    """LaTeX fragments as plain text, by fixed replacements in order."""
    for pattern, new in C.PLAIN_MATH:
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def normal_math(c: Column) -> Column:
    """Formulas between any of four pairs of delimiters as plain text, without the delimiters.

    The text is parted at each formula, so what is inside one alone is changed."""
    for pattern in C.FORMULAS:
        inside = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), plain_math)
        pairs = F.zip_with(F.split(c, pattern, -1), inside, lambda text, formula: F.concat(text, F.coalesce(formula, F.lit(""))))
        c = F.array_join(pairs, "")
    return c


def without_references(c: Column) -> Column:
    """The lines before the first that begins a list of references; the text as it is without one."""
    lines = F.split(c, "\r?\n", -1)
    marks = F.transform(lines, lambda x: F.regexp_like(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(C.REFERENCE_LINE)))
    at = F.array_position(marks, True)
    return F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n")).otherwise(c)


def normal_answer(c: Column) -> Column:
    """An answer as it is shown: no references, plain formulas, no marks of citations, few empty lines."""
    c = T.drop_citations(normal_math(without_references(c)))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return T.strip(c)


def at_offset(ts: Column, hours: int = 8) -> Column:
    """A UTC timestamp as wall time of a fixed offset."""
    return ts + F.expr(f"INTERVAL {hours} HOURS")


def iso_offset(ts: Column, offset: str = "+08:00") -> Column:
    """ISO text of a wall time with its offset; empty for null."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset)), F.lit(""))


def cost(tokens: Column, price_per_thousand: Column) -> Column:
    return tokens / 1000 * price_per_thousand


def byte_range(header: Column, size: Column) -> Column:
    """Struct (start, end, status) of a Range header: first-last, first-, -suffix; 416 if it can't be met."""
    match = lambda i: F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i)
    first, last = match(1).try_cast("long"), match(2).try_cast("long")
    start = F.when(first.isNotNull(), first).otherwise(F.greatest(F.lit(0), size - last))
    end = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    good = F.regexp_like(header, F.lit(r"^bytes=(\d+-\d*|-\d+)$")) & (start <= end) & (start < size) & ~(first.isNull() & (last == 0))
    none = F.lit(None).cast("long")
    return F.when(header.isNull(), F.struct(F.lit(0).cast("long").alias("start"), (size - 1).alias("end"), F.lit(200).alias("status"))).when(
        good, F.struct(start.alias("start"), end.alias("end"), F.lit(206).alias("status"))
    ).otherwise(F.struct(none.alias("start"), none.alias("end"), F.lit(416).alias("status")))
