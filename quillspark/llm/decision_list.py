"""Learned quality rules: ordered conjunctions of thresholds over a text's statistics.

Everything is columns and tables.  Statistics come from expressions over the whole text;
sequential covering then learns from counts alone: the statistics of labelled rows become
bins, equal rows one cell with its count, and each literal of a rule is chosen from one
grouped histogram of the cells that are left.  A rule grows on one share of the cells and is
pruned on the other.  The list that comes out is one ``CASE WHEN`` over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.expressions import ascii_words, count_of, let
from quillspark.scratch import Scratch

_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLACE = (1 << 31) - 1  # low bits of a sorted value: where a window begins


def repeated_words(w: Column, size: int = 5) -> Column:
    """Words of ``w`` inside windows of ``size`` words that occur twice or more, the first included.

    Hashes of windows are sorted with their places in the low bits, so windows that may be
    equal stand side by side; only those are then sorted and compared as text.  So the
    work is n log n and the count is exact, whatever the hashes.
    """
    alike = lambda s, at, key: lambda x, i: reduce(lambda a, b: a | b, (F.coalesce(key(x) == key(F.get(s, i + d)), F.lit(False)) for d in at))
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    packed = let(
        hashes,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))
        ),
    )
    upper = lambda x: F.shiftright(x, 31)
    maybe = let(F.sort_array(packed), lambda s: F.transform(F.filter(s, alike(s, (-1, 1), upper)), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")))
    texts = F.transform(maybe, lambda p: F.struct(F.array_join(F.slice(w, p + 1, size), " ").alias("text"), p.alias("at")))
    places = let(F.sort_array(texts), lambda s: F.array_sort(F.transform(F.filter(s, alike(s, (-1, 1), lambda x: x["text"])), lambda x: x["at"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda s, p: F.struct((s["n"] + p + size - F.greatest(s["end"], p)).alias("n"), (p + size).alias("end")), lambda s: s["n"])
    return F.when(F.size(w) >= size, covered).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of counts of a whole text, all long; a null text is empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for the rules
    n_chars, n_different (words), n_capitals and n_lines (with a word).
    """
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def counts(t: Column, w: Column, ls: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)),
            "n_symbols": count_of(t, _SYMBOLS),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": repeated_words(w),
            "n_chars": F.length(t),
            "n_different": F.size(F.array_distinct(w)),
            "n_capitals": count_of(t, _CAPITALS),
            "n_lines": F.size(ls),
        }
        return F.struct(*(c.cast("long").alias(name) for name, c in found.items()))

    return let(F.coalesce(text, F.lit("")), lambda t: let(ascii_words(t), lambda w: let(lines(t), lambda ls: counts(t, w, ls))))


def _per(top: str, below: str) -> Column:
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


#: What rules look at: ratios that don't depend on the length of the text, and its length.
MEASURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _per("word_chars", "n_words"),
    "symbols_per_word": lambda: _per("n_symbols", "n_words"),
    "repeated_share": lambda: _per("n_repeat_words", "n_words"),
    "different_share": lambda: _per("n_different", "n_words"),
    "repeated_lines": lambda: _per("n_dup_lines", "n_lines"),
    "capitals": lambda: _per("n_capitals", "n_chars"),
}


@dataclass(frozen=True)
class Literal:
    """``measure >= threshold``, or ``<`` where ``above`` is false."""

    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = MEASURES[self.measure]()
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class ListParams:
    """``levels``: quantiles that give a measure its thresholds, for all rows and for the rejected ones.
    ``literals`` of a rule and ``rules`` of the list at most. A rule is taken while it covers
    ``least`` rows that it rejects, and is right on ``purity`` of the rows kept for pruning."""

    levels: int = 20
    literals: int = 4
    rules: int = 12
    least: int = 5
    purity: float = 0.95
    seed: int = 29


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what no rule covers is kept, if ``default`` says so."""

    rules: tuple[tuple[Literal, ...], ...]
    default: bool = True

    def _cases(self, values: list, otherwise) -> Column:
        found = None
        for rule, value in zip(self.rules, values):
            test = reduce(lambda a, b: a & b, (x.column() for x in rule))
            found = F.when(test, F.lit(value)) if found is None else found.when(test, F.lit(value))
        return F.lit(otherwise) if found is None else found.otherwise(F.lit(otherwise))

    def verdict(self) -> Column:
        """Whether a row of statistics is kept."""
        return self._cases([False] * len(self.rules), self.default)

    def rule(self) -> Column:
        """The rule that decides, as text; ``default`` where none covers the row."""
        return self._cases([" and ".join(map(str, r)) for r in self.rules], "default")


def _thresholds(rated: DataFrame, p: ListParams) -> dict[str, list[float]]:
    """Quantiles of each measure; a few numbers each."""
    levels = [i / p.levels for i in range(1, p.levels)]
    cuts = [F.percentile_approx(F.when(rows, value()), levels, 1_000).alias(f"{name}_{k}") for name, value in MEASURES.items() for k, rows in enumerate((F.lit(True), F.col("label") == 0))]
    row = rated.agg(*cuts).first()
    return {name: sorted({x for k in (0, 1) for x in row[f"{name}_{k}"] or []}) for name in MEASURES}


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of ``cuts`` are at or below the measure."""
    return F.lit(0) if not cuts else F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= MEASURES[name]()))


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's gain of a literal that leaves p1 of p0 rows to reject and n1 of n0 to keep."""
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def _covers(rule: list[tuple[str, bool, int]]) -> Column:
    return reduce(lambda a, b: a & b, ((F.col(f) >= j if above else F.col(f) < j) for f, above, j in rule), F.lit(True))


def _counts(cells: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(rejected, kept) rows under each test, in one pass."""
    if not tests:
        return []
    of = lambda test, label: F.coalesce(F.sum(F.when(test & (F.col("label") == label), F.col("n"))), F.lit(0))
    row = cells.agg(*(of(t, label).alias(f"c{i}_{label}") for i, t in enumerate(tests) for label in (0, 1))).first()
    return [(row[f"c{i}_0"], row[f"c{i}_1"]) for i in range(len(tests))]


def _grown(cells: DataFrame, p: ListParams) -> list[tuple[str, bool, int]]:
    """Literals added while they raise the gain, each from one histogram by measure and bin."""
    rule: list[tuple[str, bool, int]] = []
    while len(rule) < p.literals:
        left = cells.where(_covers(rule))
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in MEASURES))).alias("x")
        table = left.select("label", "n", pairs).groupBy("x.f", "x.b").agg(*(F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"y{y}") for y in (0, 1)))
        bins: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in MEASURES}
        for r in table.collect():  # measures times thresholds
            bins[r["f"]][r["b"]] = (r["y0"], r["y1"])
        p0, n0 = (sum(v[k] for v in bins["words"].values()) for k in (0, 1))
        if not p0 or not n0:
            break
        found = []
        for f in MEASURES:
            low_p = low_n = 0
            for j in sorted(bins[f])[1:]:
                low_p, low_n = (sum(v[k] for b, v in bins[f].items() if b < j) for k in (0, 1))
                found += [(_gain(p0, n0, p0 - low_p, n0 - low_n), p0 - low_p, f, True, j), (_gain(p0, n0, low_p, low_n), low_p, f, False, j)]
        best = max(found, key=lambda x: (x[0], x[1], x[2], x[3], -x[4]), default=None)
        if best is None or best[0] <= 1e-9 or best[1] < p.least:
            break
        rule.append(best[2:])
    return rule


def learn(rated: DataFrame, params: ListParams = ListParams()) -> DecisionList:
    """The list for rows of :func:`statistics` with ``doc_id`` and ``label`` (0 rejected, 1 kept; others teach nothing).

    Rows of one doc_id stay on one side of the split. Without rows of both labels the list is empty.
    """
    p, scratch = params, Scratch(rated.sparkSession, "rules")
    rated = scratch.save(rated.where(F.col("label").isin(0, 1)), "rated")
    cuts = _thresholds(rated, p)
    side = (F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(3)) == 0).alias("prune")
    cells = rated.select("label", side, *(_bin(f, cuts[f]).alias(f) for f in MEASURES)).groupBy("label", "prune", *MEASURES).agg(F.count("*").alias("n"))
    cells = scratch.save(cells, "cells")
    rules: list[list[tuple[str, bool, int]]] = []
    while len(rules) < p.rules:
        left = cells.where(reduce(lambda a, b: a & b, (~_covers(r) for r in rules), F.lit(True)))
        rule = _grown(left.where(~F.col("prune")), p)
        if not rule:
            break
        held = _counts(left.where("prune"), [_covers(rule[:k]) for k in range(1, len(rule) + 1)])
        worth = [(gone - lost) / max(1, gone + lost) for gone, lost in held]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        gone, lost = held[k]
        if gone < p.least or gone < p.purity * (gone + lost):
            break
        rules.append(rule[: k + 1])
    gone, stay = _counts(cells, [reduce(lambda a, b: a & b, (~_covers(r) for r in rules), F.lit(True))])[0]
    scratch.drop(rated, cells)
    # a bin of j or more is a value of the j-th cut or more
    named = tuple(tuple(Literal(f, above, cuts[f][j - 1]) for f, above, j in r) for r in rules)
    return DecisionList(named, stay >= gone)
