"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The inverted index is of the test items, which are few; the training passages are
the queries.  Items are cut into segments; a segment's scores are divided by its
score against itself, so one threshold fits all.  A document is read in windows
that overlap by half, wide enough to hold any segment.  A window whose terms'
upper bounds together stay below the threshold is dropped at once, and so is one
that can't reach it in any block of neighbouring segments; the others run block-max
WAND.  A question has segments of its own, so an item is also found where its answer
stands further away than a window.  Every item so retrieved is verified against the
whole document, by the part of its word shingles that occur there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import MARKS, U64, Words, grams, pieces, shingle_sets, small_batches, words
from quillspark.scratch import Scratch


@dataclass(frozen=True)
class DecontaminationParams:
    """``segment``: words of an item's segment; windows have twice as many. ``retrieve``:
    part of a segment's own score from which it is retrieved. ``block`` postings of a list have
    one maximum, and so have ``aligned`` neighbouring segments. ``shingle`` words and
    ``overlap``: what verifies. ``items``, and ``megabytes`` of their text: what one index holds,
    about; ``together``: indexes that are sent to tasks at once. Beyond these the passages are
    scanned again, so no number of items is too large for a task or the driver. Words are
    weighed over all items, so scores don't depend on any of the three."""

    segment: int = 48
    retrieve: float = 0.6
    shingle: int = 5
    overlap: float = 0.8
    aligned: int = 2
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    items: int = 20_000
    megabytes: int = 32
    together: int = 4


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, those before it the question; of one sentence both are it."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _cut(texts: list[str], p: DecontaminationParams) -> tuple[list[int], list[np.ndarray]]:
    """The item and the words of every segment: of the whole item, then of its question if an answer
    follows, so that segments that share words are neighbours."""
    owners, out = [], []
    split = [question_and_answer(t) for t in texts]
    questions = [q if q != t else None for (q, _), t in zip(split, texts)]
    found = [words(pa.array(parts, pa.string()), MARKS) for parts in (texts, questions)]
    for i in range(len(texts)):
        for k, of in enumerate(found):
            n = of.counts[i]
            if k and n < p.shingle:  # the whole item then stands and falls with its answer
                continue
            for part in np.array_split(of.hashes[of.ends[i] - n : of.ends[i]], max(1, -(-n // p.segment))):
                if len(part):
                    owners.append(i)
                    out.append(part)
    return owners, out


@dataclass(frozen=True)
class Statistics:
    """Of the segments of all items: their number and mean length, and of some words in how many they are."""

    n: int
    mean: float
    vocabulary: np.ndarray  # ascending
    df: np.ndarray


def weighed(texts: list[str], params: DecontaminationParams) -> Statistics:
    """Statistics of items that are all there are."""
    _, segments = _cut(texts, params)
    own, counts = np.unique(np.concatenate([np.zeros(0, U64), *map(np.unique, segments)]), return_counts=True)
    return Statistics(len(segments), sum(map(len, segments)) / max(1, len(segments)), own, counts)


class Index:
    """Impact-ordered postings with block maxima, and what verification needs.

    ``whole``: of all items, where these are a part of them."""

    def __init__(self, items: list[tuple[int, str]], params: DecontaminationParams, whole: Statistics | None = None):
        self.params, self.ids = params, [i for i, _ in items]
        plain = [t for _, t in items]
        self.statistics = whole or weighed(plain, params)
        split = [question_and_answer(t) for t in plain]
        self.whole = self._parts(words(pa.array(plain, pa.string()), MARKS))
        self.question, self.answer = (self._parts(words(pa.array([s[k] for s in split], pa.string()), MARKS)) for k in (0, 1))
        self.item_of, segments = _cut(plain, params)
        self.vocabulary = np.unique(np.concatenate(segments)) if segments else np.zeros(0, U64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> U64(44)).astype(np.int64)] = True
        self._weigh(segments)
        self.statistics = None  # not sent to tasks

    def _parts(self, found: Words) -> list[tuple[np.ndarray, int]]:
        """Of each text its distinct shingles and its number of words."""
        return list(zip(shingle_sets(found, self.params.shingle), found.counts.tolist()))

    def _weigh(self, segments: list[np.ndarray]) -> None:
        p, n = self.params, len(segments)
        lengths = np.array([len(s) for s in segments])
        rows, cols, freq = [], [], []
        for j, s in enumerate(segments):
            terms, counts = np.unique(np.searchsorted(self.vocabulary, s), return_counts=True)
            rows.append(terms), cols.append(np.full(len(terms), j)), freq.append(counts)
        terms, segs, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, freq))
        whole = self.statistics
        df = whole.df[np.searchsorted(whole.vocabulary, self.vocabulary)]
        idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
        impact = idf[terms] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * lengths[segs] / max(whole.mean, 1)))
        own = np.bincount(segs, weights=impact, minlength=n)
        impact = impact / np.maximum(own[segs], 1e-12)
        order = np.lexsort((segs, terms))
        cuts = np.searchsorted(terms[order], np.arange(len(self.vocabulary) + 1))
        self.most = np.zeros(len(self.vocabulary) + 1)
        np.maximum.at(self.most, terms, impact)
        # the same by blocks of neighbouring segments: a run of (block, maximum) for each term
        self.segment_of, self.impact, self.at = segs[order], impact[order], cuts
        place = terms[order] * (-(-max(1, n) // p.aligned)) + segs[order] // p.aligned
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        self.block_of = segs[order][first] // p.aligned
        self.block_most = np.maximum.reduceat(impact[order], first) if len(first) else np.zeros(0)
        self.block_at = np.searchsorted(terms[order][first], np.arange(len(self.vocabulary) + 1))

    def blocks(self, own: np.ndarray, least: float) -> np.ndarray:
        """Which blocks of segments could reach ``least`` with the distinct terms ``own``."""
        at = _runs(self.block_at[own], self.block_at[own + 1])
        return np.bincount(self.block_of[at], weights=self.block_most[at]) >= least if len(at) else np.zeros(0, bool)

    def within(self, own: np.ndarray, blocks: np.ndarray) -> list[tuple[list, list]]:
        """Postings (segments, impacts) of the distinct terms ``own`` in some blocks alone."""
        begin, end = self.at[own], self.at[own + 1]
        at = _runs(begin, end)
        block, term = self.segment_of[at] // self.params.aligned, np.repeat(np.arange(len(own)), end - begin)
        kept = np.flatnonzero(blocks[np.minimum(block, len(blocks) - 1)] & (block < len(blocks)))
        cut = np.flatnonzero(np.diff(term[kept])) + 1
        return [(self.segment_of[x].tolist(), self.impact[x].tolist()) for x in np.split(at[kept], cut) if len(x)]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each word, the last number for words that no item has."""
        out = np.full(len(hashes), len(self.vocabulary))
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.seen[(hashes >> U64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def retrieve(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments that reach ``least``: document-at-a-time block-max WAND over
        the query's distinct terms, in the blocks of segments that could reach it."""
        size, found, least = self.params.block, [], least - 1e-9
        blocks = self.blocks(terms, least)
        if not blocks.any():
            return []
        tops = lambda values: [max(values[k : k + size]) for k in range(0, len(values), size)]
        lists = [[ids, values, tops(values), max(values), 0] for ids, values in self.within(terms, blocks)]
        while lists:
            lists.sort(key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == target:
                pivot += 1
            most, after = 0.0, None  # maxima of the blocks that would hold the target
            for ids, _, maxima, _, at in lists[: pivot + 1]:
                k = at // size
                while (k + 1) * size < len(ids) and ids[(k + 1) * size - 1] < target:
                    k += 1
                most += maxima[k]
                edge = ids[min((k + 1) * size, len(ids)) - 1]
                after = edge if after is None else min(after, edge)
            if most >= least:
                goal = target + 1
                score = 0.0
                for x in lists[: pivot + 1]:
                    ids, at = x[0], x[4]
                    while at < len(ids) and ids[at] < target:
                        at += 1
                    if at < len(ids) and ids[at] == target:
                        score += x[1][at]
                    x[4] = at
                if score >= least:
                    found.append((target, score))
            else:  # no segment before the nearest block's end can reach it with these lists
                goal = max(after, target) + 1
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][4]])
                goal = max(goal, target + 1)
            for x in lists[: pivot + 1]:
                ids, at = x[0], x[4]
                while at < len(ids) and ids[at] < goal:
                    at += 1
                x[4] = at
            lists = [x for x in lists if x[4] < len(x[0])]
        return found


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begin`` up to its ``end``, one run after the other."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def _windows(ends: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, last word + 1) of windows of two halves, a half apart."""
    n = np.maximum(1, -(-counts // half) - 1)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = (ends - counts)[doc] + k * half
    return doc, begin, np.minimum(begin + 2 * half, ends[doc])


def search(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(row, item, best score, question, answer and whole overlap) of items retrieved for a text."""
    p, found = index.params, words(texts, MARKS)
    terms = index.terms(found.hashes)
    bound = np.concatenate([[0.0], np.cumsum(index.most[terms])])
    docs, begins, stops = _windows(found.ends, found.counts, p.segment)
    best: dict[tuple[int, int], float] = {}
    for w in np.flatnonzero(bound[stops] - bound[begins] >= p.retrieve - 1e-9):
        own = np.unique(terms[begins[w] : stops[w]])
        own = own[own < len(index.vocabulary)]
        for segment, score in index.retrieve(own, p.retrieve):
            key = int(docs[w]), index.item_of[segment]
            best[key] = max(score, best.get(key, 0.0))
    hashes, owner = grams(found, p.shingle)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    last, own = -1, None
    for (row, item), score in sorted(best.items()):
        if row != last:
            last, own = row, np.unique(hashes[cuts[row] : cuts[row + 1]])
        parts = (index.question[item], index.answer[item], index.whole[item])
        question, answer, whole = (_share(part, own, found, row, p.shingle) for part in parts)
        yield row, item, score, question, answer, whole


def _share(part: tuple[np.ndarray, int], own: np.ndarray, found: Words, row: int, size: int) -> float:
    """Part of the shingles that the document has; words too few for a shingle are looked for as they are."""
    shingles, n = part
    if not len(shingles):
        return 0.0
    if n < size:
        text = found.hashes[found.ends[row] - found.counts[row] : found.ends[row]]
        own = np.unique(grams(Words(text, np.array([len(text)]), None), n)[0])
    if not len(own):
        return 0.0
    return float((own[np.minimum(np.searchsorted(own, shingles), len(own) - 1)] == shingles).mean())


def matches(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap, leaked) of all
    items retrieved for a document of ``docs`` (doc_id, text).

    leaked: the overlap of the whole item is enough, or those of its question and
    its answer both are.  Null, empty and wordless texts retrieve nothing, and such
    items are never retrieved.  Items with the same id and other texts are each looked
    for, full repeats once; rows that repeat a doc_id are each judged.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "leaks")
    usable = items.select(F.col("item_id").cast("long"), "text").where("text is not null and item_id is not null").distinct()
    usable = scratch.save(usable, "items")
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size["n"] // params.items), -(-size["bytes"] // (params.megabytes * 1_000_000)))
    usable = usable.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    frequencies = scratch.save(_frequencies(usable, params), "words")
    total = frequencies.groupBy().agg(*(F.sum(F.when(F.col("word").isNull(), F.col(c)).otherwise(0)).alias(c) for c in ("n", "words"))).first()
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"

    def index(shard: int) -> Index:
        """One bounded part of the items, with the weights that its words have over all items."""
        rows = usable.where(F.col("shard") == shard)
        own = rows.orderBy("item_id", "text").collect()
        known = frequencies if shards == 1 else frequencies.join(_frequencies(rows, params).select("word").distinct(), "word", "left_semi")
        df = known.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        word = df["word"].to_numpy(np.int64).view(U64)
        order = np.argsort(word)
        whole = Statistics(total["n"] or 0, (total["words"] or 0) / max(1, total["n"] or 0), word[order], df["n"].to_numpy(np.int64)[order])
        return Index([(r["item_id"], r["text"]) for r in own], params, whole)

    found = None
    for first in range(0, shards, params.together):
        shared = [spark.sparkContext.broadcast(index(shard)) for shard in range(first, min(shards, first + params.together))]
        part = _asked(docs, shared, schema)
        if shards > params.together:  # written, so that these indexes can go before the next come
            part = scratch.save(part, "found")
            for one in shared:
                one.destroy()
        found = part if found is None else found.unionByName(part)
    enough = F.lit(params.overlap - 1e-9)
    both = (F.col("question_overlap") >= enough) & (F.col("answer_overlap") >= enough)
    found = found.withColumn("score", F.round("score", 9))  # sums in another order differ beyond
    return found.withColumn("leaked", (F.col("overlap") >= enough) | both)


def _frequencies(items: DataFrame, params: DecontaminationParams) -> DataFrame:
    """(word, n, words): in how many segments each word is; where the word is null, n segments have so many words."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, segments = _cut(frame["text"].tolist(), params)
            own, n = np.unique(np.concatenate([np.zeros(0, U64), *map(np.unique, segments)]), return_counts=True)
            yield pd.DataFrame({"word": pd.array(own.view(np.int64), "Int64"), "n": n, "words": 0})
            yield pd.DataFrame({"word": pd.array([None], "Int64"), "n": [len(segments)], "words": [sum(map(len, segments))]})

    rows = items.select("text").mapInPandas(count, "word long, n long, words long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def _asked(docs: DataFrame, shared: list, schema: str) -> DataFrame:
    """What all passages retrieve from the indexes, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, texts in pieces(batch.column(1)):
                for index in (s.value for s in shared):
                    if rows := list(search(texts, index)):
                        columns = list(zip(*rows))
                        own = ids.take(pa.array([start + r for r in columns[0]], pa.int64()))
                        item = pa.array([index.ids[i] for i in columns[1]], pa.int64())
                        yield pa.RecordBatch.from_arrays([own, item, *(pa.array(c, pa.float64()) for c in columns[2:])], names=[c.split()[0] for c in schema.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
