"""Whole texts as arrays of hashed words, many documents at a time.

Each function works on one Arrow string array inside a Spark task.  Words are
runs of bytes that are not separators, after A-Z are lower-cased; their 64-bit
hashes stand for them.  Two different words of ``n`` share a hash with a chance
of about ``n * n / 2 ** 65``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)

#: Bytes that end a word: ASCII white space.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: The same, and all other ASCII that is neither letter nor digit.
MARKS = SPACES.copy()
MARKS[:128] = [not chr(c).isalnum() for c in range(128)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some documents: ``hashes`` of all, ``ends[i]`` where document i ends."""

    __slots__ = ("hashes", "ends", "tails")

    def __init__(self, hashes: np.ndarray, ends: np.ndarray, tails: np.ndarray | None):
        self.hashes, self.ends, self.tails = hashes, ends, tails

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    @property
    def owner(self) -> np.ndarray:
        """For each word the index of its document."""
        return np.repeat(np.arange(len(self.ends)), self.counts)


def words(texts: pa.Array, separators: np.ndarray = SPACES, fold: bool = True, tail: int = 0) -> Words:
    """Hash the words of each text; null and empty texts have none.

    ``tail``: also hash the last so many bytes of each word.
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.null_count:  # a null's slot may hold bytes
        texts = pa.array(texts.fill_null(b""), pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]) if len(offsets) else 0, int(offsets[-1]) if len(offsets) else 0
    if last == first:
        none = np.zeros(0, U64)
        return Words(none, np.zeros(len(texts), np.int64), none if tail else None)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    bounds = offsets - first
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_here = bounds[:-1][bounds[:-1] < len(data)]
    begins[starts_here] = inside[starts_here]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, U64)
        return Words(none, np.zeros(len(texts), np.int64), none if tail else None)
    starts = np.flatnonzero(begins)
    index = np.cumsum(begins[at]) - 1
    place = at - starts[index]
    values = (_LOWER if fold else _SAME)[data[at]].astype(U64) + U64(1)
    heads = np.flatnonzero(place == 0)
    hashes = mix(np.add.reduceat(values * _powers(int(place.max()) + 1)[place], heads))
    ends = np.searchsorted(starts, bounds[1:], side="left")
    tails = None
    if tail:
        final = np.append(heads[1:], len(at)) - 1
        tails = np.zeros(len(heads), U64)
        length = final - heads + 1
        for k in range(tail):
            has = length > k
            tails[has] = tails[has] * U64(257) + values[final[has] - k]
        tails = mix(tails + U64(tail))
    return Words(hashes, ends, tails)


def pieces(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``most_bytes`` each, one text at least, with the first index."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def grams(found: Words, size: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of all runs of ``size`` words of one document, ``step`` apart."""
    owner, span = found.owner, (size - 1) * step
    if len(owner) <= span:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    good = np.flatnonzero(owner[: len(owner) - span] == owner[span:])
    total = np.zeros(len(good), U64)
    for k in range(size):
        total = total * _BASE + found.hashes[good + k * step]
    return mix(total + U64(size * 31 + step)), owner[good]


def shingle_sets(found: Words, size: int) -> list[np.ndarray]:
    """Per document its sorted distinct shingles; fewer words than ``size`` make one shingle."""
    hashes, owner = grams(found, size)
    cuts = np.searchsorted(owner, np.arange(len(found.ends) + 1))
    counts, out = found.counts, []
    for i, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        elif n:
            total = U64(0)
            part = found.hashes[found.ends[i] - n : found.ends[i]]
            with np.errstate(over="ignore"):
                for h in part:
                    total = total * _BASE + h
                out.append(mix(np.array([total + U64(n * 31 + 1)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def small_batches(rows: DataFrame, most: int = 2_000) -> DataFrame:
    """``rows`` as they are; Arrow batches of their session now hold ``most`` rows at most, since rows
    with whole texts are large, and a task holds several copies of a batch."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= most:
        conf.set(key, str(most))
    return rows


def unused(columns: list[str], name: str) -> str:
    """``name``, or with marks before it that no column has; names are compared without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
