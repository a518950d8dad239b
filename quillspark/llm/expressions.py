"""Column expressions over whole texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends a word, in the order of its codes.
WHITE = "\t\n\x0b\x0c\r "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    """``text`` without any of ``characters``."""
    return F.translate(text, characters, "")


def count_of(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return F.length(text) - F.length(without(text, characters))


def ascii_words(text: Column) -> Column:
    """The maximal runs of characters that are not white space, as they stand."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def same_text(text: Column) -> Column:
    """32 bytes that stand for a text: its SHA-256."""
    return F.unhex(F.sha2(text, 256))
