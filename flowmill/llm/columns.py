"""Column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def without(text: Column, characters: str) -> Column:
    """``text`` less every occurrence of the given characters."""
    return F.translate(text, characters, "")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))
