"""Expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters, space first.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Text of ASCII alone takes the quick built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_of(df: DataFrame, name: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def in_portions(rows: Iterable[tuple], limit: int) -> Iterator[list[tuple]]:
    """Cut ``(key, text)`` rows into lists of about ``limit`` characters; a longer text comes alone and whole."""
    part, held = [], 0
    for row in rows:
        size = len(row[1])
        if part and held + size > limit:
            yield part
            part, held = [], 0
        part.append(row)
        held += size
    if part:
        yield part
