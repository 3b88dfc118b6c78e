"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate`` and does the same wherever no other character has
    another lower-case form; the pattern also holds the letters that change without being in Lu.
    """
    other = text.rlike(r"[^\x00-\x7F&&[\p{Lu}\p{Lt}Ⅰ-ⅯⒶ-Ⓩ]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that no name of theirs can clash with one that a filter adds."""
    return F.struct(*[F.col(_quoted(c)) for c in docs.columns])


def from_row(rows: DataFrame, docs: DataFrame, name: str = "row") -> DataFrame:
    """The columns of ``docs`` again, from the column that ``as_row`` made."""
    return rows.select(*[F.col(name).getField(c).alias(c) for c in docs.columns])
