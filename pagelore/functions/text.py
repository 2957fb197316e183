"""Text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def collapsed(text: Column) -> Column:
    """White space, no-break spaces included, as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether text holds one of the phrases; they are literals."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the collapsed lower-case text; shorter texts have none."""
    # one pass: at each character a look ahead takes three; substring() would walk from the text's start for each of them
    return F.array_distinct(F.regexp_extract_all(F.lower(collapsed(text)), F.lit("(?s)(?=(...))."), 1))


def near_duplicate(a: Column, b: Column, containment: float = 0.9) -> Column:
    """Whether two trigram arrays share that part of the smaller one; empty ones match nothing."""
    least = F.least(F.size(a), F.size(b))
    return (least > 0) & (F.size(F.array_intersect(a, b)) >= containment * least)


@F.pandas_udf(T.StringType())
def unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded."""
    import html

    for part in parts:
        yield part.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def quoted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A label as Python writes a string literal."""
    for part in parts:
        yield part.map(repr, na_action="ignore")


@F.pandas_udf(T.StringType())
def compatible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form."""
    import unicodedata

    for part in parts:
        yield part.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")
