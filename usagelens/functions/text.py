"""Title, rating and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens.functions.numeric import to_double

# Every kind of Unicode space; Spark's trim() knows the plain blank only.
_SPACE = r"[\s\x1c-\x1f]"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def title_key(text: Column) -> Column:
    """Stripped lower-case title."""
    return F.lower(strip_space(text))


def clean_title(text: Column, strict: bool = False) -> Column:
    """Join key of a title: lower case, single spaces, no trade marks.

    `strict` keeps two quirks of the original rule: a space before a trade mark stays, and a missing
    title becomes the text `nan`.
    """
    if strict:
        text = F.coalesce(text, F.lit("nan"))
    squeezed = F.regexp_replace(title_key(text), rf"(?U){_SPACE}+", " ")
    plain = F.regexp_replace(squeezed, "[®™©]", "")
    return plain if strict else strip_space(plain)


def rating(text: Column) -> Column:
    """Score text as double: `tbd` and blanks are NULL, `85%` is 85, `7,5` is 7.5."""
    value = title_key(text.cast("string"))
    value = F.when(~value.isin("tbd", "nan", ""), value)
    return to_double(F.replace(F.replace(value, F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))


def year_in(text: Column) -> Column:
    """The first four digits in a row, as year; NULL when there are none."""
    return F.regexp_substr(text.cast("string"), F.lit(r"\d{4}")).try_cast("int")
