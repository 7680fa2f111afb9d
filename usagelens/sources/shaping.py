"""Column names and column types of tables read as text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number patterns and the column types they stand for.
INTEGER_PATTERN = r"\A[+-]?\d+\z"
REAL_PATTERN = r"\A[+-]?(?:\d+\.\d*|\.\d+|\d+\.)\z"
SPARK_TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}


def normalized_name(name: str) -> str:
    """Lower case, blanks to `_`, `#` to `num`, `%` to `pct`, all else dropped."""
    joined = "_".join(str(name).lower().split())
    spelled = joined.replace("#", "num").replace("%", "pct")
    return "".join(ch for ch in spelled if ch == "_" or (ch.isascii() and ch.isalnum()))


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalized_name(c) for c in df.columns])


def sanitized_names(names: Sequence[str]) -> list[str]:
    """Names usable as SQL identifiers; repeats get `_2`, `_3` and so on."""
    used: Counter[str] = Counter()
    result = []
    for name in names:
        base = re.sub(r"\W+", "_", name).strip("_") or "col"
        if base[0].isdigit():
            base = f"_{base}"
        used[base] += 1
        result.append(base if used[base] == 1 else f"{base}_{used[base]}")
    return result


def sanitize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitized_names(df.columns))


def positional_names(n: int) -> list[str]:
    return [f"col{i}" for i in range(1, n + 1)]


def positional_table(df: DataFrame) -> DataFrame:
    """All columns as text, named by position."""
    return df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).toDF(
        *positional_names(len(df.columns)))


def _with_point(cell: Column) -> Column:
    """A single comma without any point is a decimal comma."""
    commas = F.length(cell) - F.length(F.replace(cell, F.lit(","), F.lit("")))
    lone = (commas == 1) & ~F.contains(cell, F.lit("."))
    return F.when(lone, F.replace(cell, F.lit(","), F.lit("."))).otherwise(cell)


def infer_column_types(df: DataFrame) -> DataFrame:
    """Type per column over all its values, in one pass. Blanks count for nothing."""
    def kind(name: str) -> Column:
        cell = _with_point(F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`")))
        whole = cell.rlike(INTEGER_PATTERN)
        number = whole | cell.rlike(REAL_PATTERN)
        return (F.when(~F.coalesce(F.bool_and(number), F.lit(True)), "TEXT")
                .when(~F.coalesce(F.bool_and(whole), F.lit(True)), "REAL")
                .otherwise("INTEGER"))

    return df.agg(*[kind(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "column_type")


def cast_inferred_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns to their inferred types, blanks to NULL.

    The types are one word per column; pass them in to skip the pass that finds them. An integer that
    does not fit 64 bits fails the job rather than turning into NULL.
    """
    if types is None:
        types = {row["column_name"]: row["column_type"] for row in infer_column_types(df).toLocalIterator()}

    def typed(name: str) -> Column:
        cell = F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`"))
        kind = types[name]
        return cell if kind == "TEXT" else _with_point(cell).cast(SPARK_TYPES[kind])

    return df.select(*[typed(c).alias(c) for c in df.columns])


def fields_of(line: Column) -> Column:
    """Fields of one CSV record; quotes may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    opened = F.transform(raw, lambda f: F.regexp_replace(f, r'\A"((?:[^"]|"")*)"', "$1"))
    return F.transform(opened, lambda f: F.replace(f, F.lit('""'), F.lit('"')))


def pad_ragged_rows(lines: DataFrame, line: str = "value", width: int | None = None) -> DataFrame:
    """CSV lines to `width` text columns: short records get blanks, long ones are cut.

    Without a width the longest record sets it, which takes one extra pass.
    """
    fields = lines.select(fields_of(F.col(line)).alias("f"))
    if width is None:
        width = fields.agg(F.max(F.size("f"))).first()[0] or 0
    return fields.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(name)
                           for i, name in enumerate(positional_names(width))])
