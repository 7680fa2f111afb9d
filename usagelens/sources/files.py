"""CSV in, CSV or tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from usagelens.functions.numeric import to_double
from usagelens.schema import ENCODINGS, RAW_INTERACTIONS
from usagelens.sources.records import first_record, read_records
from usagelens.sources.shaping import (cast_inferred_types, fields_of, normalize_column_names, pad_ragged_rows,
                                       sanitized_names)

_QUOTING = {"quote": '"', "escape": '"'}
BATCH_ROWS = 10_000


def scan_interactions(spark: SparkSession, path: str, text_ids: bool = False) -> DataFrame:
    """Headerless log: user, item, behaviour and hours, the constant fifth column dropped.

    Text that is no number gives NULL hours. Fewer than five columns is an error, and so are a missing path and a
    user id that is no integer, unless `text_ids` keeps ids as they are written.
    """
    width = len(spark.read.options(**_QUOTING).csv(path, header=False).columns)
    if width < len(RAW_INTERACTIONS):
        raise ValueError(f"expected {len(RAW_INTERACTIONS)} columns, found {width}: {path}")
    raw = spark.read.options(**_QUOTING).csv(path, schema=RAW_INTERACTIONS, header=False, mode="PERMISSIVE")
    number = F.col("user_id").try_cast("bigint")
    checked = F.when(number.isNull() & F.col("user_id").isNotNull(), F.raise_error(
        F.concat(F.lit("user id is no integer: "), "user_id")).cast("bigint")).otherwise(number)
    return raw.select("user_id" if text_ids else checked.alias("user_id"), "item", "behavior", to_double(F.col("hours")).alias("hours"))


def _table(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """CSV with a header as text columns, named by the first record; quoted fields may hold line breaks."""
    head = (first_record(spark, path, encoding) or "").removeprefix("\ufeff")
    named = spark.createDataFrame([(head,)], "value string").select(fields_of(F.col("value"))).first()[0]
    names = [name or f"_c{i}" for i, name in enumerate(named)]
    places = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = read_records(spark, path, header=True, encoding=encoding)
    return rows.select(F.from_csv("value", places.simpleString()[7:-1].replace(":", " "), _QUOTING).alias("r")).select(
        *[F.col("r")[f"c{i}"].alias(name) for i, name in enumerate(names)])


def scan_catalog(spark: SparkSession, path: str, keep: Sequence[str] = ("genre",)) -> DataFrame:
    """Catalogue with a header: the first column as title, plus the named ones. Fields may hold line breaks."""
    df = _table(spark, path)
    return df.select(F.col(f"`{df.columns[0]}`").alias("title"), *keep)


def read_lines(spark: SparkSession, path: str, header: bool = False, encoding: str = "utf-8") -> DataFrame:
    """Records of a text file, unsplit; `header` leaves out the first record of each file. Empty lines
    are no records."""
    # A record that holds the separator is whole in the column for malformed records only.
    read = spark.read.options(encoding=encoding, sep="\u0001", quote="", header=header, enforceSchema=True,
                              columnNameOfCorruptRecord="_whole").csv(path, schema="value string, _whole string")
    return read.select(F.coalesce("_whole", "value").alias("value"))


def read_ragged_csv(spark: SparkSession, path: str, header: bool = True, width: int | None = None) -> DataFrame:
    """Records of differing length as text columns by position, as wide as the longest record."""
    return pad_ragged_rows(read_records(spark, path, header).select("value"), width=width)


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header to a table with usable column names and the types its values allow."""
    df = _table(spark, path)
    return cast_inferred_types(df.toDF(*sanitized_names(df.columns)))


def _decodes(spark: SparkSession, path: str, encoding: str) -> bool:
    """False once any record holds the replacement mark the decoder leaves for bad bytes."""
    return read_lines(spark, path, encoding=encoding).where(F.contains("value", F.lit("\ufffd"))).isEmpty()


def read_csv_tolerant(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Catalogue of unknown encoding, with normalised column names.

    Takes the first encoding all bytes agree with. The first record names the columns, whether or not
    any expected name is among them, and all columns are text.
    """
    charset = {"utf-8-sig": "utf-8", "latin-1": "ISO-8859-1"}
    tried = list(dict.fromkeys(charset.get(e, e) for e in encodings))
    for encoding in tried:
        if encoding == "ISO-8859-1" or _decodes(spark, path, encoding):
            return normalize_column_names(_table(spark, path, encoding))
    raise ValueError(f"none of {tuple(encodings)} decodes {path}")


def write_report_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV as it stands: quotes doubled, spaces at either end of a value kept."""
    df.write.options(header=header, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                     **_QUOTING).mode("overwrite").csv(path)


def write_batches(df: DataFrame, path: str, rows_per_file: int = BATCH_ROWS) -> None:
    """Load a table in batches: no file holds more than `rows_per_file` rows (0: no limit)."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def save_typed_table(df: DataFrame, table: str, rows_per_file: int = BATCH_ROWS) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").saveAsTable(table)


def write_insights(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
