"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks.

Whether a line starts inside a quoted field depends on all lines before it. But a line can only keep that
state, turn it, or set it, whatever it was; so a split of a file is summed up as one such step, the few
steps of a file's splits are composed in order, and each split then knows in which state it begins.
A record belongs to the split in which it starts, wherever it ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A line, read from outside quotes, that ends inside: whole fields, then a quote without its counterpart.
_OPEN = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+|),)*+"(?:[^"]++|"")*+$'
_SPLIT = ["file", "start"]


def _steps(lines: DataFrame) -> DataFrame:
    """`turns`: the line turns the state; `sets`: the state it leaves whatever it was (NULL if it depends)."""
    after_open = F.concat(F.lit('"'), F.col("value")).rlike(_OPEN)
    after_closed = F.col("value").rlike(_OPEN)
    return lines.withColumn("turns", (after_closed & ~after_open).cast("int")).withColumn(
        "sets", F.when(after_open == after_closed, after_open.cast("int")))


def read_lines_in_place(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Lines with their file, the start of their split and a number that rises within it."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", r"\r$", "") if encoding == "utf-8" else F.regexp_replace(
        F.decode(F.col("value").cast("binary"), encoding), r"\r$", "")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("line"), value.alias("value"))


def read_records(spark: SparkSession, path: str, header: bool = False, encoding: str = "utf-8") -> DataFrame:
    """(file, start, line, value): one row per record of the files, without empty ones.

    Quotes count at the beginning of a field only, doubled ones within; line breaks inside quotes stay. `header`
    leaves out each file's first record. A file may be of any size: no task reads more than its split, a
    record's lines and one row per split. Splits come from the session's `spark.sql.files.maxPartitionBytes`.
    """
    lines = _steps(read_lines_in_place(spark, path, encoding))
    within = Window.partitionBy(*_SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = lines.withColumn("turned", F.sum("turns").over(within))
    # The state after a line is that of the last line that set it, turned once for every turn since.
    held = turned.withColumn("base", F.last((F.col("sets") + F.col("turned")) % 2, ignorenulls=True).over(within))
    after = held.withColumn("fixed", (F.col("base") + F.col("turned")) % 2)

    # One row per split: what it makes of either state.
    splits = after.groupBy(*_SPLIT).agg(F.max_by(F.struct("fixed", (F.col("turned") % 2).alias("turned")), "line").alias("s"))
    ordered = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.select(*_SPLIT, F.col("s.fixed").alias("sets"), F.when(F.col("s.fixed").isNull(), F.col("s.turned"))
                           .otherwise(0).alias("turns"))
    splits = splits.withColumn("turned", F.sum("turns").over(ordered)).withColumn(
        "base", F.last((F.col("sets") + F.col("turned")) % 2, ignorenulls=True).over(ordered))
    before = F.lag((F.coalesce("base", F.lit(0)) + F.col("turned")) % 2).over(Window.partitionBy("file").orderBy("start"))
    splits = splits.select(*_SPLIT, F.coalesce(before, F.lit(0)).alias("begins"))

    placed = after.join(splits, _SPLIT).withColumn("state", F.coalesce("fixed", (F.col("begins") + F.col("turned")) % 2))
    previous = F.lag("state").over(Window.partitionBy(*_SPLIT).orderBy("line"))
    placed = placed.withColumn("opens", F.coalesce(previous, F.col("begins")) == 0)
    placed = placed.withColumn("owner", F.last(F.when(F.col("opens"), F.col("line")), ignorenulls=True).over(within))
    # Lines before a split's first record belong to the last record that began in an earlier split.
    lasts = placed.groupBy(*_SPLIT).agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*_SPLIT, F.last(F.when(F.col("last").isNotNull(), F.struct("start", "last")), ignorenulls=True)
                         .over(earlier).alias("carried"))
    owned = placed.join(lasts, _SPLIT).select(
        "file", "start", "line", "value", F.when(F.col("owner").isNull(), F.col("carried.start")).otherwise(F.col("start")).alias("home"),
        F.coalesce("owner", "carried.last").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("start", "line", "value")))
    records = owned.groupBy("file", F.col("home").alias("start"), F.col("record").alias("line")).agg(
        F.array_join(F.transform(parts, lambda part: part["value"]), "\n").alias("value"))
    if header:
        heads = records.groupBy("file").agg(F.min(F.struct("start", "line")).alias("head"))
        records = records.join(heads, "file").where(F.struct("start", "line") != F.col("head")).drop("head")
    return records.where(F.col("value") != "")


def first_record(spark: SparkSession, path: str, encoding: str = "utf-8") -> str | None:
    """The first record of the first file, which names the columns."""
    row = read_records(spark, path, encoding=encoding).orderBy("file", "start", "line").select("value").first()
    return None if row is None else row["value"]
