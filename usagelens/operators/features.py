"""Scaling of item features, and vectors for the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from usagelens.functions import ordered
from usagelens.functions.frames import stacked
from usagelens.functions.numeric import ratio
from usagelens.session import materialize

ITEM_FEATURES = ("num_players", "avg_hours", "total_hours")


def zscore_features(features: DataFrame, columns: Sequence[str] = ITEM_FEATURES) -> DataFrame:
    """Features less their mean, over their population deviation; a constant feature becomes 0."""
    features = materialize(features)
    moments = features.agg(F.struct(*[F.avg(c).alias(f"{c}_mean") for c in columns],
                                    *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])).scalar()
    return features.select("item", *[
        F.coalesce(ratio(F.col(c) - moments[f"{c}_mean"], moments[f"{c}_std"]), F.lit(0.0)).alias(c)
        for c in columns])


def robust_scaled_features(features: DataFrame, columns: Sequence[str] = ITEM_FEATURES) -> DataFrame:
    """log1p of the features, less the median, over the distance of the exact quartiles."""
    logs = materialize(features.select("item", *[F.log1p(F.col(c).cast("double")).alias(c) for c in columns]))
    quartiles = ordered.percentiles(stacked(logs, columns), ["metric"], "value", ordered.QUARTILES)

    def of(metric: str, statistic: Column) -> Column:
        return F.max(F.when(F.col("metric") == metric, statistic))

    spread = F.col("q75") - F.col("q25")
    scale = quartiles.agg(F.struct(
        *[of(c, F.col("q50")).alias(f"{c}_mid") for c in columns],
        *[of(c, F.when(spread == 0, 1.0).otherwise(spread)).alias(f"{c}_spread") for c in columns])).scalar()
    return logs.select("item", *[((F.col(c) - scale[f"{c}_mid"]) / scale[f"{c}_spread"]).alias(c)
                                 for c in columns])


def centered(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = features.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    return features.select(*[(F.col(c) - means[c]).alias(c) if c in columns else F.col(c)
                             for c in features.columns])


def assembled(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(features)


def sparse_vectors(entries: DataFrame, key: str, code: str, value: str, size: Column) -> DataFrame:
    """Entries (key, code, value) to one sparse vector per key; a key may have no non-zero entry.

    The parser builds the vector type from its fields, so no Python worker is involved.
    """
    cell = F.when(F.col(value) != 0, F.struct(F.col(code).cast("int").alias("i"), F.col(value).alias("v")))
    cells = entries.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    fields = F.struct(F.lit(0).alias("type"), size.cast("int").alias("size"),
                      F.col("cells.i").alias("indices"), F.col("cells.v").alias("values"))
    schema = StructType([StructField("features", VectorUDT())])
    parsed = F.from_json(F.to_json(F.struct(fields.alias("features"))), schema)
    return cells.select(key, parsed["features"].alias("features"))
