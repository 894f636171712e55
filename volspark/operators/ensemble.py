"""Combinations of component forecasts in the long form (keys, order, model, f)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import along, cum

Keys = Sequence[str]


def expanding_components(df: DataFrame, keys: Keys, order: str, r: str, ann: float = 252.0) -> DataFrame:
    """Adds rv and naive over all rows before each date."""
    f, c = cum(along(keys, order), 1), F.col(r)
    ok = F.count(c).over(f) >= 2
    return df.withColumns({"rv": F.when(ok, F.stddev_samp(c).over(f) * ann**0.5), "naive": F.when(ok, F.sqrt(F.avg(c * c).over(f) * ann))})


def equal_weight(df: DataFrame, keys: Keys, order: str, f: str) -> DataFrame:
    return df.groupBy(*keys, order).agg(F.avg(f).alias("ensemble"))


def inverse_loss_weights(df: DataFrame, keys: Keys, model: str, f: str, r: str, loss: str = "mse", ann: float = 252.0) -> DataFrame:
    """keys, model, w: inverse loss over its sum. A non-positive QLIKE gets weight zero."""
    v, y = F.col(f) * F.col(f) / ann, F.col(r) * F.col(r)
    per = F.pow(v - y, 2) if loss == "mse" else F.log(F.greatest(v, F.lit(1e-12))) + y / F.greatest(v, F.lit(1e-12))
    rows = df.where(F.col(f) > 0).groupBy(*keys, model).agg(F.avg(per).alias("__l"))
    raw = 1 / F.greatest(F.col("__l"), F.lit(1e-18)) if loss == "mse" else F.when(F.col("__l") > 0, 1 / F.col("__l")).otherwise(0.0)
    rows = rows.withColumn("__w", raw)
    total = rows.groupBy(*keys).agg(F.sum("__w").alias("__t"))
    return rows.join(total, list(keys)).select(*keys, model, F.when(F.col("__t") > 0, F.col("__w") / F.col("__t")).alias("w"))


def static_weighted(df: DataFrame, weights: DataFrame, keys: Keys, order: str, model: str, f: str) -> DataFrame:
    """A missing forecast counts as zero."""
    rows = df.join(weights, [*keys, model])
    return rows.groupBy(*keys, order).agg(F.sum(F.col("w") * F.coalesce(f, F.lit(0.0))).alias("ensemble"))


def regime_weighted(df: DataFrame, labels: DataFrame, table: DataFrame, keys: Keys, order: str, regime: str, model: str, f: str) -> DataFrame:
    """The weights of the date's regime, from a table of (regime, model, w)."""
    rows = df.join(labels.select(*keys, order, regime), [*keys, order]).join(table, [regime, model])
    return rows.groupBy(*keys, order).agg(F.sum(F.col("w") * F.coalesce(f, F.lit(0.0))).alias("ensemble"))


def blended(df: DataFrame, probs: DataFrame, table: DataFrame, keys: Keys, order: str, regime: str, model: str, f: str) -> DataFrame:
    """As regime_weighted, with each regime's weights times its probability (keys, order, regime, p), over their
    sum; a missing forecast adds nothing and its weight stays. Rows without a probability get no forecast."""
    rows = df.join(probs.where("p IS NOT NULL"), [*keys, order]).join(table, [regime, model])
    share = F.col("p") * F.col("w")
    total = F.sum(share)
    return rows.groupBy(*keys, order).agg((F.sum(share * F.coalesce(f, F.lit(0.0))) / F.when(total > 0, total).otherwise(1.0)).alias("ensemble"))


def embed(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Adds x, y: the first two principal components of median-imputed, standardized columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = [f"__{c}" for c in features]
    steps = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x"),
        StandardScaler(inputCol="__x", outputCol="__z", withMean=True), PCA(k=k, inputCol="__z", outputCol="__p"),
    ]
    out = Pipeline(stages=steps).fit(df).transform(df)
    p = vector_to_array("__p")
    return out.withColumns({"x": p[0], "y": p[1]}).select(*df.columns, "x", "y")
