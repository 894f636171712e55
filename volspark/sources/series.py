"""Scans with column aliases, and sinks of ledgers, manifests and logs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, pair_parts, vol_regime
from ..functions.frames import along, ffill

#: Standard name -> spellings, the first present wins, case ignored.
ALIASES: dict[str, list[str]] = {
    "date": ["date", "datetime", "ts_event", "time", "timestamp", "index"],
    "symbol": ["symbol", "ticker"],
    "close": ["close", "adj_close", "price", "close_adj"],
    "volume": ["volume"],
    "returns": ["returns", "ret", "return", "log_return"],
}


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], need: Sequence[str] = ()) -> DataFrame:
    """Columns renamed to their standard names; other columns go, a needed one that lacks raises."""
    have = {c.lower(): c for c in df.columns}
    found = {}
    for std, names in aliases.items():
        hit = next((have[n.lower()] for n in names if n.lower() in have), None)
        if hit is not None:
            found[std] = hit
    if missing := [n for n in need if n not in found]:
        raise ValueError(f"no column for {missing} among {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(s) for s, c in found.items()])


def read_parquet_series(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """date, and the numeric columns as doubles (bad values null), between two dates; the filter is on
    the stored column, so it reaches the scan."""
    raw = spark.read.parquet(path)
    name = next(c for a in aliases["date"] for c in raw.columns if c.lower() == a)
    if start:
        raw = raw.where(F.col(name) >= F.lit(start).cast(raw.schema[name].dataType))
    if end:
        raw = raw.where(F.col(name) < F.date_add(F.lit(end).cast("date"), 1).cast(raw.schema[name].dataType))
    df = resolve_columns(raw, aliases, ["date"])
    return df.select(F.to_date("date").alias("date"), *[F.col(c) if c == "symbol" else finite(F.col(c)).alias(c) for c in df.columns if c != "date"])


def read_csv_series(spark: SparkSession, path: str, symbol: str | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Rows with parsable dates, numbers as doubles; all columns are read as text, so nothing is inferred."""
    df = resolve_columns(spark.read.csv(path, header=True), aliases, ["date"])
    ts = F.try_to_timestamp(F.col("date"))
    df = df.withColumn("ts", ts).where("ts IS NOT NULL").withColumn("date", F.to_date("ts"))
    df = df.withColumns({c: finite(F.col(c)) for c in df.columns if c not in ("date", "ts", "symbol")})
    return df.where(F.col("symbol") == symbol) if symbol and "symbol" in df.columns else df


def daily_close(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last non-null close of each calendar day."""
    return df.groupBy(*keys, "date").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"))


def strategy_dataset(df: DataFrame, keys: Sequence[str], order: str, price: str, q: float = 0.001) -> DataFrame:
    """Adds returns (log of simple) and returns_clean (clipped to the series' q and 1 - q quantiles)."""
    prev = F.lag(price).over(along(keys, order))
    rows = df.withColumn("returns", F.when(prev > 0, F.log1p(F.col(price) / prev - 1)))
    cut = rows.groupBy(*keys).agg(F.percentile("returns", q).alias("__lo"), F.percentile("returns", 1 - q).alias("__hi"))
    rows = rows.join(cut, list(keys))
    return rows.withColumn("returns_clean", clip(F.col("returns"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def daily_risk_free(df: DataFrame, order: str, yields: str, ann: float = 252.0) -> DataFrame:
    """Adds rf: ln(1 + percent / 100 / ann) of the yield filled forward."""
    y = ffill(F.col(yields), along([], order))
    return df.withColumn("rf", F.log1p(y / 100 / ann))


def read_ledgers(spark: SparkSession, path: str, pairs: Sequence[str] | None = None) -> DataFrame:
    """A ledger folder partitioned by pair; a pair list prunes partitions."""
    df = spark.read.parquet(path)
    if pairs is not None:
        df = df.where(F.col("pair").isin(*pairs))
    est, ctrl = pair_parts(F.col("pair"))
    return df.withColumns({"estimator": est, "controller": ctrl})


def manifest_ok(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    return ledger.join(manifest.where("status = 'ok'").select(F.col("name").alias("pair")), "pair", "left_semi")


def normalize_ledger(df: DataFrame) -> DataFrame:
    """returns and equity from whichever of the spellings are present, the with-rf one first."""
    for std, names in (("returns", ("returns", "returns_with_rf", "returns_no_rf")), ("equity", ("equity", "equity_curve_with_rf", "equity_curve_no_rf"))):
        have = [F.col(n) for n in names if n in df.columns]
        if have:
            df = df.withColumn(std, F.coalesce(*have))
    return df


def suitability(df: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """key, regime (canonical), score; rows of unknown regimes or scores go."""
    out = df.select(F.trim(key).alias(key), vol_regime(F.col("regime")).alias("regime"), (finite(F.col("suitability_score")) * scale).alias("score"))
    return out.where("regime IS NOT NULL AND score IS NOT NULL")


def regime_series(df: DataFrame, label: str, allowed: Sequence[str]) -> DataFrame:
    """date, regime of valid labels, the last record of a date winning."""
    x = F.lower(F.trim(F.col(label)))
    rows = df.select(F.to_date("date").alias("date"), x.alias("regime"), "prediction_date").where(x.isin(*allowed))
    return rows.groupBy("date").agg(F.max_by("regime", "prediction_date").alias("regime"))


def write_ledger(df: DataFrame, path: str) -> None:
    """One folder per pair; only the partitions present are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def missing_pairs(universe: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs of the universe that the ledger lacks: what a resumed run has to make."""
    return universe.join(ledger.select("pair").distinct(), "pair", "left_anti")


def first_column(df: DataFrame, candidates: Sequence[str], name: str) -> DataFrame | None:
    """``df`` with its first column among ``candidates`` (in any case) as the double ``name``; None if it has none."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    return None if found is None else df.withColumn(name, F.col(f"`{found}`").cast("double"))


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written under the folder that driver and executors share (``spark.checkpoint.dir``) and read back: what
    several branches of a plan read is made once. Without that folder the table is only kept by the executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.persist()
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
