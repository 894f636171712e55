"""Series, panels and pair ledgers derived from the driver's star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll, std

ESTIMATORS, CONTROLLERS = ("rv20", "rv60", "naive20"), ("constant", "clip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str, asset: str = "p_type") -> DataFrame:
    """asset, d, close, volume: one row per asset and ship date."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(asset).alias("asset"))
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.groupBy("asset", F.to_date("l_shipdate").alias("d")).agg(
        F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume")
    )


def returns(spark: SparkSession, sf_dir: str, asset: str = "p_type") -> DataFrame:
    """px with r, the scaled log return."""
    w = along(["asset"], "d")
    return px(spark, sf_dir, asset).withColumn("r", 0.01 * F.log(F.col("close") / F.lag("close").over(w)))


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d (month start), y: a percent yield each month."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg((F.avg("l_tax") * 50).alias("y"))


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, vix: 100 times the 20-row vol of the equal-weight return, plus 5, every third date."""
    ew = returns(spark, sf_dir).groupBy("d").agg(F.avg("r").alias("r")).where("r IS NOT NULL")
    w = along([], "d")
    out = ew.select("d", (100 * std(F.col("r"), roll(w, 20), 20) * 252**0.5 + 5).alias("vix"), F.row_number().over(w).alias("n"))
    return out.where("n % 3 = 0 AND vix IS NOT NULL").select("d", "vix")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, d, open, high, low, close, rv, n_obs, coverage: daily bars of the event stream."""
    e = table(spark, sf_dir, "events").where("value > 0").select("event_type", "ts", "event_id", "value")
    w = along(["event_type"], ["ts", "event_id"])
    day = F.to_date("ts")
    e = e.withColumn("d", day).withColumn("lr", F.log(F.col("value") / F.lag("value").over(w)))
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("asset"), "d").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.sqrt(F.sum(F.col("lr") * F.col("lr"))).alias("rv"),
        F.count("*").alias("n_obs"), F.least(F.lit(1.0), F.count("*") / 24).alias("coverage"),
    )


def ledger(spark: SparkSession, sf_dir: str, target: float = 0.10, bps: float = 5.0) -> DataFrame:
    """asset, pair, d, r, vol, weight, turnover, cost, ret, equity over {rv20, rv60, naive20} x
    {constant, clip}. These controllers don't feed back, so the ledger is windows alone: the weight of
    a row earns the next row's return."""
    r = F.col("r")
    w = along(["asset"], "d")
    base = returns(spark, sf_dir).where("r IS NOT NULL")
    vols = base.select(
        "asset", "d", "r",
        F.map_from_arrays(
            F.array(*[F.lit(e) for e in ESTIMATORS]),
            F.array(
                std(r, roll(w, 20, 1), 20) * 252**0.5, std(r, roll(w, 60, 1), 60) * 252**0.5,
                F.when(F.count(r).over(roll(w, 20, 1)) >= 20, F.sqrt(F.avg(r * r).over(roll(w, 20, 1)) * 252)),
            ),
        ).alias("v"),
    )
    long = vols.select("asset", "d", "r", F.explode("v").alias("est", "vol"))
    long = long.withColumn("ctrl", F.explode(F.array(*[F.lit(c) for c in CONTROLLERS])))
    long = long.withColumn("pair", F.concat("est", F.lit("__"), "ctrl"))
    weight = F.when(F.col("ctrl") == "constant", F.lit(1.0)).when(F.col("vol") > 1e-12, F.least(target / F.col("vol"), F.lit(1.5))).otherwise(0.0)
    p = along(["asset", "pair"], "d")
    out = long.withColumn("weight", weight)
    out = out.withColumn("turnover", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(p), F.lit(0.0))))
    out = out.withColumn("cost", F.col("turnover") * (bps / 1e4))
    gain = F.lag(F.col("weight") * F.lit(1.0)).over(p) * r - F.lag("cost").over(p)
    out = out.withColumn("ret", F.coalesce(gain, F.lit(0.0)))
    return out.withColumn("equity", F.exp(F.sum("ret").over(cum(p)))).drop("est", "ctrl")
