"""Streaming queries over the event table, run to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import ticks as X
from .registry import query, rounded


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def ticks(s: SparkSession, d: str) -> DataFrame:
    # A pattern, so that a single file can be the source.
    e = X.read_ticks(s, f"{d}/event[s].parquet").where("value > 0")
    return e.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"))


@query("x1_stream_bars", """WITH b AS (SELECT event_type AS asset, CAST(ts AS DATE) AS start, arg_min(value, (ts, event_id)) AS open, MAX(value) AS high, MIN(value) AS low, arg_max(value, (ts, event_id)) AS close, COUNT(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2)
SELECT asset, start, ROUND(open, 6) AS open, ROUND(high, 6) AS high, ROUND(low, 6) AS low, ROUND(close, 6) AS close, n FROM b""")  # fmt: skip
def x1(s, d):
    """All windows, closed or not: complete state by batch updates, of which the last of a window counts."""
    where = _shared(s)
    X.run_to_table(X.bars(ticks(s, d)), f"{where}/out", f"{where}/log", "update")
    rows = s.read.parquet(f"{where}/out")
    last = rows.groupBy("asset", "start").agg(F.max_by(F.struct("open", "high", "low", "close", "n"), "batch").alias("b"))
    return rounded(last.select("asset", F.to_date("start").alias("start"), "b.*"), 6)


@query("x2_online_positions", """WITH RECURSIVE t AS (SELECT event_type AS asset, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0),
f AS (SELECT asset, i, n, price, NULL::DOUBLE AS v, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS weight FROM t WHERE i = 1 UNION ALL
SELECT asset, i, n, price, v, equity, peak, CASE WHEN v > 0 THEN LEAST(0.10 / SQRT(v * 252) * CASE WHEN 1 - equity / peak <= 0.10 THEN 1.0 ELSE GREATEST(0.0, 1 - LEAST(1.0, (1 - equity / peak - 0.10) / 0.20)) END, 1.5) ELSE weight END FROM (
SELECT asset, i, n, price, CASE WHEN v IS NULL THEN r * r ELSE POWER(0.5, 1 / 20.0) * v + (1 - POWER(0.5, 1 / 20.0)) * r * r END AS v, equity * EXP(weight * r) AS equity, GREATEST(peak, equity * EXP(weight * r)) AS peak, weight FROM (
SELECT t.asset, t.i, t.n, t.price, LN(t.price / f.price) AS r, f.v, f.equity, f.peak, f.weight FROM f JOIN t ON t.asset = f.asset AND t.i = f.i + 1)))
SELECT asset, n, ROUND(SQRT(v * 252), 6) + 0.0 AS vol, ROUND(1 - equity / peak, 6) + 0.0 AS drawdown, ROUND(weight, 6) + 0.0 AS weight, ROUND(equity, 6) + 0.0 AS equity FROM f WHERE i = n""")  # fmt: skip
def x2(s, d):
    where = _shared(s)
    X.run_to_table(X.online_positions(ticks(s, d)), f"{where}/out", f"{where}/log", "update")
    rows = s.read.parquet(f"{where}/out")
    last = rows.groupBy("asset").agg(F.max_by(F.struct("n", "vol", "drawdown", "weight", "equity"), "batch").alias("b"))
    return rounded(last.select("asset", "b.*"), 6)
