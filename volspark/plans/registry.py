"""Name -> query and oracle, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the panel, for the oracles.
PX = """px AS (SELECT p_type AS asset, CAST(l_shipdate AS DATE) AS d, AVG(l_extendedprice) AS close, SUM(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RET = PX + """, ret AS (SELECT *, 0.01 * LN(close / LAG(close) OVER (PARTITION BY asset ORDER BY d)) AS r FROM px)"""
R = RET + """, rr AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) AS rn FROM ret WHERE r IS NOT NULL)"""
EW = R + """, ew AS (SELECT d, AVG(r) AS r FROM rr GROUP BY d)"""
VIX = EW + """, vix AS (SELECT d, vix FROM (SELECT d, CASE WHEN COUNT(r) OVER w >= 20 THEN 100 * STDDEV_SAMP(r) OVER w * SQRT(252) + 5 END AS vix,
row_number() OVER (ORDER BY d) AS n FROM ew WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)) WHERE n % 3 = 0 AND vix IS NOT NULL)"""
RF = """rf AS (SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS d, AVG(l_tax) * 50 AS y FROM lineitem GROUP BY 1)"""
BARS = """ev AS (SELECT event_type AS asset, CAST(ts AS DATE) AS d, ts, event_id, value,
LN(value / LAG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS lr FROM events WHERE value > 0),
bars AS (SELECT asset, d, arg_min(value, (ts, event_id)) AS open, MAX(value) AS high, MIN(value) AS low, arg_max(value, (ts, event_id)) AS close,
SQRT(SUM(lr * lr)) AS rv, COUNT(*) AS n_obs, LEAST(1.0, COUNT(*) / 24) AS coverage FROM ev GROUP BY 1, 2)"""
LEDGER = R + """, vols AS (SELECT asset, d, r,
CASE WHEN COUNT(r) OVER w20 >= 20 THEN STDDEV_SAMP(r) OVER w20 * SQRT(252) END AS rv20,
CASE WHEN COUNT(r) OVER w60 >= 60 THEN STDDEV_SAMP(r) OVER w60 * SQRT(252) END AS rv60,
CASE WHEN COUNT(r) OVER w20 >= 20 THEN SQRT(AVG(r * r) OVER w20 * 252) END AS naive20 FROM rr
WINDOW w20 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
w60 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
l1 AS (SELECT asset, d, r, est, vol, ctrl, est || '__' || ctrl AS pair,
CASE WHEN ctrl = 'constant' THEN 1.0::DOUBLE WHEN vol > 1e-12 THEN LEAST(0.10 / vol, 1.5) ELSE 0.0 END AS weight
FROM (SELECT asset, d, r, 'rv20' AS est, rv20 AS vol FROM vols UNION ALL SELECT asset, d, r, 'rv60', rv60 FROM vols
UNION ALL SELECT asset, d, r, 'naive20', naive20 FROM vols), (VALUES ('constant'), ('clip')) AS c(ctrl)),
l2 AS (SELECT *, ABS(weight - COALESCE(LAG(weight) OVER p, 0)) AS turnover, ABS(weight - COALESCE(LAG(weight) OVER p, 0)) * 0.0005 AS cost
FROM l1 WINDOW p AS (PARTITION BY asset, pair ORDER BY d)),
l3 AS (SELECT *, COALESCE(LAG(weight) OVER p * r - LAG(cost) OVER p, 0) AS ret FROM l2 WINDOW p AS (PARTITION BY asset, pair ORDER BY d)),
ledger AS (SELECT asset, pair, d, r, vol, weight, turnover, cost, ret, EXP(SUM(ret) OVER p) AS equity FROM l3
WINDOW p AS (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 8, **own: int) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    cols: list[Column] = []
    for c, kind in df.dtypes:
        x = F.col(c)
        cols.append((F.round(x, own.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else x)
    return df.select(*cols)


def rsql(sql: str, *columns: str, digits: int = 8, keys: str = "") -> str:
    """SELECT keys and rounded columns from the last statement ``sql`` names ``q``."""
    cols = ", ".join(f"ROUND({c}, {digits}) + 0.0 AS {c}" for c in columns)
    return f"WITH {sql} SELECT {keys}{', ' if keys and cols else ''}{cols} FROM q"
