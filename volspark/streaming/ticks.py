"""Bars and online positions from a tick stream (asset, ts, price)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder or file pattern as a stream; the schema comes from a batch read of it."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bars(ticks: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """asset, start, open, high, low, close, sum_sq, n per window: one incremental aggregate, so state is
    a row per asset and open window; ticks later than ``late`` are dropped by the watermark."""
    at = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("asset", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"),
        )
        .select("asset", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
    )


STATE = "last double, variance double, equity double, peak double, weight double, n long"
OUT = "asset string, n long, vol double, drawdown double, weight double, equity double"


def online_positions(ticks: DataFrame, halflife: float = 20.0, target: float = 0.10, ann: float = 252.0, start: float = 0.10, full: float = 0.30) -> DataFrame:
    """Per asset and micro-batch: EWMA vol, drawdown of the own equity, and the braked weight.

    State is six numbers per asset; a batch's ticks are taken in time order, and all of an asset's ticks of a batch
    are held together for it (``files_per_trigger`` bounds a batch). A tick that comes in a later batch than ticks after
    it is folded in when it comes.
    """
    decay = 0.5 ** (1 / halflife)

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, var, equity, peak, weight, n = state.get if state.exists else (float("nan"), float("nan"), 1.0, 1.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "tick_id"])
        for price in rows["price"].to_numpy(float):
            if price > 0 and not math.isnan(last):
                r = math.log(price / last)
                equity *= math.exp(weight * r)
                peak = max(peak, equity)
                var = r * r if math.isnan(var) else decay * var + (1 - decay) * r * r
                dd = 1 - equity / peak
                brake = 1.0 if dd <= start else max(0.0, 1 - min(1.0, (dd - start) / (full - start)))
                if var > 0:
                    weight = min(target / math.sqrt(var * ann) * brake, 1.5)
            if price > 0:
                last = price
            n += 1
        state.update((last, var, equity, peak, weight, n))
        vol = math.sqrt(var * ann) if not math.isnan(var) else None
        yield pd.DataFrame([(key[0], n, vol, 1 - equity / peak, weight, equity)], columns=["asset", "n", "vol", "drawdown", "weight", "equity"])

    return ticks.groupBy("asset").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop. An ``update`` batch is written to a folder of its own id, which becomes the
    column ``batch``; if it is run again after a failure it replaces what it had written."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
    query.awaitTermination()
