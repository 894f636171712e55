"""Shared helpers: written tables in the cluster's shared folder, and bounded Arrow slices."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset and driver and executors
    are one process (master ``local``) a temporary folder is made, one for each application. On a
    cluster executors would not see such a folder, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own[app]
    return base.rstrip("/")


_own: dict[str, str] = {}


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends in a table
    that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has ``most`` rows or fewer;
    beyond, Spark joins it by a shuffle. The result is the same."""
    return F.broadcast(table) if table.count() <= most else table


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts as bytes or None) runs of a batch, each of about ``max_bytes``; a longer text
    comes whole in a run of its own. One run at a time is taken out of the batch."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(col).to_pylist(), 1):
        size += n or 0
        if size >= max_bytes or i == len(col):
            yield first, col.slice(first, i - first).to_pylist()
            first, size = i, 0


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def has_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in this order: others, whatever their names, take no part."""
    return df.select(*quoted(*names))


def quoted(*names: str) -> list[Column]:
    """The columns of these very names, whatever dots or backticks they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
