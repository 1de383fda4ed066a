"""What the operators of this subpackage share: tables, shared scratch tables, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Java and Python (bytes) pattern of the words of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 2000  # rows of an Arrow batch at most: texts are long, and both sides hold a batch
BROADCAST_BYTES = 4 << 20  # measured bytes of a table that is broadcast whole, at most
HOT_ROWS, HOT_KEYS = 1_000, 1_000  # a key is hot beyond so many rows and beyond that share of all: so many keys at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where the setting is absent (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vellumlake-")
        sc.setCheckpointDir(root)
    return root


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/vellumlake/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellumlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of stored() that no result reads any more."""
    spark, path = df.sparkSession, getattr(df, "_vellumlake_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """fn over each Arrow batch. Workers find this package by the path it was loaded from."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pieces(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded bytes, so that decoded strings of very long rows don't pile up."""
    if batch.num_rows <= 1 or batch.nbytes <= most_bytes:
        yield batch
        return
    step = max(1, int(batch.num_rows * most_bytes / batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as it takes until none is a column's (in either case)."""
    have, front = {c.lower() for c in columns}, "_"
    while any((front + n).lower() in have for n in names):
        front += "_"
    return [front + n for n in names]


def _width(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + 16 + _width(kind.elementType, x)), F.lit(0).cast("bigint"))
        return F.coalesce(F.when(value.isNotNull(), F.size(value).cast("bigint") * 8), F.lit(0).cast("bigint"))
    if isinstance(kind, T.MapType):
        return _width(T.ArrayType(kind.keyType), F.map_keys(value)) + _width(T.ArrayType(kind.valueType), F.map_values(value))
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(8).cast("bigint"))
    return F.lit(8).cast("bigint")


def small(df: DataFrame, bound: int | None = None) -> bool:
    """Whether the measured bytes of df are at most the bound."""
    each = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(32).cast("bigint"))
    return (df.agg(F.sum(each)).first()[0] or 0) <= (BROADCAST_BYTES if bound is None else bound)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, *, count: str | None = None, how: str = "left", bound: int | None = None) -> DataFrame:
    """rows with the other columns of table, which has one row for each key; how: left or inner.

    A table of checked size is broadcast (bound=0: never, the plan is one at every size). Beyond it both sides are dealt by the keys, and neither absent nor hot
    keys meet in one task: rows with a null key and rows of hot keys take part under numbers of their own (by
    `spread`), which match nothing. The hot keys' rows of the table, at most HOT_KEYS by the column `count`, are
    broadcast instead."""
    if bound != 0 and small(table, bound):
        return rows.join(F.broadcast(table), keys, how)
    names = [c for c in table.columns if c not in keys]
    here, salt, there = fresh([*rows.columns, *table.columns], "hot", "salt", "cold")
    out, apart = rows, F.lit(False)
    for k in keys:
        apart = apart | F.col(f"`{k}`").isNull()
    if count:
        total = table.agg(F.sum(count)).first()[0] or 0
        hot = table.where(F.col(count) > max(HOT_ROWS, total // HOT_KEYS)).select(*keys, F.struct(*names).alias(here))
        out = rows.join(F.broadcast(hot), keys, "left")
        apart = apart | F.col(here).isNotNull()
    else:
        out = rows.withColumn(here, F.lit(None).cast(T.StructType([table.schema[c] for c in names])))
    out = out.withColumn(salt, F.when(apart, 1 + F.pmod(F.xxhash64(spread), F.lit(4093))).otherwise(F.lit(0).cast("bigint")))
    cold = table.select(*keys, F.struct(*names).alias(there), F.lit(0).cast("bigint").alias(salt))
    out = out.join(cold, [*keys, salt], "left").withColumn(here, F.coalesce(here, there))
    if how == "inner":
        out = out.where(F.col(here).isNotNull())
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"{here}.{c}").alias(c) for c in names))
