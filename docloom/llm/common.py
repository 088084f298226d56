"""Shared pieces of the operators: shared folder, checked broadcast, tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that may be sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: Bytes of rows that go to a Python worker at once; a larger row goes alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors, read back as often as needed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path  # for forget()
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that no result reads any more."""
    for df in tables:
        path = getattr(df, "_docloom_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):  # the folder may be gone with the application
                p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bound_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """The same frame; texts of its session go to Python in batches of so many bytes at most, a setting of the session that is only ever lowered."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = int(conf.get(name).rstrip("b"))
    if not 0 < now <= most:
        conf.set(name, f"{most}b")
    return df


def _width(x: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(x.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(x, F.lit(0).cast("long"), lambda n, y: n + _width(y, kind.elementType))
        return F.coalesce(each, F.lit(0)) + 16
    return F.lit(8)


def small_side(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The frame with a broadcast hint if a sum over its rows proves it small enough; else as it is, for a sort-merge join."""
    row = sum((_width(df[f.name], f.dataType) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if max_bytes is None else max_bytes) else df.hint("merge")
