"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parent.parent)
#: What a broadcast may hold: a fixed share of an executor's memory, whatever the input.
BROADCAST_BYTES = 48 << 20
_used: set[str] = set()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where it was put on sys.path by hand."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean(spark: SparkSession, base: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, base)
    except Exception:  # noqa: BLE001 - the session may have ended without us
        pass


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below the one that all executors share, spark.checkpoint.dir; it goes when Python ends.

    Where that is unset, a local session (as in tests) gets a folder of its own and anything else an error, since no
    machine's own folder would do there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base}/orrery-{spark.sparkContext.applicationId}"
    if own not in _used:
        _used.add(own)
        atexit.register(_clean, spark, own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    # Nothing reads this plan's shuffles once its rows are written.
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing still to run reads."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _bytes(x, inner)), F.lit(24).cast("long"))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, T.StructType):
        total = F.lit(16).cast("long")
        for f in kind.fields:
            total = total + _bytes(c[f.name], f.dataType)
        return total
    return F.lit(8).cast("long")


def size_of(df: DataFrame) -> int:
    """About how many bytes df's rows have in memory; it must be cheap to read, such as a written table."""
    total = F.lit(32).cast("long")
    for f in df.schema.fields:
        total = total + _bytes(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.sum(total)).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    return size_of(df) <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast only if its measured bytes allow it; beyond that Spark's own join strategy holds."""
    return F.broadcast(df) if small(df, most) else df
