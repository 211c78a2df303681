"""Reading inputs, and places for intermediate tables, for this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import dropped, fresh, importable, maybe_broadcast, size_of, small, written

__all__ = ["dropped", "fresh", "maybe_broadcast", "size_of", "small", "written"]

TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
