"""The driver's tables as views, and rendering of tables as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views over the Parquet tables of a folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names or NAMES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
