"""Log entries and metric points as JSON lines, laid out by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright import schemas


def by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.to_date("timestamp"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG_ENTRY).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRIC_POINT).json(path)


def write_logs(logs: DataFrame, path: str) -> None:
    by_day(logs).write.mode("append").partitionBy("dt").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    by_day(metrics).write.mode("append").partitionBy("dt").json(path)
