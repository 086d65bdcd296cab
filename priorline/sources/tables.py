"""Lazy access to the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """``Tables(spark, dir).orders`` scans ``dir/orders.parquet``; nothing runs until an action."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.read(name)
        raise AttributeError(name)
