"""Sources of evaluation data: contract labels (S14) and observed call traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "producers array<struct<service:string,impl_symbol:string,impl_file:string,lang:string,rpcs:array<string>>>, consumers array<struct<consumer:string,service:string,rpc:string>>"
TRACE = "caller_file string, caller_qualname string, callee_file string, callee_qualname string, n long"


def producer_labels(spark: SparkSession, path: str) -> DataFrame:
    """(entity, contract): labelled implementations, one row for each rpc."""
    rows = spark.read.schema(LABELS).option("multiLine", True).json(path).select(F.explode("producers").alias("p"))
    return rows.select(F.col("p.impl_symbol").alias("entity"), F.explode("p.rpcs").alias("rpc"), "p.service").select("entity", F.concat(F.lit("contract::"), "service", F.lit("."), "rpc").alias("contract"))


def consumer_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LABELS).option("multiLine", True).json(path).select(F.explode("consumers").alias("c"))
    return rows.select(F.col("c.consumer").alias("entity"), F.concat(F.lit("contract::"), "c.service", F.lit("."), "c.rpc").alias("contract"))


def trace(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, n): observed calls with graph ids."""
    rows = spark.read.schema(TRACE).json(path)
    return rows.groupBy(F.concat_ws(":", "caller_file", "caller_qualname").alias("src"), F.concat_ws(":", "callee_file", "callee_qualname").alias("dst")).agg(F.sum("n").alias("n"))
