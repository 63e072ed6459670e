"""Writers of lists, rules, verdicts and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptyList(ValueError):
    """A list that would replace a good one is empty."""


def write_block_snapshot(hosts: DataFrame, path: str) -> None:
    """Sorted hosts as text; an empty list never overwrites one."""
    if hosts.limit(1).count() == 0:
        raise EmptyList(path)
    hosts.select("host").distinct().orderBy("host").write.mode("overwrite").text(path)


class ShortList(ValueError):
    """A list with so few entries that its source must be broken."""


def write_dnr_rules(rules: DataFrame, path: str, least: int = 500) -> None:
    """Ad rules (id, domains) as JSON lines of block rules for sub-resources; fewer than ``least`` domains overwrite nothing."""
    found = rules.agg(F.coalesce(F.sum(F.size("domains")), F.lit(0))).first()[0]
    if found < least:
        raise ShortList(f"{found} domains for {path}")
    kinds = ("script", "image", "xmlhttprequest", "sub_frame", "media", "font", "ping", "websocket", "other")
    condition = F.struct(F.col("domains").alias("requestDomains"), F.array(*map(F.lit, kinds)).alias("resourceTypes"))
    rules.select("id", F.lit(1).alias("priority"), F.struct(F.lit("block").alias("type")).alias("action"), condition.alias("condition")).write.mode("overwrite").json(path)


def write_verdicts(verdicts: DataFrame, path: str, at: str, dom: bool) -> None:
    """Verdicts (url, score, status) with their cache key and expiry: 15 minutes with a page, 2 without."""
    key = F.concat(F.lit("eval:"), "url", F.lit(":dom" if dom else ":url"))
    rows = verdicts.select(key.alias("key"), "url", "score", "status", F.col(at).alias("cached_at"))
    rows.withColumn("expires_at", F.col("cached_at") + F.expr(f"INTERVAL {15 if dom else 2} MINUTES")).write.mode("overwrite").parquet(path)


def write_model(spark: SparkSession, model: dict, path: str) -> None:
    """A fitted classifier as one JSON row, numbers rounded to four places."""
    row = [(round(float(model["bias"]), 4), {k: round(float(v), 4) for k, v in model["weights"].items()})]
    spark.createDataFrame(row, "bias double, weights map<string, double>").coalesce(1).write.mode("overwrite").json(path)
