"""Views of the driver's tables as tiers, signals and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
DAY = "TIMESTAMP_NTZ '1992-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_id (a user), id, t in seconds, label, value."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {START}, ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.col("event_id").alias("id"), (micros / 1e6).alias("t"), F.col("event_type").alias("label"), F.col("value").alias("v"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event of a user to the next: bundle_id, id, start, end, label, v."""
    w = Window.partitionBy("bundle_id").orderBy("t", "id")
    return points(spark, sf_dir).select("bundle_id", "id", F.col("t").alias("start"), F.lead("t").over(w).alias("end"), "label", "v").filter("end > start")


def signal(spark: SparkSession, sf_dir: str, name: str = "x") -> DataFrame:
    return points(spark, sf_dir).select("bundle_id", F.lit(name).alias("signal"), "t", "v")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers of the users: their event intervals as "phones", and pairs of those as "words"."""
    iv = intervals(spark, sf_dir)
    w = Window.partitionBy("bundle_id").orderBy("start", "id")
    words = iv.withColumns({"_end": F.lead("end").over(w), "_k": F.row_number().over(w)}).filter("_k % 2 = 1 and _end is not null")
    return iv.select("bundle_id", F.lit("phones").alias("tier"), "id", "start", "end", "label").unionByName(words.select("bundle_id", F.lit("words").alias("tier"), "id", "start", F.col("_end").alias("end"), "label"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as day intervals of their order, which may overlap."""
    start = (F.expr(f"timestampdiff(DAY, {DAY}, l_shipdate)")).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").cast("long").alias("id"), start.alias("start"), (start + F.col("l_quantity")).alias("end"), F.col("l_returnflag").alias("label"))


# The same views for the SQL side.
SQL = """
p AS (SELECT user_id AS bundle_id, event_id AS id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6::DOUBLE AS t, event_type AS label, value AS v FROM events),
iv AS (SELECT * FROM (SELECT bundle_id, id, t AS s, lead(t) OVER (PARTITION BY bundle_id ORDER BY t, id) AS e, label, v FROM p) WHERE e > s),
wd AS (SELECT * FROM (SELECT bundle_id, id, s, lead(e) OVER (PARTITION BY bundle_id ORDER BY s, id) AS e, label, row_number() OVER (PARTITION BY bundle_id ORDER BY s, id) AS k FROM iv) WHERE k % 2 = 1 AND e IS NOT NULL),
sh AS (SELECT row_number() OVER () AS r, l_orderkey AS bundle_id, l_linenumber::BIGINT AS id, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::DOUBLE AS s, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::DOUBLE + l_quantity AS e, l_returnflag AS label FROM lineitem)
"""
