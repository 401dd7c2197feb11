"""The driver's tables as the engine's inputs. Only this module knows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.spec import MetricSpec
from turnloom.sources.tables import table

CATALOG = ("click", "error", "purchase", "signup", "view")
SPEC = MetricSpec(catalog=CATALOG)
ASYMMETRIC = MetricSpec(catalog=CATALOG, dhi_mode="asymmetric", shortage=(0.5, 0.5, 1, 1.5, 2, 2), excess=(2, 1.5, 1, 1, 0.5, 0.5))
LEGACY = MetricSpec(version="legacy-v1", weights=(0.5, 0.3, 0.2))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as turns: a term is half a month, a record a session of a student
    without a gap of eight hours."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.withColumn("term", F.concat(F.date_format("ts", "yyyy-MM"), F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b")))
    order = Window.partitionBy("term", "user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    e = e.withColumn("new", F.when(gap.isNull() | (gap > 8 * 3600 * 1_000_000), 1).otherwise(0))
    e = e.withColumn("session", F.sum("new").over(order))
    inner = Window.partitionBy("term", "user_id", "session").orderBy("ts", "event_id")
    level = F.when(F.col("event_type") != "error", (1 + (F.col("event_id") * 31 + F.col("user_id") * 17) % 6).cast("int"))
    return e.select(F.col("event_id").alias("turn_id"), "term", F.col("user_id").alias("student_key"), F.concat_ws("-", "term", "user_id", "session").alias("record_id"), F.row_number().over(inner).alias("turn_index"), F.col("event_type").alias("agent_id"), level.alias("level"))


#: The same in DuckDB, as common table expressions.
TURNS_SQL = """
  _e AS (SELECT event_id, ts, user_id, event_type, strftime(ts, '%Y-%m') || CASE WHEN day(ts) <= 15 THEN 'a' ELSE 'b' END AS term FROM events),
  _g AS (SELECT *, lag(ts) OVER (PARTITION BY term, user_id ORDER BY ts, event_id) AS before FROM _e),
  _s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 28800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY term, user_id ORDER BY ts, event_id) AS session FROM _g),
  turns AS (SELECT event_id AS turn_id, term, user_id AS student_key, term || '-' || user_id || '-' || session AS record_id,
              row_number() OVER (PARTITION BY term, user_id, session ORDER BY ts, event_id) AS turn_index, event_type AS agent_id,
              CASE WHEN event_type <> 'error' THEN CAST(1 + (event_id * 31 + user_id * 17) % 6 AS INTEGER) END AS level FROM _s)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as one text each, turns marked Q (user) and A (assistant)."""
    c = table(spark, sf_dir, "conversations")
    mark = F.when(F.col("role") == "user", "Q: ").when(F.col("role") == "assistant", "A: ").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, "text").alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x.line), "\n").alias("raw"))


TRANSCRIPTS_SQL = """
  transcripts AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Q: ' WHEN 'assistant' THEN 'A: ' ELSE '' END || text, chr(10) ORDER BY turn) AS raw,
                    count(*) AS n, count(*) FILTER (role = 'user') AS n_q, count(*) FILTER (role = 'assistant') AS n_a,
                    min(CASE WHEN role = 'system' THEN 0 ELSE 1 END) AS no_system, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
                    string_agg(CASE role WHEN 'user' THEN 'Q' WHEN 'assistant' THEN 'A' ELSE 'S' END, '' ORDER BY turn) AS signature
                  FROM conversations GROUP BY conv_id)"""


def panel(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """customers with their orders as a two-period panel."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_totalprice"))).alias("pre_score"), F.avg(F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_totalprice"))).alias("post_score"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    out = c.select(F.col("c_custkey").alias("student_key"), F.col("c_nationkey").alias("cluster_id"), (F.col("c_nationkey") % 2).alias("treated"), F.col("c_mktsegment").alias("stratum"), F.col("pre_score"), F.col("post_score"))
    return out.where("pre_score IS NOT NULL AND post_score IS NOT NULL") if complete else out


PANEL_SQL = """
  _o AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS pre_score, avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS post_score FROM orders GROUP BY 1),
  raw_panel AS (SELECT c_custkey AS student_key, c_nationkey AS cluster_id, c_nationkey % 2 AS treated, c_mktsegment AS stratum, pre_score, post_score FROM customer LEFT JOIN _o ON o_custkey = c_custkey),
  panel AS (SELECT * FROM raw_panel WHERE pre_score IS NOT NULL AND post_score IS NOT NULL)"""
