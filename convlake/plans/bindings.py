"""The given tables as transcript tables: the same views for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import scalars as S

MESSAGES_SQL = """
messages_v AS (
  SELECT *, sha256(source_type || chr(10) || session_id || chr(10) || session_id || chr(10) || CAST(sequence_no AS VARCHAR) || chr(10) || event_type) AS message_id,
         created_at + to_seconds(30) AS ingested_at, sequence_no % 4 AS commit_id
  FROM (
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS source_type, CAST(conv_id AS VARCHAR) AS session_id, turn AS sequence_no, role,
           CASE WHEN conv_id % 2 = 0 THEN 'message' ELSE role END AS event_type, text,
           TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at
    FROM conversations
  ) m
)"""

SESSIONS_SQL = """
sessions_v AS (
  SELECT source_type, session_id, conv_id,
         left(trim(regexp_replace(arg_min(text, sequence_no) FILTER (WHERE role = 'user'), '\\s+', ' ', 'g')), 120) AS title,
         '/work/p' || CAST(conv_id % 7 AS VARCHAR) AS cwd, conv_id % 10 = 0 AS archived,
         CASE WHEN conv_id > 0 AND conv_id % 5 = 0 THEN CAST(conv_id // 4 AS VARCHAR) END AS parent_id,
         CASE WHEN conv_id % 6 = 0 THEN true WHEN conv_id % 6 = 1 THEN NULL ELSE false END AS projectless,
         conv_id % 4 AS last_commit_id, CASE WHEN conv_id % 11 = 0 THEN CAST(4 AS BIGINT) END AS pending_commit_id,
         min(created_at) AS created_at, max(created_at) AS last_message_at, max(created_at) AS updated_at, max(ingested_at) AS ingested_at
  FROM messages_v GROUP BY source_type, session_id, conv_id
)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages."""
    conv = read(spark, sf_dir, "conversations")
    codex = F.col("conv_id") % 2 == 0
    rows = conv.select(
        "conv_id", F.when(codex, "codex").otherwise("claude").alias("source_type"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("sequence_no"), "role",
        F.when(codex, F.lit("message")).otherwise(F.col("role")).alias("event_type"), "text",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
    )
    return rows.withColumns({
        "message_id": S.message_id(F.col("source_type"), F.col("session_id"), F.col("session_id"), F.col("sequence_no"), F.col("event_type")),
        "ingested_at": F.col("created_at") + F.expr("INTERVAL 30 SECONDS"),
        "commit_id": F.col("sequence_no") % 4,
    })


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, rolled up from its messages."""
    n = F.col("conv_id")
    rolled = messages(spark, sf_dir).groupBy("source_type", "session_id", "conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("sequence_no"))).alias("first_text"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("last_message_at"), F.max("ingested_at").alias("ingested_at"),
    )
    return rolled.select(
        "source_type", "session_id", "conv_id", S.title_from_text(F.col("first_text")).alias("title"),
        F.concat(F.lit("/work/p"), (n % 7).cast("string")).alias("cwd"), (n % 10 == 0).alias("archived"),
        F.when((n > 0) & (n % 5 == 0), F.floor(n / 4).cast("string")).alias("parent_id"),
        F.when(n % 6 == 0, True).when(n % 6 == 1, None).otherwise(False).alias("projectless"),
        (n % 4).alias("last_commit_id"), F.when(n % 11 == 0, F.lit(4).cast("long")).alias("pending_commit_id"),
        "created_at", "last_message_at", F.col("last_message_at").alias("updated_at"), "ingested_at",
    )


def seconds(*names: str) -> list:
    """Timestamps as whole seconds, to be compared as numbers."""
    return [F.unix_timestamp(F.col(n)).alias(n) for n in names]


def seconds_sql(*names: str) -> str:
    return ", ".join(f"CAST(epoch({n}) AS BIGINT) AS {n}" for n in names)


def with_views(body: str) -> str:
    """DuckDB SQL with both views in front of ``body`` (which may begin with more of them)."""
    head = "WITH RECURSIVE" if "RECURSIVE" in body else "WITH"
    body = body.replace("RECURSIVE", "").strip()
    if body.upper().startswith("SELECT"):
        return f"{head} {MESSAGES_SQL}, {SESSIONS_SQL}\n{body}"
    return f"{head} {MESSAGES_SQL}, {SESSIONS_SQL},\n{body}"
