"""Defences of incremental ingestion: replays, recovery and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from convlake.work import exists

KEY = ["source_type", "session_id"]


def not_replayed(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Messages that weren't written before, each once: ids are the same on every replay."""
    return rows.dropDuplicates(["message_id"]).join(written.select("message_id"), "message_id", "left_anti")


def recovery(sessions: DataFrame, read: DataFrame) -> DataFrame:
    """Pending sessions and whether what was ``read`` again (KEY, cursor_offset and maybe cursor_anchor) ends where their commit did."""
    anchor = F.col("cursor_anchor") if "cursor_anchor" in read.columns else F.lit(None).cast("string")
    got = read.select(*KEY, F.col("cursor_offset").alias("_read"), anchor.alias("_anchor"))
    ends = F.col("_read").eqNullSafe(F.col("pending_cursor.offset")) & F.coalesce(F.col("_anchor") == F.col("pending_cursor.anchor"), F.lit(True))
    return sessions.where("pending_commit_id is not null").join(got, KEY, "left").select(*KEY, "pending_commit_id", ends.alias("complete"))


class StatusTable(StreamingQueryListener):
    """A table below ``path`` of what each batch of each streaming query did, written through Spark as it happens.

    One folder for each query and batch, so a batch that is told of twice counts once; nothing is kept here.
    """

    ROWS = "query string, run string, batch_id long, rows long, seconds double, state string, said_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path.rstrip("/")

    def _say(self, query, run, batch: int, rows: int, seconds: float, state: str) -> None:
        row = self.spark.createDataFrame([(str(query), str(run), batch, rows, seconds, state)], "query string, run string, batch_id long, rows long, seconds double, state string")
        row.withColumn("said_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={query}/batch={batch if state == 'running' else f'{state}-{run}'}")

    def onQueryStarted(self, event) -> None:
        self._say(event.id, event.runId, -1, 0, 0.0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say(p.id, p.runId, p.batchId, p.numInputRows, p.batchDuration / 1000, "running")

    def onQueryIdle(self, event) -> None:
        """Nothing was done, so nothing is said."""

    def onQueryTerminated(self, event) -> None:
        self._say(event.id, event.runId, -1, 0, 0.0, "failed" if event.exception else "ended")

    def table(self) -> DataFrame:
        """The rows said so far."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.ROWS)
        return self.spark.read.schema(self.ROWS).option("recursiveFileLookup", "true").parquet(self.path)
