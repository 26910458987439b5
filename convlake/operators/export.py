"""Export of stored history as native transcripts: selection, repair, lines and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import scalars as S
from convlake.sources.files import ARROW, scheme
from convlake.sources.transcripts import write_files
from convlake.work import discard

KEY = ["source_type", "session_id"]
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def selected(sessions: DataFrame, blocked: DataFrame, there: DataFrame) -> DataFrame:
    """Sessions to export: neither blocked by a pending ancestor nor at the target already."""
    return sessions.join(blocked.select(*KEY), KEY, "left_anti").join(there.select(*KEY), KEY, "left_anti")


def exportable(messages: DataFrame) -> DataFrame:
    """Messages without the lines that could not be parsed."""
    return messages.where(~F.col("event_type").eqNullSafe(F.lit("parse_error")))


def export_order(sessions: DataFrame) -> DataFrame:
    """Parents before children, then by creation and id."""
    return sessions.orderBy("depth", F.asc_nulls_last("created_at"), "session_id")


def summary(sessions: DataFrame, messages: DataFrame, there: DataFrame) -> DataFrame:
    """Restored sessions and messages, and how many sessions were skipped."""
    chosen = sessions.join(there.select(*KEY), KEY, "left_anti")
    counts = sessions.join(there.select(*KEY).withColumn("_there", F.lit(True)), KEY, "left").agg(F.count_if(F.col("_there").isNull()).alias("restored_sessions"), F.count_if(F.col("_there").isNotNull()).alias("skipped"))
    written = messages.join(chosen.select(*KEY), KEY, "left_semi").agg(F.count("*").alias("restored_messages"))
    return counts.join(F.broadcast(written))  # a row each


def remapped(sessions: DataFrame, project: str | None) -> DataFrame:
    """Sessions moved to ``project``, which makes them belong to one; None leaves them."""
    if project is None:
        return sessions
    return sessions.withColumns({"cwd": F.lit(project), "projectless": F.lit(False)})


def repaired_parents(messages: DataFrame) -> DataFrame:
    """uuid and parent of every claude message (uuid, parent_uuid in order of sequence_no).

    A valid uuid that is the first of its kind stays, any other is made from the session and place. The
    parent is what the source's parent became, if that was written before; else the previous message.
    """
    place = Window.partitionBy(*KEY).orderBy("sequence_no")
    first = F.row_number().over(Window.partitionBy(*KEY, "uuid").orderBy("sequence_no")) == 1
    made = S.name_uuid(F.concat_ws("\n", *KEY, F.col("sequence_no").cast("string")))
    rows = messages.withColumn("new_uuid", F.when(F.coalesce(F.col("uuid").rlike(UUID), F.lit(False)) & first, F.col("uuid")).otherwise(made))
    known = rows.where(F.col("uuid").isNotNull()).groupBy(*KEY, F.col("uuid").alias("parent_uuid")).agg(F.min_by("new_uuid", "sequence_no").alias("_parent"), F.min("sequence_no").alias("_at"))
    rows = rows.withColumn("_previous", F.lag("new_uuid").over(place)).join(known, [*KEY, "parent_uuid"], "left")
    return rows.withColumn("new_parent", F.when(F.col("_at") < F.col("sequence_no"), F.col("_parent")).otherwise(F.col("_previous"))).drop("_previous", "_parent", "_at")


def with_field(json: Column, name: str, value: Column) -> Column:
    """``json`` (an object as text) with a field of text at its end; the rest stays byte for byte."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    comma = F.when(json.rlike(r"^\s*\{\s*\}\s*$"), "").otherwise(",")
    return F.concat(F.regexp_replace(json, r"\s*\}\s*$", ""), comma, F.lit(f'"{name}":'), quoted, F.lit("}"))


def framed(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """``lines`` (position, ord, json) with a first line of session data (codex) or a last one with the title (claude)."""
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), "cwd").alias("payload")))
    title = F.to_json(F.struct(F.lit("custom-title").alias("type"), F.col("title").alias("customTitle"), F.col("session_id").alias("sessionId")))
    head = sessions.where("source_type = 'codex'").select(*KEY, F.lit(-1).cast("long").alias("position"), F.lit(0).alias("ord"), meta.alias("json"))
    tail = sessions.where("source_type = 'claude'").select(*KEY, F.lit((1 << 63) - 1).cast("long").alias("position"), F.lit(0).alias("ord"), title.alias("json"))
    return lines.select(*KEY, "position", "ord", "json").unionByName(head).unionByName(tail)


def boundary_mark(sessions: DataFrame) -> Column:
    """What marks the end of a restored session: its owner, its last commit and a digest of its cursor, if it has one."""
    digest = F.sha2(F.concat_ws(":", F.col("cursor_offset").cast("string"), "cursor_anchor"), 256) if {"cursor_offset", "cursor_anchor"} <= set(sessions.columns) else F.lit(None).cast("string")
    return F.concat_ws(":", *KEY, F.col("last_commit_id").cast("string"), digest)


def marked(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """``lines`` with a restore marker in each session's last one: a later scan goes on behind it."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("position"), F.desc("ord"))
    rows = lines.withColumn("_last", F.row_number().over(last) == 1).join(sessions.select(*KEY, boundary_mark(sessions).alias("_mark")), KEY, "left")
    return rows.withColumn("json", F.when(F.col("_last") & F.col("_mark").isNotNull(), with_field(F.col("json"), "_restore_boundary", F.col("_mark"))).otherwise(F.col("json"))).drop("_last", "_mark")


def restore_boundaries(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Where the last line with a session's own marker ends (``lines``: line, end_offset)."""
    found = lines.withColumn("_mark", F.get_json_object("line", "$._restore_boundary")).where(F.col("_mark").isNotNull())
    wanted = sessions.select(*KEY, boundary_mark(sessions).alias("_mark"))
    return found.select("_mark", "end_offset").join(wanted, "_mark").groupBy(*KEY).agg(F.max("end_offset").alias("resume_offset"))


def write_transcripts(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """One folder per session with its lines in order, in one file; names are safe for any store."""
    client, session = F.col("source_type"), S.safe_directory(F.col("session_id"))
    if scheme(path) in ARROW:
        discard(lines.sparkSession, path)
        file = F.concat(F.lit("client="), client, F.lit("/session="), session, F.lit("/part-00000.txt"))
        write_files(lines.select(file.alias("file"), "position", "ord", "json"), path, partitions)
        return
    named = lines.select(client.alias("client"), session.alias("session"), "position", "ord", "json")  # a store that only Spark opens
    dealt = named.repartition(partitions, "client", "session") if partitions else named.repartition("client", "session")
    dealt.sortWithinPartitions("client", "session", "position", "ord").select("client", "session", F.col("json").alias("value")).write.mode("overwrite").partitionBy("client", "session").text(path)


def restored_threads(sessions: DataFrame, previews: DataFrame) -> DataFrame:
    """The client's thread table for what was exported."""
    path = F.concat(F.lit("sessions/"), S.safe_directory(F.col("session_id")), F.lit(".jsonl"))
    return sessions.join(previews, KEY, "left").select(F.col("session_id").alias("id"), path.alias("rollout_path"), "title", "cwd", F.col("preview").alias("first_user_message"), "archived", F.unix_timestamp("created_at").alias("created_at"), F.unix_timestamp("updated_at").alias("updated_at"))
