"""From raw lines to messages: what each client's events mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import scalars as S


def terminated(lines: DataFrame) -> DataFrame:
    """Lines that are complete; an unfinished tail is left for later."""
    return lines.where("line_terminated")


def text_at(line: Column, path: str) -> Column:
    return F.get_json_object(line, path)


def parsed(lines: DataFrame) -> DataFrame:
    """Complete, non-blank lines with ``malformed``: whether they are no JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("line"))
    rows = terminated(lines).where(~S.is_blank(F.col("line")))
    return rows.withColumn("malformed", ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)))


def cursors(lines: DataFrame) -> DataFrame:
    """How far each file is read: behind its last complete line, blank ones included."""
    return terminated(lines).groupBy("path").agg(F.max("end_offset").alias("cursor_offset"), F.max_by(S.line_anchor(F.col("line")), "end_offset").alias("cursor_anchor"))


def parse_errors(rows: DataFrame) -> DataFrame:
    """Malformed lines as messages of role ``unknown`` that keep the line."""
    content = F.to_json(F.struct(F.lit(True).alias("_parse_error"), F.col("line").alias("raw_line")))
    return rows.where("malformed").select("path", "start_offset", "end_offset", F.lit("unknown").alias("role"), F.lit("parse_error").alias("event_type"), content.alias("content_json"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("identity"))


def codex_class(line: Column) -> tuple[Column, Column]:
    """(role, event_type) of a codex event; both null for one that isn't kept."""
    kind, inner = text_at(line, "$.type"), text_at(line, "$.payload.type")
    item = kind == "response_item"
    said, called, answered = inner == "message", inner.endswith("_call"), inner.endswith("_call_output")
    drawn = (kind == "event_msg") & (inner == "image_generation_end")
    role = F.when(item & said, F.coalesce(S.first_non_blank(text_at(line, "$.payload.role")), F.lit("unknown"))).when(item & answered, "tool").when(item & called | drawn, "assistant")
    return role, F.when(role.isNotNull(), inner)


def session_ids(lines: DataFrame, source: str, known: DataFrame | None = None) -> DataFrame:
    """path and session_id of every transcript in ``lines``.

    Codex sessions are called by what is ``known`` of their path (path, session_id) from earlier reads, else by
    their session_meta, else by the file; claude sessions by the file.
    """
    paths = lines.select("path").distinct()
    if source == "claude":
        return paths.withColumn("session_id", file_stem(F.col("path")))
    found = paths.join(codex_sessions(lines).select("path", F.col("session_id").alias("_meta")), "path", "left")
    known = found.select("path", F.lit(None).cast("string").alias("_known")).limit(0) if known is None else known.select("path", F.col("session_id").alias("_known"))
    return found.join(known, "path", "left").select("path", F.coalesce("_known", "_meta", file_stem(F.col("path"))).alias("session_id"))


def codex_messages(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Messages of codex transcripts; duplicate projections and other events are dropped."""
    rows, line = parsed(lines), F.col("line")
    role, kind = codex_class(line)
    kept = rows.where("not malformed").select("path", "start_offset", "end_offset", role.alias("role"), kind.alias("event_type"), line.alias("content_json"), S.instant(text_at(line, "$.timestamp")).alias("created_at"), F.lit(None).cast("string").alias("identity"))
    found = kept.where(F.col("role").isNotNull()).unionByName(parse_errors(rows)).join(session_ids(lines, "codex", known), "path")
    return identified(found, "codex")


def codex_sessions(lines: DataFrame) -> DataFrame:
    """Id, cwd, time and kind of each transcript, from its first session_meta; the path says if it is archived."""
    line = F.col("line")
    meta = terminated(lines).where(text_at(line, "$.type") == "session_meta")
    fields = F.struct(S.first_non_blank(text_at(line, "$.payload.id"), text_at(line, "$.payload.session_id")).alias("session_id"), text_at(line, "$.payload.cwd").alias("cwd"), S.instant(text_at(line, "$.payload.timestamp")).alias("created_at"), text_at(line, "$.payload.source").alias("source"))
    first = meta.groupBy("path").agg(F.min_by(fields, "start_offset").alias("m"))
    return first.select("path", "m.*", F.col("path").contains("/archived_sessions/").alias("archived"))


def file_stem(path: Column) -> Column:
    """The file's name without what follows its last dot."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def of_session(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose event names no session, or the one that it is in."""
    return rows.where(S.is_blank(F.col(column)) | (F.col(column) == F.col("session_id")))


def claude_titles(lines: DataFrame) -> DataFrame:
    """The last title event of every claude transcript that has one: session_id and title."""
    line = F.col("line")
    kind = text_at(line, "$.type")
    text = F.when(kind == "custom-title", F.coalesce(text_at(line, "$.customTitle"), F.lit(""))).when(kind == "ai-title", S.first_non_blank(text_at(line, "$.aiTitle")))
    found = terminated(lines).select("path", "start_offset", text.alias("title")).where(F.col("title").isNotNull())
    return found.groupBy(file_stem(F.col("path")).alias("session_id")).agg(F.max_by("title", "start_offset").alias("title"))


def claude_messages(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Messages of claude transcripts; the session is the file's stem."""
    rows, line = parsed(lines).withColumn("session_id", file_stem(F.col("path"))), F.col("line")
    kind = text_at(line, "$.type")
    keep = kind.isin("user", "assistant", "attachment") | (kind == "system") & text_at(line, "$.message").isNotNull()
    good = of_session(rows.where("not malformed").withColumn("event_session", text_at(line, "$.sessionId")), "event_session").where(keep)
    role = F.coalesce(S.first_non_blank(text_at(line, "$.message.role")), kind)
    found = good.select("path", "start_offset", "end_offset", role.alias("role"), kind.alias("event_type"), line.alias("content_json"), S.client_time(text_at(line, "$.timestamp")).alias("created_at"), S.first_non_blank(text_at(line, "$.uuid")).alias("identity"))
    return identified(found.unionByName(parse_errors(rows)).withColumn("session_id", file_stem(F.col("path"))), "claude")


def identified(rows: DataFrame, source: str) -> DataFrame:
    """Rows as messages: owner, place and an id that every replay gives again."""
    place = F.col("start_offset")
    own = F.col("identity").isNotNull()
    identity = F.when(own, F.col("identity")).when(F.lit(source) == "claude", F.when(F.col("event_type") == "parse_error", F.col("session_id")).otherwise(F.col("path"))).otherwise(F.col("session_id"))
    return rows.select(
        S.message_id(F.lit(source), F.col("session_id"), identity, F.when(own, 0).otherwise(place), F.col("event_type")).alias("message_id"), F.lit(source).alias("source_type"), "session_id", place.alias("sequence_no"),
        "role", "event_type", "content_json", "created_at", "path", "end_offset",
    )


DIALECTS = {"codex": codex_messages, "claude": claude_messages}
