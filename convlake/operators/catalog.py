"""The read side: filters, searches, orders, pages, overlays and overviews of sessions and messages."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.scalars import strip

ROLES = ("user", "assistant", "system", "tool", "developer")
SESSION_KEY = ("source_type", "session_id")
MESSAGE_KEY = ("source_type", "session_id", "message_id", "sequence_no")


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that agree with every given value; texts are trimmed, None and blanks ask for nothing."""
    for name, value in wanted.items():
        value = value.strip() if isinstance(value, str) else value
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def list_of_sessions(sessions: DataFrame, source: str | None = None, archived: bool | None = None) -> DataFrame:
    """Sessions of people: those that belong to another session are never listed."""
    return matching(sessions.where(F.col("subagent_source_json").isNull()), source_type=source, archived=archived)


def is_conversation(role: Column, event_type: Column, loose: bool = False) -> Column:
    """Whether a message is part of what people and assistant said to each other.

    ``loose`` ignores case and white space around both, as rows that aren't stored yet are judged.
    """
    if loose:
        role, event_type = F.lower(strip(role)), F.lower(strip(event_type))
    kind = F.coalesce(event_type, F.lit(""))
    said = role.isin("user", "assistant") & kind.isin("", "message", "user", "assistant")
    drawn = (role == "assistant") & (kind == "image_generation_end")
    attached = (role == "attachment") & kind.isin("", "attachment")
    by_type = (kind == "attachment") & (role.isNull() | ~role.isin("system", "developer", "tool"))
    return F.coalesce(said, F.lit(False)) | F.coalesce(drawn, F.lit(False)) | F.coalesce(attached, F.lit(False)) | by_type


def conversation_only(messages: DataFrame) -> DataFrame:
    """Stored messages that pass both the exact and the loose test."""
    pair = F.col("role"), F.col("event_type")
    return messages.where(is_conversation(*pair) & is_conversation(*pair, loose=True))


def visible(messages: DataFrame, preview: str = "preview", stored: str = "stored_attachments") -> DataFrame:
    """Without the rows that have neither words nor a stored attachment."""
    return messages.where((F.col(preview) != "") | (F.size(stored) > 0))


def search(df: DataFrame, query: str | None, *names: str) -> DataFrame:
    """Rows of which a column contains ``query``, whatever its case; no character is a wildcard."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return df
    return df.where(functools.reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(n)), F.lit(wanted)), F.lit(False)) for n in names]))


def is_tool_event(role: Column, event_type: Column) -> Column:
    kind = F.regexp_replace(F.lower(F.coalesce(event_type, F.lit(""))), "[-.]", "_")
    return F.coalesce(F.lower(role) == "tool", F.lit(False)) | kind.rlike(r"tool|function_call|(^|_)call(_|$)|_call(_output)?$")


def known_role(role: Column) -> Column:
    lower = F.lower(role)
    return F.when(lower.isin(*ROLES), lower).otherwise("unknown")


def storage_status(pending: Column) -> Column:
    return F.when(pending, "pending").otherwise("uploaded")


def changed(before: DataFrame, now: DataFrame, names: list[str], key: tuple[str, ...] = SESSION_KEY) -> DataFrame:
    """Rows of ``now`` of which a column differs from the row ``before``; nulls equal nulls."""
    old = before.select(*key, *(F.col(n).alias(f"_old_{n}") for n in names))
    differs = functools.reduce(Column.__or__, [~F.col(n).eqNullSafe(F.col(f"_old_{n}")) for n in names])
    return now.join(old, list(key)).where(differs).select(*now.columns)


SESSION_ORDER = (F.desc_nulls_last, "last_message_at", "updated_at"), ("source_type", "session_id")


def by_recency(df: DataFrame, times: tuple[str, ...], keys: tuple[Column | str, ...], pending: str | None = None) -> DataFrame:
    """Sorted by times, latest first and nulls last, then by keys; pending rows lead if their flag is given."""
    first = [F.col(pending).desc()] if pending else []
    return df.orderBy(*first, *(F.desc_nulls_last(t) for t in times), *keys)


def session_order(df: DataFrame, pending: str | None = None) -> DataFrame:
    return by_recency(df, ("last_message_at", "updated_at"), SESSION_KEY, pending)


def message_order(df: DataFrame, pending: str | None = None) -> DataFrame:
    return by_recency(df, ("created_at", "ingested_at"), (*SESSION_KEY, F.desc("sequence_no"), "message_id"), pending)


def newest_first(files: DataFrame) -> DataFrame:
    """Files (path, modified_at) with the latest first, ties by path."""
    return files.orderBy(F.desc_nulls_last("modified_at"), "path")


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of sorted rows, with the total and whether more follow.

    Sorting and limiting are one top-k; the total is a count of its own, so no window sees all rows.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    total = ordered.sparkSession.range(1).crossJoin(ordered.agg(F.count("*").alias("total"))).select("total")
    rows = ordered.offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > number * size)  # one row


def capped(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most ``most`` rows (which ones isn't stated), and whether there are others."""
    return df.limit(most), df.limit(most + 1).count() > most


def overlay(stored: DataFrame, pending: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Stored rows with pending ones in their place, flagged ``is_pending``; one row per key."""
    both = stored.withColumn("is_pending", F.lit(False)).unionByName(pending.withColumn("is_pending", F.lit(True)))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("is_pending")))
    return both.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def live_sessions(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """The overlay of sessions; one that is pending as a sub-agent also hides its stored row."""
    hidden = pending.where(F.col("subagent_source_json").isNotNull()).select(*SESSION_KEY)
    people = pending.where(F.col("subagent_source_json").isNull())
    return overlay(stored.join(hidden, list(SESSION_KEY), "left_anti"), people, SESSION_KEY)


def session_overview(sessions: DataFrame) -> DataFrame:
    """Counts over all sessions, sub-agents included, and by source."""
    counts = [F.count("*").alias("sessions"), F.count_if("archived").alias("archived"), F.count_if(~F.coalesce("archived", F.lit(False))).alias("active"), F.count_if(F.col("pending_commit_id").isNotNull()).alias("pending"), F.max("ingested_at").alias("last_ingested_at")]
    return sessions.groupBy("source_type").agg(*counts).unionByName(sessions.agg(*counts).withColumn("source_type", F.lit("all")))


def message_overview(messages: DataFrame) -> DataFrame:
    counts = [F.count("*").alias("messages"), F.max("ingested_at").alias("last_ingested_at")]
    return messages.groupBy("source_type").agg(*counts).unionByName(messages.agg(*counts).withColumn("source_type", F.lit("all")))


def published_view(total: Column, durable_pending: Column, live_pending: Column) -> tuple[Column, Column]:
    """(uploaded, pending): what the overview shows while a batch is under way."""
    pending = F.greatest(durable_pending, live_pending)
    return F.greatest(F.lit(0), total - pending), pending


def project_groups(sessions: DataFrame) -> DataFrame:
    """Sessions by project, in the order in which projects are first seen; loose tasks come last.

    ``sessions`` has cwd, projectless, source_type and ``rank`` (its place in the list).
    """
    from convlake.functions.scalars import is_blank, is_generated_workspace

    folder = F.regexp_replace(F.coalesce("cwd", F.lit("")), r"[/\\]+$", "")
    task = (F.col("source_type") == "codex") & (F.coalesce("projectless", F.lit(False)) | is_blank(F.col("cwd")) | is_generated_workspace(F.col("cwd")))
    key = F.when(task, F.lit("tasks")).otherwise(F.concat(F.lit("project:"), folder))
    label = F.when(task, "Tasks").otherwise(F.coalesce(F.nullif(F.regexp_extract(folder, r"([^/\\]+)$", 1), F.lit("")), F.lit("other")))
    groups = sessions.withColumns({"project": key, "label": label, "is_task": task}).groupBy("project", "label", "is_task").agg(F.count("*").alias("sessions"), F.min("rank").alias("first_rank"))
    return groups.orderBy("is_task", "first_rank")


def timeline(messages: DataFrame) -> DataFrame:
    """``position`` of every message in its session."""
    order = Window.partitionBy(*SESSION_KEY).orderBy("sequence_no", F.coalesce("created_at", "ingested_at"), "message_id")
    return messages.withColumn("position", F.row_number().over(order))


def day_dividers(messages: DataFrame) -> DataFrame:
    """``starts_day``: whether a message is the first of its calendar day in its session."""
    order = Window.partitionBy(*SESSION_KEY).orderBy("sequence_no", F.coalesce("created_at", "ingested_at"), "message_id")
    day = F.to_date(F.coalesce("created_at", "ingested_at"))
    return messages.withColumn("_day", day).withColumn("starts_day", ~F.col("_day").eqNullSafe(F.lag("_day").over(order)) & F.col("_day").isNotNull()).drop("_day")


def last_wins(df: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """One row per key, that of the greatest ``order``."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_nth = 1").drop("_nth")


def repeated_keys(df: DataFrame, key: tuple[str, ...] = MESSAGE_KEY) -> DataFrame:
    """Keys with more than one row: a point lookup of them is an error."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def one(df: DataFrame) -> DataFrame:
    """``df`` if it has at most one row; else reading it fails. Two rows are looked at, and ``df`` is read once."""
    two = df.limit(2).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return two.where(F.when(F.col("_n") <= 1, True).otherwise(F.raise_error(F.lit("more than one row for a key")).cast("boolean"))).drop("_n")


def message_detail(messages: DataFrame, most: int = 2_000_000) -> DataFrame:
    """KEY, message_id and what a detail view shows: length, at most ``most`` characters, whether that cuts them,
    and the manifest without the bytes. ``messages`` has one row, or reading it fails."""
    from convlake.functions.scalars import bounded
    from convlake.operators.attachments import manifest

    length, detail, cut = bounded(F.col("content_json"), most)
    return one(messages).select(*MESSAGE_KEY, length.alias("content_length"), detail.alias("detail"), cut.alias("cut"), manifest(F.col("content_json")).alias("manifest"))


def list_messages(messages: DataFrame, number: int = 1, size: int = 25, conversation: bool = True, query: str | None = None, among: tuple[str, ...] = ("message_id", "content_json"), **wanted: object) -> DataFrame:
    """A page of messages, latest first, with ``preview`` and ``stored_attachments``; see page() for the rest.

    ``conversation`` leaves what people and assistant said to each other, without rows that show nothing.
    Otherwise previews are made for the rows of the page alone.
    """
    from convlake.operators.attachments import stored_attachments
    from convlake.operators.render import preview

    content = F.col("content_json")
    shown = {"preview": preview(content, F.col("role"), F.col("event_type"), conversation), "stored_attachments": stored_attachments(content)}
    rows = search(matching(messages, **wanted), query, *among)
    if conversation:
        return page(message_order(visible(conversation_only(rows).withColumns(shown))), number, size)
    return page(message_order(rows), number, size).withColumns(shown)
