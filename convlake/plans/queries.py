"""Registered queries over the given tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import scalars as S
from convlake.operators import catalog as C
from convlake.operators import lineage as G
from convlake.operators import sessions as N

from .bindings import messages, read, seconds, seconds_sql, sessions, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MKEY = "source_type, session_id, sequence_no"
SUB = "CASE WHEN parent_id IS NOT NULL THEN '{\"thread_spawn\":{\"parent_thread_id\":\"' || parent_id || '\",\"depth\":1}}' END"


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a query; ``sql`` sees messages_v and sessions_v unless ``views`` is off."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_views(sql) if views else sql
        return f

    return add


def people(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the JSON that marks sub-sessions."""
    json = F.concat(F.lit('{"thread_spawn":{"parent_thread_id":"'), F.col("parent_id"), F.lit('","depth":1}}'))
    return sessions(spark, d).withColumn("subagent_source_json", F.when(F.col("parent_id").isNotNull(), json))


def varied(spark: SparkSession, d: str) -> DataFrame:
    """Messages with roles and types as varied as real ones, from the turn."""
    n = F.col("sequence_no")
    role = F.when(n % 4 == 0, " User ").when(n % 4 == 1, "assistant").when(n % 4 == 2, "attachment").otherwise(F.lit(None))
    kind = F.element_at(F.array(*map(F.lit, ("message", "function_call", "image_generation_end", "", "attachment", "tool.use", "web_call_output"))), ((n + F.col("conv_id")) % 7 + 1).cast("int"))
    return messages(spark, d).withColumns({"role": role, "event_type": kind})


VARIED = """
varied AS (SELECT * REPLACE (
  CASE sequence_no % 4 WHEN 0 THEN ' User ' WHEN 1 THEN 'assistant' WHEN 2 THEN 'attachment' END AS role,
  ['message', 'function_call', 'image_generation_end', '', 'attachment', 'tool.use', 'web_call_output'][CAST((sequence_no + conv_id) % 7 AS INTEGER) + 1] AS event_type) FROM messages_v)
"""


def said(role: str, kind: str) -> str:
    return f"""(coalesce({role} IN ('user', 'assistant') AND coalesce({kind}, '') IN ('', 'message', 'user', 'assistant'), false)
      OR coalesce({role} = 'assistant' AND {kind} = 'image_generation_end', false)
      OR coalesce({role} = 'attachment' AND coalesce({kind}, '') IN ('', 'attachment'), false)
      OR coalesce({kind} = 'attachment' AND ({role} IS NULL OR {role} NOT IN ('system', 'developer', 'tool')), false))"""


# ---- sources ----------------------------------------------------------------------------------

@query("s5_thread_metadata", f"""
SELECT CAST(conv_id AS VARCHAR) AS session_id, '/t/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS source_path, conv_id % 2 = 0 AS archived,
       CASE WHEN conv_id * 60 - 300 > 0 THEN conv_id * 60 - 300 END AS created_at, conv_id AS updated_at
FROM sessions_v WHERE conv_id % 9 <> 0 AND conv_id > 0""")
def _(spark, d):
    n = F.col("conv_id")
    threads = sessions(spark, d).select(n.cast("string").alias("id"), F.when(n % 9 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("/t/"), n.cast("string"), F.lit(".jsonl"))).alias("rollout_path"), (n % 2 == 0).cast("long").alias("archived"), (n * 60 - 300).alias("created_at"), (n * 1000).alias("updated_at_ms"))
    rows = N.thread_metadata(threads).where("session_id <> '0'")
    return rows.select("session_id", "source_path", "archived", *seconds("created_at", "updated_at"))


LINE = "'{\"id\":\"' || CAST(conv_id % 50 AS VARCHAR) || '\",\"thread_name\":\"name ' || CAST(conv_id AS VARCHAR) || '\",\"updated_at\":\"2026-01-01T00:00:' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') || 'Z\"}'"


@query("s6_title_index", """
SELECT CAST(conv_id % 50 AS VARCHAR) AS session_id, 'name ' || CAST(max(conv_id) AS VARCHAR) AS title, 1767225600 + max(conv_id % 60) AS updated_at
FROM sessions_v WHERE conv_id % 7 NOT IN (1, 2, 3) GROUP BY conv_id % 50""")
def _(spark, d):
    n = F.col("conv_id")
    name = F.when(n % 7 == 2, F.lit("7")).when(n % 7 == 3, F.lit('"  "')).otherwise(F.concat(F.lit('"name '), n.cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"id":"'), (n % 50).cast("string"), F.lit('","thread_name":'), name, F.lit(',"updated_at":"2026-01-01T00:00:'), F.lpad((n % 60).cast("string"), 2, "0"), F.lit('Z"}'))
    lines = sessions(spark, d).select(n.alias("position"), F.when(n % 7 == 1, F.lit('{"broken')).otherwise(line).alias("line"))
    return N.title_index(lines).select("session_id", "title", *seconds("updated_at"))


@query("s9_sessions_read", "SELECT source_type, session_id, max(sequence_no) AS version, arg_max(text, sequence_no) AS state FROM messages_v GROUP BY ALL")
def _(spark, d):
    from convlake.streaming.publish import latest_sessions

    return latest_sessions(messages(spark, d).select("source_type", "session_id", F.col("sequence_no").alias("version"), F.col("text").alias("state"))).select("source_type", "session_id", "version", "state")


@query("s10_messages_read", f"SELECT {MKEY}, message_id FROM messages_v WHERE source_type = 'codex' AND session_id IN (SELECT session_id FROM sessions_v WHERE archived)")
def _(spark, d):
    wanted = sessions(spark, d).where("archived").select("source_type", "session_id")
    return N.only(C.matching(messages(spark, d), source_type="codex"), wanted).select("source_type", "session_id", "sequence_no", "message_id")


@query("s14_schema_evolution", "SELECT session_id, title, CASE WHEN conv_id % 2 = 1 THEN projectless END AS projectless FROM sessions_v")
def _(spark, d):
    s = sessions(spark, d)
    return s.where("conv_id % 2 = 0").select("session_id", "title").unionByName(s.where("conv_id % 2 = 1").select("session_id", "title", "projectless"), allowMissingColumns=True)


# ---- projections and filters -------------------------------------------------------------------

@query("p5_session_mismatch", f"SELECT {MKEY} FROM messages_v WHERE sequence_no % 3 <> 1")
def _(spark, d):
    from convlake.sources.dialects import of_session

    own = F.when(F.col("sequence_no") % 3 == 0, F.col("session_id")).when(F.col("sequence_no") % 3 == 1, F.lit("elsewhere")).otherwise(F.lit(" "))
    return of_session(messages(spark, d).withColumn("event_session", own), "event_session").select("source_type", "session_id", "sequence_no")


@query("p7_message_filter", f"SELECT {MKEY} FROM messages_v WHERE source_type = 'claude' AND role = 'assistant'")
def _(spark, d):
    return C.matching(messages(spark, d), source_type=" claude ", role="assistant", event_type=None, session_id="").select("source_type", "session_id", "sequence_no")


@query("p8_session_filter", "SELECT source_type, session_id FROM sessions_v WHERE source_type = 'codex' AND NOT archived AND parent_id IS NULL")
def _(spark, d):
    return C.list_of_sessions(people(spark, d), "codex", False).select("source_type", "session_id")


@query("p9_conversation_only", f"{VARIED} SELECT {MKEY}, role, event_type FROM varied WHERE {said('role', 'event_type')} AND {said('lower(trim(role))', 'lower(trim(event_type))')}")
def _(spark, d):
    return C.conversation_only(varied(spark, d)).select("source_type", "session_id", "sequence_no", "role", "event_type")


@query("p9_conversation_pending", f"{VARIED} SELECT {MKEY}, role, event_type FROM varied WHERE {said('lower(trim(role))', 'lower(trim(event_type))')}")
def _(spark, d):
    rows = varied(spark, d)
    return rows.where(C.is_conversation(F.col("role"), F.col("event_type"), loose=True)).select("source_type", "session_id", "sequence_no", "role", "event_type")


@query("p10_visible", f"SELECT {MKEY} FROM messages_v WHERE sequence_no % 3 <> 0 OR conv_id % 2 = 0")
def _(spark, d):
    rows = messages(spark, d).withColumns({"preview": F.when(F.col("sequence_no") % 3 == 0, "").otherwise(F.col("text")), "stored_attachments": F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))})
    return C.visible(rows).select("source_type", "session_id", "sequence_no")


@query("p11_session_search", "SELECT source_type, session_id FROM sessions_v WHERE contains(lower(session_id), '1') OR contains(lower(title), '1') OR contains(lower(cwd), '1')")
def _(spark, d):
    return C.search(sessions(spark, d), " 1 ", "session_id", "title", "cwd").select("source_type", "session_id")


@query("p12_message_search", f"SELECT {MKEY} FROM messages_v WHERE contains(lower(message_id), 'the and') OR contains(lower(text), 'the and')")
def _(spark, d):
    return C.search(messages(spark, d), "THE and", "message_id", "text").select("source_type", "session_id", "sequence_no")


@query("p12_document_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the and')", views=False)
def _(spark, d):
    docs = read(spark, d, "documents")
    return C.search(docs, "THE AND", "text").select("doc_id")


@query("p13_tool_event", f"{VARIED} SELECT {MKEY}, coalesce(lower(role) = 'tool', false) OR regexp_matches(regexp_replace(lower(coalesce(event_type, '')), '[-.]', '_', 'g'), 'tool|function_call|(^|_)call(_|$)|_call(_output)?$') AS is_tool FROM varied")
def _(spark, d):
    return varied(spark, d).select("source_type", "session_id", "sequence_no", C.is_tool_event(F.col("role"), F.col("event_type")).alias("is_tool"))


@query("p14_known_role", f"{VARIED} SELECT {MKEY}, CASE WHEN lower(role) IN ('user', 'assistant', 'system', 'tool', 'developer') THEN lower(role) ELSE 'unknown' END AS role FROM varied")
def _(spark, d):
    return varied(spark, d).select("source_type", "session_id", "sequence_no", C.known_role(F.col("role")).alias("role"))


@query("p15_narrow_projection", "SELECT source_type, count(*) AS messages FROM messages_v GROUP BY source_type")
def _(spark, d):
    """Published messages; only the columns that tell what is published are read."""
    from .job_queries import published

    return published(spark, d).messages().groupBy("source_type").agg(F.count("*").alias("messages"))


@query("p16_changed", "SELECT source_type, session_id FROM sessions_v WHERE conv_id % 3 = 0 OR conv_id % 4 = 1 AND title IS NOT NULL")
def _(spark, d):
    s = sessions(spark, d)
    now = s.withColumn("cwd", F.when(F.col("conv_id") % 3 == 0, "/moved").otherwise(F.col("cwd"))).withColumn("title", F.when(F.col("conv_id") % 4 == 1, F.lit(None)).otherwise(F.col("title")))
    return C.changed(s, now, ["title", "cwd", "archived", "projectless"]).select("source_type", "session_id")


@query("p17_storage_status", "SELECT source_type, session_id, CASE WHEN pending_commit_id IS NOT NULL THEN 'pending' ELSE 'uploaded' END AS status FROM sessions_v")
def _(spark, d):
    return sessions(spark, d).select("source_type", "session_id", C.storage_status(F.col("pending_commit_id").isNotNull()).alias("status"))


# ---- joins --------------------------------------------------------------------------------------

@query("j1_named_threads", f"SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN 'named ' || session_id ELSE title END AS title, CAST(epoch(updated_at) AS BIGINT) + CASE WHEN conv_id % 3 < 2 THEN 60 ELSE 0 END AS updated_at FROM sessions_v")
def _(spark, d):
    s, n = sessions(spark, d), F.col("conv_id")
    names = s.where(n % 3 < 2).select("session_id", F.when(n % 3 == 0, F.concat(F.lit("named "), "session_id")).otherwise(F.lit(" ")).alias("title"), F.timestamp_seconds(F.unix_timestamp("updated_at") + 60).alias("updated_at"))
    return N.named(s, names).select("session_id", "title", *seconds("updated_at"))


@query("j2_unindexed", "SELECT session_id, '/p/' || session_id AS source_path, conv_id % 2 = 0 AS indexed FROM sessions_v")
def _(spark, d):
    s = sessions(spark, d).select("conv_id", "session_id", F.concat(F.lit("/p/"), "session_id").alias("source_path"))
    indexed = s.where("conv_id % 2 = 0").select("session_id", "source_path", F.lit(True).alias("indexed"))
    found = s.where("conv_id % 4 <> 2").select("session_id", "source_path", F.lit(False).alias("indexed"))
    again = found.withColumn("source_path", F.concat("source_path", F.lit("/copy")))
    return N.with_unindexed(indexed, found.unionByName(again))


@query("j3_repaired", "SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN '/meta' ELSE cwd END AS cwd, CASE WHEN conv_id % 4 = 0 THEN 'own' ELSE 'index' END AS source FROM sessions_v")
def _(spark, d):
    s, n = sessions(spark, d), F.col("conv_id")
    threads = s.select("session_id", "conv_id", F.when(n % 2 == 0, F.lit("  ")).otherwise(F.col("cwd")).alias("cwd"), F.lit("index").alias("source"))
    metas = s.where(n % 2 == 0).select("session_id", F.lit("/meta").alias("cwd"), F.when(n % 4 == 0, "own").alias("source"))
    return N.repaired(threads, metas).select("session_id", "cwd", "source")


@query("j4_checkpoints", f"SELECT m.source_type, m.session_id, m.sequence_no, CASE WHEN m.conv_id % 3 = 0 THEN s.last_commit_id ELSE -1 END AS last_commit_id, CASE WHEN m.conv_id % 3 = 0 THEN m.conv_id * 10 ELSE 0 END AS cursor_offset FROM messages_v m JOIN sessions_v s USING (source_type, session_id)")
def _(spark, d):
    known = sessions(spark, d).where("conv_id % 3 = 0").select("source_type", "session_id", (F.col("conv_id") * 10).alias("cursor_offset"), "last_commit_id")
    return N.with_checkpoints(messages(spark, d), known).select("source_type", "session_id", "sequence_no", "last_commit_id", "cursor_offset")


@query("j5_only_sessions", f"SELECT {MKEY} FROM messages_v WHERE (source_type, session_id) IN (SELECT (source_type, session_id) FROM sessions_v WHERE pending_commit_id IS NOT NULL)")
def _(spark, d):
    return N.only(messages(spark, d), sessions(spark, d).where("pending_commit_id is not null")).select("source_type", "session_id", "sequence_no")


@query("j6_skip_existing", "SELECT source_type, session_id FROM sessions_v WHERE NOT archived")
def _(spark, d):
    s = sessions(spark, d)
    return N.skip_existing(s, s.where("archived")).select("source_type", "session_id")


@query("j7_remapped_anchors", """
lines AS (SELECT session_id AS path, (sequence_no + 1) * 100 AS end_offset, sha256(text) AS anchor FROM messages_v),
wanted AS (SELECT session_id AS path, CASE WHEN any_value(conv_id) % 5 = 0 THEN 'none' ELSE sha256(arg_max(text, sequence_no) FILTER (WHERE sequence_no % 2 = 0)) END AS anchor, CAST(250 AS BIGINT) AS old FROM messages_v GROUP BY session_id),
best AS (SELECT path, arg_min(end_offset, abs(end_offset - old) * 1000000 + end_offset) AS end_offset FROM lines JOIN wanted USING (path, anchor) GROUP BY path)
SELECT path, end_offset, end_offset IS NULL AS paused FROM wanted LEFT JOIN best USING (path)""")
def _(spark, d):
    lines = messages(spark, d).select(F.col("session_id").alias("path"), ((F.col("sequence_no") + 1) * 100).alias("end_offset"), S.line_anchor(F.concat("text", F.lit("\r"))).alias("anchor"))
    last = messages(spark, d).groupBy("session_id").agg(F.any_value("conv_id").alias("conv_id"), F.max_by("text", F.when(F.col("sequence_no") % 2 == 0, F.col("sequence_no"))).alias("text"))
    wanted = last.select(F.col("session_id").alias("path"), F.when(F.col("conv_id") % 5 == 0, "none").otherwise(S.line_anchor(F.col("text"))).alias("anchor"), F.lit(250).cast("long").alias("offset"))
    return N.remapped_anchors(lines, wanted)


@query("j9_parent_child", "SELECT c.source_type, c.session_id, c.parent_id, p.title AS parent_title FROM sessions_v c JOIN sessions_v p ON p.source_type = c.source_type AND p.session_id = c.parent_id")
def _(spark, d):
    s = people(spark, d)
    parents = s.select("source_type", F.col("session_id").alias("parent_id"), F.col("title").alias("parent_title"))
    return G.edges(s).join(parents, ["source_type", "parent_id"]).select("source_type", "session_id", "parent_id", "parent_title")


@query("j10_snapshot_stability", "SELECT source_type, session_id FROM sessions_v WHERE conv_id % 7 = 0 OR pending_commit_id IS NOT NULL OR conv_id % 5 = 1")
def _(spark, d):
    s = sessions(spark, d).withColumn("cursor_offset", F.col("conv_id"))
    now = s.where("conv_id % 7 <> 0").withColumn("cursor_offset", F.col("conv_id") + (F.col("conv_id") % 5 == 1).cast("long"))
    return N.unstable(s, now)


@query("j11_message_overlay", f"SELECT {MKEY}, message_id, sequence_no % 2 = 1 AS is_pending, CASE WHEN sequence_no % 2 = 1 THEN 'new' ELSE role END AS role FROM messages_v")
def _(spark, d):
    m = messages(spark, d)
    pending = m.where("sequence_no % 2 = 1").withColumn("role", F.lit("new"))
    return C.overlay(m, pending, C.MESSAGE_KEY).select("source_type", "session_id", "sequence_no", "message_id", "is_pending", "role")


@query("j12_live_sessions", "SELECT source_type, session_id, pending_commit_id IS NOT NULL AS is_pending FROM sessions_v WHERE pending_commit_id IS NULL OR parent_id IS NULL")
def _(spark, d):
    s = people(spark, d)
    stored = s.withColumn("subagent_source_json", F.lit(None).cast("string"))
    return C.live_sessions(stored, s.where("pending_commit_id is not null")).select("source_type", "session_id", "is_pending")


# ---- aggregates ---------------------------------------------------------------------------------

OVER = "count(*) AS sessions, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE NOT archived) AS active, count(*) FILTER (WHERE pending_commit_id IS NOT NULL) AS pending, CAST(epoch(max(ingested_at)) AS BIGINT) AS last_ingested_at"


@query("a1_session_overview", f"SELECT source_type, {OVER} FROM sessions_v GROUP BY source_type UNION ALL SELECT 'all', {OVER} FROM sessions_v")
def _(spark, d):
    return C.session_overview(sessions(spark, d)).withColumns({"last_ingested_at": F.unix_timestamp("last_ingested_at")})


@query("a2_message_overview", "SELECT coalesce(source_type, 'all') AS source_type, count(*) AS messages, CAST(epoch(max(ingested_at)) AS BIGINT) AS last_ingested_at FROM messages_v GROUP BY GROUPING SETS ((source_type), ())")
def _(spark, d):
    return C.message_overview(messages(spark, d)).withColumns({"last_ingested_at": F.unix_timestamp("last_ingested_at")})


@query("a3_published_view", "SELECT source_type, greatest(0, count(*) - greatest(count(*) FILTER (WHERE pending_commit_id IS NOT NULL), 3)) AS uploaded, greatest(count(*) FILTER (WHERE pending_commit_id IS NOT NULL), 3) AS pending FROM sessions_v GROUP BY source_type")
def _(spark, d):
    view = C.session_overview(sessions(spark, d)).where("source_type <> 'all'")
    uploaded, pending = C.published_view(F.col("sessions"), F.col("pending"), F.lit(3))
    return view.select("source_type", uploaded.cast("long").alias("uploaded"), pending.cast("long").alias("pending"))


def events(spark, d):
    """Messages as ordered events with gaps in what they know."""
    n = F.col("sequence_no")
    return messages(spark, d).select(
        "source_type", "session_id", (n * 100).alias("start_offset"), (n * 100 + 99).alias("end_offset"), "role", F.when(n == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("text"),
        F.when(n % 2 == 1, F.concat(F.lit("/w/"), n.cast("string"))).otherwise(F.lit(" ")).alias("cwd"), F.when(n != 1, F.timestamp_seconds(F.unix_timestamp("created_at") + F.when(n == 2, -7200).otherwise(0))).alias("event_time"), F.sha2(F.col("role"), 256).alias("anchor"),
    )


EVENTS = """
events AS (SELECT source_type, session_id, sequence_no * 100 AS start_offset, sequence_no * 100 + 99 AS end_offset, role, CASE WHEN sequence_no = 0 THEN ' ' ELSE text END AS text,
  CASE WHEN sequence_no % 2 = 1 THEN '/w/' || CAST(sequence_no AS VARCHAR) END AS cwd,
  CASE WHEN sequence_no <> 1 THEN CAST(epoch(created_at) AS BIGINT) + CASE WHEN sequence_no = 2 THEN -7200 ELSE 0 END END AS event_time, sha256(role) AS anchor FROM messages_v)
"""


@query("a4_session_rollup", f"""{EVENTS}
SELECT source_type, session_id, left(trim(regexp_replace(arg_min(text, start_offset) FILTER (WHERE role = 'user' AND trim(text) <> ''), '\\s+', ' ', 'g')), 120) AS title,
  arg_max(cwd, start_offset) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(event_time, start_offset) FILTER (WHERE event_time IS NOT NULL) AS created_at,
  arg_max(event_time, start_offset) FILTER (WHERE event_time IS NOT NULL) AS updated_at FROM events GROUP BY ALL""")
def _(spark, d):
    return N.rolled_up(events(spark, d)).select("source_type", "session_id", "title", "cwd", *seconds("created_at", "updated_at"))


@query("a5_merge_with_previous", f"""{EVENTS}, now AS (SELECT source_type, session_id, arg_max(cwd, start_offset) FILTER (WHERE cwd IS NOT NULL) AS cwd, max(end_offset) AS cursor_offset FROM events GROUP BY ALL)
SELECT source_type, session_id, CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN 'before' ELSE 'now' END AS title, coalesce(cwd, CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN '/before' END) AS cwd, cursor_offset FROM now""")
def _(spark, d):
    now = N.rolled_up(events(spark, d)).select("source_type", "session_id", F.lit("now").alias("title"), "cwd", "cursor_offset")
    before = sessions(spark, d).where("conv_id % 2 = 0").select("source_type", "session_id", F.lit("before").alias("title"), F.lit("/before").alias("cwd"))
    return N.merged(before, now)


@query("a6_cursor_advance", f"{EVENTS} SELECT source_type, session_id, max(end_offset) AS cursor_offset, arg_max(anchor, end_offset) AS cursor_anchor FROM events GROUP BY ALL")
def _(spark, d):
    return N.rolled_up(events(spark, d)).select("source_type", "session_id", "cursor_offset", "cursor_anchor")


@query("a7_next_commit", "SELECT coalesce(max(pending_commit_id), max(last_commit_id) + 1) AS commit_id FROM sessions_v")
def _(spark, d):
    return N.next_commit(sessions(spark, d))


@query("a8_batch_merge", "SELECT source_type, session_id, arg_max(text, sequence_no) AS state, min(sequence_no) * 10 AS starting_cursor, CAST(sum(sequence_no + 1) AS BIGINT) AS read_count, count(*) AS chunks FROM messages_v GROUP BY ALL")
def _(spark, d):
    n = F.col("sequence_no")
    return N.merged_batches(messages(spark, d).select("source_type", "session_id", n.alias("chunk"), F.col("text").alias("state"), (n * 10).alias("starting_cursor"), (n + 1).alias("read_count")))


@query("a9_commit_counts", "SELECT commit_id, count(DISTINCT (source_type, session_id)) AS sessions, count(*) AS messages FROM messages_v GROUP BY commit_id")
def _(spark, d):
    return N.commit_counts(messages(spark, d))


@query("a10_duplicate_audit", "SELECT source_type, session_id, count(*) AS copies, count(DISTINCT text) AS contents, CASE WHEN count(DISTINCT text) > 1 THEN 'conflict' ELSE 'ignored' END AS verdict FROM messages_v GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return N.duplicate_audit(messages(spark, d), ["source_type", "session_id"], "text")


@query("a11_repeated_keys", "SELECT source_type, role, count(*) AS n FROM messages_v GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return C.repeated_keys(messages(spark, d), ("source_type", "role"))


@query("a12_export_summary", "SELECT count(*) FILTER (WHERE NOT archived) AS restored_sessions, count(*) FILTER (WHERE archived) AS skipped, (SELECT count(*) FROM messages_v m SEMI JOIN (SELECT * FROM sessions_v WHERE NOT archived) s USING (source_type, session_id)) AS restored_messages FROM sessions_v")
def _(spark, d):
    from convlake.operators.export import summary

    return summary(sessions(spark, d), messages(spark, d), sessions(spark, d).where("archived"))


@query("a13_project_groups", """
SELECT CASE WHEN source_type = 'codex' AND coalesce(projectless, false) THEN 'tasks' ELSE 'project:' || cwd END AS project,
  CASE WHEN source_type = 'codex' AND coalesce(projectless, false) THEN 'Tasks' ELSE replace(cwd, '/work/', '') END AS label,
  source_type = 'codex' AND coalesce(projectless, false) AS is_task, count(*) AS sessions, min(conv_id) AS first_rank
FROM sessions_v GROUP BY 1, 2, 3""")
def _(spark, d):
    return C.project_groups(sessions(spark, d).withColumn("rank", F.col("conv_id")).withColumn("cwd", F.concat("cwd", F.lit("//"))))


# ---- ordered --------------------------------------------------------------------------------------

@query("w1_timeline", f"SELECT {MKEY}, CAST(row_number() OVER (PARTITION BY source_type, session_id ORDER BY sequence_no, created_at, message_id) AS INTEGER) AS position FROM messages_v")
def _(spark, d):
    return C.timeline(messages(spark, d)).select("source_type", "session_id", "sequence_no", "position")


@query("w2_day_dividers", """
d AS (SELECT *, CAST(created_at + to_hours(sequence_no * 7) AS DATE) AS day FROM messages_v)
SELECT source_type, session_id, sequence_no, day IS DISTINCT FROM lag(day) OVER (PARTITION BY source_type, session_id ORDER BY sequence_no) AS starts_day FROM d""")
def _(spark, d):
    rows = messages(spark, d).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("sequence_no") * 7 * 3600))
    return C.day_dividers(rows).select("source_type", "session_id", "sequence_no", "starts_day")


@query("w5_turns", f"SELECT {MKEY}, CAST(count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY source_type, session_id ORDER BY sequence_no) AS BIGINT) AS turn_no FROM messages_v")
def _(spark, d):
    from convlake.operators.turns import basic_turns

    return basic_turns(messages(spark, d)).select("source_type", "session_id", "sequence_no", "turn_no")


@query("l1_session_order", "SELECT source_type, session_id, conv_id FROM sessions_v ORDER BY last_message_at DESC NULLS LAST, updated_at DESC NULLS LAST, source_type, session_id LIMIT 25")
def _(spark, d):
    return C.session_order(sessions(spark, d)).select("source_type", "session_id", "conv_id").limit(25)


@query("l2_message_order", f"SELECT {MKEY} FROM messages_v ORDER BY created_at DESC NULLS LAST, ingested_at DESC NULLS LAST, source_type, session_id, sequence_no DESC, message_id LIMIT 25")
def _(spark, d):
    return C.message_order(messages(spark, d)).select("source_type", "session_id", "sequence_no").limit(25)


@query("l3_overlay_order", "SELECT source_type, session_id FROM sessions_v ORDER BY pending_commit_id IS NOT NULL DESC, last_message_at DESC NULLS LAST, updated_at DESC NULLS LAST, source_type, session_id LIMIT 25")
def _(spark, d):
    return C.session_order(sessions(spark, d).withColumn("is_pending", F.col("pending_commit_id").isNotNull()), "is_pending").select("source_type", "session_id").limit(25)


@query("l4_page", "SELECT source_type, session_id, (SELECT count(*) FROM sessions_v) AS total, (SELECT count(*) FROM sessions_v) > 20 AS has_more FROM sessions_v ORDER BY last_message_at DESC NULLS LAST, updated_at DESC NULLS LAST, source_type, session_id LIMIT 10 OFFSET 10")
def _(spark, d):
    return C.page(C.session_order(sessions(spark, d)), 2, 10).select("source_type", "session_id", "total", "has_more")


@query("u1_last_wins", "SELECT source_type, role, max(conv_id * 100 + sequence_no) AS place FROM messages_v GROUP BY ALL")
def _(spark, d):
    return C.last_wins(messages(spark, d).select("source_type", "role", (F.col("conv_id") * 100 + F.col("sequence_no")).alias("place")), ("source_type", "role"), "place")


# ---- lineage ----------------------------------------------------------------------------------------

TREE = """
tree AS (SELECT 'x' AS source_type, session_id, parent_id, pending_commit_id IS NOT NULL AS pending, archived FROM sessions_v)"""
ROOTS = f"""RECURSIVE {TREE},
up AS (SELECT session_id, session_id AS root_id, CAST(0 AS BIGINT) AS depth FROM tree WHERE parent_id IS NULL OR parent_id NOT IN (SELECT session_id FROM tree)
       UNION ALL SELECT t.session_id, up.root_id, up.depth + 1 FROM tree t JOIN up ON t.parent_id = up.session_id)"""


def tree(spark, d):
    """Sessions of one client, so that parents and children meet."""
    return people(spark, d).select(F.lit("x").alias("source_type"), "session_id", "parent_id", F.col("pending_commit_id").isNotNull().alias("pending"), "archived", "subagent_source_json")


@query("g1_edges", "SELECT source_type, session_id, parent_id FROM sessions_v WHERE parent_id IS NOT NULL")
def _(spark, d):
    return G.edges(people(spark, d))


@query("g2_roots", f"{ROOTS} SELECT session_id, root_id FROM up")
def _(spark, d):
    return G.roots(tree(spark, d)).select("session_id", "root_id")


@query("g3_family", f"{ROOTS} SELECT session_id, root_id FROM up WHERE root_id IN (SELECT root_id FROM up JOIN tree USING (session_id) WHERE archived)")
def _(spark, d):
    t = tree(spark, d)
    return G.family(G.roots(t), t.where("archived")).select("session_id", "root_id")


@query("g4_depth", f"{ROOTS} SELECT session_id, depth FROM up")
def _(spark, d):
    return G.roots(tree(spark, d)).select("session_id", "depth")


@query("g5_audit", "SELECT session_id, 'missing_parent' AS problem FROM sessions_v WHERE parent_id IS NOT NULL AND CAST(parent_id AS BIGINT) % 3 = 0 AND conv_id % 3 <> 0")
def _(spark, d):
    t = tree(spark, d).where(F.col("session_id").cast("long") % 3 != 0)
    return G.audit(t).select("session_id", "problem")


@query("g6_blocked", f"RECURSIVE {TREE}, b AS (SELECT session_id FROM tree WHERE pending UNION SELECT t.session_id FROM tree t JOIN b ON t.parent_id = b.session_id) SELECT session_id FROM b")
def _(spark, d):
    return G.blocked(tree(spark, d)).select("session_id")


@query("g7_rejected", f"{ROOTS} SELECT session_id FROM up JOIN tree USING (session_id) WHERE pending AND root_id IN (SELECT root_id FROM up JOIN tree USING (session_id) WHERE archived)")
def _(spark, d):
    t = tree(spark, d)
    return G.rejected(t, t.where("archived")).select("session_id")


@query("g8_multi_agent_roots", f"{ROOTS} SELECT root_id, count(*) AS subagents FROM up WHERE depth > 0 GROUP BY root_id")
def _(spark, d):
    return G.multi_agent_roots(G.roots(tree(spark, d))).select("root_id", "subagents")
