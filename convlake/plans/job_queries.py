"""Registered queries that run whole jobs: transcripts written and read, published, taken apart, exported.

Each writes what it derives from the given tables to a work folder and reads that back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import scalars as S
from convlake.operators import attachments as A
from convlake.operators import catalog as C
from convlake.operators import export as X
from convlake.operators import sessions as N
from convlake.operators import turns as T
from convlake.sources import dialects as D
from convlake.sources.jsonl import register
from convlake.streaming.incremental import recovery
from convlake.streaming.publish import Store
from convlake.work import work_dir

from .bindings import messages, read, sessions
from .queries import MKEY, query

CODEX = """'{"timestamp":"2026-01-01T00:00:00Z","type":"response_item","payload":{"type":"message","role":"' || role || '","content":[{"type":"input_text","text":"' || role || '"}]}}'"""
#: The same with what was said in place of the role.
CODEX_TEXT = """'{"timestamp":"2026-01-01T00:00:00Z","type":"response_item","payload":{"type":"message","role":"' || role || '","content":[{"type":"input_text","text":' || CAST(to_json(text) AS VARCHAR) || '}]}}'"""


def transcripts(spark: SparkSession, d: str, said: str = "text") -> DataFrame:
    """Lines of every session's messages as codex events with the column ``said``, every fifth one malformed."""
    block = F.struct(F.lit("input_text").alias("type"), F.col(said).alias("text"))
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(block).alias("content"))
    event = F.to_json(F.struct(F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit("response_item").alias("type"), payload.alias("payload")))
    broken = F.col("sequence_no") % 5 == 4
    return messages(spark, d).select("source_type", "session_id", F.col("sequence_no").alias("position"), F.lit(0).alias("ord"), F.when(broken, F.lit("{broken")).otherwise(event).alias("json"))


def written(spark: SparkSession, d: str, said: str = "text") -> DataFrame:
    """The same, written as files by session and read with offsets; ``session_id`` comes from the folder."""
    path = f"{work_dir(spark)}/transcripts"
    X.write_transcripts(transcripts(spark, d, said), path)
    register(spark)
    lines = spark.read.format("jsonl_offsets").option("path", f"{path}/*/*/*.txt").load()
    return lines.withColumn("session_id", F.regexp_extract("path", "session=([^/]+)/", 1))


def scanned(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id").agg(F.count_if("line_terminated").alias("lines"), F.max("end_offset").alias("bytes"))


@query("s1_text_scan", f"SELECT session_id, count(*) AS lines, CAST(sum(strlen(CASE WHEN sequence_no % 5 = 4 THEN '{{broken' ELSE {CODEX_TEXT} END) + 1) AS BIGINT) AS bytes FROM messages_v GROUP BY session_id")
def _(spark, d):
    return scanned(written(spark, d))


@query("p1_codex_events", f"SELECT session_id, CASE WHEN sequence_no % 5 = 4 THEN 'unknown' ELSE role END AS role, CASE WHEN sequence_no % 5 = 4 THEN 'parse_error' ELSE 'message' END AS event_type, count(*) AS n FROM messages_v GROUP BY ALL")
def _(spark, d):
    rows = D.codex_messages(written(spark, d))
    session = F.regexp_extract("path", "session=([^/]+)/", 1)
    return rows.groupBy(session.alias("session_id"), "role", "event_type").agg(F.count("*").alias("n"))


def cursors(lines: DataFrame) -> DataFrame:
    return D.cursors(lines).select(F.regexp_extract("path", "session=([^/]+)/", 1).alias("session_id"), "cursor_offset", "cursor_anchor")


@query("p3_text_cursors", f"SELECT session_id, CAST(sum(strlen(CASE WHEN sequence_no % 5 = 4 THEN '{{broken' ELSE {CODEX_TEXT} END) + 1) AS BIGINT) AS cursor_offset, sha256(arg_max(CASE WHEN sequence_no % 5 = 4 THEN '{{broken' ELSE {CODEX_TEXT} END, sequence_no)) AS cursor_anchor FROM messages_v GROUP BY session_id")
def _(spark, d):
    return cursors(written(spark, d))


@query("p4_malformed", "SELECT session_id, '{\"_parse_error\":true,\"raw_line\":\"{broken\"}' AS content_json FROM messages_v WHERE sequence_no % 5 = 4")
def _(spark, d):
    found = D.parse_errors(D.parsed(written(spark, d)))
    return found.select(F.regexp_extract("path", "session=([^/]+)/", 1).alias("session_id"), "content_json")


def published(spark: SparkSession, d: str, stop_after: str = "") -> Store:
    """Messages in two commits, the second left where ``stop_after`` says."""
    store = Store(spark, f"{work_dir(spark)}/store", "bench")
    store.claim()
    rows = messages(spark, d).withColumn("content_json", F.to_json(F.struct("role", "text"))).select("message_id", "source_type", "session_id", "sequence_no", "role", "event_type", "content_json", "created_at")
    for commit, part in enumerate((rows.where("sequence_no < 2"), rows.where("sequence_no >= 2"))):
        state = part.groupBy("source_type", "session_id").agg(F.max("sequence_no").alias("cursor_offset"))
        store.publish(state, part, commit, stop_after if commit else "")
    return store


@query("st5_published", f"SELECT {MKEY}, message_id, sequence_no >= 2 AS second FROM messages_v")
def _(spark, d):
    return published(spark, d).messages().select("source_type", "session_id", "sequence_no", "message_id", (F.col("commit_id") == 1).alias("second"))


@query("st5_unfinished", f"SELECT {MKEY}, message_id FROM messages_v WHERE sequence_no < 2")
def _(spark, d):
    return published(spark, d, "messages").messages().select("source_type", "session_id", "sequence_no", "message_id")


@query("st6_recovery", "SELECT source_type, session_id, CAST(1 AS BIGINT) AS pending_commit_id, conv_id % 2 = 0 AS complete FROM messages_v WHERE sequence_no >= 2 GROUP BY ALL")
def _(spark, d):
    store = published(spark, d, "messages")
    again = messages(spark, d).groupBy("source_type", "session_id", "conv_id").agg(F.max("sequence_no").alias("last")).select("source_type", "session_id", (F.col("last") + F.col("conv_id") % 2).alias("cursor_offset"))
    return recovery(store.sessions(), again)


@query("s12_sessions_upsert", "SELECT source_type, session_id, max(CASE WHEN sequence_no >= 2 THEN 1 ELSE 0 END) AS last_commit_id, max(sequence_no) AS cursor_offset FROM messages_v GROUP BY ALL")
def _(spark, d):
    return published(spark, d).sessions().select("source_type", "session_id", F.col("last_commit_id").cast("int").alias("last_commit_id"), "cursor_offset")


def with_attachments(spark: SparkSession, d: str, most: int = A.MOST) -> DataFrame:
    """Every document as a message with its text inline in base64, and a remote image; at most ``most`` bytes are stored."""
    data = S.base64_text(F.col("text").cast("binary"))
    source = F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), data.alias("data"))
    none = F.lit(None).cast("struct<type:string,media_type:string,data:string>")
    content = F.array(F.struct(F.lit("document").alias("type"), F.lit(None).cast("string").alias("image_url"), source.alias("source")), F.struct(F.lit("input_image").alias("type"), F.lit("https://me:pw@h.org/i.png?k=1").alias("image_url"), none.alias("source")))
    docs = read(spark, d, "documents").where("length(text) > 0")
    return A.taken_out(docs.select(F.col("doc_id").cast("string").alias("message_id"), F.to_json(F.struct(F.struct(content.alias("content")).alias("message"))).alias("content_json")), most=most)


def entries(rows: DataFrame) -> DataFrame:
    rows = rows.select("message_id", F.explode(A.manifest(F.col("content_json"))).alias("e"))
    return rows.select("message_id", *(F.col(f"e.{n}").alias(n) for n in ("index", "status", "size", "sha256", "source_reference")))


@query("b4_whole_manifest", "SELECT CAST(doc_id AS VARCHAR) AS message_id, i AS index, CASE WHEN i = 1 THEN 'remote_not_downloaded' ELSE 'stored' END AS status, CASE WHEN i = 0 THEN strlen(text) END AS size, CASE WHEN i = 0 THEN sha256(text) END AS sha256, CASE WHEN i = 0 THEN 'inline:text/plain' ELSE 'https://h.org/i.png' END AS source_reference FROM documents, (SELECT unnest([CAST(0 AS INTEGER), 1]) AS i) WHERE length(text) > 0", views=False)
def _(spark, d):
    return entries(with_attachments(spark, d))


def stored(rows: DataFrame) -> DataFrame:
    return rows.where(F.size(A.stored_attachments(F.col("content_json"))) == 1).select("message_id")


@query("b6_whole_stored", "SELECT CAST(doc_id AS VARCHAR) AS message_id FROM documents WHERE length(text) > 0", views=False)
def _(spark, d):
    return stored(with_attachments(spark, d))


def looked_up(rows: DataFrame) -> DataFrame:
    return A.lookup(rows, 0).select("message_id", F.sha2("data", 256).alias("sha256"), "mime_type", "file_name")


@query("q5_whole_attachment", "SELECT CAST(doc_id AS VARCHAR) AS message_id, sha256(text) AS sha256, 'text/plain' AS mime_type, 'attachment-0' AS file_name FROM documents WHERE length(text) > 0", views=False)
def _(spark, d):
    return looked_up(with_attachments(spark, d))


@query("b8_whole_pending", "SELECT CAST(doc_id AS VARCHAR) AS message_id, i AS index, i = 0 AS present FROM documents, (SELECT unnest([CAST(0 AS INTEGER), 1]) AS i) WHERE length(text) > 0", views=False)
def _(spark, d):
    return A.pending_detail(with_attachments(spark, d))


def restored(rows: DataFrame) -> DataFrame:
    rows = A.put_back(rows)
    data = F.get_json_object("content_json", "$.message.content[0].source.data")
    return rows.select("message_id", F.when(data == "blob:0", "too large").otherwise(F.sha2(F.unbase64(data), 256)).alias("sha256"))


@query("b9_whole_put_back", "SELECT CAST(doc_id AS VARCHAR) AS message_id, sha256(text) AS sha256 FROM documents WHERE length(text) > 0", views=False)
def _(spark, d):
    return restored(with_attachments(spark, d))


def boundaries(spark: SparkSession, d: str, said: str = "text") -> DataFrame:
    path, s = f"{work_dir(spark)}/marked", sessions(spark, d)
    lines = transcripts(spark, d, said).withColumn("json", F.when(F.col("json") == "{broken", "{}").otherwise(F.col("json")))
    X.write_transcripts(X.marked(lines, s), path)
    register(spark)
    return X.restore_boundaries(spark.read.format("jsonl_offsets").option("path", f"{path}/*/*/*.txt").load(), s).select("session_id", "resume_offset")


@query("j8_text_boundaries", f"SELECT session_id, CAST(sum(strlen(CASE WHEN sequence_no % 5 = 4 THEN '{{}}' ELSE {CODEX_TEXT} END) + 1) AS BIGINT) + strlen(',\"_restore_boundary\":\"' || any_value(source_type) || ':' || session_id || ':' || CAST(any_value(conv_id) % 4 AS VARCHAR) || '\"') - CASE WHEN max(sequence_no) % 5 = 4 THEN 1 ELSE 0 END AS resume_offset FROM messages_v GROUP BY session_id")
def _(spark, d):
    return boundaries(spark, d)


@query("r2_wrapped", """
t AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY source_type, session_id ORDER BY sequence_no) AS turn FROM messages_v),
u AS MATERIALIZED (
  SELECT source_type, session_id, turn, CASE WHEN turn = 1 THEN (SELECT min(sequence_no) FROM messages_v m WHERE m.source_type = t.source_type AND m.session_id = t.session_id) ELSE min(sequence_no) END AS start,
         max(sequence_no) FILTER (WHERE role = 'user') AS prompt, max(sequence_no) FILTER (WHERE role = 'assistant') AS answer
  FROM t WHERE turn > 0 GROUP BY source_type, session_id, turn
)
SELECT session_id, sequence_no AS position, CAST(1 AS INTEGER) AS ord, 'message' AS kind, text AS said FROM t
UNION ALL SELECT session_id, start, 0, 'task_started', NULL FROM u
UNION ALL SELECT u.session_id, prompt, 2, 'user_message', text FROM u JOIN t ON t.source_type = u.source_type AND t.session_id = u.session_id AND t.sequence_no = prompt
UNION ALL SELECT session_id, prompt, 3, 'task_complete', NULL FROM u WHERE answer IS NULL
UNION ALL SELECT u.session_id, answer, o, CASE o WHEN 2 THEN 'agent_message' ELSE 'task_complete' END, text FROM u JOIN t ON t.source_type = u.source_type AND t.session_id = u.session_id AND t.sequence_no = answer CROSS JOIN (SELECT unnest([2, 3]) AS o)""")
def _(spark, d):
    turned = T.turns(messages(spark, d).withColumn("content_json", F.to_json(F.struct("role", "text"))))
    at = lambda *paths: F.coalesce(*(F.get_json_object("json", p) for p in paths))
    return T.wrapped(turned).select("session_id", "position", "ord", F.coalesce(at("$.payload.type"), F.lit("message")).alias("kind"), at("$.payload.message", "$.payload.last_agent_message", "$.text").alias("said"))


@query("r8_restored_threads", "SELECT session_id AS id, 'sessions/' || session_id || '.jsonl' AS rollout_path, title, CAST(epoch(created_at) AS BIGINT) AS created_at, archived FROM sessions_v")
def _(spark, d):
    s = sessions(spark, d)
    previews = T.first_prompt(T.basic_turns(messages(spark, d)), s)
    return X.restored_threads(s, previews).select("id", "rollout_path", "title", "created_at", "archived")


@query("w4_fair_share", 'SELECT source, path, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round, path) AS place FROM (SELECT source_type AS source, session_id AS path, sequence_no AS "offset", row_number() OVER (PARTITION BY source_type, session_id ORDER BY sequence_no) AS round FROM messages_v)) ORDER BY place, source LIMIT 40')
def _(spark, d):
    waiting = messages(spark, d).select(F.col("source_type").alias("source"), F.col("session_id").alias("path"), F.col("sequence_no").alias("offset"))
    return N.fair_share(waiting, 40)


@query("l5_capped", "SELECT least(count(*), 20) AS n, count(*) > 20 AS truncated FROM messages_v")
def _(spark, d):
    rows, more = C.capped(messages(spark, d), 20)
    return rows.agg(F.count("*").alias("n")).withColumn("truncated", F.lit(more))


@query("l6_newest_first", "SELECT session_id AS path FROM sessions_v ORDER BY last_message_at DESC NULLS LAST, session_id LIMIT 15")
def _(spark, d):
    return C.newest_first(sessions(spark, d).select(F.col("session_id").alias("path"), F.col("last_message_at").alias("modified_at"))).limit(15).select("path")
