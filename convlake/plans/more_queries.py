"""Registered queries of sources, dialects, labels, attachments and collecting, over the texts of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import scalars as S
from convlake.operators import attachments as A
from convlake.operators import catalog as C
from convlake.operators import export as X
from convlake.operators import render as R
from convlake.operators import sessions as N
from convlake.sources import dialects as D
from convlake.sources.jsonl import register
from convlake.sources.files import listed
from convlake.streaming.publish import Store
from convlake.streaming.tail import collect
from convlake.work import work_dir

from .bindings import messages, read, sessions
from .queries import MKEY, query
from .text_queries import NORMAL

M = ("source_type", "session_id", "sequence_no")


def as_lines(rows: DataFrame, line, place=None) -> DataFrame:
    """One complete line for each message, in a file called after its session."""
    at = F.col("sequence_no") if place is None else place
    return rows.select(F.concat(F.lit("/t/"), "session_id", F.lit(".jsonl")).alias("path"), at.alias("start_offset"), (at + 1).alias("end_offset"), line.alias("line"), F.lit(True).alias("line_terminated"))


def base64(text):
    return S.base64_text(F.coalesce(text, F.lit("")).cast("binary"))


@query("p2_claude_events", "SELECT session_id, sequence_no, role, role AS event_type, text FROM messages_v WHERE role IN ('user', 'assistant', 'system') AND sequence_no % 3 <> 2")
def _(spark, d):
    session = F.when(F.col("sequence_no") % 3 == 2, "another").otherwise(F.col("session_id"))
    event = F.to_json(F.struct(F.col("role").alias("type"), session.alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message")))
    rows = D.claude_messages(as_lines(messages(spark, d), event))
    return rows.select("session_id", "sequence_no", "role", "event_type", F.get_json_object("content_json", "$.message.content").alias("text"))


@query("p6_duplicate_projection", "SELECT session_id, 2 * sequence_no AS sequence_no, role, text FROM messages_v")
def _(spark, d):
    rows = messages(spark, d)
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), "text")).alias("content"))
    item = F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    echo = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.concat("role", F.lit("_message")).alias("type"), F.col("text").alias("message")).alias("payload")))
    twice = F.col("sequence_no") * 2
    found = D.codex_messages(as_lines(rows, item, twice).unionByName(as_lines(rows, echo, twice + 1)))
    return found.select("session_id", "sequence_no", "role", F.get_json_object("content_json", "$.payload.content[0].text").alias("text"))


def shown(rows: DataFrame, content, role: str) -> DataFrame:
    json = F.to_json(F.struct(F.struct(content.alias("content")).alias("message")))
    return rows.select(*M, R.preview(json, F.lit(role), F.lit("message")).alias("preview"))


def normal(sql: str) -> str:
    return NORMAL.replace("text", f"({sql})", 1)


@query("t6_output_label", f"SELECT {MKEY}, CASE WHEN length(t) <= 240 THEN t ELSE left(t, 239) || '…' END AS preview FROM (SELECT *, {normal("'output: ' || text")} AS t FROM messages_v)")
def _(spark, d):
    return shown(messages(spark, d), F.array(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content"))), "tool")


@query("t7_attachment_labels", f"SELECT {MKEY}, CASE WHEN length(t) <= 4096 THEN t ELSE left(t, 4095) || '…' END AS preview FROM (SELECT *, '[image] · [document]' || CASE WHEN {NORMAL} = '' THEN '' ELSE ' · ' || {NORMAL} END AS t FROM messages_v)")
def _(spark, d):
    block = lambda kind, text=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    return shown(messages(spark, d), F.array(block("image"), block("document"), block("text", F.col("text")), block("image")), "user")


@query("t9_joined_parts", f"SELECT {MKEY}, CASE WHEN length(t) <= 4096 THEN t ELSE left(t, 4095) || '…' END AS text FROM (SELECT *, CASE WHEN {NORMAL} IN ('', role) THEN role ELSE {NORMAL} || ' · ' || role END AS t FROM messages_v)")
def _(spark, d):
    return messages(spark, d).select(*M, R.joined(F.array("text", "role", "text", F.lit(" "), "role"), F.lit(4096)).alias("text"))


@query("t11_malformed", f"SELECT {MKEY}, CASE WHEN length(t) <= 4096 THEN t ELSE left(t, 4095) || '…' END AS preview FROM (SELECT *, {normal("'{broken ' || text")} AS t FROM messages_v)")
def _(spark, d):
    return messages(spark, d).select(*M, R.preview(F.concat(F.lit("{broken "), "text"), F.lit("user"), F.lit("message")).alias("preview"))


@query("s7_session_index", "SELECT session_id, title, cwd FROM sessions_v")
def _(spark, d):
    none = F.lit(None).cast("string")
    entry = F.struct(F.col("session_id").alias("sessionId"), F.lit(" ").alias("summary"), F.col("title").alias("firstPrompt"), none.alias("projectPath"), none.alias("created"), none.alias("modified"))
    return N.session_index(sessions(spark, d).groupBy(F.col("cwd").alias("originalPath")).agg(F.collect_list(entry).alias("entries"))).select("session_id", "title", "cwd")


@query("s8_id_list", "SELECT conv_id, turn, CASE WHEN turn % 3 > 0 AND text <> '' THEN text END AS second FROM conversations", views=False)
def _(spark, d):
    rows, odd = read(spark, d, "conversations"), F.col("turn") % 3 == 0
    json = F.when(odd, '{"projectless-thread-ids":["a",7]}').otherwise(F.to_json(F.struct(F.array(F.lit("a"), "text").alias("projectless-thread-ids"))))
    return N.id_list(rows.withColumn("json", json)).select("conv_id", "turn", F.get("ids", F.lit(1)).alias("second"))


@query("r4_framed", "SELECT session_id, count(*) + 1 AS lines, CASE WHEN any_value(source_type) = 'codex' THEN 'session_meta' ELSE 'message' END AS first_type, any_value(source_type) = 'claude' AS titled FROM messages_v GROUP BY session_id")
def _(spark, d):
    path = f"{work_dir(spark)}/framed"
    json = F.to_json(F.struct(F.lit("message").alias("type"), "role", "text"))
    lines = messages(spark, d).select("source_type", "session_id", F.col("sequence_no").alias("position"), F.lit(0).alias("ord"), json.alias("json"))
    X.write_transcripts(X.framed(lines, sessions(spark, d)), path)
    register(spark)
    kind = F.get_json_object("line", "$.type")
    found = spark.read.format("jsonl_offsets").option("path", f"{path}/*/*/*.txt").load().groupBy(F.regexp_extract("path", "session=([^/]+)/", 1).alias("session_id"))
    return found.agg(F.count("*").alias("lines"), F.min_by(kind, "start_offset").alias("first_type"), (F.max_by(kind, "start_offset") == "custom-title").alias("titled"))


@query("s16_exported", f"SELECT session_id, sequence_no AS position, text FROM messages_v")
def _(spark, d):
    path = f"{work_dir(spark)}/exported"
    lines = messages(spark, d).select("source_type", "session_id", F.col("sequence_no").alias("position"), F.lit(0).alias("ord"), F.to_json(F.struct(F.col("sequence_no").alias("n"), "text")).alias("json"))
    X.write_transcripts(lines, path)
    back = spark.read.text(path).select(F.col("session").cast("string").alias("session_id"), "value")
    return back.select("session_id", F.get_json_object("value", "$.n").cast("long").alias("position"), F.get_json_object("value", "$.text").alias("text"))


def found_data(rows: DataFrame, json) -> DataFrame:
    return rows.select(*M, F.posexplode(A.references(json)).alias("index", "r")).select(*M, "index", F.col("r.kind").alias("kind"), F.col("r.mime_type").alias("mime_type"), F.sha2(F.unbase64("r.data"), 256).alias("sha256"))


@query("b1_codex_references", f"SELECT {MKEY}, CAST(0 AS INTEGER) AS index, 'DATA_URI' AS kind, 'text/plain' AS mime_type, sha256(text) AS sha256 FROM messages_v")
def _(spark, d):
    image = F.struct(F.lit("input_image").alias("type"), F.concat(F.lit("data:text/plain;base64,"), base64(F.col("text"))).alias("image_url"))
    return found_data(messages(spark, d), F.to_json(F.struct(F.struct(F.array(image).alias("content")).alias("payload"))))


@query("b2_claude_references", f"SELECT {MKEY}, CAST(0 AS INTEGER) AS index, 'BASE64' AS kind, 'image/png' AS mime_type, sha256(text) AS sha256 FROM messages_v")
def _(spark, d):
    source = F.struct(F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), base64(F.col("text")).alias("data"))
    result = F.struct(F.lit("tool_result").alias("type"), F.array(F.struct(F.lit("image").alias("type"), source.alias("source"))).alias("content"))
    return found_data(messages(spark, d), F.to_json(F.struct(F.struct(F.array(result).alias("content")).alias("message"))))


@query("b3_placeholders", f"SELECT {MKEY}, 'blob:0' AS first, text FROM messages_v")
def _(spark, d):
    source = F.struct(F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), base64(F.concat(F.lit("x"), "text")).alias("data"))
    none = F.lit(None).cast("string")
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast(f"struct<type:string,media_type:string,data:string>").alias("source")), F.struct(F.lit("image").alias("type"), none.alias("text"), source.alias("source")))
    out = A.taken_out(messages(spark, d).withColumn("content_json", F.to_json(F.struct(F.struct(content.alias("content")).alias("message")))))
    return out.select(*M, F.get_json_object("content_json", "$.message.content[1].source.data").alias("first"), F.get_json_object("content_json", "$.message.content[0].text").alias("text"))


@query("b10_rewritten_paths", f"SELECT {MKEY}, CASE WHEN conv_id % 7 = 1 AND sequence_no % 2 = 0 THEN '/new/x' ELSE '/work/p' || CAST(conv_id % 7 AS VARCHAR) || CASE WHEN sequence_no % 2 = 0 THEN '/x' ELSE '0' END END AS cwd, text FROM messages_v")
def _(spark, d):
    cwd = F.concat(F.lit("/work/p"), (F.col("conv_id") % 7).cast("string"), F.when(F.col("sequence_no") % 2 == 0, "/x").otherwise("0"))
    json = A.rewritten_paths(F.to_json(F.struct(cwd.alias("cwd"), "text")), "/work/p1", "/new")
    return messages(spark, d).select(*M, F.get_json_object(json, "$.cwd").alias("cwd"), F.get_json_object(json, "$.text").alias("text"))


@query("j14_local_attachments", "SELECT CAST(conv_id AS VARCHAR) AS message_id, CASE WHEN conv_id % 2 = 0 THEN 'stored' ELSE 'missing' END AS status, CASE WHEN conv_id % 2 = 0 THEN sha256(text) END AS sha256 FROM conversations WHERE turn = 0", views=False)
def _(spark, d):
    first = read(spark, d, "conversations").where("turn = 0")
    path = F.concat(F.lit("/files/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    files = first.where("conv_id % 2 = 0").select(F.concat(F.lit("file:"), path).alias("path"), F.col("text").cast("binary").alias("content"))
    block = F.struct(F.lit("file").alias("type"), path.alias("path"))
    rows = first.select(F.col("conv_id").cast("string").alias("message_id"), F.to_json(F.struct(F.struct(F.array(block).alias("content")).alias("message"))).alias("content_json"))
    return A.taken_out(rows, files).select("message_id", F.explode(A.manifest(F.col("content_json"))).alias("e")).select("message_id", "e.status", "e.sha256")


@query("w3_attachment_ordinals", f"SELECT {MKEY}, i AS index, CASE i WHEN 0 THEN text ELSE 'last' END AS file_name FROM messages_v, (SELECT unnest([CAST(0 AS INTEGER), 5]) AS i)")
def _(spark, d):
    entry = lambda index, name: F.struct(F.lit(index).cast("int").alias("index"), name.alias("file_name"), F.lit("stored").alias("status"))
    json = F.to_json(F.struct(F.lit(1).alias("x"), F.array(entry(None, F.col("text")), entry(5, F.lit("first")), entry(5, F.lit("last"))).alias("_attachments")))
    return messages(spark, d).select(*M, F.explode(A.stored_attachments(json)).alias("e")).select(*M, "e.index", "e.file_name")


def collected(spark: SparkSession, d: str, sources: int = 1) -> Store:
    """All conversations written as codex transcripts and collected in commits of a third of the bytes at most.

    They are dealt to so many folders, each collected by a query of its own into the same store.
    """
    path = work_dir(spark)
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), "text")).alias("content"))
    event = F.to_json(F.struct(F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit("response_item").alias("type"), payload.alias("payload")))
    store = Store(spark, f"{path}/store", "bench")
    for k in range(sources):
        own = F.pmod("conv_id", F.lit(sources)) == k
        lines = messages(spark, d).where(own).select(F.lit("codex").alias("source_type"), "session_id", F.col("sequence_no").alias("position"), F.lit(0).alias("ord"), event.alias("json"))
        X.write_transcripts(X.framed(lines, sessions(spark, d).where(own).withColumn("source_type", F.lit("codex"))), f"{path}/transcripts{k}")
        files = f"{path}/transcripts{k}/*/*/*.txt"
        most = (listed(spark, files).agg(F.sum("size")).first()[0] or 0) // 3
        collect(spark, store, files, "codex", f"{path}/checkpoint{k}", most_bytes=most)
    return store


@query("st1_drained", "SELECT session_id, role, text FROM messages_v")
def _(spark, d):
    return collected(spark, d).messages().select("session_id", "role", F.get_json_object("content_json", "$.payload.content[0].text").alias("text"))


@query("a5_stream_merge", "SELECT session_id, title, cwd FROM sessions_v")
def _(spark, d):
    return collected(spark, d).sessions().select("session_id", "title", "cwd")


@query("s11_two_sources", "SELECT session_id, role, text FROM messages_v")
def _(spark, d):
    return collected(spark, d, 2).messages().select("session_id", "role", F.get_json_object("content_json", "$.payload.content[0].text").alias("text"))


# ---- whole texts, where another query has a role or a few fixed words --------------------------------

@query("f12_whole_percent", "SELECT conv_id, turn, 'a+b ' || text AS found FROM conversations", views=False)
def _(spark, d):
    coded = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return read(spark, d, "conversations").select("conv_id", "turn", S.percent_decoded(F.concat(F.lit("a+b%20"), coded)).cast("string").alias("found"))


@query("f15_whole_sniffed", "SELECT doc_id, ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/avif', NULL, NULL, 'image/gif'][doc_id % 8 + 1] AS mime FROM documents", views=False)
def _(spark, d):
    heads = ("89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "524946460000000057454250", "000000206674797061766966", "524946460000000057415645", "", "474946383761")
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8 + 1).cast("int")))
    return read(spark, d, "documents").select("doc_id", S.sniffed_mime(F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))).alias("mime"))


@query("f23_whole_attachment", "SELECT conv_id, turn, CASE turn WHEN 0 THEN role WHEN 1 THEN text END AS found FROM conversations", views=False)
def _(spark, d):
    stored = F.array(F.col("role").cast("binary"), F.col("text").cast("binary"))
    return read(spark, d, "conversations").select("conv_id", "turn", S.attachment_at(stored, F.col("turn").cast("int"), None).cast("string").alias("found"))


@query("t12_whole_text", f"SELECT {MKEY}, CASE WHEN sequence_no % 2 = 0 THEN text || chr(10) || chr(10) || 'b' ELSE text END AS text FROM messages_v")
def _(spark, d):
    said = F.to_json(F.struct(F.array(F.struct("text"), F.struct(F.lit("b").alias("text")), F.struct(F.lit("b").alias("text"))).alias("a"), F.lit("tool").alias("name")))
    named = F.to_json(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.col("text").alias("name"))).alias("content")))
    return messages(spark, d).select(*M, R.human_text(F.when(F.col("sequence_no") % 2 == 0, said).otherwise(named), F.lit("x")).alias("text"))


@query("t14_whole_tables", "SELECT conv_id, turn, CAST(0 AS INTEGER) AS table_no, CAST(r AS INTEGER) AS row_no, CASE WHEN r = 0 THEN ['h', 'k'] ELSE [trim(regexp_replace(text, '[^A-Za-z0-9 ]', 'x', 'g')), CAST(turn AS VARCHAR)] END AS cells, ['left', 'right'] AS alignments FROM conversations, range(2) b(r)", views=False)
def _(spark, d):
    cell = F.regexp_replace("text", "[^A-Za-z0-9 ]", "x")
    table = F.concat(F.col("text"), F.lit("\n\n| h | k |\n|:--|--:|\n| "), cell, F.lit(" | "), F.col("turn").cast("string"), F.lit(" |\n"))
    return R.pipe_tables(read(spark, d, "conversations").withColumn("text", table), "text", "conv_id", "turn")


@query("a4_whole_fold", """
SELECT source_type, session_id,
  CASE WHEN n IS NULL THEN left(trim(regexp_replace(first_text, '\\s+', ' ', 'g')), 120) WHEN n % 3 = 1 THEN 'ai ' || CAST(n AS VARCHAR) WHEN conv_id % 3 > 0 THEN 'custom ' || CAST(n AS VARCHAR) END AS title
FROM (SELECT source_type, session_id, conv_id, max(sequence_no) FILTER (WHERE sequence_no % 3 <> 0) AS n, arg_min(text, sequence_no) FILTER (WHERE sequence_no % 3 = 0) AS first_text FROM messages_v GROUP BY ALL)""")
def _(spark, d):
    n = F.col("sequence_no")
    number, third = n.cast("string"), n % 3
    rows = messages(spark, d).select(
        "source_type", "session_id", n.alias("start_offset"), F.when(third == 0, "user").when(third == 1, "ai-title").otherwise("custom-title").alias("event_type"),
        F.when(third == 0, F.col("text")).when(third == 1, F.concat(F.lit(" ai "), number)).when(F.col("conv_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("custom "), number)).alias("title_text"),
    )
    return N.titles_in_order(rows)


@query("q3_message_previews", f"""
SELECT {MKEY}, message_id, CASE WHEN length(t) <= 4096 THEN t ELSE left(t, 4095) || '…' END AS preview, CAST(CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS stored, count(*) OVER () AS total
FROM (SELECT *, CASE WHEN sequence_no % 3 = 0 THEN '' ELSE {NORMAL} END AS t FROM messages_v)
WHERE source_type = 'codex' AND role IN ('user', 'assistant') AND (t <> '' OR conv_id % 4 = 0) ORDER BY created_at DESC, session_id, sequence_no DESC LIMIT 25""")
def _(spark, d):
    block = F.struct(F.lit("input_text").alias("type"), F.when(F.col("sequence_no") % 3 == 0, " ").otherwise(F.col("text")).alias("text"))
    entries = F.when(F.col("conv_id") % 4 == 0, F.array(F.struct(F.lit(0).alias("index"), F.lit("stored").alias("status"))))
    rows = messages(spark, d).withColumn("content_json", F.to_json(F.struct(F.struct(F.array(block).alias("content")).alias("payload"), entries.alias("_attachments"))))
    return C.list_messages(rows, source_type="codex").select(*M, "message_id", "preview", F.size("stored_attachments").alias("stored"), "total")
