"""Registered queries of collecting, stores, native transcripts and attachments by position, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import json_tree as J
from convlake.operators import attachments as A
from convlake.operators import export as X
from convlake.sources import dialects as D
from convlake.sources.files import listed
from convlake.sources.jsonl import range_lines
from convlake.sources.transcripts import write_native
from convlake.streaming import publish as P
from convlake.streaming.publish import Store
from convlake.streaming.tail import drain
from convlake.work import work_dir

from .bindings import messages, read, seconds, seconds_sql, sessions
from .more_queries import base64
from .queries import MKEY, query

M = ["source_type", "session_id", "sequence_no"]


def native(spark: SparkSession, d: str, path: str, more: DataFrame | None = None) -> None:
    """All conversations, and the lines of ``more``, as transcripts of their clients, in the clients' folders below ``path``."""
    text, at = F.col("text"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    codex = F.to_json(F.struct(at.alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content")).alias("payload")))
    # only messages that Claude keeps as they are
    kind = F.when(F.col("role") == "system", "attachment").otherwise(F.col("role"))
    claude = F.to_json(F.struct(kind.alias("type"), F.col("session_id").alias("sessionId"), F.concat_ws("-", "session_id", "sequence_no").alias("uuid"), at.alias("timestamp"), F.struct("role", text.alias("content")).alias("message")))
    lines = messages(spark, d).select("source_type", "session_id", F.col("sequence_no").alias("position"), F.lit(0).alias("ord"), F.when(F.col("source_type") == "codex", codex).otherwise(claude).alias("json"))
    own = sessions(spark, d)
    framed = X.framed(lines, own)
    write_native(framed if more is None else framed.unionByName(more), own, path)


def text_of(json: str = "content_json"):
    return F.coalesce(F.get_json_object(json, "$.payload.content[0].text"), F.get_json_object(json, "$.message.content"))


def told(store: Store) -> DataFrame:
    return store.messages().select("source_type", "session_id", "role", text_of().alias("text"))


TOLD = "SELECT source_type, session_id, role, text FROM messages_v"


def folders(path: str) -> dict[str, str]:
    return {"codex": f"{path}/codex", "claude": f"{path}/claude/projects"}


@query("s16_round_trip", TOLD)
def _(spark, d):
    path = work_dir(spark)
    native(spark, d, f"{path}/native")
    store = Store(spark, f"{path}/store", "bench")
    drain(spark, store, folders(f"{path}/native"))
    return told(store)


@query("s3_threads", f"SELECT session_id, cwd, archived FROM sessions_v WHERE source_type = 'codex'")
def _(spark, d):
    path = work_dir(spark)
    native(spark, d, path)
    files = listed(spark, f"{path}/codex")
    lines = range_lines(files.select("path", F.lit(0).cast("long").alias("low"), F.col("size").alias("high")))
    return D.codex_sessions(lines).select("session_id", "cwd", "archived")


@query("s4_projects", "SELECT session_id, count(*) AS messages, any_value(conv_id) % 7 AS project FROM messages_v WHERE source_type = 'claude' GROUP BY session_id")
def _(spark, d):
    path = work_dir(spark)
    native(spark, d, path)
    files = listed(spark, f"{path}/claude/projects", layout="projects")
    lines = range_lines(files.select("path", F.lit(0).cast("long").alias("low"), F.col("size").alias("high")))
    folder = F.regexp_extract("path", "/-work-p([0-9]+)/[^/]+$", 1).cast("long")
    return D.claude_messages(lines).groupBy("session_id", folder.alias("project")).agg(F.count("*").alias("messages"))


@query("s2_two_triggers", TOLD)
def _(spark, d):
    """The first wake-up sees every file up to its middle, wherever that is in a line."""
    path = work_dir(spark)
    native(spark, d, f"{path}/native")
    store, paths = Store(spark, f"{path}/store", "bench"), folders(f"{path}/native")
    drain(spark, store, paths, listing={s: listed(spark, p).withColumn("size", F.floor(F.col("size") / 2)) for s, p in paths.items()})
    drain(spark, store, paths)
    return told(store)


@query("st9_bounded", "SELECT source_type, session_id, count(*) AS messages, true AS bounded FROM messages_v GROUP BY source_type, session_id")
def _(spark, d):
    """Commits of a quarter of all bytes: none is larger, and nothing is left or read twice."""
    path = work_dir(spark)
    native(spark, d, f"{path}/native")
    store, paths = Store(spark, f"{path}/store", "bench"), folders(f"{path}/native")
    most = -(-sum(listed(spark, p).agg(F.sum("size")).first()[0] for p in paths.values()) // 4)
    drain(spark, store, paths, most_bytes=most)
    sizes = spark.read.schema(P.INTENTS).parquet(f"{store.path}/intents").groupBy("version").agg(F.sum(F.col("high") - F.col("low")).alias("n"))
    bounded = sizes.agg(F.bool_and(F.col("n") <= most).alias("bounded"))
    return store.messages().groupBy("source_type", "session_id").agg(F.count("*").alias("messages")).join(F.broadcast(bounded))


def resumed(spark: SparkSession, d: str, stop: str) -> Store:
    """Half of every file collected, the next commit stopped as a lost driver would, and then all of it."""
    path = work_dir(spark)
    native(spark, d, f"{path}/native")
    store, paths = Store(spark, f"{path}/store", "bench"), folders(f"{path}/native")
    drain(spark, store, paths, listing={s: listed(spark, p).withColumn("size", F.floor(F.col("size") / 2)) for s, p in paths.items()})
    drain(spark, store, paths, stop_after=stop)
    drain(spark, store, paths)
    return store


@query("st6_redone", TOLD)
def _(spark, d):
    return told(resumed(spark, d, "pending"))


@query("st5_resumed", TOLD)
def _(spark, d):
    return told(resumed(spark, d, "messages"))


@query("st2_once", "SELECT source_type, session_id, CAST(1 AS BIGINT) AS commits FROM sessions_v")
def _(spark, d):
    """Wake-ups that find nothing new commit nothing."""
    path = work_dir(spark)
    native(spark, d, f"{path}/native")
    store = Store(spark, f"{path}/store", "bench")
    for _ in range(2):
        drain(spark, store, folders(f"{path}/native"))
    return store.sessions().select("source_type", "session_id", F.lit(store.next_commit()).cast("long").alias("commits"))


@query("s14_layouts", f"SELECT source_type, session_id, title, CASE WHEN conv_id % 3 > 0 THEN '{{}}' END AS subagent_source_json, CASE WHEN conv_id % 3 = 2 THEN projectless END AS projectless FROM sessions_v")
def _(spark, d):
    """Sessions written in three layouts, read in the present one."""
    store = Store(spark, f"{work_dir(spark)}/store", "bench")
    own = sessions(spark, d).withColumns({"subagent_source_json": F.lit("{}"), "last_commit_id": F.lit(0).cast("long"), "pending_commit_id": F.lit(None).cast("long")})
    for k, missing in enumerate(P.LAYOUTS[:3]):
        rows = P.assert_schema(own.where(F.col("conv_id") % 3 == k).withColumn("version", F.lit(2 * k + 1).cast("long")).drop("conv_id", "last_message_at", "ingested_at", "parent_id"), P.SESSIONS)
        rows.drop(*missing).write.parquet(f"{store.path}/sessions/part={2 * k + 1}")
    store.claim()
    return store.sessions().select("source_type", "session_id", "title", "subagent_source_json", "projectless")


@query("s15_owner", f"SELECT {MKEY}, 'bench' AS owner FROM messages_v")
def _(spark, d):
    """Another writer is refused, and what is stored stays."""
    from .job_queries import published

    store = published(spark, d)
    try:
        Store(spark, store.path, "another").claim()
        owner = "another"
    except PermissionError:
        owner = store.contract()[0]
    return store.messages().select(*M, F.lit(owner).alias("owner"))


@query("s12_compacted", "SELECT source_type, session_id, max(sequence_no) AS cursor_offset, true AS small FROM messages_v GROUP BY source_type, session_id")
def _(spark, d):
    """A commit for every turn, with a snapshot in between."""
    store = Store(spark, f"{work_dir(spark)}/store", "bench")
    rows = messages(spark, d).withColumn("content_json", F.to_json(F.struct("role", "text"))).select("message_id", *M, "role", "event_type", "content_json", "created_at")
    for turn in range(3):
        own = rows.where(F.least(F.col("sequence_no"), F.lit(2)) == turn)
        store.publish(own.groupBy("source_type", "session_id").agg(F.max("sequence_no").alias("cursor_offset")), own, turn)
        store.compact()
    small = len(store._parts("sessions")) <= 4
    return store.sessions().select("source_type", "session_id", "cursor_offset", F.lit(small).alias("small"))


@query("s13_refused", f"SELECT {MKEY}, true AS refused FROM messages_v")
def _(spark, d):
    """Messages of another schema are refused, and what is stored stays."""
    from .job_queries import published

    store = published(spark, d)
    try:
        P.assert_schema(store.messages().withColumn("sequence_no", F.col("sequence_no").cast("string")), P.MESSAGES)
        refused = False
    except ValueError:
        refused = True
    return store.messages().select(*M, F.lit(refused).alias("refused"))


@query("st3_cursors", "SELECT source_type, session_id, true AS at_end FROM sessions_v")
def _(spark, d):
    """Every cursor stands where its file ends, after a commit that was stopped and done again."""
    store = resumed(spark, d, "intent")
    ends = store.positions().select(F.col("path").alias("source_path"), F.col("high").alias("size"))
    return store.sessions().join(ends, "source_path").select("source_type", "session_id", (F.col("cursor_offset") == F.col("size")).alias("at_end"))


@query("st4_rewritten", f"{TOLD} UNION ALL SELECT source_type, session_id, 'user', 'added' FROM sessions_v")
def _(spark, d):
    """Every file is replaced by one with a line more in front and one behind: only the last is new."""
    path, extra = work_dir(spark), sessions(spark, d).select("source_type", "session_id")
    codex = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.lit("added").alias("text"))).alias("content")).alias("payload")))
    claude = F.to_json(F.struct(F.lit("user").alias("type"), F.concat("session_id", F.lit("-added")).alias("uuid"), F.struct(F.lit("user").alias("role"), F.lit("added").alias("content")).alias("message")))
    line = lambda at, json: extra.select("source_type", "session_id", F.lit(at).cast("long").alias("position"), F.lit(1).alias("ord"), json.alias("json"))
    store, paths = Store(spark, f"{path}/store", "bench"), folders(f"{path}/native")
    native(spark, d, f"{path}/native")
    drain(spark, store, paths)
    more = line((1 << 63) - 1, F.when(F.col("source_type") == "codex", codex).otherwise(claude))
    native(spark, d, f"{path}/native", line(-2, F.lit('{"type":"summary"}')).unionByName(more))
    drain(spark, store, paths)
    return told(store)


@query("st11_progress", "SELECT CAST(0 AS BIGINT) AS commit_id, count(DISTINCT source_type || session_id) AS sessions, count(*) AS messages, 'done' AS state FROM messages_v")
def _(spark, d):
    path = work_dir(spark)
    native(spark, d, f"{path}/native")
    store = Store(spark, f"{path}/store", "bench")
    drain(spark, store, folders(f"{path}/native"))
    return store.progress()


@query("q4_whole_detail", f"SELECT {MKEY}, message_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, 'stored' AS status, false AS cut FROM messages_v WHERE source_type = 'codex' AND session_id = '4' AND sequence_no = 1")
def _(spark, d):
    """A message with its text attached: what the detail's manifest says."""
    from convlake.operators import catalog as C

    source = F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), base64(F.col("text")).alias("data"))
    json = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("document").alias("type"), source.alias("source"))).alias("content")).alias("message")))
    found = C.message_detail(A.taken_out(C.matching(messages(spark, d).withColumn("content_json", json), source_type="codex", session_id="4", sequence_no=1)))
    return found.select(*M, "message_id", "cut", F.explode("manifest").alias("e")).select(*M, "message_id", "e.sha256", "e.size", "e.status", "cut")


# ---- attachments by position ---------------------------------------------------------------------

def documents(spark: SparkSession, d: str, content) -> DataFrame:
    """Every document as a message whose content is ``content``."""
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("message_id"), "text", F.to_json(F.struct(F.struct(content.alias("content")).alias("message"))).alias("content_json"))


def uri(text):
    return F.concat(F.lit("data:text/plain,"), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")))


@query("b1_percent", "SELECT CAST(doc_id AS VARCHAR) AS message_id, 'stored' AS status, strlen('a+' || coalesce(text, '')) AS size, sha256('a+' || coalesce(text, '')) AS sha256 FROM documents", views=False)
def _(spark, d):
    """Percent-encoded data URIs, in which a plus stays a plus."""
    value = F.concat(F.lit("data:text/plain,a+"), F.substring(uri(F.coalesce("text", F.lit(""))), F.lit(17), F.lit(1 << 30)))
    rows = A.taken_out(documents(spark, d, F.array(F.struct(F.lit("input_image").alias("type"), value.alias("image_url")))))
    e = F.get(A.manifest(F.col("content_json")), F.lit(0))
    return rows.select("message_id", e["status"].alias("status"), e["size"].alias("size"), F.sha2(F.get("attachments", F.lit(0)), 256).alias("sha256"))


@query("b2_deep", "SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(i AS INTEGER) AS index, CASE i WHEN 0 THEN 'outer' ELSE 'inner ' || CAST(doc_id AS VARCHAR) END AS file_name, sha256(CASE i WHEN 0 THEN 'o' ELSE 'i' END || coalesce(text, '')) AS sha256 FROM documents, range(2) r(i)", views=False)
def _(spark, d):
    """Documents with titles, one four containers deep in a tool's result."""
    own = F.coalesce(F.col("text"), F.lit(""))
    image = lambda head, title: F.struct(F.lit("document").alias("type"), title.alias("title"), F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), base64(F.concat(F.lit(head), own)).alias("data")).alias("source"))
    block = F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.array(image("i", F.concat(F.lit("inner "), F.col("doc_id").cast("string")))).alias("content"))).alias("nested"))
    content = F.array(F.struct(F.array(image("o", F.lit("outer"))).alias("a"), F.struct(F.array(block).alias("b")).alias("c")))
    rows = A.taken_out(documents(spark, d, content)).select("message_id", "attachments", F.explode(A.manifest(F.col("content_json"))).alias("e"))
    return rows.select("message_id", "e.index", "e.file_name", F.sha2(F.get("attachments", F.col("e.index")), 256).alias("sha256"))


@query("b3_equal_text", "SELECT CAST(doc_id AS VARCHAR) AS message_id, true AS text_stays, 'blob:0' AS data, true AS comes_back FROM documents WHERE text <> ''", views=False)
def _(spark, d):
    """A text that equals an attachment's data stays, and putting back gives what was there, byte for byte."""
    data = base64(F.col("text"))
    source = F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), data.alias("data"))
    none = F.lit(None).cast("struct<type:string,media_type:string,data:string>")
    content = F.array(F.struct(F.lit("text").alias("type"), data.alias("text"), none.alias("source")), F.struct(F.lit("document").alias("type"), F.lit(None).cast("string").alias("text"), source.alias("source")))
    rows = documents(spark, d, content).where("text <> ''").withColumns({"was": F.col("content_json"), "data": data})
    rows = A.put_back(A.taken_out(rows).withColumn("taken", F.col("content_json")))
    return rows.select("message_id", (F.get_json_object("taken", "$.message.content[0].text") == F.col("data")).alias("text_stays"), F.get_json_object("taken", "$.message.content[1].source.data").alias("data"), (F.col("content_json") == F.col("was")).alias("comes_back"))


@query("b9_missing", "SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(CASE i WHEN 0 THEN 0 ELSE 2 END AS INTEGER) AS index, CASE i WHEN 0 THEN 'read_error' ELSE 'missing' END AS status FROM documents, range(2) r(i)", views=False)
def _(spark, d):
    """What couldn't be stored is listed when a message is put back: broken data and a file that isn't there, not what is remote."""
    image = lambda url: F.struct(F.lit("input_image").alias("type"), url.alias("image_url"))
    content = F.array(image(F.concat(F.lit("data:text/plain;base64,*"), F.coalesce("text", F.lit("")))), image(F.lit("https://h.org/i.png")), image(F.concat(F.lit("/none/"), F.col("doc_id").cast("string"))))
    rows = A.put_back(A.taken_out(documents(spark, d, content)))
    lost = F.from_json(F.get_json_object("content_json", "$._missing_attachments"), "array<struct<index:int,status:string>>")
    return rows.select("message_id", F.explode(lost).alias("e")).select("message_id", "e.index", "e.status")


@query("j14_resolved", "SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS message_id, CASE WHEN turn % 5 = 4 THEN 'missing' ELSE 'stored' END AS status, CASE WHEN turn % 5 < 4 THEN sha256(text) END AS sha256, CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '.txt' AS file_name FROM conversations", views=False)
def _(spark, d):
    """Paths below home, beside the transcript, above it, as a file URI, and of a file that isn't there."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(".txt"))
    rows, n = read(spark, d, "conversations"), F.col("turn") % 5
    there = F.when(n == 0, F.concat(F.lit("/home/me/docs/"), name)).when(n == 1, F.concat(F.lit("/logs/day/"), name)).when(n == 2, F.concat(F.lit("/logs/"), name)).when(n == 3, F.concat(F.lit("/other place/"), name))
    said = F.when(n == 0, F.concat(F.lit("~/docs/"), name)).when(n == 1, F.concat(F.lit("./"), name)).when(n == 2, F.concat(F.lit("../x/../"), name)).when(n == 3, F.concat(F.lit("file:///other%20place/"), name)).otherwise(F.concat(F.lit("/gone/"), name))
    files = rows.where(n < 4).select(F.concat(F.lit("file:"), there).alias("path"), F.col("text").cast("binary").alias("content"))
    block = F.struct(F.lit("file").alias("type"), said.alias("path"))
    found = rows.select(F.concat_ws(".", "conv_id", "turn").alias("message_id"), F.to_json(F.struct(F.struct(F.array(block).alias("content")).alias("message"))).alias("content_json"))
    found = A.taken_out(found, files, base=F.lit("/logs/day"), home="/home/me")
    return found.select("message_id", F.explode(A.manifest(F.col("content_json"))).alias("e")).select("message_id", "e.status", "e.sha256", "e.file_name")


@query("t12_all_texts", f"SELECT {MKEY}, text || chr(10) || chr(10) || 'said ' || role || chr(10) || chr(10) || 'out ' || text AS text FROM messages_v")
def _(spark, d):
    """Texts, contents of messages and outputs of results, at any depth, each once."""
    text, none = F.col("text"), F.lit(None).cast("string")
    part = lambda kind, **said: F.struct(F.lit(kind).alias("type"), *(said.get(n, none).alias(n) for n in ("text", "content", "output", "name")))
    inner = F.array(part("output_text", text=text), part("message", content=F.concat(F.lit("said "), F.col("role"))), part("tool_result", output=F.concat(F.lit("out "), text)), part("text", text=text), part("tool_use", name=F.lit("grep")))
    return messages(spark, d).select(*M, J.human_text(F.to_json(F.struct(F.struct(F.struct(inner.alias("content")).alias("a")).alias("payload"))), F.lit("x")).alias("text"))


@query("f10_in_order", f"SELECT {MKEY}, text AS found FROM messages_v")
def _(spark, d):
    """The first of its name in the order of the text: a blank one, and one deeper but later, don't count."""
    deep = F.struct(F.lit(" ").alias("k"), F.struct(F.col("text").alias("k")).alias("z"))
    late = F.struct(F.array(F.struct(F.lit("later").alias("k"))).alias("k"))
    json = F.to_json(F.struct(deep.alias("zz"), late.alias("aa")))
    return messages(spark, d).select(*M, J.first_scalar(json, "k").alias("found"))
