"""Byte offsets, dialects, streams and publishing, on transcripts written here."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from convlake.functions import scalars
from convlake.operators import attachments as A
from convlake.operators import sessions as N
from convlake.operators.turns import turns
from convlake.sources.dialects import claude_messages, codex_messages, codex_sessions, cursors
from convlake.sources.jsonl import register
from convlake.streaming.incremental import StatusTable, recovery
from convlake.streaming.publish import MESSAGES, Store, assert_schema
from convlake.streaming.tail import collect

META = {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s1", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "source": "cli"}}


def said(role, text, at="2026-01-01T00:00:01Z"):
    return {"timestamp": at, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}


def lines_of(*events):
    return "".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events)


def read(spark, path, **options):
    register(spark)
    return spark.read.format("jsonl_offsets").option("path", str(path)).options(**options).load()


@pytest.mark.parametrize("size", [1, 7, 16, 1000])
def test_offsets_are_exact_in_any_ranges(spark, tmp_path, size):
    parts = [b'{"a":1}\n', b"\r\n", b"\n", '{"é":"\U0001f600"}\r\n'.encode(), b"x" * 40 + b"\n", b'{"partial":']
    (tmp_path / "a.jsonl").write_bytes(b"".join(parts))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    rows = sorted(read(spark, tmp_path, rangeBytes=size).collect(), key=lambda r: r.start_offset)
    at, want = 0, []
    for p in parts:
        want.append((at, at + len(p), p.rstrip(b"\n").removesuffix(b"\r").decode(), p.endswith(b"\n")))
        at += len(p)
    assert [tuple(r)[1:] for r in rows] == want


def test_codex(spark, tmp_path):
    (tmp_path / "archived_sessions").mkdir()
    path = tmp_path / "archived_sessions" / "r.jsonl"
    call = {"timestamp": "bad", "type": "response_item", "payload": {"type": "function_call", "name": "f"}}
    out = {"type": "response_item", "payload": {"type": "function_call_output", "output": "ok"}}
    echo = {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}
    image = {"type": "event_msg", "payload": {"type": "image_generation_end", "result": ""}}
    path.write_text(lines_of(META, said("user", "hi"), echo, call, out, image) + "not json\n\n" + '{"partial":', encoding="utf-8")
    lines = read(spark, tmp_path)
    rows = codex_messages(lines).orderBy("sequence_no").collect()
    assert [(r.role, r.event_type) for r in rows] == [("user", "message"), ("assistant", "function_call"), ("tool", "function_call_output"), ("assistant", "image_generation_end"), ("unknown", "parse_error")]
    assert {r.session_id for r in rows} == {"s1"} and rows[1].created_at is None
    assert json.loads(rows[-1].content_json) == {"_parse_error": True, "raw_line": "not json"}
    assert rows[0].content_json == json.dumps(said("user", "hi"))
    meta = codex_sessions(lines).collect()
    assert [(m.session_id, m.cwd, m.archived) for m in meta] == [("s1", "/w", True)]
    assert cursors(lines).first().cursor_offset == len(path.read_bytes()) - len('{"partial":')


def test_claude(spark, tmp_path):
    path = tmp_path / "s9.jsonl"
    events = [
        {"type": "user", "sessionId": "s9", "uuid": "u1", "timestamp": 1767225600, "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "sessionId": "other", "uuid": "u2", "message": {"role": "assistant", "content": "no"}},
        {"type": "system", "sessionId": "s9"},
        {"type": "system", "sessionId": "s9", "message": {"content": "x"}},
        {"type": "summary", "summary": "s"},
        {"type": "attachment", "timestamp": "2026-01-01T00:00:00Z"},
    ]
    path.write_text(lines_of(*events), encoding="utf-8")
    rows = claude_messages(read(spark, path)).orderBy("sequence_no").collect()
    assert [(r.role, r.event_type) for r in rows] == [("user", "user"), ("system", "system"), ("attachment", "attachment")]
    again = claude_messages(read(spark, path, rangeBytes=10)).collect()
    assert {r.message_id for r in rows} == {r.message_id for r in again}


def test_id_list_and_index(spark):
    docs = spark.createDataFrame([('{"projectless-thread-ids":["a","b"]}',), ('{"projectless-thread-ids":["a",7]}',), ('{"projectless-thread-ids":["a"," "]}',), ("broken",), ("{}",)], "json string")
    assert [r.ids for r in N.id_list(docs).collect()] == [["a", "b"], None, None, None, None]
    schema = "originalPath string, entries array<struct<sessionId:string,summary:string,firstPrompt:string,projectPath:string,created:string,modified:string>>"
    index = spark.createDataFrame([("/o", [("1", " ", "first", None, "2026-01-01T00:00:00Z", "1767225600000"), ("2", "sum", "first", "/p", None, None), (" ", "x", None, None, None, None)])], schema)
    assert [(r.session_id, r.title, r.cwd) for r in N.session_index(index).collect()] == [("1", "first", "/o"), ("2", "sum", "/p")]


def test_fair_share(spark):
    rows = [(s, p, o) for s, files in (("a", 3), ("b", 1)) for p in range(files) for o in range(10 if s == "a" else 2)]
    got = N.fair_share(spark.createDataFrame(rows, "source string, path int, offset int"), 6).collect()
    assert len(got) == 6 and sum(r.source == "b" for r in got) == 2
    assert sorted({r.path for r in got if r.source == "a"}) == [0, 1, 2]
    with_first = {(r.source, r.path): r.offset for r in sorted(got, key=lambda r: -r.offset)}
    assert set(with_first.values()) == {0}


def test_attachments_round_trip(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"data"
    data = base64.b64encode(png).decode()
    content = [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": data}}, {"type": "input_image", "image_url": "https://u:p@h.org:8/x?q=1#f"}, {"type": "text", "text": "## n.txt: /tmp/n.txt\n## gone: /tmp/gone"}]
    before = json.dumps({"message": {"content": content}, "z": 1, "a": 2})
    rows = spark.createDataFrame([("m", before), ("plain", '{"a": 1 }')], "message_id string, content_json string")
    files = spark.createDataFrame([("file:/tmp/n.txt", bytearray(b"note"))], "path string, content binary")
    out = {r.message_id: r for r in A.taken_out(rows, files).collect()}
    m = out["m"]
    assert [None if x is None else bytes(x) for x in m.attachments] == [png, None, b"note", None]
    entries = json.loads(m.content_json)["_attachments"]
    assert [e["status"] for e in entries] == ["stored", "remote_not_downloaded", "stored", "missing"]
    assert entries[1]["source_reference"] == "https://h.org:8/x" and entries[0]["mime_type"] == "image/png" and entries[2]["file_name"] == "n.txt"
    assert data not in m.content_json and m.content_json.startswith(before[:-1].replace(data, "blob:0"))
    assert out["plain"].content_json == '{"a": 1 }' and out["plain"].attachments is None
    small = {r.message_id: r for r in A.taken_out(rows, files, most=3).collect()}["m"]
    assert [e["status"] for e in json.loads(small.content_json)["_attachments"]][::2] == ["too_large", "too_large"] and small.attachments[0] is None
    stored = A.taken_out(rows, files)
    assert [e["index"] for e in stored.select(A.stored_attachments(F.col("content_json")).alias("s")).first().s] == [0, 2]
    assert bytes(A.lookup(stored.where("message_id = 'm'"), 2).first().data) == b"note"
    assert [r.present for r in A.pending_detail(stored).orderBy("index").collect()] == [True, False, True, False]
    back = A.put_back(stored.where("message_id = 'm'")).first().content_json
    assert json.loads(back)["message"]["content"][0] == content[0]
    moved = spark.range(1).select(A.rewritten_paths(F.lit('{"path":"/a/b","text":"/a/b"}'), "/a", "/c$1").alias("t")).first().t
    assert moved == '{"path":"/c$1/b","text":"/a/b"}'


def test_stream_and_replay(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), "me")
    src.mkdir()
    path = src / "r.jsonl"
    path.write_text(lines_of(META, said("user", "one")) + '{"part', encoding="utf-8")
    progress = StatusTable(spark, str(tmp_path / "status"))
    spark.streams.addListener(progress)
    run = lambda: collect(spark, store, str(src), "codex", str(tmp_path / "cp")).awaitTermination(120)
    assert run()
    assert [r.sequence_no for r in store.messages().collect()] == [len(lines_of(META))]
    with path.open("a", encoding="utf-8") as f:
        f.write('": 1}\n' + lines_of(said("assistant", "two")))
    assert run()
    rows = store.messages().orderBy("sequence_no").collect()
    assert [(r.role, r.session_id) for r in rows] == [("user", "s1"), ("assistant", "s1")]
    assert {r.message_id for r in rows} == {r.message_id for r in codex_messages(read(spark, src)).collect()}
    s = store.sessions().first()
    assert (s.title, s.cwd, s.cursor_offset, s.last_commit_id) == ("one", "/w", len(path.read_bytes()), 1)
    assert run() and store.messages().count() == 2
    spark.streams.removeListener(progress)
    told = progress.table().collect()
    assert {r.state for r in told} >= {"started", "running"} and len({r.query for r in told}) == 1 and {r.batch_id for r in told if r.state == "running"} >= {0, 1}
    assert sorted((r.commit_id, r.messages, r.state) for r in store.progress().collect()) == [(0, 1, "done"), (1, 1, "done")]
    plan = store.messages().select("message_id", "role")._jdf.queryExecution().executedPlan().toString()
    assert "attachments" not in plan and "content_json" not in plan  # a narrow list reads narrow columns
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "store"), "you").claim()


def test_publish_is_atomic_and_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "me")
    state = spark.createDataFrame([("codex", "a", "t", 10)], "source_type string, session_id string, title string, cursor_offset long")
    rows = spark.createDataFrame([(f"m{i}", "codex", "a", i, "user", "message", "{}") for i in (1, 2, 2)], "message_id string, source_type string, session_id string, sequence_no long, role string, event_type string, content_json string")
    store.publish(state, rows, 0)
    assert store.messages().count() == 2
    more = rows.withColumn("message_id", F.concat("message_id", F.lit("x")))
    for stop in ("pending", "messages"):
        store.publish(state.withColumn("title", F.lit("new")), more, 1, stop_after=stop)
        assert store.messages().count() == 2 and store.sessions().first().pending_commit_id == 1 and store.next_commit() == 1
    assert [tuple(r)[2:] for r in recovery(store.sessions(), state).collect()] == [(1, True)]
    for _ in range(2):
        store.publish(state.withColumn("title", F.lit("new")), more, 1)
        assert store.messages().count() == 4 and store.sessions().first().title == "new" and store.next_commit() == 2
    with pytest.raises(ValueError, match="unknown"):
        assert_schema(rows.withColumn("other", F.lit(1)), MESSAGES)
    with pytest.raises(ValueError, match="missing"):
        assert_schema(rows.drop("message_id"), MESSAGES)


def claude_said(session, k, text):
    return {"type": "user", "sessionId": session, "uuid": f"{session}-{k}", "timestamp": 1767225600 + k, "message": {"role": "user", "content": text}}


def test_two_sources_share_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "me")
    for name, text in (("codex/r.jsonl", lines_of(META, said("user", "one"))), ("claude/c1.jsonl", lines_of(claude_said("c1", 0, "two")))):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text, encoding="utf-8")
    run = lambda source, cp: collect(spark, store, str(tmp_path / source), source, str(tmp_path / cp))
    run("codex", "a"), run("claude", "b")
    with (tmp_path / "codex/r.jsonl").open("a", encoding="utf-8") as f:
        f.write(lines_of(said("assistant", "three")))
    run("codex", "another folder")  # a lost checkpoint reads nothing twice
    rows = store.messages().collect()
    assert sorted((r.source_type, r.session_id, r.commit_id) for r in rows) == [("claude", "c1", 1), ("codex", "s1", 0), ("codex", "s1", 2)]
    meta = spark.createDataFrame([("claude", "c1", "renamed")], "source_type string, session_id string, title string")
    for _ in range(2):
        collect(spark, store, str(tmp_path / "claude"), "claude", str(tmp_path / "b"), metadata=meta)
    assert [(r.title, r.last_commit_id) for r in store.sessions().where("session_id = 'c1'").collect()] == [("renamed", 3)]
    assert store.messages().count() == 3


def test_bounded_batches_are_drained(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "me")
    (tmp_path / "in").mkdir()
    events = [claude_said("c", k, f"text {k}") for k in range(5)]
    (tmp_path / "in" / "c.jsonl").write_text(lines_of(*events, {"type": "ai-title", "aiTitle": "A title"}), encoding="utf-8")
    collect(spark, store, str(tmp_path / "in"), "claude", str(tmp_path / "cp"), most_bytes=300)
    assert store.messages().count() == 5 and store.messages().select("commit_id").distinct().count() > 1
    s = store.sessions().first()
    assert s.title == "A title" and s.cursor_offset == (tmp_path / "in" / "c.jsonl").stat().st_size
    assert s.created_at.timestamp() == 1767225600 and s.updated_at.timestamp() == 1767225604


def test_rewritten_files_are_never_replayed(spark, tmp_path):
    from convlake.operators.export import marked

    store, src = Store(spark, str(tmp_path / "store"), "me"), tmp_path / "in"
    src.mkdir()
    first = {n: lines_of(*(claude_said(n, k, f"text {k}") for k in range(3))) for n in ("short", "shifted", "moved", "restored", "plain")}
    for n, text in first.items():
        (src / f"{n}.jsonl").write_text(text, encoding="utf-8")
    run = lambda: collect(spark, store, str(src), "claude", str(tmp_path / "cp"))
    run()
    more = {n: lines_of(claude_said(n, 9, "more")) for n in first}
    (src / "short.jsonl").write_text(lines_of(claude_said("short", 5, "other")), encoding="utf-8")  # the anchor is gone
    (src / "shifted.jsonl").write_text(lines_of({"type": "summary", "summary": "new line"}) + first["shifted"] + more["shifted"], encoding="utf-8")
    (src / "moved.jsonl").rename(src / "sub" / "moved.jsonl" if (src / "sub").mkdir() else src / "sub" / "moved.jsonl")
    with (src / "sub" / "moved.jsonl").open("a", encoding="utf-8") as f:
        f.write(more["moved"])
    last = spark.createDataFrame([("claude", "restored", 0, 0, '{"type":"custom-title"}')], "source_type string, session_id string, position long, ord int, json string")
    (src / "restored.jsonl").write_text(lines_of(claude_said("restored", 0, "as restored")) + marked(last, store.sessions()).first().json + "\n" + more["restored"], encoding="utf-8")
    with (src / "plain.jsonl").open("a", encoding="utf-8") as f:
        f.write(more["plain"])
    for _ in range(2):
        run()
        rows = store.messages().collect()
        count = {n: sum(r.session_id == n for r in rows) for n in first}
        assert count == {"short": 3, "shifted": 4, "moved": 4, "restored": 4, "plain": 4}
        assert len({r.message_id for r in rows}) == len(rows)


def test_turn_rules(spark):
    rows = [
        ("user", "<environment_context>", 1, None), ("user", "ask", 2, None), ("user", "# AGENTS.md instructions\n\n<INSTRUCTIONS>x", 3, None), ("assistant", "a", 4, None),
        ("user", "cancelled", 5, None), ("user", "again", 6, None), ("user", "same time", 6, None), ("assistant", "final", 7, "final_answer"), ("assistant", "stray", 8, None),
        ("user", "next", 9, None), ("user", "no time", None, None), ("user", "no time either", None, None), ("user", "# AGENTS.md is a file", 10, None), ("assistant", "b", 11, "final_answer"), ("assistant", "after all", 12, None),
    ]
    df = spark.createDataFrame([("codex", "s", i, *r) for i, r in enumerate(rows)], "source_type string, session_id string, sequence_no long, role string, text string, created_at long, phase string")
    got = turns(df).orderBy("sequence_no").collect()
    assert [r.turn_no for r in got] == [1, 1, 1, 1, 2, 3, 3, 3, 4, 4, 5, 6, 7, 7, 0]
    assert {r.turn_no for r in got if r.cancelled} == {2, 5, 6}


def test_fair_share_rotates(spark):
    rows = [(s, p, o) for s in "abc" for p in range(3) for o in range(5)]
    df = spark.createDataFrame(rows, "source string, path int, offset int")
    first = [[(r.source, r.path) for r in N.fair_share(df, 1, turn).collect()] for turn in range(3)]
    assert [x[0] for x in first] == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(r.source for r in N.fair_share(df, 6, 4).collect()) == list("aabbcc")


def test_small_rules(spark):
    docs = [('{"a":{"k":7}}', "7"), ('{"b":[{"k":"  "},{"k":"x\\n"}]}', "x\n"), ('{"a":{"k":"in"},"k":"top"}', "top"), ('{"k":{"k":true}}', "true"), ("{}", None)]
    got = spark.createDataFrame(docs, "d string, want string").select(scalars.deep_find(F.col("d"), "k").alias("k"), "want").collect()
    assert all(r.k == r.want for r in got), got
    text = '{"cwd":"/ab","path":"/a","file_path":"/a/c"}'
    assert spark.range(1).select(A.rewritten_paths(F.lit(text), "/a", "/z").alias("t")).first().t == '{"cwd":"/ab","path":"/z","file_path":"/z/c"}'
    data = base64.b64encode(b"some bytes").decode()
    before = json.dumps({"message": {"content": [{"type": "text", "text": f"blob:0 and {data}"}, {"type": "text", "text": "blob:0"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": data}}, {"type": "input_image", "image_url": "data:image/png;base64," + data}]}})
    rows = spark.createDataFrame([("m", before)], "message_id string, content_json string")
    out = A.taken_out(rows)
    assert json.loads(out.first().content_json)["message"]["content"][0]["text"] == f"blob:0 and {data}"
    assert A.put_back(out).first().content_json == before


def test_small_files_share_a_task():
    from convlake.sources.jsonl import OPEN_BYTES, Range, shares

    found = [Range(str(k), 0, 10, 10) for k in range(7)] + [Range("large", 0, 5 * OPEN_BYTES, 5 * OPEN_BYTES)]
    parts = shares(found, 4 * OPEN_BYTES)
    assert [r for p in parts for r in p.ranges] == found
    assert [len(p.ranges) for p in parts] == [3, 3, 1, 1]
    assert shares([], 10) == [] and [len(p.ranges) for p in shares(found, 1)] == [1] * 8
