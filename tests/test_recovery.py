"""Commits that were begun and not finished, bounded commits, snapshots, and stores that only Spark opens."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from convlake.sources.files import listed
from convlake.sources.jsonl import range_lines, spark_lines
from convlake.streaming import publish as P
from convlake.streaming import tail
from convlake.streaming.publish import Store
from convlake.streaming.tail import drain, share, update_metadata

from .test_sources import claude_said, lines_of, read


def rows_of(store):
    found = sorted((r.message_id, r.session_id, r.sequence_no, r.content_json) for r in store.messages().collect())
    state = sorted((r.session_id, r.title, r.cursor_offset, r.cursor_anchor, r.pending_commit_id, r.last_commit_id) for r in store.sessions().collect())
    return found, state


def test_begun_commits_are_finished(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in "ab":
        (src / f"{n}.jsonl").write_text(lines_of(claude_said(n, 0, f"first {n}")), encoding="utf-8")
    stores = {name: Store(spark, str(tmp_path / name), "me") for name in ("plain", "intent", "pending", "messages")}
    assert drain(spark, stores["pending"], {"claude": str(src)}) == "done"
    with (src / "a.jsonl").open("a", encoding="utf-8") as f:
        f.write(lines_of(*(claude_said("a", k, f"more {k}") for k in (1, 2))))
    for stop in ("intent", "pending", "messages"):
        store = stores[stop]
        assert drain(spark, store, {"claude": str(src)}, stop_after=stop) == "stopped"
        assert store.pending_commit() == store.next_commit() == (stop == "pending")
        assert store.messages().count() == 2 * (stop == "pending")
        # no cursor runs ahead of what is there
        at = {r.session_id: r.cursor_offset for r in store.sessions().collect()}
        assert at == ({} if stop == "intent" else {"a": None, "b": None} if stop == "messages" else {"a": at["b"], "b": at["b"]})
    drain(spark, stores["plain"], {"claude": str(src)})
    (src / "new.jsonl").write_text(lines_of(claude_said("new", 0, "later")), encoding="utf-8")
    for s in stores.values():
        assert drain(spark, s, {"claude": str(src)}) == "done" and s.pending_commit() is None
    want = [rows_of(s) for s in stores.values()]
    assert all(w[0] == want[0][0] and [x[:5] for x in w[1]] == [x[:5] for x in want[0][1]] for w in want) and len(want[0][0]) == 5


def test_a_commit_whose_bytes_are_gone_waits(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "s"), "me")
    src.mkdir()
    (src / "a.jsonl").write_text(lines_of(claude_said("a", 0, "one"), claude_said("a", 1, "two")), encoding="utf-8")
    drain(spark, store, {"claude": str(src)}, stop_after="pending")
    kept = (src / "a.jsonl").read_text()
    (src / "a.jsonl").write_text(lines_of(claude_said("a", 0, "one")), encoding="utf-8")
    assert drain(spark, store, {"claude": str(src)}) == "waiting" and store.messages().count() == 0
    (src / "a.jsonl").write_text(kept, encoding="utf-8")
    assert drain(spark, store, {"claude": str(src)}) == "done" and store.messages().count() == 2


def test_metadata_that_was_begun_is_promoted(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "s"), "me")
    src.mkdir()
    (src / "a.jsonl").write_text(lines_of(claude_said("a", 0, "one")), encoding="utf-8")
    drain(spark, store, {"claude": str(src)})
    before = store.sessions().first()
    whole = Store.publish
    for stop in ("pending", "messages"):
        monkeypatch.setattr(Store, "publish", lambda self, s, m, c, stop=stop: whole(self, s, m, c, stop))
        update_metadata(store, "claude", spark.createDataFrame([("claude", "a", f"renamed {stop}")], "source_type string, session_id string, title string"))
        monkeypatch.setattr(Store, "publish", whole)
        assert store.pending_commit() is not None
        assert drain(spark, store, {"claude": str(src)}) == "done"
        s = store.sessions().first()
        assert (s.title, s.cursor_offset, s.cursor_anchor, s.pending_commit_id) == (f"renamed {stop}", before.cursor_offset, before.cursor_anchor, None)
    assert store.messages().count() == 1


def test_bounded_commits_take_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LEAST_SHARE", 200)
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "s"), "me")
    src.mkdir()
    for n in range(3):
        (src / f"s{n}.jsonl").write_text(lines_of(*(claude_said(f"s{n}", k, "x" * 150) for k in range(2 + n))), encoding="utf-8")
    sizes = {f.name: f.stat().st_size for f in src.iterdir()}
    assert drain(spark, store, {"claude": str(src)}, most_bytes=450) == "done"
    taken = {}
    for c in store._parts("intents"):
        for r in store.intent(c).collect():
            taken.setdefault(c, []).append((os.path.basename(r.path), r.low, r.high))
    assert max(sum(high - low for _, low, high in x) for x in taken.values()) <= 450
    first = [n for c in sorted(taken) for n, *_ in taken[c]]
    assert set(first[:3]) == set(sizes)  # everybody once before anybody twice
    for n, size in sizes.items():
        own = sorted((low, high) for x in taken.values() for m, low, high in x if m == n)
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert store.messages().count() == sum(range(2, 5))


def test_shares_rotate_over_sources(spark):
    left = spark.createDataFrame([(s, f"{s}{k}", None, None, 0, 10**9) for s in "ab" for k in range(3)], "source_type string, path string, session_id string, file_key string, low long, high long")
    served = spark.createDataFrame([("a", "a0", 4), ("b", "b1", 3)], "source_type string, path string, version long")
    got = {(r.source_type, r.path, r.high) for r in share(left, served, 4 * tail.LEAST_SHARE).collect()}
    assert got == {("a", "a1", tail.LEAST_SHARE), ("a", "a2", tail.LEAST_SHARE), ("b", "b0", tail.LEAST_SHARE), ("b", "b2", tail.LEAST_SHARE)}
    assert [r.high for r in share(left, served, 1000).collect()] == [1000]


def test_snapshots_bound_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "COMPACT_EVERY", 3)
    store = Store(spark, str(tmp_path / "s"), "me")
    none = spark.createDataFrame([], P.MESSAGES)
    files = []
    for c in range(10):
        state = spark.createDataFrame([("codex", f"s{c % 4}", f"t{c}", c)], "source_type string, session_id string, title string, cursor_offset long")
        store.intend(spark.createDataFrame([("codex", f"/p{c % 4}", None, None, 0, c)], "source_type string, path string, session_id string, file_key string, low long, high long"), c)
        store.publish(state, none, c)
        files.append(len(store.states().inputFiles()))
    assert max(files) <= 2 * 3 + 4 and len(store._parts("sessions")) <= 4 * 3
    assert {r.session_id: (r.title, r.cursor_offset, r.last_commit_id) for r in store.sessions().collect()} == {f"s{c % 4}": (f"t{c}", c, c) for c in range(6, 10)}
    assert {r.path: r.high for r in store.positions().collect()} == {f"/p{c % 4}": c for c in range(6, 10)}
    planned = store.states()  # a reader in flight still finds its files after the next snapshot
    before = planned.count()
    store.compact()
    assert planned.count() == before and store.next_commit() == 10


def test_lists_read_narrow_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "me")
    rows = spark.createDataFrame([("m", "codex", "s", 0, "user", "message", "{}", [bytearray(b"x")])], "message_id string, source_type string, session_id string, sequence_no long, role string, event_type string, content_json string, attachments array<binary>")
    store.publish(rows.select("source_type", "session_id"), rows, 0)

    def scanned(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x for x in re.findall(r"ReadSchema: struct<([^\n]*)>", plan) if "message_id" in x or "commit_id:bigint" in x and "last_commit_id" not in x]

    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        counted = scanned(store.messages().groupBy("source_type").count())
        shown = scanned(store.messages().select("message_id", "role", "content_json"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(counted) == len(shown) == 1
    assert "content_json" not in counted[0] and "attachments" not in counted[0] + shown[0] and "content_json" in shown[0]


def test_half_written_folders_do_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "me")
    state = spark.createDataFrame([("codex", "a", "t", 5)], "source_type string, session_id string, title string, cursor_offset long")
    store.publish(state, spark.createDataFrame([], P.MESSAGES), 0)
    store.publish(state.withColumn("title", F.lit("half")), spark.createDataFrame([], P.MESSAGES), 1)
    (tmp_path / "s" / "sessions" / "part=3" / "_SUCCESS").unlink()
    assert store.pending_commit() == 1 and store.sessions().first().pending_commit_id == 1
    store.promote(1)
    assert store.sessions().first().last_commit_id == 1 and store.pending_commit() is None


def test_layouts(spark, tmp_path):
    rows = {1: [], 2: [], 3: [], 4: []}
    for k, missing in enumerate(P.LAYOUTS):
        schema = P.T.StructType([f for f in P.SESSIONS if f.name not in missing])
        value = {"source_type": "codex", "session_id": f"s{k}", "title": f"t{k}", "version": 2 * k + 1, "last_commit_id": k, "subagent_source_json": "{}", "projectless": True}
        rows[k + 1] = spark.createDataFrame([tuple(value.get(f.name) for f in schema)], schema)
        assert P.layout_of(schema) == k + 1
        rows[k + 1].write.parquet(str(tmp_path / f"s/sessions/part={2 * k + 1}"))
    store = Store(spark, str(tmp_path / "s"), "me")
    store.claim()
    assert store.contract() == ("me", 4)
    assert sorted((r.session_id, r.subagent_source_json, r.projectless, r.pending_cursor) for r in store.sessions().collect()) == [("s0", None, None, None), ("s1", "{}", None, None), ("s2", "{}", True, None), ("s3", "{}", True, None)]
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "s"), "you").claim()
    rows[4].withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "t/sessions/part=1"))
    with pytest.raises(ValueError, match="layout"):
        Store(spark, str(tmp_path / "t"), "me").claim()


@pytest.fixture
def mounted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}/in")
    return tmp_path / "in", "viewfs://box/in"


def test_stores_that_only_spark_opens(spark, tmp_path, mounted):
    here, there = mounted
    text = "\n" + lines_of(claude_said("c d%41", 0, "one é"), claude_said("c d%41", 1, "two")).replace("\n", "\r\n") + "\n"
    (here / "p").mkdir()
    (here / "p" / "c d%41.jsonl").write_bytes(text.encode() + b'{"part')
    want = sorted((r.start_offset, r.end_offset, r.line, r.line_terminated) for r in read(spark, here).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = spark_lines(spark, [f"{there}/p/c d%41.jsonl"])
        assert sorted(tuple(r)[1:] for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    store = Store(spark, str(tmp_path / "s"), "me")
    assert drain(spark, store, {"claude": there}, most_bytes=100) == "done"
    assert sorted(json.loads(r.content_json)["message"]["content"] for r in store.messages().collect()) == ["one é", "two"]
    with (here / "p" / "c d%41.jsonl").open("a", encoding="utf-8") as f:
        f.write("\n" + lines_of(claude_said("c d%41", 2, "three")))
    assert drain(spark, store, {"claude": there}) == "done"
    assert store.messages().count() == 4  # the broken line counts as one
    assert store.sessions().first().source_path == "viewfs://box/in/p/c d%41.jsonl"


@pytest.mark.parametrize("size", [3, 50, 1000])
def test_ranges_own_lines_by_their_end(spark, tmp_path, size):
    data = b'{"a":1}\n\n' + b"x" * 90 + b"\r\nend\nopen"
    (tmp_path / "a.jsonl").write_bytes(data)
    ranges = [(0, 4), (4, 60), (60, len(data) - 2), (len(data) - 2, len(data))]
    table = spark.createDataFrame([(str(tmp_path / "a.jsonl"), *r) for r in ranges], "path string, low long, high long")
    got = sorted((r.start_offset, r.end_offset, r.line) for r in range_lines(table, size).collect())
    assert got == [(0, 8, '{"a":1}'), (8, 9, ""), (9, 101, "x" * 90), (101, 105, "end")]
    gone = table.withColumn("file_key", F.lit("another"))
    assert range_lines(gone, size).count() == 0


def test_listing(spark, tmp_path):
    for name in ("p/one/a.jsonl", "p/one/deep/b.jsonl", "p/two/sessions-index.jsonl", "p/c.jsonl", "p/one/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    names = lambda *a, **b: sorted(os.path.relpath(r.path, tmp_path / "p") for r in listed(spark, *a, **b).collect())
    assert names(str(tmp_path / "p")) == ["c.jsonl", "one/a.jsonl", "one/deep/b.jsonl"]
    assert names(str(tmp_path / "p"), recursive=False) == ["c.jsonl"]
    assert names(str(tmp_path / "p"), layout="projects") == ["one/a.jsonl"]
    assert names(f"file://{tmp_path}/p/one/*.jsonl,{tmp_path}/p/c.jsonl,{tmp_path}/none") == ["c.jsonl", "one/a.jsonl"]


def test_streams_are_bounded_and_go_on(spark, tmp_path):
    from convlake.sources.jsonl import StreamReader, register

    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.jsonl").write_text("".join(f"line {k} of {n}\n" for k in range(4)))
    options = {"path": str(src), "maxBytesPerTrigger": "20"}
    reader, at, got, sizes = StreamReader(options), {"files": "{}", "turn": "0"}, [], []
    while (now := reader.latestOffset())["files"] != at["files"]:
        parts = reader.partitions(at, now)
        sizes.append(sum(r.high - r.low for p in parts for r in p.ranges))
        from convlake.sources.jsonl import ended

        got += [row for p in parts for r in p.ranges for row in ended(r)]
        reader, at = StreamReader(options), now  # restarted after every batch
        reader.partitions(at, at)
    assert max(sizes) <= 20 and sorted(r[3] for r in got) == sorted(f"line {k} of {n}" for k in range(4) for n in range(3))
    register(spark)
    out = str(tmp_path / "out")
    for _ in range(2):
        stream = spark.readStream.format("jsonl_offsets").option("path", str(src)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(60)
        with (src / "0.jsonl").open("a") as f:
            f.write("one more\npart")
    assert spark.read.parquet(out).count() == 13


def test_local_files_are_read_by_tasks(spark, tmp_path):
    from convlake.operators import attachments as A

    (tmp_path / "logs").mkdir()
    (tmp_path / "a.txt").write_bytes(b"home")
    (tmp_path / "logs" / "b.txt").write_bytes(b"beside")
    (tmp_path / "large").write_bytes(b"x" * 50)
    said = "".join(f"## f: {p}\n" for p in ("~/a.txt", "./b.txt", f"file://{tmp_path}/large", "/etc/passwd", "../logs/../a.txt"))
    event = json.dumps({"type": "response_item", "payload": {"type": "message", "content": [{"type": "input_text", "text": said}, {"type": "input_text", "text": "x"}]}})
    rows = spark.createDataFrame([("m", event), ("m", event), ("n", "{}"), ("o", "broken")], "message_id string, content_json string")
    found = A.taken_out(rows, base=F.lit(str(tmp_path / "logs")), home=str(tmp_path), roots=[str(tmp_path)], read=True, most=20).collect()
    assert len(found) == 4 and [r.content_json for r in found[2:]] == ["{}", "broken"]
    for r in found[:2]:
        entries = json.loads(r.content_json)["_attachments"]
        assert [(e["source_reference"], e["status"], e["size"]) for e in entries] == [("~/a.txt", "stored", 4), ("./b.txt", "stored", 6), (f"file://{tmp_path}/large", "too_large", 50), ("../logs/../a.txt", "stored", 4)]
        assert [x and bytes(x) for x in r.attachments] == [b"home", b"beside", None, b"home"]


def test_values_by_position():
    from convlake.functions import json_tree as J

    text = ' {"a" : [1, "x\\"y", {"k": null}], "b":{"k":{"k":"in"}}, "c": [[], {}], "k": true} '
    found = [(n.parent, n.key, n.kind, text[n.start : n.end]) for n in J.nodes(text)]
    assert found[1:5] == [(0, "a", "array", '[1, "x\\"y", {"k": null}]'), (1, 0, "other", "1"), (1, 1, "string", '"x\\"y"'), (1, 2, "object", '{"k": null}')]
    assert [(f[1], f[3]) for f in found[-4:]] == [("c", "[[], {}]"), (0, "[]"), (1, "{}"), ("k", "true")] and J.scalar(text, "k") == "true"
    assert J.nodes("{broken") == J.nodes(None) == J.nodes("") == [] and [n.kind for n in J.nodes("7")] == ["other"]
    assert J.human('{"x": [{"type":"text","text":" a "},{"type":"message","content":"b"},{"type":"x_output","output":"c"},{"type":"text","text":"a"}]}', "e") == "a\n\nb\n\nc"
    assert J.human('{"type":"tool_use","name":"grep"}', "e") == "grep" and J.human("{}", "e") == "[e]" and J.human("{}", None) == ""
    assert J.human('{"text":"one","y":{"output":"two"},"text":"cut', "e") == "one\n\ntwo"
    assert J.uri_data("data:,%zz") == "%" and J.uri_data("data:x") is None and J.uri_data("data:,a%20b+") == "YSBiKw=="
    lone = J.found_references('{"message":{"content":[{"type":"document","title":"\\ud800","source":{"type":"base64","data":"QQ=="}}]}}', None, None, None)
    assert lone[0]["file_name"] == "\ufffd" and lone[0]["data"] == "QQ=="


def test_stored_files_come_back_by_path(spark):
    from convlake.operators import attachments as A

    event = '{"message":{"content":[{"type":"file","path":"/f/a.txt"},{"type":"text","text":"/f/a.txt"},{"type":"file","path":"/f/gone"}]},"path":"/f/a.txt"}'
    rows = spark.createDataFrame([("m", 7, event)], "message_id string, sequence_no long, content_json string")
    out = A.taken_out(rows, spark.createDataFrame([("file:/f/a.txt", bytearray(b"a"))], "path string, content binary"))
    back = A.put_back(out, "/restored").first()
    said = json.loads(back.content_json)
    name = back.restored_files[0].name
    assert said["message"]["content"][0]["path"] == said["path"] == f"/restored/{name}" and name.endswith("-a.txt") and back.restored_files[0]["index"] == 0
    assert said["message"]["content"][1]["text"] == "/f/a.txt" and [(m["index"], m["status"]) for m in said["_missing_attachments"]] == [(1, "missing")]
