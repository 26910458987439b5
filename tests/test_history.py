"""Turns, lineage, rendering and export on rows written here."""

import json

import pytest
from pyspark.sql import functions as F

from convlake.operators import catalog as C
from convlake.operators import export as X
from convlake.operators import lineage as G
from convlake.operators import render as R
from convlake.operators import turns as T
from convlake.sources.jsonl import register

M = "source_type string, session_id string, sequence_no long, role string, text string, created_at timestamp, content_json string"


def messages(spark, rows):
    return spark.createDataFrame([("codex", "s", i, role, text, None, json.dumps({"n": i})) for i, (role, text) in enumerate(rows)], M).withColumn("created_at", F.timestamp_seconds(F.col("sequence_no") + 1))


def test_turns(spark):
    rows = messages(spark, [("user", "<environment_context>"), ("user", "a"), ("assistant", "b"), ("tool", "c"), ("assistant", "d"), ("user", "never answered"), ("user", "e"), ("assistant", "f")])
    found = T.turns(rows).orderBy("sequence_no").collect()
    assert [r.turn_no for r in found] == [1, 1, 1, 1, 1, 2, 3, 3]
    assert [r.cancelled for r in found] == [False] * 5 + [True, False, False]
    lines = [json.loads(r.json) for r in T.wrapped(T.turns(rows)).orderBy("position", "ord").collect()]
    ids = {r.turn_no: r.turn_id for r in found}
    own = lambda x: x["n"] if "n" in x else (x["payload"].get("turn_id"), x["payload"]["type"], x["payload"].get("message", x["payload"].get("last_agent_message")))
    start, done, said = (lambda k: (ids[k], "task_started", None)), (lambda k, text: (ids[k], "task_complete", text)), (lambda kind, text: (None, kind, text))
    assert [own(x) for x in lines] == [start(1), 0, 1, said("user_message", "a"), 2, 3, 4, said("agent_message", "d"), done(1, "d"), start(2), 5, said("user_message", "never answered"), done(2, None), start(3), 6, said("user_message", "e"), 7, said("agent_message", "f"), done(3, "f")]


def test_wrapped_lines_are_whole(spark):
    picture = {"timestamp": "2026-01-01T00:00:05Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "look"}, {"type": "input_image", "image_url": "data:,x"}, {"type": "input_image", "image_url": "/l.png"}, {"type": "input_image", "image_url": " "}]}}
    rows = spark.createDataFrame([("codex", "s", 0, "system", "before", None, "{}"), ("codex", "s", 1, "user", "look", None, json.dumps(picture)), ("codex", "s", 2, "assistant", "ok", None, '{"payload":{"phase":"commentary"}}'), ("codex", "t", 0, "assistant", "alone", None, "{}")], M).withColumn("created_at", F.timestamp_seconds(F.col("sequence_no") + 1))
    turned = T.turns(rows)
    turn = turned.where("turn_no = 1").first().turn_id
    event = lambda at, **payload: {"timestamp": at, "type": "event_msg", "payload": payload}
    got = [json.loads(r.json) for r in T.wrapped(turned).where("session_id = 's'").orderBy("position", "ord").collect()]
    assert got[0] == event("1970-01-01T00:00:01.000Z", type="task_started", turn_id=turn, model_context_window=None, collaboration_mode_kind="default") and got[1] == {}
    assert got[3] == event("2026-01-01T00:00:05Z", type="user_message", message="look", images=["data:,x"], local_images=["/l.png"], text_elements=[])
    assert got[5:] == [event("1970-01-01T00:00:03.000Z", type="agent_message", message="ok", phase="commentary", memory_citation=None), event("1970-01-01T00:00:03.000Z", type="task_complete", turn_id=turn, last_agent_message="ok")]
    assert [r.json for r in T.wrapped(turned).where("session_id = 't'").collect()] == ["{}"]


def test_lineage(spark):
    rows = [("x", "r", None), ("x", "c", "r"), ("x", "g", "c"), ("x", "lost", "nobody"), ("x", "k1", "k2"), ("x", "k2", "k1"), ("x", "under", "k1"), ("y", "c", "g")]
    nodes = spark.createDataFrame(rows, "source_type string, session_id string, parent_id string").withColumn("pending", F.col("session_id") == "c")
    found = {(r.source_type, r.session_id): (r.root_id, r.depth) for r in G.roots(nodes).collect()}
    assert found[("x", "g")] == ("r", 2) and found[("x", "lost")] == ("lost", 0) and found[("x", "under")] == (None, None) and found[("y", "c")] == ("c", 0)
    assert {(r.session_id, r.problem) for r in G.audit(nodes).where("source_type = 'x'").collect()} == {("lost", "missing_parent"), ("k1", "cycle"), ("k2", "cycle"), ("under", "cycle")}
    assert {r.session_id for r in G.family(G.roots(nodes), nodes.where("session_id = 'g'")).collect()} == {"r", "c", "g"}
    assert {r.session_id for r in G.blocked(nodes.where("source_type = 'x'")).collect()} == {"c", "g"}
    with pytest.raises(Exception, match="without a parent"):
        G.edges(nodes.withColumn("subagent_source_json", F.lit("{}"))).collect()


def test_conversation_truth_table(spark):
    yes = [("user", None), ("assistant", ""), ("assistant", "message"), ("user", "assistant"), ("assistant", "image_generation_end"), ("attachment", None), ("attachment", "attachment"), (None, "attachment")]
    no = [("tool", "message"), ("assistant", "function_call"), ("user", "image_generation_end"), ("system", "attachment"), (None, None)]
    df = spark.createDataFrame([(*x, True) for x in yes] + [(*x, False) for x in no], "role string, event_type string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", C.is_conversation(F.col("role"), F.col("event_type"))).collect())


def test_previews(spark):
    def shown(content, role="assistant", kind="message", **more):
        doc = content if isinstance(content, str) else json.dumps(content)
        return spark.range(1).select(R.preview(F.lit(doc), F.lit(role), F.lit(kind), **more).alias("p")).first().p

    block = lambda *b: {"payload": {"content": list(b)}}
    assert shown(block({"type": "output_text", "text": "a  b\r\n\r\n\r\n\r\nc"})) == "a b\n\nc"
    assert shown(block({"type": "text", "text": "x"}, {"type": "text", "text": "x"}, {"type": "refusal", "refusal": "no"})) == "x · no"
    assert shown(block({"type": "input_image"})) == "[image]"
    assert shown({"message": {"content": "plain"}}) == "plain"
    assert shown(block({"type": "tool_use", "name": "grep", "input": '{"path":"/p"}'})) == "call grep: path=/p"
    assert shown(block({"type": "tool_use", "name": "grep"}), conversation=True) == ""
    assert shown("{broken", role="user") == "{broken"
    assert shown(block({"type": "text", "text": "\U0001f600" * 300}), role="system") == "\U0001f600" * 239 + "…"
    files = "# Files mentioned by the user:\n\n## a: /a\n\n## My request for Codex:\ndo it"
    assert shown(block({"type": "text", "text": files})) == "do it"


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a\n```py\nx = 1\n\ny\n```\n```\nz\n```\n"), (2, "h | k\n--|:-:\n1 | 2\n\n3 | 4\n")], "id int, text string")
    assert [(r.id, r.block, r.language, r.code) for r in R.code_blocks(df, "text", "id").collect()] == [(1, 0, "py", "x = 1\n\ny\n"), (1, 1, None, "z\n")]
    rows = R.pipe_tables(df, "text", "id").orderBy("row_no").collect()
    assert [(r.table_no, r.row_no, r.cells, r.alignments) for r in rows] == [(0, 0, ["h", "k"], ["none", "center"]), (0, 1, ["1", "2"], ["none", "center"])]


def test_parents_are_repaired(spark):
    u = "00000000-0000-4000-8000-00000000000"
    rows = [("claude", "s", 0, u + "1", None), ("claude", "s", 1, u + "2", u + "9"), ("claude", "s", 2, u + "2", u + "1"), ("claude", "s", 3, "bad", u + "2")]
    found = X.repaired_parents(spark.createDataFrame(rows, "source_type string, session_id string, sequence_no long, uuid string, parent_uuid string")).orderBy("sequence_no").collect()
    assert found[0].new_parent is None and found[1].new_parent == u + "1" and found[2].new_parent == u + "1" and found[3].new_parent == u + "2"
    assert len({r.new_uuid for r in found}) == 4


def test_transcripts_are_one_ordered_file(spark, tmp_path):
    sessions = spark.createDataFrame([("codex", "a/b", "t", "/w", 3), ("claude", "c", "t2", "/w", 4)], "source_type string, session_id string, title string, cwd string, last_commit_id long")
    lines = spark.createDataFrame([(s, i, k, 0, json.dumps({"k": k})) for s, i in (("codex", "a/b"), ("claude", "c")) for k in (2, 0, 1)], "source_type string, session_id string, position long, ord int, json string")
    X.write_transcripts(X.marked(X.framed(lines, sessions), sessions), str(tmp_path / "out"), 3)
    files = sorted((tmp_path / "out").glob("client=*/session=*/*.txt"))
    assert [f.parent.name for f in files] == ["session=c", "session=a-b"]
    claude, codex = ([json.loads(x) for x in f.read_text().splitlines()] for f in files)
    assert [x.get("k") for x in codex] == [None, 0, 1, 2] and codex[0]["type"] == "session_meta" and codex[-1]["_restore_boundary"] == "codex:a/b:3"
    assert claude[-1]["customTitle"] == "t2" and [x.get("k") for x in claude] == [0, 1, 2, None]
    register(spark)
    back = spark.read.format("jsonl_offsets").option("path", str(tmp_path / "out/**/*.txt")).load()
    assert {(r.session_id, r.resume_offset) for r in X.restore_boundaries(back, sessions).collect()} == {("a/b", len(files[1].read_bytes())), ("c", len(files[0].read_bytes()))}
