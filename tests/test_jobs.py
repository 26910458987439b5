"""Whole jobs on a few awkward texts, against plain versions."""

import hashlib
import json

import pytest

from convlake.plans import job_queries as J
from convlake.plans.registry import queries

#: Quotes, escapes, line ends, control characters, multi-byte and long texts.
TEXTS = ['say "hi" \\ and\\n', "two\nlines\r\nand\ttabs", "ñ straße \U0001f600 漢字", "\u0001\u001f\u007f ", "never written", "x" * 200_000 + "é", "", "</script> & 'q'"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("jobs"))
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", text) for c in (1, 2) for t, text in enumerate(TEXTS[: 9 - c])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def event(turn, text):
    if turn % 5 == 4:
        return b"{broken"
    role = "user" if turn % 2 == 0 else "assistant"
    content = [{"type": "input_text", "text": text}]
    said = {"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": content}}
    return json.dumps(said, ensure_ascii=False, separators=(",", ":")).replace("\\u001f", "\\u001F").encode()


def test_texts_reach_the_reader(spark, sf):
    lines = {str(c): [event(t, text) for t, text in enumerate(TEXTS[: 9 - c])] for c in (1, 2)}
    size = {c: sum(len(x) + 1 for x in own) for c, own in lines.items()}
    assert {r.session_id: (r.lines, r.bytes) for r in queries()["s1_text_scan"](spark, sf).collect()} == {c: (len(own), size[c]) for c, own in lines.items()}
    assert {r.session_id: (r.cursor_offset, r.cursor_anchor) for r in queries()["p3_text_cursors"](spark, sf).collect()} == {c: (size[c], hashlib.sha256(own[-1]).hexdigest()) for c, own in lines.items()}
    marks = {c: len(f',"_restore_boundary":"{"claude" if c == "1" else "codex"}:{c}:{c}"') for c in lines}
    assert {r.session_id: r.resume_offset for r in queries()["j8_text_boundaries"](spark, sf).collect()} == {c: size[c] + marks[c] - 5 * (len(lines[c]) > 4) for c in lines}
    read = {(r.session_id, r.start_offset): r.line.encode() for r in J.written(spark, sf).collect()}
    assert sorted((c, x) for (c, _), x in read.items()) == sorted((c, x) for c, own in lines.items() for x in own)
    kept = J.D.codex_messages(J.written(spark, sf)).where("event_type = 'message'").collect()
    assert sorted(json.loads(r.content_json)["payload"]["content"][0]["text"] for r in kept) == sorted(t for c in (1, 2) for k, t in enumerate(TEXTS[: 9 - c]) if k % 5 != 4)


def test_texts_are_published(spark, sf):
    found = [json.loads(r.content_json)["text"] for r in J.published(spark, sf).messages().collect()]
    assert sorted(found) == sorted(t for c in (1, 2) for t in TEXTS[: 9 - c])


def test_long_documents_are_stored_and_put_back(spark, tmp_path):
    texts = ["short", "y" * 3_999 + "é", "z \U0001f600" * 60_000]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    sums = {str(i): hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    found = {name: queries()[name](spark, d).collect() for name in ("b4_whole_manifest", "b6_whole_stored", "q5_whole_attachment", "b8_whole_pending", "b9_whole_put_back", "b5_whole_policy")}
    assert {r.message_id: (r.status, r.size, r.sha256) for r in found["b4_whole_manifest"] if r["index"] == 0} == {str(i): ("stored", len(t.encode()), sums[str(i)]) for i, t in enumerate(texts)}
    assert {r.message_id for r in found["b6_whole_stored"]} == set(sums)
    assert {r.message_id: r.sha256 for r in found["q5_whole_attachment"]} == {r.message_id: r.sha256 for r in found["b9_whole_put_back"]} == sums
    assert {(r.message_id, r.present) for r in found["b8_whole_pending"] if r["index"] == 0} == {(i, True) for i in sums}
    assert {(str(r.doc_id), r.status, r.sha256) for r in found["b5_whole_policy"]} == {(i, "stored", x) for i, x in sums.items()}
    capped = J.with_attachments(spark, d, most=4000)
    assert {(r.message_id, r.status) for r in J.entries(capped).collect() if r["index"] == 0} == {("0", "stored"), ("1", "too_large"), ("2", "too_large")}


def test_whole_texts_are_cut_and_scanned(spark, sf, tmp_path):
    texts = ["a\nb\n\nc", "m" * 2_000_001, "no line end", "é\n" * 900]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    cut = {r.doc_id: (r.content_length, r.detail, r.cut) for r in queries()["f24_whole_bounded"](spark, d).collect()}
    assert cut == {i: (len(t), t[:2_000_000], len(t) > 2_000_000) for i, t in enumerate(texts)}
    code = {(r.doc_id, r.block): (r.language, r.code) for r in queries()["t13_whole_blocks"](spark, d).where("doc_id <> 1").collect()}
    assert code == {(i, b): (None if b else "sql", t + "\n") for i, t in enumerate(texts) for b in (0, 1) if i != 1}
    said = {(r.session_id, r.sequence_no): r.text for r in queries()["t10_whole_envelope"](spark, sf).collect()}
    assert {k: t for k, t in said.items() if TEXTS[k[1]].strip()} == {(str(c), t): x for c in (1, 2) for t, x in enumerate(TEXTS[: 9 - c]) if x.strip()}
    assert len(said) == 15


def test_generated_images_are_taken_out(spark):
    import base64

    from convlake.operators import attachments as A

    inline = base64.b64encode(b"drawn here").decode()
    image = lambda **more: json.dumps({"type": "event_msg", "payload": {"type": "image_generation_end", **more}})
    rows = [("saved", image(saved_path="/i/a.png", result=inline)), ("lost", image(saved_path="/i/b.png", result=inline)), ("inline", image(result=inline)), ("gone", image(saved_path="/i/b.png")), ("none", image()), ("other", json.dumps({"type": "event_msg", "payload": {"type": "x", "result": inline}}))]
    messages = spark.createDataFrame(rows, "message_id string, content_json string")
    files = spark.createDataFrame([("file:/i/a.png", bytearray(b"on disk"))], "path string, content binary")
    found = {r.message_id: r for r in A.taken_out(messages, files).collect()}
    entries = {k: json.loads(r.content_json).get("_attachments") for k, r in found.items()}
    assert {k: (e[0]["source_kind"], e[0]["status"], e[0]["mime_type"]) for k, e in entries.items() if e} == {"saved": ("LOCAL_PATH", "stored", "image/png"), "lost": ("BASE64", "stored", "image/png"), "inline": ("BASE64", "stored", "image/png"), "gone": ("LOCAL_PATH", "missing", "image/png")}
    assert {k: bytes(r.attachments[0]) for k, r in found.items() if r.attachments and r.attachments[0]} == {"saved": b"on disk", "lost": b"drawn here", "inline": b"drawn here"}
    assert {k for k, r in found.items() if inline in r.content_json} == {"other"}


def test_file_paths_are_attachments(spark):
    from convlake.operators import attachments as A

    blocks = [{"type": "file", "filePath": "/f/a"}, {"type": "file", "path": "/f/b"}, {"type": "file", "file": {"path": "/f/c"}}, {"type": "image", "file": {"filePath": "/f/d"}}, {"type": "document", "file": "/f/e"}, {"type": "file", "path": "/f/a"}, {"type": "text", "file": "/f/no"}, {"type": "tool_result", "content": [{"type": "file", "path": "/f/g"}]}]
    rows = spark.createDataFrame([("m", json.dumps({"message": {"content": blocks}}))], "message_id string, content_json string")
    found = A.taken_out(rows, spark.createDataFrame([("file:/f/a", bytearray(b"a"))], "path string, content binary")).first()
    entries = json.loads(found.content_json)["_attachments"]
    assert [(e["source_kind"], e["file_name"], e["status"]) for e in entries] == [("LOCAL_PATH", x, "stored" if x == "a" else "missing") for x in "abcdeg"]
