"""What the findings of round 3 were about."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from convlake.functions import scalars as S
from convlake.plans.registry import oracle_sql, queries


def of_sql(name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.sql(oracle_sql()[name])


def same(spark, name, folder, tables=("documents",)):
    df, found = queries()[name](spark, str(folder)), of_sql(name, folder, tables)
    key = lambda rows: sorted(rows, key=repr)
    return key(tuple(r[c] for c in found.columns) for r in df.collect()) == key(found.fetchall())


@pytest.fixture
def documents(spark, tmp_path):
    texts = ["a", "", None, "short text", "x" * 57, "long " * 400, "b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return tmp_path


def test_short_and_missing_texts_decode_as_sql_says(spark, documents):  # F2
    assert same(spark, "f12_decoded", documents)


def test_line_end_behind_base64_is_refused(spark):  # F2
    rows = spark.createDataFrame([("QQ==",), ("QQ==\n",), ("QQ=",), ("",), ("QUJD",), ("Q===",)], "x string")
    assert [r[0] for r in rows.select(S.strict_base64(F.col("x"))).collect()] == [b"A", None, None, b"", b"ABC", None]


def test_size_policy_tells_large_from_stored(spark, documents):  # F3
    assert {r["status"] for r in queries()["b5_size_policy"](spark, str(documents)).collect()} == {"stored", "too_large"}
    assert same(spark, "b5_size_policy", documents) and same(spark, "b5_whole_policy", documents)


def test_attachments_are_decoded_once(spark, documents):  # F1, F4, F5, F6, F7, F11, F16, F20, F22
    for name in ("b8_whole_pending", "b6_whole_stored", "b9_whole_put_back"):
        df = queries()[name](spark, str(documents))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("A-Za-z0-9+/") == 1 and plan.count("ArrowEvalPython") == 1 + (name == "b9_whole_put_back")
        assert same(spark, name, documents)


def test_data_that_stands_in_the_text_isnt_given_again(spark):  # F4
    from convlake.functions.json_tree import references

    rows = spark.createDataFrame([('{"message":{"content":[{"type":"image","source":{"data":"QUJD"}},{"image_url":"data:a/b,x%20y"}]}}',)], "x string")
    got = rows.select(references(F.col("x"), whole=False).alias("r")).first()["r"]
    assert [r["data"] for r in got] == [None, "eCB5"]


def test_small_files_make_no_more_tasks_than_cores_need(spark, tmp_path):  # F10, F18
    from convlake.sources.jsonl import range_lines

    for k in range(100):
        (tmp_path / f"{k}.jsonl").write_text(f'{{"k":{k}}}\n')
    table = spark.createDataFrame([(f"{tmp_path}/{k}.jsonl", 0, len(f'{{"k":{k}}}\n')) for k in range(100)], "path string, low long, high long")
    lines = range_lines(table, size=1 << 18)
    assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["line"] for r in lines.collect()) == sorted(f'{{"k":{k}}}' for k in range(100))


def test_tasks_put_transcripts_in_place(spark, tmp_path, monkeypatch):  # F14, F15, F23
    from pyspark.sql.readwriter import DataFrameWriter

    from convlake.operators.export import write_transcripts

    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda *_: pytest.fail("the driver would move every folder"))
    rows = [("codex", "a/b", 1, 0, "two"), ("codex", "a/b", 0, 1, None), ("codex", "a/b", 0, 0, "óne"), ("claude", "c", 0, 0, "x")]
    schema = "source_type string, session_id string, position long, ord int, json string"
    files = lambda: {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").glob("*/*/*") if p.is_file()}
    write_transcripts(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    assert files() == {"client=codex/session=a-b/part-00000.txt": "óne\n\ntwo\n", "client=claude/session=c/part-00000.txt": "x\n"}
    write_transcripts(spark.createDataFrame(rows[3:], schema), str(tmp_path / "out"))  # what was there goes
    assert files() == {"client=claude/session=c/part-00000.txt": "x\n"}


def test_tasks_list_wide_folders(spark, tmp_path, monkeypatch):  # F8, F9, F13
    from convlake.sources import files as N

    for k in range(120):
        (tmp_path / f"c=x/s={k}/deep").mkdir(parents=True)
        (tmp_path / f"c=x/s={k}/p.txt").write_text("x" * k)
        (tmp_path / f"c=x/s={k}/deep/q.jsonl").write_text("y")
        (tmp_path / f"c=x/s={k}/.p.txt").write_text("hidden")
    monkeypatch.setattr(N, "_by_spark", lambda *_: pytest.fail("the driver would hold every file"))
    names = lambda path, **more: {r["path"].removeprefix(f"{tmp_path}/"): r["size"] for r in N.listed(spark, path, **more).collect()}
    for bound in (1000, 10):
        monkeypatch.setattr(N, "LOOKED_AT", bound)
        assert names(f"{tmp_path}/*/*/*.txt") == {f"c=x/s={k}/p.txt": k for k in range(120)}
        assert names(f"file:{tmp_path}") == {f"c=x/s={k}/deep/q.jsonl": 1 for k in range(120)}
        assert names(f"{tmp_path}/c=x/s=1?/*") == {f"c=x/s={k}/deep/q.jsonl": 1 for k in range(10, 20)}  # folders too, so other endings don't count
        assert names(str(tmp_path), recursive=False) == {} and names(f"{tmp_path}/none/*") == {}


def test_a_commit_parses_its_lines_once(spark, tmp_path, monkeypatch):  # F8, F9, F12, F13, F17, F19, F21
    from convlake.streaming import publish as P
    from convlake.streaming.tail import drain

    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.jsonl").write_text('{"type":"user","uuid":"u","message":{"role":"user","content":"hi"}}\n{"type":"custom-title","customTitle":"t","sessionId":"s"}\n')
    plans, publish = [], P.Store.publish

    def seen(self, sessions, messages, *rest):
        plans.extend(df._jdf.queryExecution().withCachedData().toString() for df in (sessions, messages))
        publish(self, sessions, messages, *rest)

    monkeypatch.setattr(P.Store, "publish", seen)
    store = P.Store(spark, str(tmp_path / "store"), "me")
    assert drain(spark, store, {"claude": str(tmp_path / "in")}) == "done"
    assert [r.title for r in store.sessions().collect()] == ["t"] and store.messages().count() == 1
    assert len(plans) == 2 and all(any("content_json" in kept for kept in re.findall(r"InMemoryRelation \[([^\]]*)\]", p)) for p in plans)
