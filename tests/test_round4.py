"""What round 4 found."""

import json
import shutil

import pytest

from convlake.plans.registry import queries
from convlake.streaming import tail
from convlake.streaming.publish import Store
from convlake.streaming.tail import drain

from .test_sources import lines_of, said


def codex(session, *texts):
    return lines_of({"type": "session_meta", "payload": {"id": session}}, *(said("user", t) for t in texts))


def put(folder, session, *texts):
    """A transcript in a folder of its own, under the name that all have."""
    (folder / session).mkdir(parents=True)
    (folder / session / "part-00000.jsonl").write_text(codex(session, *texts), encoding="utf-8")
    return folder / session / "part-00000.jsonl"


def texts_of(store):
    return sorted((r.session_id, json.loads(r.content_json)["payload"]["content"][0]["text"]) for r in store.messages().collect())


@pytest.mark.parametrize("there", ["file://", "viewfs://"])
def test_files_of_one_name_are_told_apart_by_session(spark, tmp_path, there):  # F1
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.names.link./in", f"file://{tmp_path}/in")
    store, at = Store(spark, str(tmp_path / "store"), "me"), f"file://{tmp_path}/in" if there == "file://" else "viewfs://names/in"
    first = put(tmp_path / "in/0", "a", "one")
    put(tmp_path / "in/0", "b", "two")
    assert drain(spark, store, {"codex": f"{at}/0"}) == "done"
    for name in "cd":
        put(tmp_path / "in/1", name, f"new in {name}")
    (tmp_path / "in/1/moved").mkdir()
    shutil.copy(first, tmp_path / "in/1/moved")  # another file, so only its name and session tell whose it is
    with (tmp_path / "in/1/moved/part-00000.jsonl").open("a", encoding="utf-8") as f:
        f.write(lines_of(said("user", "more")))
    for _ in range(2):
        assert drain(spark, store, {"codex": f"{at}/1"}) == "done"
        assert texts_of(store) == [("a", "more"), ("a", "one"), ("b", "two"), ("c", "new in c"), ("d", "new in d")]


def joined_rows(df):
    """How many rows the largest join of ``df`` makes."""

    def below(plan):
        name = plan.nodeName()
        kids = [plan.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
        own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([own, *map(below, kids)])

    df.collect()
    return below(df._jdf.queryExecution().executedPlan())


def test_files_of_one_name_are_not_paired_with_every_session(spark, tmp_path, monkeypatch):  # F2
    store, checked, most = Store(spark, str(tmp_path / "store"), "me"), tail._checked, []
    for folder in "01":
        for k in range(12):
            put(tmp_path / folder, f"{folder}-{k}", f"text {k}")
    drain(spark, store, {"codex": str(tmp_path / "0")})
    monkeypatch.setattr(tail, "_checked", lambda pairs: most.append(joined_rows(pairs)) or checked(pairs))
    drain(spark, store, {"codex": str(tmp_path / "1")})
    drain(spark, store, {"codex": f"{tmp_path}/0,{tmp_path}/1"})
    assert len(most) == 2 and max(most) <= 24 * 3  # by path, as the same file, by name
    assert len(texts_of(store)) == 24


@pytest.mark.parametrize("conversations", [(0, 1, -1), (2,)])
def test_two_sources_of_few_conversations(spark, tmp_path, conversations):  # F1
    rows = [(c, t, "user", f"text {t} of {c}") for c in conversations for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries()["s11_two_sources"](spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.role, r.text) for r in found) == sorted((str(c), role, text) for c, _, role, text in rows)
