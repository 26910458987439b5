"""Sessions and messages that are published together, so that whatever runs again changes nothing.

A session row is a state with a ``version``: 2c while commit c is under way, 2c + 1 once it is done. The
first keeps the cursor of the last finished commit, and says in ``pending_cursor`` where c will end; so a
cursor never stands behind something that readers don't have. Before that, c's intent says which bytes of
which files it takes. Messages are written under their commit id, one partition each, and a commit that runs
again replaces its own partition. Readers take messages up to their session's last commit.

Intents and states are logs of one folder a commit, which count once Spark has marked them as complete. Every
``COMPACT_EVERY`` commits their latest rows are written as a snapshot, which counts once it is complete in
the same way; readers take the newest one and the folders after it. What a snapshot stands for is deleted
when the next one is there, so that readers in flight still find it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.work import children, discard, exists

KEY = ["source_type", "session_id"]
CURSOR = T.StructType([T.StructField("offset", T.LongType()), T.StructField("anchor", T.StringType())])
COMPACT_EVERY = 50

SESSIONS = T.StructType([
    T.StructField("source_type", T.StringType(), False), T.StructField("session_id", T.StringType(), False), T.StructField("title", T.StringType()), T.StructField("cwd", T.StringType()),
    T.StructField("archived", T.BooleanType()), T.StructField("source_path", T.StringType()), T.StructField("file_key", T.StringType()), T.StructField("cursor_offset", T.LongType()), T.StructField("cursor_anchor", T.StringType()),
    T.StructField("last_commit_id", T.LongType()), T.StructField("pending_commit_id", T.LongType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
    T.StructField("subagent_source_json", T.StringType()), T.StructField("projectless", T.BooleanType()), T.StructField("pending_cursor", CURSOR), T.StructField("version", T.LongType()),
])

MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType(), False), T.StructField("source_type", T.StringType(), False), T.StructField("session_id", T.StringType(), False), T.StructField("sequence_no", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("content_json", T.StringType(), False), T.StructField("attachments", T.ArrayType(T.BinaryType())),
    T.StructField("created_at", T.TimestampType()), T.StructField("commit_id", T.LongType()),
])

#: What publishing adds to a session.
COMMIT = ("version", "last_commit_id", "pending_commit_id", "pending_cursor")

#: Which bytes of which files a commit takes; ``session_id`` where the file's session is known from before.
INTENTS = T.StructType([
    T.StructField("source_type", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("session_id", T.StringType()), T.StructField("file_key", T.StringType()),
    T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("version", T.LongType()),
])

CONTRACT = T.StructType([T.StructField("owner", T.StringType()), T.StructField("layout", T.IntegerType())])

#: What earlier layouts of the sessions table didn't have yet, the newest last; readers get nulls there.
LAYOUTS = (("subagent_source_json", "projectless", "pending_cursor"), ("projectless", "pending_cursor"), ("pending_cursor",), ())


def assert_schema(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """``df`` in the order of ``wanted``; columns that only allow nulls may be missing, others may not differ."""
    have = {f.name: f.dataType for f in df.schema}
    for f in wanted:
        if f.name not in have and not f.nullable:
            raise ValueError(f"column {f.name} is missing")
        if f.name in have and have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    if extra := set(have) - {f.name for f in wanted}:
        raise ValueError(f"unknown columns {sorted(extra)}")
    return df.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def layout_of(schema: T.StructType) -> int:
    """Which of the known layouts of the sessions table ``schema`` is, from 1; another one is refused."""
    have = {f.name: f.dataType for f in schema if f.name != "part"}
    for k, missing in enumerate(LAYOUTS):
        if have == {f.name: f.dataType for f in SESSIONS if f.name not in missing}:
            return k + 1
    raise ValueError(f"no known layout of sessions: {schema.simpleString()}")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the greatest version of every key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(*keys, "s.*").select(*rows.columns)


def latest_sessions(states: DataFrame) -> DataFrame:
    """The state of the greatest version of every session."""
    return latest(states, KEY)


class Store:
    """Tables under one folder; ``owner`` names who may write them."""

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), owner

    # ---- contract ----

    def contract(self) -> tuple[str | None, int] | None:
        """Owner and layout of the tables; None before anybody has claimed them."""
        names = [n for n in children(self.spark, f"{self.path}/contract") if exists(self.spark, f"{self.path}/contract/{n}/_SUCCESS")]
        if not names:
            return None
        found = self.spark.read.schema(CONTRACT).parquet(f"{self.path}/contract/{max(names)}").first()  # one row
        return found["owner"], found["layout"]

    def claim(self) -> None:
        """Become the writer of the tables, or fail if another one is, or if they aren't of a known layout.

        Tables of an earlier layout are read with nulls for what it lacks; from now on they are written in
        the present one.
        """
        known = self.contract()
        if known and known[0] != self.owner:
            raise PermissionError(f"the tables belong to {known[0]!r}")
        if known and known[1] > len(LAYOUTS):
            raise ValueError(f"the tables have layout {known[1]}, which is newer than {len(LAYOUTS)}")
        if known == (self.owner, len(LAYOUTS)):
            return
        for part in self._parts("sessions"):
            layout_of(self.spark.read.parquet(f"{self.path}/sessions/part={part}").schema)
        names = children(self.spark, f"{self.path}/contract")
        self.spark.createDataFrame([(self.owner, len(LAYOUTS))], CONTRACT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/contract/{len(names):08d}")

    # ---- logs ----

    def _parts(self, name: str) -> list[int]:
        """Folders of a table that were written to their end."""
        found = sorted(int(n.removeprefix("part=")) for n in children(self.spark, f"{self.path}/{name}") if n.startswith("part="))
        return [p for p in found if exists(self.spark, f"{self.path}/{name}/part={p}/_SUCCESS")]

    def _snapshots(self, name: str) -> list[int]:
        return self._parts(f"snapshots/{name}")

    def _log(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows of a log: the newest snapshot, and the folders after it."""
        at = max(self._snapshots(name), default=-1)
        paths = [f"{self.path}/{name}/part={p}" for p in self._parts(name) if p > at] + [f"{self.path}/snapshots/{name}/part={at}"] * (at >= 0)
        return self.spark.read.schema(schema).parquet(*paths).select(*schema.names) if paths else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame, part: int) -> None:
        """Replace folder ``part`` of a table: what a commit wrote before goes."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/part={part}")

    def compact(self) -> None:
        """Write snapshots of both logs, and delete what the snapshots before them stood for."""
        for name, schema, keys in (("sessions", SESSIONS, KEY), ("intents", INTENTS, ["source_type", "path"])):
            before, now = max(self._snapshots(name), default=-1), max(self._parts(name), default=-1)
            pending = self.pending_commit()
            if pending is not None:  # what isn't finished stays as it is
                now = max((p for p in self._parts(name) if p < pending * (2 if name == "sessions" else 1)), default=-1)
            if now <= before:
                continue
            rows = latest(self._log(name, schema).where(F.col("version") <= now), keys)
            rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}/part={now}")
            for old in [p for p in self._parts(name) if p <= before]:
                discard(self.spark, f"{self.path}/{name}/part={old}")
            for old in [p for p in self._snapshots(name) if p < before]:
                discard(self.spark, f"{self.path}/snapshots/{name}/part={old}")

    # ---- tables ----

    def states(self) -> DataFrame:
        return self._log("sessions", SESSIONS)

    def sessions(self) -> DataFrame:
        return latest_sessions(self.states())

    def positions(self) -> DataFrame:
        """How far each file was read by finished and unfinished commits, and by which one last (``version``)."""
        return latest(self._log("intents", INTENTS), ["source_type", "path"])

    def messages(self, pending: bool = False) -> DataFrame:
        """Messages of published commits; with ``pending`` all that are written."""
        there = exists(self.spark, f"{self.path}/messages")
        rows = self.spark.read.schema(MESSAGES).parquet(f"{self.path}/messages").select(*MESSAGES.names) if there else self.spark.createDataFrame([], MESSAGES)
        if pending:
            return rows
        return rows.join(self.sessions().select(*KEY, "last_commit_id"), KEY).where("commit_id <= last_commit_id").drop("last_commit_id")

    def progress(self) -> DataFrame:
        """commit_id, sessions, messages and state ("done" or "pending") of every commit that wrote messages."""
        from convlake.operators.sessions import commit_counts

        pending = self.pending_commit()
        state = F.when(F.col("commit_id") == F.lit(-1 if pending is None else pending), "pending").otherwise("done")
        return commit_counts(self.messages(pending=True)).withColumn("state", state)

    # ---- commits ----

    def last_part(self, name: str) -> int:
        return max([*self._parts(name), *self._snapshots(name)], default=-1)

    def pending_commit(self) -> int | None:
        """The commit that was begun and isn't done; there is one at most."""
        intent, state = self.last_part("intents"), self.last_part("sessions")
        begun = max(intent, state // 2)
        return begun if begun >= 0 and state < 2 * begun + 1 else None

    def next_commit(self) -> int:
        """The commit to publish next: the one that is pending, or the one after the last."""
        pending = self.pending_commit()
        return max(self.last_part("intents"), self.last_part("sessions") // 2) + 1 if pending is None else pending

    def intend(self, ranges: DataFrame, commit_id: int) -> DataFrame:
        """Write which bytes commit ``commit_id`` takes, and read that back."""
        self._append("intents", assert_schema(ranges.withColumn("version", F.lit(commit_id).cast("long")), INTENTS), commit_id)
        return self.intent(commit_id)

    def intent(self, commit_id: int) -> DataFrame:
        """What commit ``commit_id`` takes; no rows for one that isn't from files."""
        there = commit_id in self._parts("intents")
        return self.spark.read.schema(INTENTS).parquet(f"{self.path}/intents/part={commit_id}").select(*INTENTS.names) if there else self.spark.createDataFrame([], INTENTS)

    def publish(self, sessions: DataFrame, messages: DataFrame, commit_id: int, stop_after: str = "") -> None:
        """Write one commit: sessions as pending, messages, sessions as done. Running it again is safe; what it
        marked as pending stays.

        ``stop_after`` ("pending" or "messages") leaves it unfinished, as a lost driver would.
        """
        messages = assert_schema(messages.drop("commit_id").dropDuplicates(["message_id"]).withColumn("commit_id", F.lit(commit_id).cast("long")), MESSAGES)
        if not self.has_pending(commit_id):  # else they are marked already, and what is written may be read from there
            sessions = sessions.drop(*COMMIT)
            sessions = sessions.withColumns({c: F.lit(None).cast(t) for c, t in (("cursor_offset", "long"), ("cursor_anchor", "string")) if c not in sessions.columns})
            old = self.sessions().select(*KEY, F.col("last_commit_id").alias("_last"), F.col("cursor_offset").alias("_offset"), F.col("cursor_anchor").alias("_anchor"))
            state = sessions.withColumn("pending_cursor", F.struct(F.col("cursor_offset").cast("long").alias("offset"), F.col("cursor_anchor").alias("anchor"))).join(old, KEY, "left")
            pending = state.withColumns({
                "last_commit_id": F.coalesce("_last", F.lit(-1).cast("long")), "cursor_offset": F.col("_offset"), "cursor_anchor": F.col("_anchor"),
                "pending_commit_id": F.lit(commit_id).cast("long"), "version": F.lit(2 * commit_id).cast("long"),
            })
            self._append("sessions", assert_schema(pending.drop("_last", "_offset", "_anchor"), SESSIONS), 2 * commit_id)
        if stop_after == "pending":
            return
        self._append("messages", messages, commit_id)
        if stop_after == "messages":
            return
        self.promote(commit_id)

    def promote(self, commit_id: int) -> None:
        """Finish a commit whose pending states and messages are written: cursors go on to where it ends."""
        rows = self.spark.read.schema(SESSIONS).parquet(f"{self.path}/sessions/part={2 * commit_id}").select(*SESSIONS.names)
        done = rows.withColumns({
            "last_commit_id": F.lit(commit_id).cast("long"), "pending_commit_id": F.lit(None).cast("long"), "cursor_offset": F.col("pending_cursor.offset"), "cursor_anchor": F.col("pending_cursor.anchor"),
            "pending_cursor": F.lit(None).cast(CURSOR), "version": F.lit(2 * commit_id + 1).cast("long"),
        })
        self._append("sessions", assert_schema(done, SESSIONS), 2 * commit_id + 1)
        if (commit_id + 1) % COMPACT_EVERY == 0:
            self.compact()

    def has_pending(self, commit_id: int) -> bool:
        """Whether the sessions of a commit are marked as pending."""
        return 2 * commit_id in self._parts("sessions")

    def is_written(self, commit_id: int) -> bool:
        """Whether a pending commit has all its messages, and all its states as pending."""
        return commit_id in self._parts("messages") and self.has_pending(commit_id)


def session_states(store: Store, lines: DataFrame, messages: DataFrame, source: str, known: DataFrame, keys: DataFrame, roll_up: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The new state of every session in ``lines``: what these say, and what only earlier batches said.

    The cursor is behind the last complete line, message or not. Title and creation time stay once there are any,
    but for title events; ``keys`` has the file_key of each path.
    """
    from convlake.operators.sessions import merged, rolled_up
    from convlake.sources import dialects as D

    text = F.coalesce(F.get_json_object("content_json", "$.payload.content[0].text"), F.get_json_object("content_json", "$.message.content[0].text"), F.get_json_object("content_json", "$.message.content"))
    events = messages.select(*KEY, F.col("sequence_no").alias("start_offset"), "end_offset", "role", text.alias("text"), F.get_json_object("content_json", "$.cwd").alias("cwd"), F.col("created_at").alias("event_time"), F.lit(None).cast("string").alias("anchor"))
    said = (roll_up or rolled_up)(events).drop("read_count", "cursor_offset", "cursor_anchor", "source_type")
    files = D.cursors(lines).join(D.session_ids(lines, source, known), "path").join(keys, "path", "left")
    if source == "codex":
        own = D.codex_sessions(lines).select("path", F.col("cwd").alias("_cwd"), F.col("created_at").alias("_created"))
        files = files.join(own, "path", "left").withColumns({"archived": F.col("path").contains("/archived_sessions/"), "_title": F.lit(None).cast("string")})
    else:
        own = D.claude_titles(lines).withColumnRenamed("title", "_title")
        files = files.join(own, "session_id", "left").withColumns({"archived": F.lit(None).cast("boolean"), "_cwd": F.lit(None).cast("string"), "_created": F.lit(None).cast("timestamp")})
    rest = ("path", "file_key", "cursor_offset", "cursor_anchor", "archived", "_title", "_cwd", "_created")
    one = files.groupBy("session_id").agg(F.max_by(F.struct(*rest), "path").alias("f")).select("session_id", "f.*").join(said, "session_id", "left")
    now = one.select(
        F.lit(source).alias("source_type"), "session_id", "title", F.coalesce("cwd", "_cwd").alias("cwd"), "archived", F.col("path").alias("source_path"), "file_key", "cursor_offset", "cursor_anchor",
        F.coalesce("_created", "created_at").alias("created_at"), "updated_at", F.nullif(F.col("_title"), F.lit("")).alias("last_title"),
    )
    before = store.sessions().where(F.col("source_type") == source)
    own = T.StructType([*(f for f in SESSIONS if f.name not in COMMIT), T.StructField("last_title", T.StringType())])
    state = merged(before.drop(*COMMIT), assert_schema(now.withColumn("subagent_source_json", F.lit(None).cast("string")), own))
    return state.withColumn("title", F.coalesce("last_title", "title")).drop("last_title")
