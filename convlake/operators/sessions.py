"""Session state: metadata of several origins, roll-ups of ordered events, checkpoints and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions import scalars as S

KEY = ["source_type", "session_id"]

THREADS = {"id": "string", "rollout_path": "string", "title": "string", "cwd": "string", "archived": "long", "created_at": "long", "updated_at": "long", "created_at_ms": "long", "updated_at_ms": "long", "source": "string", "thread_source": "string"}


def thread_metadata(threads: DataFrame) -> DataFrame:
    """The client's thread table, whichever of its columns a version has; rows without id or path go."""
    col = {n: F.col(n).cast(t) if n in threads.columns else F.lit(None).cast(t) for n, t in THREADS.items()}
    return threads.select(
        col["id"].alias("session_id"), col["rollout_path"].alias("source_path"), col["title"].alias("title"), col["cwd"].alias("cwd"), F.coalesce(col["archived"] != 0, F.lit(False)).alias("archived"),
        S.millis_or_seconds(col["created_at_ms"], col["created_at"]).alias("created_at"), S.millis_or_seconds(col["updated_at_ms"], col["updated_at"]).alias("updated_at"),
        S.subagent_source(col["source"], col["thread_source"]).alias("subagent_source_json"),
    ).where(~S.is_blank(F.col("session_id")) & ~S.is_blank(F.col("source_path")))


def title_index(lines: DataFrame) -> DataFrame:
    """Title by session from JSON lines (``position``, ``line``): the last valid one wins.

    A line that isn't an object with a non-blank id and a non-blank text as name is passed over.
    """
    entry = F.try_parse_json("line")
    field = lambda name: F.try_variant_get(entry, f"$.{name}", "string")
    text = F.schema_of_variant(F.try_variant_get(entry, "$.thread_name", "variant")) == "STRING"
    valid = lines.select("position", field("id").alias("session_id"), F.when(text, field("thread_name")).alias("title"), S.instant(field("updated_at")).alias("updated_at"))
    valid = valid.where(~S.is_blank(F.col("session_id")) & ~S.is_blank(F.col("title")))
    return valid.groupBy("session_id").agg(F.max_by("title", "position").alias("title"), F.max("updated_at").alias("updated_at"))


def session_index(document: DataFrame) -> DataFrame:
    """Entries of a session index document (originalPath, entries)."""
    e = F.col("e")
    rows = document.select("originalPath", F.explode("entries").alias("e"))
    return rows.select(e["sessionId"].alias("session_id"), S.first_non_blank(e["summary"], e["firstPrompt"]).alias("title"), S.first_non_blank(e["projectPath"], F.col("originalPath")).alias("cwd"), S.client_time(e["created"]).alias("created_at"), S.client_time(e["modified"]).alias("updated_at")).where(~S.is_blank(F.col("session_id")))


def id_list(documents: DataFrame, column: str = "json", path: str = "$.projectless-thread-ids") -> DataFrame:
    """Ids of a list document; if any element isn't a non-blank text, the whole list is unknown (null)."""
    ids = F.try_variant_get(F.try_parse_json(column), "$['" + path[2:] + "']", "array<variant>")
    texts = F.transform(ids, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return documents.withColumn("ids", F.when(F.forall(texts, lambda x: x.isNotNull() & (F.trim(x) != "")), texts))


def named(threads: DataFrame, names: DataFrame) -> DataFrame:
    """Threads with the index's titles, where it has one, and the later of both times."""
    other = names.select("session_id", F.col("title").alias("_title"), F.col("updated_at").alias("_updated"))
    return threads.join(other, "session_id", "left").withColumn("title", S.first_non_blank(F.col("_title"), F.col("title"))).withColumn("updated_at", S.latest(F.col("updated_at"), F.col("_updated"))).drop("_title", "_updated")


def with_unindexed(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """Indexed threads, and transcripts whose path no thread has: one for each id that is still free."""
    fresh = found.join(indexed.select("source_path"), "source_path", "left_anti").join(indexed.select("session_id"), "session_id", "left_anti")
    first = fresh.groupBy("session_id").agg(*(F.min_by(c, "source_path").alias(c) for c in found.columns if c != "session_id"))
    return indexed.unionByName(first.select(*found.columns), allowMissingColumns=True)


def repaired(threads: DataFrame, metas: DataFrame) -> DataFrame:
    """Threads with a blank cwd filled, and the source overridden, from the transcripts themselves."""
    own = metas.select("session_id", F.col("cwd").alias("_cwd"), F.col("source").alias("_source"))
    return threads.join(own, "session_id", "left").withColumn("cwd", S.first_non_blank(F.col("cwd"), F.col("_cwd"))).withColumn("source", F.coalesce("_source", "source")).drop("_cwd", "_source")


def with_checkpoints(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records with where their session's last commit ended; 0 and -1 for one that is new."""
    at = sessions.select(*KEY, F.col("cursor_offset"), F.col("last_commit_id"))
    return records.join(at, KEY, "left").fillna({"cursor_offset": 0, "last_commit_id": -1})


def only(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records of the given sessions."""
    return records.join(sessions.select(*KEY).distinct(), KEY, "left_semi")


def skip_existing(sessions: DataFrame, there: DataFrame) -> DataFrame:
    """Sessions that the target doesn't have."""
    return sessions.join(there.select(*KEY).distinct(), KEY, "left_anti")


def remapped_anchors(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where a session goes on after its file was rewritten.

    ``lines`` has path, end_offset and anchor; ``wanted`` path, anchor and the old offset. Of the lines with
    the anchor the nearest counts, the first of two; without any the session is paused.
    """
    near = lines.select("path", "anchor", "end_offset").join(wanted.select("path", "anchor", "offset"), ["path", "anchor"])
    best = near.groupBy("path").agg(F.min_by("end_offset", F.struct(F.abs(F.col("end_offset") - F.col("offset")), "end_offset")).alias("end_offset"))
    return wanted.select("path").join(best, "path", "left").withColumn("paused", F.col("end_offset").isNull())


def unstable(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sessions of ``before`` that are gone, pending, or at another commit or cursor ``now``."""
    new = now.select(*KEY, F.lit(True).alias("_there"), F.col("pending_commit_id").alias("_pending"), F.col("last_commit_id").alias("_last"), F.col("cursor_offset").alias("_cursor"))
    moved = F.col("_there").isNull() | F.col("_pending").isNotNull() | ~F.col("_last").eqNullSafe(F.col("last_commit_id")) | ~F.col("_cursor").eqNullSafe(F.col("cursor_offset"))
    return before.join(new, KEY, "left").where(moved).select(*KEY)


def rolled_up(events: DataFrame) -> DataFrame:
    """State of each session from its events (start_offset, end_offset, role, text, cwd, event_time, anchor).

    Title: the first user text; cwd: the last that isn't blank; created_at: the first time there is;
    updated_at: the last in file order, which needn't be the latest; the cursor: behind the last event.
    """
    at = F.col("start_offset")
    timed, said = F.when(F.col("event_time").isNotNull(), at), F.when((F.col("role") == "user") & ~S.is_blank(F.col("text")), at)
    rows = events.groupBy(*KEY).agg(
        F.min_by("text", said).alias("first_text"), F.max_by("cwd", F.when(~S.is_blank(F.col("cwd")), at)).alias("cwd"), F.min_by("event_time", timed).alias("created_at"),
        F.max_by("event_time", timed).alias("updated_at"), F.max("end_offset").alias("cursor_offset"), F.max_by("anchor", "end_offset").alias("cursor_anchor"), F.count("*").alias("read_count"),
    )
    return rows.withColumn("title", S.title_from_text(F.col("first_text"))).drop("first_text")


def titles_in_order(events: DataFrame) -> DataFrame:
    """Title of each session by folding its events in order.

    A ``custom-title`` always overwrites, an ``ai-title`` if it isn't blank, and the first user text only
    while there is no title. Only events that bear on it are gathered, so a group is a few short rows.
    """
    kind, title = F.col("event_type"), F.col("title_text")
    bears = events.where((kind == "custom-title") | (kind.isin("ai-title", "user") & ~S.is_blank(title)))
    first_user = bears.where(kind == "user").groupBy(*KEY).agg(F.min("start_offset").alias("start_offset"))
    fixed = bears.where(kind != "user").unionByName(bears.where(kind == "user").join(first_user, [*KEY, "start_offset"], "left_semi"))
    steps = F.array_sort(F.collect_list(F.struct("start_offset", kind.alias("kind"), S.strip(title).alias("title"))))
    fold = F.aggregate("steps", F.lit(None).cast("string"), lambda now, e: F.when(e["kind"] == "user", F.coalesce(now, F.left(F.trim(F.regexp_replace(e["title"], r"\s+", " ")), F.lit(120)))).otherwise(F.nullif(e["title"], F.lit(""))))
    return fixed.groupBy(*KEY).agg(steps.alias("steps")).select(*KEY, fold.alias("title"))


def merged(before: DataFrame, now: DataFrame) -> DataFrame:
    """``now`` with what only an earlier state knows, and its creation time."""
    keep = [c for c in now.columns if c not in KEY]
    old = before.select(*KEY, *(F.col(c).alias(f"_{c}") for c in keep if c in before.columns))
    rows = now.join(old, KEY, "left")
    for c in keep:
        if f"_{c}" in rows.columns:
            rows = rows.withColumn(c, F.coalesce(f"_{c}", c) if c in ("created_at", "title") else F.coalesce(c, f"_{c}"))
    return rows.select(*now.columns)


def next_commit(sessions: DataFrame) -> DataFrame:
    """The commit to publish next: the one that is pending, or the one after the last; two pending are an error."""
    found = sessions.agg(F.count_distinct("pending_commit_id").alias("n"), F.max("pending_commit_id").alias("pending"), F.max("last_commit_id").alias("last"))
    return found.select(F.when(F.col("n") > 1, F.raise_error(F.lit("several pending commits")).cast("long")).otherwise(F.coalesce("pending", F.coalesce(F.col("last"), F.lit(-1)) + 1)).alias("commit_id"))


def merged_batches(batches: DataFrame) -> DataFrame:
    """Chunks of a session (``chunk`` in order) as one: last state, first cursor, counts added up."""
    return batches.groupBy(*KEY).agg(F.max_by("state", "chunk").alias("state"), F.min_by("starting_cursor", "chunk").alias("starting_cursor"), F.sum("read_count").alias("read_count"), F.count("*").alias("chunks"))


def commit_counts(messages: DataFrame) -> DataFrame:
    """Sessions and messages of every commit."""
    return messages.groupBy("commit_id").agg(F.count_distinct(*KEY).alias("sessions"), F.count("*").alias("messages"))


def duplicate_audit(rows: DataFrame, identity: list[str], content: str) -> DataFrame:
    """Identities that come more than once: ``ignored`` if their contents agree, else ``conflict``."""
    found = rows.groupBy(*identity).agg(F.count("*").alias("copies"), F.count_distinct(content).alias("contents")).where("copies > 1")
    return found.withColumn("verdict", F.when(F.col("contents") > 1, "conflict").otherwise("ignored"))


def fair_share(waiting: DataFrame, most: int, turn: int = 0) -> DataFrame:
    """Which of the waiting records (source, path, offset) a bounded batch takes.

    Files of a source take turns, and so do the sources: nobody gets a second record before everybody
    had one. ``turn`` moves where the turns begin. Records behind the bound can't be taken, so a file
    offers no more than that.
    """
    from pyspark.sql import Window

    files = waiting.select("source", "path").distinct().withColumn("_nth", F.row_number().over(Window.partitionBy("source").orderBy("path")))
    sources = files.groupBy("source").agg(F.count("*").alias("_files"))
    sources = sources.withColumns({"_source_turn": F.pmod(F.row_number().over(Window.orderBy("source")) - 1 - turn, F.count("*").over(Window.partitionBy()))})  # a row per source
    turns = files.join(F.broadcast(sources), "source").select("source", "path", "_source_turn", F.pmod(F.col("_nth") - 1 - turn, F.col("_files")).alias("_file_turn"))
    # what lies behind the bound is dropped by each task before it is sent anywhere
    in_file = waiting.withColumn("_round", F.row_number().over(Window.partitionBy("source", "path").orderBy("offset"))).where(F.col("_round") <= most)
    in_source = in_file.join(turns, ["source", "path"]).withColumn("_place", F.row_number().over(Window.partitionBy("source").orderBy("_round", "_file_turn"))).where(F.col("_place") <= most)
    return in_source.orderBy("_place", "_source_turn").limit(most).drop("_round", "_place", "_source_turn", "_file_turn")
