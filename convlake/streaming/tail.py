"""Collecting: what files have grown by, as DataFrame jobs that end in commits of a store.

A wake-up lists the files and freezes their sizes. Files and sessions are matched by join, the line at each
cursor is checked by tasks, and what is left to read is a table of byte ranges. Each commit takes its share
of it: everything, or at most ``most_bytes``, where the files that were served longest ago come first and
sources take turns. The ranges are written as the commit's intent before a line is read, so a commit that
was begun is finished from its intent, before anything else, by whoever comes next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convlake.sources.files import file_key, is_open_to_tasks, listed
from convlake.sources.jsonl import LEAST_SHARE, head_lines, line_before, range_lines
from convlake.work import discard, staged, work_dir

from .incremental import recovery
from .publish import COMMIT, KEY, Store, session_states


def _looked_at(files: DataFrame) -> DataFrame:
    """``files`` (path, size) with file_key and name."""

    def look(pdfs):
        for pdf in pdfs:
            pdf["file_key"] = [file_key(p) for p in pdf["path"]]
            yield pdf

    own = files.where(is_open_to_tasks(F.col("path"))).mapInPandas(look, "path string, size long, file_key string")
    rest = files.where(~is_open_to_tasks(F.col("path"))).withColumn("file_key", F.lit(None).cast("string"))
    return own.unionByName(rest).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))


def _checked(pairs: DataFrame) -> DataFrame:
    """``pairs`` of files and sessions with ``same``: whether the session's cursor still holds in the file.

    It does in the same file, if that is long enough and the line that ends there is the cursor's. A file
    that ends at its cursor has nothing to read and isn't opened; one that only Spark opens is trusted.
    """

    def check(pdfs):
        for pdf in pdfs:
            same = []
            for r in pdf.itertuples():
                ok = (r.known_key is None or r.file_key is None or r.known_key == r.file_key) and r.size >= r.cursor
                if ok and r.cursor and r.size > r.cursor and r.open:
                    line = line_before(r.path, int(r.cursor))
                    ok = line is not None and (r.anchor is None or hashlib.sha256(line.encode()).hexdigest() == r.anchor)
                same.append(ok)
            yield pdf.assign(same=same)

    rows = pairs.select("path", "size", "file_key", "session_id", "known_key", "cursor", "anchor", is_open_to_tasks(F.col("path")).alias("open"))
    return rows.mapInPandas(check, "path string, size long, file_key string, session_id string, known_key string, cursor long, anchor string, open boolean, same boolean")


def _by_name(files: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """path and ``called`` (name and session) of the ``files`` that may be moved ones: no session is known at their
    path, but one whose file had their name. Many files can have one name, so what session a file is of is what it
    would be called if it were new.
    """
    from convlake.sources import dialects as D

    names = known.select(F.regexp_extract("source_path", "([^/]+)$", 1).alias("name")).distinct()
    found = files.join(known.select(F.col("source_path").alias("path")), "path", "left_anti").join(names, "name", "left_semi")
    session = D.file_stem(F.col("path"))
    if source == "codex" and not found.isEmpty():
        found = found.join(D.codex_sessions(head_lines(found, "session_meta")).select("path", F.col("session_id").alias("_meta")), "path", "left")
        session = F.coalesce("_meta", session)
    return found.select("path", F.concat_ws("/", "name", session).alias("called"))


def backlog(store: Store, source: str, files: DataFrame, folder: str) -> DataFrame:
    """The bytes of ``files`` (path, size) that no commit took, up to the sizes given: ranges as an intent has them.

    A session's file is the one at its path, else the file it was, else one of that name and session. It goes on at the
    cursor, or behind bytes without a line end that were looked at already. A file that was replaced,
    shortened, rewritten or moved goes on behind the last restore marker of its session, else behind the
    nearest line with the cursor's anchor; without either it is left alone, as reading it from the start
    would write its messages twice.
    """
    from convlake.functions import scalars as S
    from convlake.operators.export import restore_boundaries
    from convlake.operators.sessions import remapped_anchors

    files = staged(_looked_at(files), f"{folder}/files-{source}")
    sessions = store.sessions().where((F.col("source_type") == source) & F.col("source_path").isNotNull() & F.col("cursor_offset").isNotNull())
    known = sessions.select("session_id", "source_path", F.col("file_key").alias("known_key"), F.col("cursor_offset").alias("cursor"), F.col("cursor_anchor").alias("anchor"))
    # by path, as the same file, by name and session: of each session and of each file the first way that leads anywhere counts
    ways = lambda rows, *values: rows.select("*", F.posexplode(F.array(*values)).alias("way", "value")).where("value is not null")
    called = F.concat_ws("/", F.regexp_extract("source_path", "([^/]+)$", 1), "session_id")
    sides = ways(files.join(_by_name(files, known, source), "path", "left"), F.col("path"), F.col("file_key"), F.col("called")), ways(known, F.col("source_path"), F.col("known_key"), called)
    pairs = sides[0].join(sides[1], ["way", "value"]).drop("value")
    rest = [c for c in pairs.columns if c != "session_id"]
    pairs = pairs.groupBy("session_id").agg(F.min_by(F.struct(*rest), F.struct("way", "path")).alias("s")).select("session_id", "s.*")
    rest = [c for c in pairs.columns if c != "path"]
    pairs = pairs.groupBy("path").agg(F.min_by(F.struct(*rest), F.struct("way", "session_id")).alias("s")).select("path", "s.*")
    checked = staged(_checked(pairs), f"{folder}/checked-{source}")
    new = files.join(checked.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("session_id"), "file_key", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    sound = checked.where("same").select("path", "session_id", "file_key", F.col("cursor").alias("low"), F.col("size").alias("high"))
    out = new.unionByName(sound)
    doubtful = checked.where("not same")
    if not doubtful.isEmpty():
        lines = range_lines(doubtful.select("path", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))).persist()
        asked = doubtful.select("path", "session_id", "anchor", F.col("cursor").alias("offset"))
        near = remapped_anchors(lines.select("path", "end_offset", S.line_anchor(F.col("line")).alias("anchor")), asked)
        marks = restore_boundaries(lines, store.sessions()).join(asked.select("session_id", "path"), "session_id").select("path", "resume_offset")
        again = near.join(marks, "path", "left").select("path", F.coalesce("resume_offset", "end_offset").alias("low")).where("low is not null")
        found = staged(doubtful.join(again, "path").select("path", "session_id", "file_key", "low", F.col("size").alias("high")), f"{folder}/again-{source}")
        lines.unpersist()
        out = out.unionByName(found)
    # bytes behind the cursor that were looked at, and held no line end yet
    looked = store.positions().where(F.col("source_type") == source).select("path", F.col("file_key").alias("_key"), F.col("high").alias("_high"))
    out = out.join(looked, "path", "left")
    ahead = F.col("_key").eqNullSafe(F.col("file_key")) & (F.col("_high") <= F.col("high")) & (F.col("_high") > F.col("low"))
    out = out.withColumn("low", F.when(ahead, F.col("_high")).otherwise(F.col("low"))).where("low < high")
    return out.select(F.lit(source).alias("source_type"), "path", "session_id", "file_key", "low", "high")


def share(left: DataFrame, served: DataFrame, most_bytes: int) -> DataFrame:
    """What one commit takes of the ranges ``left``: at most ``most_bytes``.

    Files that were ``served`` (source_type, path, version) longest ago come first, and sources take turns, so
    every file gets on within one round over all. So many files take part that each gets LEAST_SHARE bytes, or
    one file alone where the bound is less.
    """
    there = left.count()
    many = max(1, min(there, most_bytes // LEAST_SHARE))
    if many >= there:  # all take part, in any order
        return left.withColumn("high", F.least("high", F.col("low") + most_bytes // many))
    turn = left.join(served.select("source_type", "path", "version"), ["source_type", "path"], "left")
    order = Window.partitionBy("source_type").orderBy(F.asc_nulls_first("version"), "path")
    # no source has more than ``many`` in it, which each task sees for itself
    first = turn.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= many)
    taken = first.orderBy("_nth", F.asc_nulls_first("version"), "source_type").limit(many)
    return taken.withColumn("high", F.least("high", F.col("low") + most_bytes // many)).select(*left.columns)


def finish(store: Store, commit: int, options: dict, stop_after: str = "") -> bool:
    """Do commit ``commit`` from its intent; False if its bytes don't end any more where its pending states say.

    What is written already isn't read again: a commit with all its messages is only promoted.
    """
    from convlake.operators.attachments import taken_out
    from convlake.sources import dialects as D

    spark = store.spark
    if store.is_written(commit):
        store.promote(commit)
        return True
    intent = store.intent(commit)
    states, messages, held = None, None, []
    for source in [r["source_type"] for r in intent.select("source_type").distinct().collect()]:  # the two clients
        own = intent.where(F.col("source_type") == source)
        lines = range_lines(own).persist()
        held.append(lines)
        names = store.sessions().where(F.col("source_type") == source).select(F.col("source_path").alias("path"), "session_id").where("path is not null")
        told = own.where("session_id is not null").select("path", "session_id")
        names = names.join(told, "path", "left_anti").unionByName(told)
        rows = D.DIALECTS[source](lines, names).dropDuplicates(["message_id"]).persist()  # states and messages are both made of them
        held.append(rows)
        state = session_states(store, lines, rows, source, names, own.select("path", "file_key"), options.get("roll_up"))
        base = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        rows = taken_out(rows, options.get("files"), base=base, **options.get("attachments", {})).drop("path", "end_offset")
        states, messages = (state, rows) if states is None else (states.unionByName(state), messages.unionByName(rows))
    try:
        if states is None:  # a commit of metadata alone, begun by somebody who is gone
            pending = store.sessions().where(F.col("pending_commit_id") == commit)
            states, messages = pending.withColumns({"cursor_offset": F.col("pending_cursor.offset"), "cursor_anchor": F.col("pending_cursor.anchor")}), store.messages(pending=True).limit(0)
        elif store.has_pending(commit) and not recovery(store.sessions().where(F.col("pending_commit_id") == commit), states).where("not complete").isEmpty():
            return False
        store.publish(states, messages, commit, stop_after)
    finally:
        for kept in held:
            kept.unpersist()
    return True


def drain(spark: SparkSession, store: Store, paths: dict[str, str], most_bytes: int | None = None, recursive: bool = True, layout: str | None = None, stop_after: str = "", listing: dict[str, DataFrame] | None = None, **options) -> str:
    """One wake-up over ``paths`` (by source): finish what was begun, then read to the ends that files have now.

    Gives "done", or "waiting" if a commit that was begun can't be finished, as its files changed meanwhile;
    nothing else is read then. ``listing`` (path, size; by source) says what is read, and up to where, in place of
    what is there. ``stop_after`` ("intent", "pending" or "messages") leaves the first new commit
    unfinished, as a lost driver would.
    """
    store.claim()
    pending = store.pending_commit()
    if pending is not None and not finish(store, pending, options):
        return "waiting"
    folder = work_dir(spark)
    left = None
    for source, path in paths.items():
        files = listing[source] if listing and source in listing else listed(spark, path, recursive, layout)
        own = backlog(store, source, files, folder)
        left = own if left is None else left.unionByName(own)
    left = staged(left, f"{folder}/left")
    while not left.isEmpty():
        commit = store.next_commit()
        taken = left if most_bytes is None else share(left, store.positions(), most_bytes)
        taken = store.intend(taken, commit)
        if stop_after == "intent":
            return "stopped"
        finish(store, commit, options, stop_after)
        if stop_after:
            return "stopped"
        if most_bytes is None:
            break
        got = taken.select("source_type", "path", F.col("high").alias("_high"))
        rest = left.join(got, ["source_type", "path"], "left").withColumn("low", F.coalesce("_high", "low")).where("low < high").drop("_high")
        left = staged(rest, f"{folder}/left{commit}")
    discard(spark, folder)
    return "done"


def update_metadata(store: Store, source: str, metadata: DataFrame) -> None:
    """Publish sessions whose ``metadata`` (KEY and some of title, cwd, archived) differ from what is stored."""
    from convlake.operators.catalog import changed

    before = store.sessions().where(F.col("source_type") == source).drop(*COMMIT)
    names = [c for c in metadata.columns if c not in KEY]
    now = before.join(metadata.select(*KEY, *(F.col(c).alias(f"_{c}") for c in names)), KEY).withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*before.columns)
    differ = changed(before, now, names)
    if not differ.isEmpty():
        store.publish(differ, store.messages(pending=True).limit(0), store.next_commit())


def follow(spark: SparkSession, store: Store, paths: dict[str, str], checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """A streaming query that drains ``paths`` at every trigger: once, or each ``every`` ("5 minutes").

    Its source only ticks; what is read, and what is done, is in the store. So a batch that Spark runs again,
    or another query after a lost ``checkpoint``, goes on where the store says.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, batch: drain(spark, store, paths, **options) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def collect(spark: SparkSession, store: Store, path: str, source: str, checkpoint: str, roll_up: Callable[[DataFrame], DataFrame] | None = None, files: DataFrame | None = None, metadata: DataFrame | None = None, most_bytes: int | None = None, **options) -> StreamingQuery:
    """Collect the transcripts of one source into ``store`` until all that was there at the start is read.

    Attachments are taken out on the way (local ones from ``files``). ``metadata`` also changes sessions
    without new messages. Returns the query of one wake-up, which has ended.
    """
    query = follow(spark, store, {source: path}, checkpoint, roll_up=roll_up, files=files, most_bytes=most_bytes, **options)
    query.awaitTermination()
    if metadata is not None:
        update_metadata(store, source, metadata)
    return query
