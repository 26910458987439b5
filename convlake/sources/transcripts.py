"""The ``transcripts`` sink: one JSON lines file for each session, whole or not at all.

``df.write.format("transcripts").mode("append").save(path)`` takes rows of file (below ``path``), position, ord
and json, the rows of a file together and in order. A null line is an empty one. A task writes each file under a name of its own and gives
it its real one when all its rows are there; a task that fails takes its unfinished files away, and one that
runs again writes the same files again.
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from convlake.functions import scalars as S
from convlake.sources.files import plain, scheme

ROWS = "file string, position long, ord int, json string"


class Target:
    """Where files are written: a local folder, or one of a store that Arrow opens."""

    def __init__(self, path: str):
        self.root, self.store = plain(path), None
        if scheme(self.root) != "file":
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(path)

    def create(self, name: str):
        where = posixpath.join(self.root, name)
        if self.store is None:
            os.makedirs(os.path.dirname(where), exist_ok=True)
            return open(where, "wb")
        self.store.create_dir(posixpath.dirname(where), recursive=True)
        return self.store.open_output_stream(where)

    def move(self, name: str, to: str) -> None:
        old, new = posixpath.join(self.root, name), posixpath.join(self.root, to)
        os.replace(old, new) if self.store is None else self.store.move(old, new)

    def remove(self, name: str) -> None:
        with contextlib.suppress(OSError):
            where = posixpath.join(self.root, name)
            os.remove(where) if self.store is None else self.store.delete_file(where)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:  # of Arrow batches
        target, own, out = Target(self.path), "", None
        try:
            for batch in iterator:
                for file, json in zip(batch.column("file").to_pylist(), batch.column("json").to_pylist(), strict=True):
                    if file != own:
                        self._done(target, own, out)
                        own, out = file, None
                        self.hidden = posixpath.join(posixpath.dirname(own), f".{posixpath.basename(own)}.{uuid.uuid4().hex}")
                        out = target.create(self.hidden)
                    out.write((json or "").encode() + b"\n")
            self._done(target, own, out)
        except BaseException:
            if out is not None:
                out.close()
                target.remove(self.hidden)
            raise
        return WriterCommitMessage()

    def _done(self, target: Target, own: str, out) -> None:
        if out is not None:
            out.close()
            target.move(self.hidden, own)

    def commit(self, messages) -> None:
        Target(self.path).create("_SUCCESS").close()

    def abort(self, messages) -> None:
        """Files that are whole stay; a later run writes them again."""


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def native_paths(sessions: DataFrame) -> DataFrame:
    """KEY and ``file``: where each client keeps a session's transcript.

    Claude: by project folder and session. Codex: by day, with the time in the name, or among the archived.
    """
    session = S.safe_file_name(F.col("session_id"))
    claude = F.concat(F.lit("projects/"), S.safe_directory(F.coalesce("cwd", F.lit("/"))), F.lit("/"), session, F.lit(".jsonl"))
    at = F.coalesce("created_at", F.timestamp_seconds(F.lit(0)))
    name = F.concat(F.lit("rollout-"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), session, F.lit(".jsonl"))
    codex = F.when(F.col("archived"), F.concat(F.lit("archived_sessions/"), name)).otherwise(F.concat(F.lit("sessions/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), name))
    return sessions.select("source_type", "session_id", F.concat("source_type", F.lit("/"), F.when(F.col("source_type") == "claude", claude).otherwise(codex)).alias("file"))


def write_native(lines: DataFrame, sessions: DataFrame, path: str) -> None:
    """Write ``lines`` (KEY, position, ord, json) as the clients' own transcripts below ``path``."""
    write_files(lines.join(native_paths(sessions), ["source_type", "session_id"]), path)


def write_files(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ``lines`` (file, position, ord, json) as files below ``path``; tasks put each where it belongs, the driver moves none."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(Transcripts)
    rows = lines.select("file", F.col("position").cast("long").alias("position"), F.col("ord").cast("int").alias("ord"), "json")
    dealt = rows.repartition(partitions, "file") if partitions else rows.repartition("file")
    dealt.sortWithinPartitions("file", "position", "ord").write.format("transcripts").option("path", path).mode("append").save()
