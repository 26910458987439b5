"""The ``jsonl_offsets`` data source: lines of growing files with exact byte offsets, batch and stream.

Rows are path, start_offset, end_offset, line (one carriage return at its end stripped) and
line_terminated. A file is cut into byte ranges, and small files share a task. In a batch a range owns the
lines that begin in it. In a stream it owns those that end in it: where a line begins is looked for backwards
in the task, so the driver lists files and their sizes and opens none. An unfinished line belongs to the
batch in which its end comes.

Options: ``path`` (a folder, a file or a glob; several by commas), ``recursive`` (default true), ``layout``
("projects": only ``<path>/<folder>/*.jsonl``), ``rangeBytes``, and for streams ``maxBytesPerTrigger``: no
batch reads more, and files take turns, so every file gets on within one round. The stream's offset has how
far each file was read, and whose turn is next.

``range_lines`` reads the same rows from a table of ranges, which tasks make and read; ``spark_lines`` reads
them with Spark's own text reader, from any store that only Spark opens.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from convlake.sources.files import file_key, is_open_to_tasks, opened, plain, plain_path, scheme, size_of

SCHEMA = "path string, start_offset long, end_offset long, line string, line_terminated boolean"
RANGE_BYTES = 32 << 20
BLOCK = 1 << 16


#: What a file costs besides its bytes: small ones share a task.
OPEN_BYTES = 256 << 10
#: The least that a file gets of a bounded batch, unless the batch is smaller.
LEAST_SHARE = 1 << 10


class Range(NamedTuple):
    """Lines of ``path`` that begin in [``low``, ``high``); nothing at or after ``end`` is read."""

    path: str
    low: int
    high: int
    end: int


class Share(InputPartition):
    """The ranges that one task reads."""

    def __init__(self, ranges: Iterable[Range]):
        super().__init__(ranges)
        self.ranges = ranges


def shares(found: list[Range], size: int) -> list[Share]:
    """``found`` in shares of about ``size`` bytes, in order; each range counts OPEN_BYTES more than it has."""
    out: list[list[Range]] = []
    room = 0
    for r in found:
        cost = r.high - r.low + OPEN_BYTES
        if not out or cost > room:
            out.append([])
            room = size
        out[-1].append(r)
        room -= cost
    return [Share(x) for x in out]


def found_files(options: dict) -> list[str]:
    """Paths of the JSON lines files that the options name."""
    recursive = str(options.get("recursive", "true")).lower() == "true"
    below = "*/*.jsonl" if options.get("layout") == "projects" else "**/*.jsonl" if recursive else "*.jsonl"
    out: set[str] = set()
    for path in map(plain, options["path"].split(",")):
        if scheme(path) != "file":
            out.update(_remote(path, below))
        elif os.path.isdir(path):
            out.update(glob.glob(os.path.join(glob.escape(path), below), recursive=True))
        else:
            out.update(glob.glob(path, recursive=True))
    return sorted(p for p in out if os.path.basename(p) != "sessions-index.jsonl" and (scheme(p) != "file" or os.path.isfile(p)))


def _remote(path: str, below: str) -> Iterator[str]:
    """The same below a folder, or at a file, of a store that Arrow opens."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        yield path
        return
    inner = inner.rstrip("/")
    for f in store.get_file_info(fs.FileSelector(inner, recursive=below != "*.jsonl", allow_not_found=True)):
        deep = f.path[len(inner) :].count("/")
        if f.type == fs.FileType.File and f.path.endswith(".jsonl") and (below == "**/*.jsonl" or deep == below.count("/") + 1):
            yield path.rstrip("/") + f.path[len(inner) :]


def line_before(path: str, end: int) -> str | None:
    """The line that ends at ``end``, without its line end; None if none ends there."""
    with opened(path) as f:
        raw, low = b"", end
        while low and b"\n" not in raw[:-1]:
            start = max(0, low - BLOCK)
            f.seek(start)
            raw, low = f.read(low - start) + raw, start
    if len(raw) < end - low or not raw.endswith(b"\n"):
        return None
    return raw[:-1].rpartition(b"\n")[2].removesuffix(b"\r").decode("utf-8", "replace")


def ranges(path: str, low: int, end: int, size: int) -> list[Range]:
    return [Range(path, at, min(at + size, end), end) for at in range(low, end, size)]


def lines(part: Range) -> Iterator[tuple]:
    """The lines that begin in the range, with their offsets."""
    with opened(part.path) as f:
        at = part.low
        if at:  # a line begins here only after a newline
            f.seek(at - 1)
            at += len(f.readline(part.end - at + 1)) - 1
        f.seek(at)
        while at < part.high:
            raw = f.readline(part.end - at)
            if not raw:
                return
            done = raw.endswith(b"\n")
            line = raw[:-1].removesuffix(b"\r") if done else raw
            yield part.path, at, at + len(raw), line.decode("utf-8", "replace"), done
            at += len(raw)


def line_start(f, at: int) -> int:
    """Where the line that ``at`` lies in begins."""
    while at:
        start = max(0, at - BLOCK)
        f.seek(start)
        found = f.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def ended(part: Range) -> Iterator[tuple]:
    """The lines whose end lies behind ``low`` and not behind ``high``, with their offsets."""
    with opened(part.path) as f:
        at = line_start(f, part.low)
        f.seek(at)
        while at < part.high:
            raw = f.readline(part.high - at)
            if not raw.endswith(b"\n"):
                return
            yield part.path, at, at + len(raw), raw[:-1].removesuffix(b"\r").decode("utf-8", "replace"), True
            at += len(raw)


def batches(part: Share, of=None) -> Iterator:
    """Lines (by ``of``: lines or ended) as Arrow batches of bounded size."""
    import pyarrow as pa

    names, rows, size = ("path", "start_offset", "end_offset", "line", "line_terminated"), [], 0
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for row in chain.from_iterable(map(of or lines, part.ranges)):
        rows.append(row)
        size += row[2] - row[1]
        if len(rows) >= 4096 or size >= 4 << 20:
            yield table()
            rows, size = [], 0
    if rows:
        yield table()


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Share]:
        size = int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES)))
        return shares([r for p in found_files(self.options) for r in ranges(p, 0, size_of(p) or 0, size)], size)

    def read(self, partition: Share) -> Iterator:
        return batches(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.at = options, {"files": "{}", "turn": "0"}

    def initialOffset(self) -> dict:
        return {"files": "{}", "turn": "0"}

    def latestOffset(self) -> dict:
        seen, turn = json.loads(self.at["files"]), int(self.at["turn"])
        most = self.options.get("maxbytespertrigger", self.options.get("maxBytesPerTrigger"))
        sizes = {p: size_of(p) or 0 for p in found_files(self.options)}
        behind = [p for p, size in sizes.items() if size > seen.get(p, 0)]
        if most is None or not behind:
            seen |= {p: sizes[p] for p in behind}
        else:
            turn %= len(behind)
            many = max(1, min(len(behind), int(most) // LEAST_SHARE))
            for p in (behind[turn:] + behind[:turn])[:many]:
                seen[p] = min(sizes[p], seen.get(p, 0) + int(most) // many)
            turn += many
        self.at = {"files": json.dumps(seen, sort_keys=True), "turn": str(turn)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Share]:
        size = int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES)))
        before, now = json.loads(start["files"]), json.loads(end["files"])
        known = json.loads(self.at["files"])
        if any(known.get(p, 0) < at for p, at in now.items()):  # a restarted stream goes on from its log
            self.at = end
        return shares([r for p, high in now.items() for r in ranges(p, before.get(p, 0), high, size)], size)

    def read(self, partition: Share) -> Iterator:
        return batches(partition, ended)


class JsonlOffsets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_offsets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("jsonl_offsets")`` and its stream known to the session."""
    spark.dataSource.register(JsonlOffsets)


def range_lines(table: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Lines that end in the ranges of ``table`` (path, low, high and maybe file_key), read by tasks.

    A file that is shorter than its range, or another one than ``file_key`` says, gives nothing.
    """
    spark = table.sparkSession
    key = F.col("file_key") if "file_key" in table.columns else F.lit(None).cast("string")
    table = table.select("path", "low", "high", key.alias("file_key")).where("low < high")
    cut = table.withColumn("at", F.explode(F.expr(f"sequence(low, high - 1, {size}L)")))
    cut = cut.select("path", F.col("at").alias("low"), F.least(F.col("at") + size, "high").alias("high"), F.col("high").alias("end"), "file_key")
    own, others = cut.where(is_open_to_tasks(F.col("path"))), table.where(~is_open_to_tasks(F.col("path")))
    many, size_, cost = own.agg(F.count("*"), *(F.coalesce(F.sum(F.col("high") - F.col("low") + n), F.lit(0)) for n in (0, OPEN_BYTES))).first()
    # small files are spread over all cores, but their number alone doesn't make more tasks
    tasks = min(-(-cost // size), max(-(-size_ // size), 4 * spark.sparkContext.defaultParallelism))

    def read(batches_):
        for batch in batches_:  # each file is looked at just before it is read; small ones share what is given back
            yield from batches(Share(Range(r["path"], r["low"], r["high"], r["end"]) for r in batch.to_pylist() if (size_of(r["path"]) or 0) >= r["end"] and r["file_key"] in (None, file_key(r["path"]))), ended)

    found = own.repartition(max(1, min(many, tasks)), "path", "low").mapInArrow(read, SCHEMA)
    if not (paths := [r["path"] for r in others.select("path").distinct().toLocalIterator()]):  # of stores that only Spark opens
        return found
    slow = spark_lines(spark, paths).join(others.select("path", "low", "high"), "path").where("line_terminated and end_offset > low and end_offset <= high").drop("low", "high")
    return found.unionByName(slow)


def head_lines(files: DataFrame, kind: str) -> DataFrame:
    """Complete lines of ``files`` (path, size) that have ``kind`` in them, up to the first event of that type; read by tasks.

    Of a file in a store that only Spark opens these are all its lines.
    """
    spark = files.sparkSession

    def is_kind(line: str) -> bool:
        try:
            event = json.loads(line)
        except (ValueError, RecursionError):
            return False
        return isinstance(event, dict) and event.get("type") == kind

    def head(part: Range) -> Iterator[tuple]:
        for row in ended(part):
            if kind in row[3]:
                yield row
                if is_kind(row[3]):
                    return

    def read(batches_):
        for batch in batches_:
            yield from batches(Share(Range(r["path"], 0, r["size"], r["size"]) for r in batch.to_pylist() if (size_of(r["path"]) or 0) >= r["size"]), head)

    own, others = files.where(is_open_to_tasks(F.col("path"))), files.where(~is_open_to_tasks(F.col("path")))
    found = own.select("path", "size").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(read, SCHEMA)
    if others.isEmpty():
        return found
    return found.unionByName(range_lines(others.select("path", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))))


def spark_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of ``paths`` by Spark's text reader, which opens any of Spark's file systems.

    It says which block of its file a line is from, and gives a block's lines in order. Tasks add up lengths
    within blocks; how long the blocks before are is a sum over the few blocks of a file.
    """
    path = plain_path(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    rows = spark.read.option("lineSep", "\n").text(paths).select(path.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def place(batches_):
        import pyarrow as pa

        last, at = None, 0
        for batch in batches_:
            path, block, places, lines, longs = batch.column("path").to_pylist(), batch.column("block").to_pylist(), [], [], []
            for p, b, v in zip(path, block, batch.column("value").to_pylist(), strict=True):
                if (p, b) != last:
                    last, at = (p, b), 0
                places.append(at)
                longs.append(len(v) + 1)
                at += len(v) + 1
                lines.append(v.decode("utf-8", "replace"))
            columns = [pa.array(path, pa.string()), batch.column("size"), batch.column("block"), pa.array(places, pa.int64()), pa.array(longs, pa.int64()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "size", "block", "at", "length", "line"])

    placed = rows.mapInArrow(place, "path string, size long, block long, at long, length long, line string")
    blocks = rows.groupBy("path", "block").agg(F.sum(F.octet_length("value") + 1).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = placed.join(blocks, ["path", "block"]).withColumn("start_offset", F.col("before") + F.col("at"))
    end, done = F.col("start_offset") + F.col("length"), F.col("start_offset") + F.col("length") <= F.col("size")
    line = F.when(done & F.col("line").endswith("\r"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    return rows.select("path", "start_offset", F.when(done, end).otherwise(F.col("size")).alias("end_offset"), line.alias("line"), done.alias("line_terminated"))
