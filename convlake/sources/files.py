"""Files of any store, opened in tasks: local ones, those that Arrow's file systems open, and Spark's own."""

from __future__ import annotations

import contextlib
import fnmatch
import io
import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.work import hadoop, staged, work_dir

#: Schemes that Python workers can open by themselves; others are read by Spark's text reader.
ARROW = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
LISTING = "path string, size long"
WALKED = "path string, level int, size long"
#: So many entries of a folder the driver looks at itself; longer ones are left to tasks.
LOOKED_AT = 1000


def scheme(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else "file"


def plain(path: str) -> str:
    """A local path without its scheme; others stay."""
    return re.sub(r"^file:/*(?=/)", "", path)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def is_open_to_tasks(path: Column) -> Column:
    """Whether Python workers can open ``path``."""
    found = F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return found.isin("", *ARROW)


def _store(path: str):
    """Arrow's file system of ``path`` and the path within it."""
    from pyarrow import fs

    uri = path if scheme(path) not in ("gcs", "s3a") else path.replace(f"{scheme(path)}:", {"gcs": "gs:", "s3a": "s3:"}[scheme(path)], 1)
    return fs.FileSystem.from_uri(uri)


def opened(path: str):
    """``path`` for reading, with seek and readline."""
    path = plain(path)
    if scheme(path) == "file":
        return open(path, "rb")
    store, inner = _store(path)
    return io.BufferedReader(store.open_input_file(inner))


def size_of(path: str) -> int | None:
    """Bytes of ``path``; None if it isn't a file."""
    path = plain(path)
    if scheme(path) == "file":
        return os.path.getsize(path) if os.path.isfile(path) else None
    from pyarrow import fs

    store, inner = _store(path)
    found = store.get_file_info(inner)
    return found.size if found.type == fs.FileType.File else None


def file_key(path: str) -> str | None:
    """What a local file is, whatever it is called; other stores have no such thing."""
    path = plain(path)
    if scheme(path) != "file" or not os.path.exists(path):
        return None
    found = os.stat(path)
    return f"{found.st_dev}:{found.st_ino}"


def entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """path, whether it is a folder, and size of everything right in ``folder``; nothing if that is gone."""
    if scheme(folder) != "file":
        from pyarrow import fs

        store, inner = _store(folder)
        for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            yield f"{folder.rstrip('/')}/{f.base_name}", f.type == fs.FileType.Directory, f.size
        return
    with contextlib.suppress(FileNotFoundError, NotADirectoryError), os.scandir(folder) as found:
        for e in found:
            with contextlib.suppress(FileNotFoundError):  # gone since
                yield e.path, e.is_dir(), e.stat().st_size


class Walk(NamedTuple):
    """From a folder through those that match ``globs``, one after another, into what these name.

    Of a folder that is named, files ending in ``.jsonl`` count, with ``deep`` those further below too. Hidden
    names don't, as for Spark. Found are path, level (how many globs led there) and size, which folders don't have.
    """

    globs: tuple[str, ...]
    deep: bool

    def step(self, folder: str, level: int) -> Iterator[tuple[str, int, int | None]]:
        last = len(self.globs)
        for path, is_folder, size in entries(folder):
            name = path.rpartition("/")[2]
            hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
            if level < last:
                keep = fnmatch.fnmatchcase(name, self.globs[level]) and (is_folder or level + 1 == last and not hidden)
            else:
                keep = not hidden and (self.deep if is_folder else name.endswith(".jsonl"))
            if keep:
                yield path, level + 1, None if is_folder else size

    def below(self, folder: str, level: int) -> Iterator[tuple[str, int, int | None]]:
        for found in self.step(folder, level):
            yield found
            if found[2] is None:
                yield from self.below(*found[:2])


def walked(spark: SparkSession, folder: str, walk: Walk) -> DataFrame:
    """What ``walk`` finds from ``folder`` on (path, level, size), folders too.

    The driver looks at the first few folders, until there are enough to deal out; tasks list these, deal out
    what they hold once more, and go on from there.
    """
    found, near, far = [], deque([(folder, 0)]), []
    while near and len(near) < 64 and len(found) < LOOKED_AT:
        at = near.popleft()
        own = list(islice(walk.step(*at), LOOKED_AT))
        if len(own) == LOOKED_AT:
            far.append(at)
            continue
        found += own
        near += [f[:2] for f in own if f[2] is None]
    rows = spark.createDataFrame(found, WALKED)
    if not (far := [*far, *near]):
        return rows
    tasks = 4 * spark.sparkContext.defaultParallelism

    def each(step):
        def run(batches):
            import pandas as pd

            for batch in batches:
                known = batch["size"].notna()
                yield batch[known]
                for path, level in batch.loc[~known, ["path", "level"]].itertuples(index=False):
                    more = step(path, level)
                    while own := list(islice(more, 10_000)):
                        yield pd.DataFrame(own, columns=["path", "level", "size"]).astype({"size": "Int64"})

        return run

    def on(path, level):
        yield path, level, None
        yield from walk.below(path, level)

    own = spark.createDataFrame([(*f, None) for f in far], WALKED).repartition(min(tasks, len(far)), "path")
    return rows.unionByName(own.mapInPandas(each(walk.step), WALKED).repartition(tasks, "path").mapInPandas(each(on), WALKED))


def listed(spark: SparkSession, path: str, recursive: bool = True, layout: str | None = None) -> DataFrame:
    """path and size of the JSON lines files at ``path``: a folder, a file or a glob, several by commas.

    Tasks list and look at the files, but for stores that only Spark opens and globs of more than ``*`` and ``?``; no
    content is read. With ``layout`` "projects" only ``<path>/<folder>/*.jsonl`` counts. What isn't there gives no
    rows.
    """
    out = None
    for part in filter(None, (p.strip() for p in path.split(","))):
        fs, where = hadoop(spark, part)
        whole = plain(fs.makeQualified(where).toString())
        names = whole.split("/")
        at = next((k for k, n in enumerate(names) if "*" in n or "?" in n), len(names))
        if scheme(whole) in ARROW and not re.search(r"[\[{\\]", whole) and (at == len(names) or layout != "projects"):
            rows = _by_tasks(spark, whole, "/".join(names[:at]) or "/", tuple(names[at:]), recursive, layout)
        else:
            rows = _by_spark(spark, part, fs, where, recursive, layout)
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], LISTING)
    return out.where(~F.col("path").endswith("/sessions-index.jsonl")).distinct()


def _by_tasks(spark: SparkSession, path: str, folder: str, globs: tuple[str, ...], recursive: bool, layout: str | None) -> DataFrame | None:
    if not globs and (size := size_of(path)) is not None:
        return spark.createDataFrame([(path, size)], LISTING)
    projects = layout == "projects"
    rows = walked(spark, folder, Walk(("*", "*.jsonl") if projects else globs, recursive and not projects))
    if globs and not globs[-1].endswith(".jsonl"):  # a file with another ending counts if the glob names files alone
        rows = staged(rows, work_dir(spark))
        if not rows.where((F.col("level") == len(globs)) & F.col("size").isNull()).isEmpty():
            rows = rows.where(F.col("path").endswith(".jsonl"))
    return rows.where("size is not null").select("path", "size")


def _by_spark(spark: SparkSession, part: str, fs, where, recursive: bool, layout: str | None) -> DataFrame | None:
    found = list(fs.globStatus(where) or [])
    if not found:
        return None
    reader = spark.read.format("binaryFile")
    if any(f.isDirectory() for f in found):
        deep = recursive and layout != "projects"
        below = f"{part.rstrip('/')}/*/*.jsonl" if layout == "projects" else part
        if layout == "projects" and not (fs.globStatus(hadoop(spark, below)[1]) or []):
            return None
        rows = reader.option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", "*.jsonl").load(below)
    else:
        rows = reader.load(part)
    return rows.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"))
