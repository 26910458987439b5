"""Attachments: found in content, taken out of it, described in a manifest, put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import scalars as S
from convlake.functions.json_tree import PLACED, placeholders, references, spliced
from convlake.sources.files import plain_path

ENTRY = "index int, file_name string, mime_type string, source_kind string, source_reference string, status string, size long, sha256 string"
MANIFEST = f"array<struct<{', '.join(':'.join(x.split()) for x in ENTRY.split(', '))}>>"
MOST = 100 << 20
BATCH_BYTES = 8 << 20
FILES = "map<string,struct<size:long,content:binary>>"


def resolved_inline(rows: DataFrame, data: str, most: int = MOST) -> DataFrame:
    """``rows`` with payload, status, size and sha256 of base64 ``data``; what is too large isn't decoded."""
    size = S.decoded_size(F.col(data))
    bytes_ = F.when(size <= most, S.strict_base64(F.col(data)))
    status = F.when(size > most, "too_large").when(bytes_.isNull(), "read_error").otherwise("stored")
    return rows.withColumns({"payload": bytes_, "status": status}).withColumns({"size": F.when(F.col("status") != "read_error", size), "sha256": F.sha2("payload", 256)})


def settled(value: Column) -> Column:
    """``value``, worked out where it stands: Spark doesn't merge it into what is made of it.

    It can't take lambdas that end up among the arguments of a Python function.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to give Python workers at most BATCH_BYTES at once, where that isn't set yet."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) == "67108864b":  # Spark's own
        conf.set(name, str(BATCH_BYTES))
    return df


def read_files(refs: Column, most: int = MOST) -> Column:
    """What the paths of ``refs`` hold, as FILES, read by the tasks that have the rows; what is larger than ``most`` isn't read."""
    import pandas as pd

    from convlake.sources.files import opened, size_of

    def one(path):
        try:
            size = size_of(path)
            if size is None:
                return None
            if size > most:
                return {"size": size, "content": None}
            with opened(path) as f:
                return {"size": size, "content": f.read(most + 1)}
        except OSError:
            return None

    def read(rows: pd.Series) -> pd.Series:
        return pd.Series([{r["path"]: found for r in ([] if own is None else own) if r["path"] and (found := one(r["path"]))} for own in rows], dtype=object)

    read.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(read, FILES)(refs)


def taken_out(messages: DataFrame, files: DataFrame | None = None, most: int = MOST, key: str = "message_id", base: Column | None = None, home: str | None = None, roots: list[str] | None = None, read: bool = False) -> DataFrame:
    """``messages`` with ``attachments`` (bytes or null, by index) and a manifest at the end of content_json.

    Inline data becomes ``blob:<index>`` where it stands in content_json, the rest of which stays byte for
    byte, equal strings elsewhere too. Local paths (``~`` below ``home``, relative ones below ``base``) are looked
    up in ``files`` (path, content), the table that Spark's binaryFile reader gives, or with ``read`` the tasks
    read those that are named, and no others. Files that a text only lists have to lie in one of ``roots``, if
    these are given. Remote ones are never fetched. Rows that repeat ``key`` stay as they are.
    """
    rows = bounded_batches(messages).withColumn("_refs", references(F.col("content_json"), base, home, roots, whole=False))
    paths = F.array_distinct(F.transform(F.filter("_refs", lambda r: r["path"].isNotNull()), lambda r: r["path"]))
    if files is not None:
        there = files.select(plain_path(F.col("path")).alias("_path"), F.struct(F.octet_length("content").cast("long").alias("size"), "content").alias("_file"))
        found = rows.select(key, F.explode(paths).alias("_path")).distinct().join(there, "_path")
        rows = rows.join(found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_path", "_file"))).alias("_files")), key, "left")
    else:
        rows = rows.withColumn("_files", read_files(F.col("_refs"), most) if read else F.lit(None).cast(FILES))

    def looked_up(r: Column, i: Column) -> Column:
        file = F.when(r["path"].isNotNull(), F.get(F.map_values(F.map_filter("_files", lambda k, _: k == r["path"])), F.lit(0)))
        # what was saved and isn't there any more may still be inline
        data = F.coalesce(r["data"], F.substring(F.col("content_json"), r["start"] + 1, r["end"] - r["start"]))
        instead = (r["kind"] == "LOCAL_PATH") & file.isNull() & (r["data"].isNotNull() | r["start"].isNotNull())
        return F.struct(
            i.alias("index"), F.when(instead, "BASE64").otherwise(r["kind"]).alias("kind"), F.when(~instead, r["reference"]).alias("reference"), F.when(~instead | (r["kind"] != "LOCAL_PATH"), r["file_name"]).alias("file_name"),
            r["mime_type"].alias("mime_type"), data.alias("data"), file.alias("file"), r["start"].alias("start"), r["end"].alias("end"),
        )

    def decoded(r: Column) -> Column:
        local, remote, size = r["kind"] == "LOCAL_PATH", r["kind"] == "REMOTE_URL", S.decoded_size(r["data"])
        payload = F.when(local, F.when(r["file"]["size"] <= most, r["file"]["content"])).when(~remote & (size <= most), S.strict_base64(r["data"]))
        return F.struct(r.alias("r"), size.alias("size"), payload.alias("payload"))

    def stored(i: Column) -> Column:
        r, size, payload = i["r"], i["size"], i["payload"]
        local, remote = r["kind"] == "LOCAL_PATH", r["kind"] == "REMOTE_URL"
        status = F.when(remote, "remote_not_downloaded").when(local & r["file"].isNull(), "missing").when(F.when(local, r["file"]["size"]).otherwise(size) > most, "too_large").when(payload.isNull(), "read_error").otherwise("stored")
        return F.struct(r.alias("r"), payload.alias("payload"), status.alias("status"), F.when(local, r["file"]["size"]).when(~remote & (status != "read_error"), size).alias("size"))

    # what is worked out here is settled: else Spark's filters behind it would do it once more for every use
    def entry(i: Column) -> Column:
        r, mime = i["r"], F.coalesce(i["r"]["mime_type"], S.sniffed_mime(i["payload"]))
        return F.struct(r["index"].alias("index"), r["file_name"].alias("file_name"), mime.alias("mime_type"), r["kind"].alias("source_kind"), S.safe_reference(r["kind"], r["reference"], mime).alias("source_reference"), i["status"].alias("status"), i["size"].alias("size"), F.sha2(i["payload"], 256).alias("sha256"))

    rows = rows.withColumn("_refs", settled(F.transform("_refs", looked_up))).withColumn("_items", settled(F.transform(F.transform("_refs", decoded), stored)))
    edits = F.array_sort(F.transform(F.filter("_refs", lambda r: r["start"].isNotNull()), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["index"].alias("index"))))
    text = spliced(F.col("content_json"), edits, lambda e: F.concat(F.lit("blob:"), e["index"].cast("string")))
    comma = F.when(F.col("content_json").rlike(r"^\s*\{\s*\}\s*$"), "").otherwise(",")
    rows = rows.withColumn("_text", settled(text))
    told = F.concat(S.without_brace(F.col("_text")), comma, F.lit('"_attachments":'), F.to_json(F.transform("_items", entry)), F.lit("}"))
    none = F.coalesce(F.size("_items"), F.lit(0)) <= 0
    return rows.withColumns({"content_json": settled(F.when(none, F.col("content_json")).otherwise(told)), "attachments": F.when(~none, F.transform("_items", lambda i: i["payload"]))}).drop("_items", "_refs", "_files", "_text")


def manifest(content_json: Column) -> Column:
    """The manifest of a message; an entry without an index has its place, and of one index the last counts."""
    raw = F.from_json(F.get_json_object(content_json, "$._attachments"), MANIFEST)
    return F.transform(raw, lambda e, i: F.struct(*(F.coalesce(e["index"], i).alias("index") if n == "index" else e[n].alias(n) for n in (x.split()[0] for x in ENTRY.split(", ")))))


def stored_attachments(content_json: Column) -> Column:
    """Manifest entries of what is stored, by index; no bytes are read."""
    entries = manifest(content_json)
    # a variable of a lambda is worked out once
    last = F.get(F.transform(F.array(entries), lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["index"] == e["index"]))), F.lit(0))
    return F.array_sort(F.filter(F.coalesce(last, F.array().cast(MANIFEST)), lambda e: e["status"] == "stored"))


def lookup(messages: DataFrame, index: int, most: int | None = None) -> DataFrame:
    """Bytes, name and type of attachment ``index`` of each message."""
    entry = F.try_element_at(F.filter(manifest(F.col("content_json")), lambda e: e["index"] == index), F.lit(-1))
    return messages.select("message_id", S.attachment_at(F.col("attachments"), F.lit(index), most).alias("data"), F.coalesce(entry["mime_type"], F.lit("application/octet-stream")).alias("mime_type"), F.coalesce(entry["file_name"], F.lit(f"attachment-{index}")).alias("file_name"))


def pending_detail(messages: DataFrame) -> DataFrame:
    """One row per attachment that a message has or names: index and whether its bytes are there."""
    named = F.array_max(F.transform(manifest(F.col("content_json")), lambda e: e["index"])) + 1
    n = F.greatest(F.coalesce(F.array_size("attachments"), F.lit(0)), F.coalesce(named, F.lit(0)))
    rows = messages.withColumn("_n", n).where("_n > 0").withColumn("index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("message_id", "index", F.get("attachments", F.col("index")).isNotNull().alias("present"))


def put_back(messages: DataFrame, folder: str | None = None) -> DataFrame:
    """``messages`` with inline data in content_json again, and without the manifest.

    Only fields that hold data are looked at, by position: words that look like a placeholder stay as they
    are. Data URIs come back as base64. With ``folder``, stored local files are named by the path that they get
    there in fields of paths, and ``restored_files`` (name and index) says what is to be written. What was to
    be stored and isn't is listed in ``_missing_attachments``.
    """
    bare = F.regexp_replace("content_json", r'(?s)^(.*),"_attachments":\[.*\]\}\s*$', "$1}")
    bare = F.regexp_replace(bare, r'(?s)^(\s*\{)"_attachments":\[.*\]\}\s*$', "$1}")
    rows = bounded_batches(messages).withColumns({"_manifest": F.coalesce(manifest(F.col("content_json")), F.array().cast(MANIFEST)), "_bare": settled(bare)})
    rows = rows.withColumn("_places", placeholders(F.col("_bare"))).withColumn("_places", F.when(F.size("_manifest") > 0, F.col("_places")).otherwise(F.array().cast(f"array<{PLACED}>")))
    bytes_ = lambda i: F.get("attachments", i)
    place = F.col("sequence_no").cast("string") if "sequence_no" in messages.columns else F.lit("0")
    file_name = lambda e: S.attachment_file_name(place, e["index"], F.sha2(bytes_(e["index"]), 256), e["file_name"])
    local = F.filter("_manifest", lambda e: (e["source_kind"] == "LOCAL_PATH") & bytes_(e["index"]).isNotNull() & F.lit(folder is not None))
    rows = rows.withColumn("_local", F.transform(local, lambda e: F.struct(e["source_reference"].alias("reference"), file_name(e).alias("name"), e["index"].alias("index"))))
    named = lambda p: F.get(F.filter("_local", lambda e: e["reference"] == p["path"]), F.lit(0))
    edits = F.filter("_places", lambda p: F.when(p["index"].isNotNull(), bytes_(p["index"]).isNotNull()).otherwise(named(p).isNotNull()))

    def instead(p: Column) -> Column:
        data = S.base64_text(bytes_(p["index"]))
        header = F.when(p["header"].isNull(), "").when(F.lower(p["header"]).endswith(";base64"), F.concat(p["header"], F.lit(","))).otherwise(F.concat(p["header"], F.lit(";base64,")))
        return F.when(p["index"].isNotNull(), F.concat(header, data)).otherwise(F.concat(F.lit(f"{(folder or '').rstrip('/')}/"), named(p)["name"]))

    rows = rows.withColumn("_edits", edits).withColumn("_text", F.when(F.size("_edits") > 0, spliced(F.col("_bare"), F.col("_edits"), instead)).otherwise(F.col("_bare")))
    lost = F.filter("_manifest", lambda e: (e["source_kind"] != "REMOTE_URL") & bytes_(e["index"]).isNull())
    listed = F.to_json(F.transform(lost, lambda e: F.struct(e["index"].alias("index"), e["file_name"].alias("file_name"), e["mime_type"].alias("mime_type"), e["source_kind"].alias("source_kind"), e["status"].alias("status"))))
    comma = F.when(F.col("_text").rlike(r"^\s*\{\s*\}\s*$"), "").otherwise(",")
    text = F.when(F.size(lost) > 0, F.concat(S.without_brace(F.col("_text")), comma, F.lit('"_missing_attachments":'), listed, F.lit("}"))).otherwise(F.col("_text"))
    rows = rows.withColumn("content_json", settled(text))
    if folder is not None:
        rows = rows.withColumn("restored_files", F.transform("_local", lambda e: F.struct(e["name"].alias("name"), e["index"].alias("index"))))
    return rows.drop("_manifest", "_bare", "_places", "_local", "_edits", "_text")


def rewritten_paths(text: Column, old: str, new: str) -> Column:
    """``new`` for the path ``old``, whole or as a folder, in path fields and image wrappers of JSON text, and nowhere else."""
    quoted = F.lit(rf'("(?:path|filePath|saved_path|file_path|cwd)"\s*:\s*"|<image\b[^>]*\bpath=\\?"){_escaped(old)}(?=["/\\])')
    return F.regexp_replace(text, quoted, F.lit("$1" + new.replace("\\", "\\\\").replace("$", "\\$")))


def _escaped(text: str) -> str:
    import re

    return re.escape(text)
