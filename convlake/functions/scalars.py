"""Scalar functions of transcript jobs, as Columns that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Java's trim() strips: all characters up to the space.
EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"
# Formats that the clients write and their files must match.
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z$"
MENTION = r"(?m)^##[ \t]+(.+):[ \t]+(.+?)[ \t]*$"
WORKSPACE = r"(?:^|/)Documents/Codex/\d{4}-\d{2}-\d{2}/[^/]+$"


def message_id(source: Column, session: Column, identity: Column, position: Column, event_type: Column) -> Column:
    """SHA-256 identity of a message; the same record gets the same id on every replay."""
    return F.sha2(F.concat_ws("\n", source, session, identity, position.cast("string"), event_type), 256)


def line_anchor(line: Column) -> Column:
    """SHA-256 of a line without its carriage return."""
    return F.sha2(F.regexp_replace(line, r"\r$", ""), 256)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def first_non_blank(*texts: Column) -> Column:
    return F.coalesce(*(F.when(~is_blank(t), t) for t in texts))


def title_from_text(text: Column, most: int = 120) -> Column:
    """White space as single spaces, trimmed, cut to ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def slashed(path: Column) -> Column:
    """Forward slashes, none at the end."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/+$", "")


def is_generated_workspace(path: Column) -> Column:
    return F.coalesce(slashed(path).rlike(WORKSPACE), F.lit(False))


def instant(text: Column) -> Column:
    """Strict ISO instants in UTC; anything else is null."""
    return F.when(text.rlike(INSTANT), F.try_to_timestamp(text))


def latest(*times: Column) -> Column:
    """The latest of ``times``; nulls don't count."""
    return F.greatest(*times)


def client_time(text: Column) -> Column:
    """Numbers below 1e10 are seconds, others milliseconds; texts are ISO instants."""
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    return F.coalesce(F.timestamp_millis(F.when(F.abs(number) < 1e10, number * 1000).otherwise(number).cast("long")), instant(text))


def millis_or_seconds(millis: Column, seconds: Column) -> Column:
    """A timestamp from milliseconds, or else seconds; zero and below is null."""
    value = F.coalesce(millis, seconds * 1000)
    return F.timestamp_millis(F.when(value > 0, value))


def json_text(document: Column, path: str) -> Column:
    """Text of a field; null if it is missing or null."""
    return F.get_json_object(document, path)


def deep_find(document: Column, name: str) -> Column:
    """The first non-blank text, number or boolean called ``name``: of each object before what is within it, in the order of the text."""
    from .json_tree import first_scalar

    return first_scalar(document, name)


def subagent_source(source: Column, thread_source: Column) -> Column:
    """JSON of the sub-agent that a session is, or null; a legacy marker where only its kind is known."""
    own = F.coalesce(F.get_json_object(source, "$.subagent"), F.get_json_object(source, "$.subAgent"))
    return F.coalesce(own, F.when(thread_source == "subagent", F.lit('{"other":"legacy"}')))


def decoded_size(text: Column) -> Column:
    """Bytes that base64 ``text`` decodes to, from its length alone."""
    padding = F.when(text.endswith("=="), 2).when(text.endswith("="), 1).otherwise(0)
    return (F.floor(F.length(text) * 3 / 4) - padding).cast("long")


def strict_base64(text: Column) -> Column:
    """Bytes of base64 ``text``; null if it has any other character, a line end behind it included."""
    return F.when((F.length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/]*={0,2}\z"), F.try_to_binary(text, F.lit("base64")))


def base64_text(data: Column) -> Column:
    """``data`` as base64 in one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def without_brace(json: Column) -> Column:
    """``json`` without its last brace and the white space around it."""
    blank = F.lit(" \t\n\x0b\f\r")
    text = F.rtrim(json, blank)
    return F.when(text.endswith("}"), F.rtrim(F.left(text, F.length(text) - 1), blank)).otherwise(json)


def percent_decoded(text: Column) -> Column:
    """Percent decoding in which a plus stays a plus."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))).cast("binary")


def redacted_url(url: Column) -> Column:
    """Scheme, host, port and path; user, query and fragment go."""
    parts = [F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)", k) for k in (1, 2, 3, 4)]
    return F.when(parts[1] == "", F.lit("remote:<redacted>")).otherwise(F.concat(parts[0], F.lit("://"), *parts[1:]))


def safe_reference(kind: Column, reference: Column, mime: Column) -> Column:
    """What a manifest may say of where an attachment came from."""
    inline = F.concat(F.lit("inline:"), F.coalesce(mime, F.lit("application/octet-stream")))
    return F.when(kind.isin("DATA_URI", "BASE64"), inline).when(kind == "REMOTE_URL", redacted_url(reference)).otherwise(reference)


def attachment_kind(reference: Column) -> Column:
    return F.when(reference.startswith("data:"), "DATA_URI").when(reference.rlike("^https?://"), "REMOTE_URL").otherwise("LOCAL_PATH")


def data_uri_mime(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^data:([^;,]*)", 1), F.lit(""))


def sniffed_mime(data: Column) -> Column:
    """Image type by magic bytes; null for all else."""
    head = F.hex(F.substring(data, 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    avif = (F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("61766966", "61766973")
    kinds = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif"}
    out = F.when(webp, "image/webp").when(avif, "image/avif")
    for magic, kind in kinds.items():
        out = out.when(head.startswith(magic), kind)
    return out


def mentioned_files(text: Column) -> Column:
    """Names and paths of files that a message lists, as an array of structs."""
    names, paths = (F.regexp_extract_all(text, F.lit(MENTION), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(names.alias("name"), paths.alias("path"))


def wrapped_image_path(text: Column) -> Column:
    """Path of the last inline image wrapper in ``text``."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r'<image\b[^>]*\bpath="([^"]+)"'), F.lit(1)), F.lit(-1))


def safe_directory(path: Column, most: int = 200) -> Column:
    """Letters and digits kept, all else a dash; long names end in a hash of the whole."""
    plain = F.regexp_replace(path, "[^A-Za-z0-9]", "-")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.left(plain, F.lit(most)), F.lit("-"), F.left(F.sha2(path, 256), F.lit(12))))


def safe_component(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit("-"), F.sha2(name, 256))


def safe_file_name(name: Column, most: int = 150) -> Column:
    """``name`` if every file system takes it, else what is left of it and a hash of the whole."""
    kept = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    fits = (kept == name) & (F.length(name) <= most) & ~name.startswith(".")
    return F.when(fits, name).otherwise(F.concat(F.left(kept, F.lit(most)), F.lit("-"), F.left(F.sha2(name, 256), F.lit(12))))


def name_uuid(name: Column) -> Column:
    """Name-based UUID of version 3: the MD5 of ``name`` with the version and variant bits set."""
    h = F.md5(name)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def attachment_file_name(sequence: Column, index: Column, digest: Column, name: Column, most: int = 100) -> Column:
    """A name that sorts by message and place, ends in the given name, and fits any file system."""
    given = F.left(F.regexp_replace(F.coalesce(name, F.concat(F.lit("attachment-"), index.cast("string"))), r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(most))
    return F.concat_ws("-", F.lpad(sequence.cast("string"), 20, "0"), F.lpad(index.cast("string"), 2, "0"), digest, given)


def same_position(a: Column, b: Column) -> Column:
    """Whether two cursors are at one place of one file."""
    return a["offset"].eqNullSafe(b["offset"]) & a["file_key"].eqNullSafe(b["file_key"])


def same_boundary(a: Column, b: Column) -> Column:
    """Whether two cursors mean one record: by offset in one or unknown files, else by anchor."""
    known = a["file_key"].isNotNull() & b["file_key"].isNotNull() & (a["file_key"] != b["file_key"])
    return F.when(known, a["anchor"].isNotNull() & a["anchor"].eqNullSafe(b["anchor"])).otherwise(a["offset"].eqNullSafe(b["offset"]))


def bounded(text: Column, most: int = 2_000_000) -> tuple[Column, Column, Column]:
    """How long ``text`` is, its first ``most`` characters, and whether that cuts it."""
    return F.length(text).cast("long"), F.left(text, F.lit(most)), F.length(text) > most


def attachment_at(attachments: Column, index: Column, most: int | None = None) -> Column:
    """Bytes at ``index``; null beyond the end; an error above ``most`` bytes."""
    found = F.get(attachments, index)
    return found if most is None else F.when(F.octet_length(found) > most, F.raise_error(F.lit("attachment too large")).cast("binary")).otherwise(found)
