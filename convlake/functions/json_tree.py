"""JSON text by position: where each value of a document stands, in the order of the text.

Small helpers that run within Arrow batches. Positions are in characters, as Spark counts them, so edits can be
made to the text itself: what isn't edited stays as it was written, and equal strings elsewhere do too.
"""

from __future__ import annotations

import base64
import binascii
import json
import posixpath
import re
import urllib.parse
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
#: Fields and marks that the clients write.
DATA_FIELDS = ("data", "image_url", "result")
PATH_FIELDS = ("path", "filePath", "saved_path", "file_path", "file")
MENTION = re.compile(r"^##[ \t]+(.+):[ \t]+(.+?)[ \t]*$", re.M)
WRAPPER = re.compile(r'<image\b[^>]*\bpath="([^"]+)"')
PLACE = re.compile(r"(?:(data:[^,]*),)?blob:(\d+)")

REFERENCE = "struct<kind:string,reference:string,path:string,file_name:string,mime_type:string,data:string,mentioned:boolean,start:int,end:int>"
PLACED = "struct<start:int,end:int,index:int,header:string,path:string>"


class Node(NamedTuple):
    """A value: its parent's number (-1 at the top), its name or place there, what it is, and its span."""

    parent: int
    key: str | int | None
    kind: str
    start: int
    end: int


def nodes(text: str | None) -> list[Node]:
    """Every value of ``text`` before those within it; none if it isn't one JSON document."""
    try:
        json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return []
    out: list[Node] = []
    stack: list[int] = []
    key: str | None = None
    seen: list[int] = []
    named = False  # whether the next string in this object is a value
    for m in TOKEN.finditer(text):
        token = m[0]
        if token in "}]":
            at = stack.pop()
            out[at] = out[at]._replace(end=m.end())
            seen.pop()
            named = bool(stack) and out[stack[-1]].kind == "object"
        elif token == ":":
            named = True
        elif token == ",":
            named = out[stack[-1]].kind == "array"
        else:
            parent = stack[-1] if stack else -1
            within = out[parent].kind if stack else ""
            if within == "object" and not named:
                key = json.loads(token)
                continue
            place = None if not stack else key if within == "object" else seen[-1]
            if stack and within == "array":
                seen[-1] += 1
            kind = {"{": "object", "[": "array", '"': "string"}.get(token[0], "other")
            out.append(Node(parent, place, kind, m.start(), m.end()))
            if token in "{[":
                stack.append(len(out) - 1)
                seen.append(0)
                named = token == "["
    return out


def sound(text: str) -> str:
    """``text`` with half surrogate pairs replaced, which no column can hold."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Tree:
    """The values of one document and their fields."""

    def __init__(self, text: str | None):
        self.text, self.nodes = text or "", nodes(text)
        self.fields: list[dict] = [{} for _ in self.nodes]
        for at, n in enumerate(self.nodes):
            if n.parent >= 0:
                self.fields[n.parent][n.key] = at

    def child(self, at: int | None, *names) -> int | None:
        for name in names:
            at = None if at is None else self.fields[at].get(name)
        return at

    def string(self, at: int | None, *names) -> str | None:
        at = self.child(at, *names)
        return sound(json.loads(self.text[self.nodes[at].start : self.nodes[at].end])) if at is not None and self.nodes[at].kind == "string" else None

    def filled(self, at: int | None, *names) -> str | None:
        found = self.string(at, *names)
        return found if found and found.strip() else None


def resolved(path: str, base: str | None, home: str | None) -> str:
    """An absolute path: of a file URI, below ``home`` for ``~``, else below ``base``; dots are worked out."""
    if path.startswith("file:"):
        path = urllib.parse.unquote(re.sub("^file:/*(?=/)", "", path))
    elif path == "~" or path.startswith("~/"):
        path = posixpath.join(home or "/", path[2:])
    elif not path.startswith("/") and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and base:
        path = f"{base.rstrip('/')}/{path}"
    head = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*", path)
    cut = len(head[0]) if head else 0
    return path[:cut] + posixpath.normpath(path[cut:] or "/")


def uri_data(uri: str) -> str | None:
    """What a data URI holds, as base64; an empty text that decodes to nothing if it is broken."""
    header, comma, payload = uri.partition(",")
    if not comma:
        return None
    if header.lower().endswith(";base64"):
        return payload
    if re.search("%(?![0-9A-Fa-f]{2})", payload):
        return "%"
    return base64.b64encode(urllib.parse.unquote_to_bytes(payload)).decode()


def found_references(text: str | None, base: str | None, home: str | None, roots: list[str] | None) -> list[dict]:
    """Attachments of an event of either client, as REFERENCE, in the order of the text.

    Images and documents at any depth: as data or URL, with the span of their data; files that blocks name, each
    path once; then files that the message's text lists, unless the image wrapper before an inline image names
    them, or they lie outside ``roots``. A generated image is the file that was saved, with the data that stands in
    for it where the file is missing.
    """
    tree, out = Tree(text), []
    if not tree.nodes:
        return out
    local: set[str] = set()

    def add(kind, reference=None, name=None, mime=None, data=None, mentioned=False, span=None):
        path = resolved(reference, base, home) if kind == "LOCAL_PATH" and reference else None
        name = name or (re.search(r"([^/\\]*)$", reference)[1] if path else None)
        out.append({"kind": kind, "reference": reference, "path": path, "file_name": name, "mime_type": mime, "data": data, "mentioned": mentioned, "start": span and span[0], "end": span and span[1]})

    def add_file(path):
        if path and path not in local:
            local.add(path)
            add("LOCAL_PATH", path)

    def inner(at, skip=0):
        n = tree.nodes[at]
        return n.start + 1 + skip, n.end - 1

    def file_of(at):
        at = tree.child(at, "file")
        if at is None:
            return None
        return tree.filled(at) if tree.nodes[at].kind == "string" else tree.filled(at, "filePath") or tree.filled(at, "path")

    payload = tree.child(0, "payload") if tree.nodes[0].kind == "object" else None
    if tree.string(0, "type") == "event_msg" and tree.string(payload, "type") == "image_generation_end":
        saved, result = tree.filled(payload, "saved_path"), tree.filled(payload, "result")
        if saved or result:
            add("LOCAL_PATH" if saved else "BASE64", saved, mime="image/png", data=result, span=inner(tree.child(payload, "result")) if result else None)
        return out
    for at, n in enumerate(tree.nodes):
        if n.kind != "object":
            continue
        kind, url = tree.string(at, "type"), tree.child(at, "image_url")
        if url is not None and (value := tree.filled(url)):
            if value.startswith("data:"):
                comma = tree.text.find(",", tree.nodes[url].start)
                mime = re.match("data:([^;,]*)", value)[1] or None
                add("DATA_URI", value.partition(",")[0], mime=mime, data=uri_data(value), span=(comma + 1, tree.nodes[url].end - 1) if comma < tree.nodes[url].end and comma > 0 else None)
            elif re.match("https?://", value):
                add("REMOTE_URL", value)
            else:
                add("LOCAL_PATH", value)
        if kind in ("image", "document"):
            source = tree.child(at, "source")
            if tree.string(source, "type") in ("base64", None) and (data := tree.filled(source, "data")):
                add("BASE64", name=tree.filled(at, "title"), mime=tree.filled(source, "media_type"), data=data, span=inner(tree.child(source, "data")))
            add_file(file_of(at))
        elif kind == "file":
            add_file(tree.filled(at, "filePath") or tree.filled(at, "path") or file_of(at))
    content = tree.child(0, "payload", "content") if payload is not None else tree.child(0, "message", "content")
    if content is None or tree.nodes[content].kind != "array":
        return out
    inline, wrapper = set(), None
    items = [tree.fields[content][k] for k in sorted(tree.fields[content])]
    for at in items:
        said = tree.string(at, "text")
        if said is not None and (found := WRAPPER.findall(said)):
            wrapper = resolved(found[-1], base, home)
        elif tree.child(at, "image_url") is not None or tree.string(at, "type") == "image":
            if wrapper and not re.match("https?://", tree.string(at, "image_url") or ""):
                inline.add(wrapper)
            wrapper = None
    for at in items:
        for name, path in MENTION.findall(tree.string(at, "text") or ""):
            path = path.strip()
            whole = resolved(path, base, home)
            if path not in local and whole not in inline and (roots is None or any(whole == r or whole.startswith(r.rstrip("/") + "/") for r in roots)):
                add("LOCAL_PATH", path, name.strip(), mentioned=True)
    return out


def placed(text: str | None) -> list[dict]:
    """Where values of data fields are placeholders, or end in one behind a data URI's header, and where path fields are."""
    tree, out = Tree(text), []
    for n in tree.nodes:
        if n.kind != "string" or n.key not in DATA_FIELDS + PATH_FIELDS:
            continue
        value = sound(json.loads(tree.text[n.start : n.end]))
        found = PLACE.fullmatch(value) if n.key in DATA_FIELDS else None
        if found:
            out.append({"start": n.start + 1, "end": n.end - 1, "index": int(found[2]), "header": found[1], "path": None})
        elif n.key in PATH_FIELDS:
            out.append({"start": n.start + 1, "end": n.end - 1, "index": None, "header": None, "path": value})
    return out


def human(text: str | None, event_type: str | None) -> str:
    """What a person would read of a document: all its texts, else the names of its tools, else its type."""
    tree, texts, tools = Tree(text), [], []
    if not tree.nodes:  # cut in the middle
        for m in list(re.finditer(r'"(?:text|output)"\s*:\s*"((?:\\.|[^"\\])*)"', text or "", re.S))[:3]:
            try:
                texts.append(sound(json.loads(f'"{m[1]}"')).strip())
            except ValueError:
                texts.append(m[1])
        return "\n\n".join(filter(None, texts))
    for at, n in enumerate(tree.nodes):
        if n.kind != "object":
            continue
        kind = tree.child(at, "type")
        kind = "" if kind is None or tree.nodes[kind].kind in ("object", "array") else (tree.string(kind) or tree.text[tree.nodes[kind].start : tree.nodes[kind].end].strip('"')).lower()
        said = {name: tree.string(at, name) for name in ("text", "content", "output", "name")}
        if said["text"] is not None and ("text" in kind or not kind):
            texts.append(said["text"].strip())
        if said["content"] is not None and kind in ("message", "user", "assistant"):
            texts.append(said["content"].strip())
        if said["output"] is not None and ("output" in kind or "result" in kind):
            texts.append(said["output"].strip())
        if said["name"] is not None and ("tool" in kind or "call" in kind):
            tools.append(said["name"])
    if found := list(dict.fromkeys(filter(None, texts))):
        return "\n\n".join(found)
    return ", ".join(tools) if tools else f"[{event_type}]" if event_type else ""


def scalar(text: str | None, name: str) -> str | None:
    """The first non-blank text, number or boolean called ``name``: of each object before what is within it."""
    tree = Tree(text)
    for at, n in enumerate(tree.nodes):
        if n.kind == "object" and (found := tree.child(at, name)) is not None and tree.nodes[found].kind in ("string", "other"):
            value = tree.string(found) if tree.nodes[found].kind == "string" else tree.text[tree.nodes[found].start : tree.nodes[found].end]
            if value.strip() and value != "null":
                return value
    return None


def _column(of, kind: str, *columns: Column) -> Column:
    """``of`` of each row's values; only one row's are Python objects at a time."""
    import pyarrow as pa

    plain = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = re.fullmatch("array<struct<(.*)>>", kind)
    arrow = pa.list_(pa.struct([(n, plain[t]) for n, t in (x.split(":") for x in fields[1].split(","))])) if fields else plain[kind]

    def run(*parts: pa.Array) -> pa.Array:
        return pa.array((of(*(x.as_py() for x in row)) for row in zip(*parts, strict=True)), arrow)

    names = ["a", "b"][: len(columns)]
    typed = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[len(columns)]
    typed.__annotations__ = {n: pa.Array for n in names} | {"return": pa.Array}
    return F.arrow_udf(typed, kind)(*columns)


def references(content_json: Column, base: Column | None = None, home: str | None = None, roots: list[str] | None = None, whole: bool = True) -> Column:
    """``found_references`` as a column; ``base`` is the folder that relative paths start from.

    Without ``whole``, data that stands in the text as it is, from start to end, isn't given once more.
    """
    base = F.lit(None).cast("string") if base is None else base

    def found(text, folder):
        out = found_references(text, folder, home, roots)
        for r in out:
            if not whole and r["start"] is not None and text[r["start"] : r["end"]] == r["data"]:
                r["data"] = None
        return out

    return _column(found, f"array<{REFERENCE}>", content_json, base)


def placeholders(content_json: Column) -> Column:
    return _column(placed, f"array<{PLACED}>", content_json)


def human_text(detail_json: Column, event_type: Column) -> Column:
    return _column(human, "string", detail_json, event_type)


def first_scalar(document: Column, name: str) -> Column:
    return _column(lambda text: scalar(text, name), "string", document)


def spliced(text: Column, edits: Column, instead) -> Column:
    """``text`` with ``instead(edit)`` at the spans (start, end) of ``edits``, which are in order and apart."""
    # each edit meets the end of the one before it; behind the last one, there is the rest
    ends = F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["end"]))
    parts = F.zip_with(edits, ends, lambda e, last: F.when(e.isNull(), F.substring(text, last + 1, F.length(text))).otherwise(F.concat(F.substring(text, last + 1, e["start"] - last), instead(e))))
    return F.array_join(parts, "")
