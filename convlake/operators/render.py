"""Text of messages for people: previews, labels of tools and attachments, blocks and tables in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.json_tree import human_text  # noqa: F401  a rendering like the others
from convlake.functions.scalars import strip

BLOCK = "type string, text string, refusal string, content string, output string, name string, arguments string, input string"
LABELS = {"image": "[image]", "document": "[document]", "attachment": "[attachment]", "generated": "[generated image]"}
LONG, SHORT, MOST_PARTS = 4096, 240, 32


def preview_limit(role: Column, event_type: Column) -> Column:
    from convlake.operators.catalog import is_tool_event

    return F.when(is_tool_event(role, event_type), SHORT).when(F.lower(role).isin("user", "assistant"), LONG).otherwise(SHORT)


def normalised(text: Column) -> Column:
    """Runs of spaces as one, any line end as a newline, at most two in a row, none around."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    inner = F.regexp_replace(F.regexp_replace(lines, r"[ \t\x0B\f]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(inner, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def truncated(text: Column, most: Column) -> Column:
    """At most ``most`` code points, the last an ellipsis where something was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, most - 1), F.lit("…")))


def blocks(content_json: Column) -> Column:
    """Content blocks of either dialect as an array of structs; a plain string is one text block."""
    raw = F.coalesce(F.get_json_object(content_json, "$.payload.content"), F.get_json_object(content_json, "$.message.content"), F.get_json_object(content_json, "$.content"))
    listed = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, f"array<struct<{BLOCK.replace(' string', ':string')}>>"))
    one = F.array(F.struct(*(F.when(F.lit(n == "text"), raw).otherwise(F.lit("text") if n == "type" else F.lit(None)).cast("string").alias(n) for n in (x.split()[0] for x in BLOCK.split(", ")))))
    return F.coalesce(listed, F.when(raw.isNotNull(), one))


def is_tool_block(kind: Column) -> Column:
    return F.coalesce(kind.rlike(r"tool|function|_call"), F.lit(False))


def block_text(b: Column) -> Column:
    """What one block says."""
    kind = F.lower(F.coalesce(b["type"], F.lit("")))
    call = F.concat(F.lit("call "), F.coalesce(b["name"], F.lit("tool")), tool_detail(F.coalesce(b["input"], b["arguments"])))
    out = F.when(kind.contains("image_generation"), LABELS["generated"]).when(kind.contains("image"), LABELS["image"]).when(kind == "document", LABELS["document"]).when(kind == "attachment", LABELS["attachment"])
    out = out.when(kind.isin("tool_result", "function_call_output"), F.concat(F.lit("output: "), F.coalesce(b["output"], b["content"], F.lit("")))).when(is_tool_block(kind), call)
    return out.otherwise(F.coalesce(b["text"], b["refusal"], b["content"], b["output"], F.lit("")))


def tool_detail(arguments: Column, most: int = 180) -> Column:
    """``: name=value`` of the telling arguments of a tool call."""
    names = ("query", "queries", "url", "command", "path", "file_path")
    parts = F.array_compact(F.array(*(F.when(F.get_json_object(arguments, f"$.{n}").isNotNull(), F.concat(F.lit(f"{n}="), F.get_json_object(arguments, f"$.{n}"))) for n in names)))
    return F.coalesce(F.when(F.size(parts) > 0, F.concat(F.lit(": "), truncated(F.array_join(parts, " "), F.lit(most)))), F.lit(""))


def without_envelope(text: Column) -> Column:
    """Only the request of a message that lists files before it."""
    body = F.regexp_extract(text, r"(?s)^\s*# Files mentioned by the user:.*?\n##[ \t]+.+:[ \t]+(?:/|[A-Za-z]:\\).*?\n## My request for Codex:\s*(.*)$", 1)
    return F.when(body != "", body).otherwise(text)


def joined(parts: Column, most: Column) -> Column:
    """Different parts, the first 32, between dots."""
    clean = F.filter(F.transform(parts, lambda p: normalised(p)), lambda p: p != "")
    return truncated(F.array_join(F.slice(F.array_distinct(clean), 1, MOST_PARTS), " · "), most)


def preview(content_json: Column, role: Column, event_type: Column, conversation: bool = False) -> Column:
    """Preview text of a message; without tools, and empty where nothing else is left, for conversations."""
    all_blocks = blocks(content_json)
    shown = F.filter(all_blocks, lambda b: ~is_tool_block(F.lower(b["type"]))) if conversation else all_blocks
    parts = F.transform(shown, lambda b: without_envelope(block_text(b)))
    own = F.when(F.lit(conversation), F.lit("")).otherwise(truncated(F.coalesce(F.get_json_object(content_json, "$.payload.output"), F.concat(F.lit("["), event_type, F.lit("]"))), F.lit(SHORT)))
    broken = F.try_parse_json(content_json).isNull()
    limit = preview_limit(role, event_type)
    return F.when(broken, truncated(normalised(content_json), limit)).otherwise(F.coalesce(joined(parts, limit), own))


def code_blocks(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per fenced block: keys, block (from 0), language and code."""
    fence = r"(?ms)^```[ \t]*([^\n`]*)\n(.*?)^```[ \t]*$"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(fence), F.lit(1)).alias("language"), F.regexp_extract_all(text, F.lit(fence), F.lit(2)).alias("code"))
    return df.select(*keys, F.posexplode(found).alias("block", "b")).select(*keys, "block", F.nullif(F.trim("b.language"), F.lit("")).alias("language"), "b.code")


def pipe_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line with pipes: keys, line_no (from 0) and its cells, trimmed."""
    rows = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").contains("|"))
    bare = F.regexp_replace(strip(F.col("line")), r"^\||\|$", "")
    return rows.select(*keys, "line_no", F.transform(F.split(bare, r"\|"), lambda c: F.trim(c)).alias("cells"))


def pipe_tables(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Rows of Markdown pipe tables: keys, table_no, row_no (0 is the header), cells and alignments.

    A table is a header line, a line of dashes with as many cells right below it, and the lines with pipes
    that follow without a gap.
    """
    from pyspark.sql import Window

    lines = pipe_lines(df, text, *keys)
    order = Window.partitionBy(*keys).orderBy("line_no")
    rule = F.forall("cells", lambda c: c.rlike("^:?-+:?$"))
    rows = lines.withColumn("_rule", rule).withColumns({"_next_rule": F.lead("_rule").over(order), "_next_at": F.lead("line_no").over(order), "_next_size": F.lead(F.size("cells")).over(order), "_next_cells": F.lead("cells").over(order)})
    rows = rows.withColumn("_head", ~F.col("_rule") & F.coalesce(F.col("_next_rule") & (F.col("_next_at") == F.col("line_no") + 1) & (F.col("_next_size") == F.size("cells")), F.lit(False)))
    gap = F.coalesce(F.col("line_no") != F.lag("line_no").over(order) + 1, F.lit(True))
    rows = rows.withColumn("_starts", (gap | F.col("_head")).cast("long")).withColumn("_run", F.sum("_starts").over(order))
    run = Window.partitionBy(*keys, "_run").orderBy("line_no")
    side = lambda c: F.when(c.rlike("^:-+:$"), "center").when(c.endswith(":"), "right").when(c.startswith(":"), "left").otherwise("none")
    rows = rows.withColumns({"_is_table": F.first("_head").over(run), "alignments": F.first(F.transform("_next_cells", side)).over(run)}).where(F.col("_is_table") & ~F.col("_rule"))
    dense = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_run")) - 1
    return rows.select(*keys, dense.alias("table_no"), (F.row_number().over(run) - 1).alias("row_no"), "cells", "alignments")
