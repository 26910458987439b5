"""Turns: what a user asked and all that answered it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_type", "session_id"]
#: Fixed value of the client's format: texts that carry context and aren't asked by anybody.
CONTEXT = r"^[\x00-\x20]*(<environment_context>|# AGENTS\.md instructions\n\n<INSTRUCTIONS>)"


def basic_turns(messages: DataFrame) -> DataFrame:
    """``turn_no``: how many user messages came up to this one."""
    order = Window.partitionBy(*KEY).orderBy("sequence_no").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.sum((F.col("role") == "user").cast("long")).over(order))


def is_context(text: Column) -> Column:
    return F.coalesce(text.rlike(CONTEXT), F.lit(False))


def turns(messages: DataFrame) -> DataFrame:
    """``turn_no``, ``turn_id`` and ``cancelled`` of every message (role, text, created_at and maybe phase).

    A user message opens a turn if an answer came since the last one. Where none came yet, context belongs to
    the turn that is open, and so does what follows context alone or has the time of the prompt before; any
    other user message leaves a cancelled turn behind. An answer of phase ``final_answer`` closes its turn: what
    follows belongs to the next one. Messages of no turn have number 0. Everything is sums and neighbours over
    the session in order.
    """
    order = Window.partitionBy(*KEY).orderBy("sequence_no")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("sequence_no")
    last = lambda test, value=at: F.last(F.when(test, value), ignorenulls=True).over(before)
    phase = F.col("phase") if "phase" in messages.columns else F.lit(None).cast("string")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    after = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.col(a).isNotNull())
    rows = messages.withColumns({"_user": F.coalesce(user, F.lit(False)), "_real": F.coalesce(user & ~is_context(F.col("text")), F.lit(False)), "_final": F.coalesce(assistant & (phase == "final_answer"), F.lit(False))})
    rows = rows.withColumns({"_asked": last(F.col("_user")), "_prompt": last(F.col("_real")), "_time": last(F.col("_real"), F.struct("created_at"))["created_at"], "_answer": last(assistant), "_before": last(F.col("_final"))})
    rows = rows.withColumn("_closes", F.col("_final") & after("_asked", "_before"))
    rows = rows.withColumns({"_closed": last(F.col("_closes")), "_follows": F.coalesce(F.lag("_closes").over(order), F.lit(False))})
    new_time = ~F.coalesce(F.col("_time") == F.col("created_at"), F.lit(False))
    opens = F.col("_user") & after("_asked", "_closed") & (F.coalesce(F.col("_answer") > F.col("_asked"), F.lit(False)) | F.col("_real") & after("_prompt", "_answer") & new_time)
    starts = opens | F.col("_follows") | (F.col("_user") & F.col("_asked").isNull())
    rows = rows.withColumn("turn_no", F.sum(starts.cast("long")).over(so_far))
    turn = Window.partitionBy(*KEY, "turn_no")
    rows = rows.withColumns({"_has_user": F.max("_user").over(turn), "_answered": F.max(F.coalesce(assistant, F.lit(False))).over(turn)})
    rows = rows.withColumns({"turn_no": F.when(F.col("_has_user"), F.col("turn_no")).otherwise(0), "cancelled": F.col("_has_user") & ~F.col("_answered")})
    turn_id = name_based(F.concat_ws("\n", *KEY, F.col("turn_no").cast("string")))
    return rows.withColumn("turn_id", turn_id).drop("_user", "_real", "_final", "_asked", "_prompt", "_time", "_answer", "_before", "_closes", "_closed", "_follows", "_has_user", "_answered")


def name_based(text: Column) -> Column:
    from convlake.functions.scalars import name_uuid

    return name_uuid(text)


def wrapped(turned: DataFrame) -> DataFrame:
    """The client's own events around the messages of each turn (what turns() gave): position, ord and json.

    A turn starts before its first message; the first one takes in what came before anybody asked. Its prompt is
    the last user message that isn't context, or else the last one, and is followed by a user_message with the
    pictures that came with it. The last assistant message after a user's is the answer: an agent_message and a
    task_complete follow it. A turn without one is complete behind its prompt, with no answer. ``content_json`` may
    have the event's timestamp and phase; without a timestamp it is that of created_at.
    """
    at, user = F.col("sequence_no"), F.coalesce(F.col("role") == "user", F.lit(False))
    turn, session = Window.partitionBy(*KEY, "turn_no"), Window.partitionBy(*KEY)
    in_turn = F.col("turn_no") > 0
    rows = turned.withColumns({
        "_start": F.when(F.col("turn_no") == 1, F.min(at).over(session)).when(in_turn, F.min(at).over(turn)), "_asked": F.min(F.when(user, at)).over(turn),
        "_prompt": F.coalesce(F.max(F.when(user & ~is_context(F.col("text")), at)).over(turn), F.max(F.when(user, at)).over(turn)),
    })
    rows = rows.withColumn("_answer", F.max(F.when((F.col("role") == "assistant") & (at > F.col("_asked")), at)).over(turn))
    # one row says where the first turn starts, which may be before its own messages
    rows = rows.withColumn("_opens", F.when(at == F.min(at).over(session), F.min(F.when(F.col("turn_no") == 1, F.struct("_start", "turn_id"))).over(session)).when(in_turn & (F.col("turn_no") > 1) & (at == F.col("_start")), F.struct("_start", "turn_id")))
    when = F.coalesce(F.get_json_object("content_json", "$.timestamp"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    event = lambda kind, *more: F.to_json(F.struct(when.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit(kind).alias("type"), *more).alias("payload")), {"ignoreNullFields": "false"})
    none, said = F.lit(None).cast("string"), F.coalesce("text", F.lit(""))
    pictures = F.transform(F.filter(F.coalesce(F.from_json(F.get_json_object("content_json", "$.payload.content"), "array<struct<type:string,image_url:string>>"), F.array().cast("array<struct<type:string,image_url:string>>")), lambda c: (c["type"] == "input_image") & (F.trim(c["image_url"]) != "")), lambda c: c["image_url"])
    remote = lambda url: url.rlike("^(data:|https?://)")
    own = F.col("turn_id").alias("turn_id")
    asked = event("user_message", said.alias("message"), F.filter(pictures, remote).alias("images"), F.filter(pictures, lambda u: ~remote(u)).alias("local_images"), F.array().cast("array<string>").alias("text_elements"))
    phase = F.coalesce(F.nullif(F.trim(F.get_json_object("content_json", "$.payload.phase")), F.lit("")), F.lit("final_answer"))
    answered = event("agent_message", said.alias("message"), phase.alias("phase"), none.alias("memory_citation"))
    is_prompt, is_answer = in_turn & (at == F.col("_prompt")), in_turn & (at == F.col("_answer"))
    items = F.array(
        F.struct(F.lit(0).alias("ord"), F.when(F.col("_opens").isNotNull(), event("task_started", F.col("_opens.turn_id").alias("turn_id"), none.alias("model_context_window"), F.lit("default").alias("collaboration_mode_kind"))).alias("json")),
        F.struct(F.lit(1).alias("ord"), F.col("content_json").alias("json")),
        F.struct(F.lit(2).alias("ord"), F.when(is_prompt, asked).when(is_answer, answered).alias("json")),
        F.struct(F.lit(3).alias("ord"), F.when(is_answer, event("task_complete", own, said.alias("last_agent_message"))).when(is_prompt & F.col("_answer").isNull(), event("task_complete", own, none.alias("last_agent_message"))).alias("json")),
    )
    return rows.select(*KEY, at.alias("position"), F.explode(items).alias("i")).select(*KEY, "position", "i.ord", "i.json").where(F.col("json").isNotNull())


def first_prompt(turned: DataFrame, sessions: DataFrame, otherwise: str = "Untitled", most: int = 2000) -> DataFrame:
    """What a session's preview says: its first turn's user text, or its title, or a constant."""
    asked = turned.where((F.col("role") == "user") & (F.col("turn_no") == 1)).groupBy(*KEY).agg(F.min_by("text", "sequence_no").alias("text"))
    return sessions.join(asked, KEY, "left").select(*KEY, F.left(F.coalesce("text", "title", F.lit(otherwise)), F.lit(most)).alias("preview"))
