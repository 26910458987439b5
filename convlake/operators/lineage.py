"""Sub-sessions: edges to parents, roots and depths by pointer jumping, closures and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.scalars import deep_find
from convlake.work import staged, work_dir

KEY = ["source_type", "session_id"]


def parent_id(subagent_source_json: Column) -> Column:
    """The parent named anywhere in a sub-agent's JSON."""
    return deep_find(subagent_source_json, "parent_thread_id")


def edges(sessions: DataFrame, strict: bool = True) -> DataFrame:
    """source_type, session_id and parent_id of every sub-session; ``strict`` fails on one without a parent."""
    found = parent_id(F.col("subagent_source_json"))
    if strict:
        found = F.coalesce(found, F.raise_error(F.lit("sub-session without a parent")).cast("string"))
    return sessions.where(F.col("subagent_source_json").isNotNull()).select(*KEY, found.alias("parent_id"))


def roots(nodes: DataFrame) -> DataFrame:
    """root_id and depth of every row of ``nodes`` (source_type, session_id, parent_id or null).

    Every round doubles how far up a pointer reaches, so rounds grow with the logarithm of the depth.
    Rows below a cycle get a null root; a parent that doesn't exist makes its child a root.
    """
    folder = work_dir(nodes.sparkSession)
    base = nodes.select(*KEY, "parent_id").dropDuplicates(KEY)
    there = base.select("source_type", F.col("session_id").alias("parent_id"), F.lit(True).alias("there"))
    up = base.join(there, ["source_type", "parent_id"], "left").select(*KEY, F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("session_id")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("depth"))
    up = staged(up, f"{folder}/0")
    k, last = 0, None
    while True:
        top = up.where("depth = 0").select("source_type", F.col("session_id").alias("up"))
        unsettled = up.where("depth > 0").join(top, ["source_type", "up"], "left_anti").count()
        if unsettled in (0, last):
            break
        k, last = k + 1, unsettled
        above = up.select("source_type", F.col("session_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        up = staged(up.join(above, ["source_type", "up"]).select(*KEY, F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), f"{folder}/{k}")
    top = up.where("depth = 0").select("source_type", F.col("session_id").alias("up"), F.lit(True).alias("is_root"))
    found = up.join(top, ["source_type", "up"], "left")
    return found.select(*KEY, F.when(F.col("is_root"), F.col("up")).alias("root_id"), F.when(F.col("is_root"), F.col("depth")).cast("long").alias("depth"))


def audit(nodes: DataFrame) -> DataFrame:
    """One row per problem: a parent that doesn't exist, or a cycle above."""
    there = nodes.select("source_type", F.col("session_id").alias("parent_id"))
    missing = nodes.where("parent_id is not null").join(there, ["source_type", "parent_id"], "left_anti").select(*KEY, F.lit("missing_parent").alias("problem"))
    cycle = roots(nodes).where("root_id is null").select(*KEY, F.lit("cycle").alias("problem"))
    return missing.unionByName(cycle)


def family(rooted: DataFrame, asked: DataFrame) -> DataFrame:
    """All sessions under the roots of the ``asked`` ones; ``rooted`` is what roots() gave."""
    wanted = rooted.join(asked.select(*KEY), KEY, "left_semi").select("source_type", "root_id").distinct()
    return rooted.join(wanted, ["source_type", "root_id"], "left_semi")


def blocked(nodes: DataFrame) -> DataFrame:
    """Pending sessions and everything below them (``nodes`` has ``pending``).

    Cutting the tree above each pending session makes it a root, so a session is blocked when its root
    in the cut tree is pending.
    """
    cut = nodes.withColumn("parent_id", F.when(~F.col("pending"), F.col("parent_id")))
    tops = nodes.where("pending").select("source_type", F.col("session_id").alias("root_id"))
    return roots(cut).join(tops, ["source_type", "root_id"], "left_semi").select(*KEY)


def rejected(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The pending sessions of the families of ``asked``: with any, the whole selection is refused."""
    return family(roots(nodes), asked).join(nodes.where("pending").select(*KEY), KEY, "left_semi").select(*KEY)


def multi_agent_roots(rooted: DataFrame) -> DataFrame:
    """Roots that own at least one sub-session, with how many."""
    return rooted.where("depth > 0 and root_id is not null").groupBy("source_type", "root_id").agg(F.count("*").alias("subagents"))
