"""Repair of ids and sessions as plans over snapshots: built from evidence, checked before and after, applied, taken back.

A plan is a table; applying it gives the next snapshot, and every check is a count that must be zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.mutate import guarded_rewrite


def remap(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, project, session, key, action, target, reason) of rows of (id, project, session, key): where all evidence of a
    session names one other project, the row moves there; else it is skipped with a reason. Rows that would meet a row
    which stays, or one another, under one key of the target are left to a person.

    ``evidence``: session, project, any number of rows. ``key`` is what may occur once in a project; a null key never meets.
    """
    e = evidence.where("session is not null and project is not null").groupBy("session").agg(F.count_distinct("project").alias("_n"), F.min("project").alias("_to"))
    d = rows.join(e, "session", "left")
    why = F.when(F.col("_n").isNull(), "no evidence").when(F.col("_n") > 1, "ambiguous").when(F.col("_to") == F.col("project"), "unchanged")
    d = d.withColumn("reason", why).withColumn("target", F.when(F.col("reason").isNull(), F.col("_to"))).drop("_n", "_to")
    there = d.where("key is not null and reason is not null").groupBy(F.col("project").alias("target"), "key").agg(F.lit(True).alias("_taken"))
    twice = d.where("key is not null and reason is null").groupBy("target", "key").agg(F.count("*").alias("_m"))
    d = d.join(there, ["target", "key"], "left").join(twice, ["target", "key"], "left")
    clash = F.when(F.col("_taken"), "target exists").when(F.col("_m") > 1, "collision")
    d = d.withColumn("reason", F.coalesce("reason", clash, F.lit("ok")))
    move = F.col("reason") == "ok"
    return d.select("id", "project", "session", "key", F.when(move, "update").otherwise("skip").alias("action"), F.when(move, F.col("target")).alias("target"), "reason")


def preflight(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(check, n): what stands against applying a remap now: rows that are gone or no longer as planned, keys that the target
    has by now."""
    p = plan.where("action = 'update'").select("id", F.col("project").alias("_p"), "target", F.col("key").alias("_k"))
    j = p.join(rows.select("id", "project", "key", F.lit(True).alias("_there")), "id", "left")
    a = j.agg(F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if(F.col("_there") & (~F.col("project").eqNullSafe(F.col("_p")) | ~F.col("key").eqNullSafe(F.col("_k")))).alias("changed"))
    held = rows.where("key is not null").select(F.col("id").alias("_id"), F.col("project").alias("target"), F.col("key").alias("_k"))
    taken = p.join(held, ["target", "_k"]).where("id <> _id").agg(F.count("*").alias("n"))
    one = a.select(F.expr("stack(2, 'missing', missing, 'changed', changed) as (check, n)"))
    return one.unionByName(taken.select(F.lit("target taken").alias("check"), "n"))


def apply_remap(plan: DataFrame, rows: DataFrame, back: bool = False) -> DataFrame:
    """The next snapshot of ``rows`` (id, project, ...) under a remap, or, ``back``, the one before it: a row is rewritten only
    if it still is where the plan says; ``applied`` tells."""
    p = plan.where("action = 'update'").select("id", F.col("target" if back else "project").alias("_was"), F.col("project" if back else "target").alias("_will"))
    return guarded_rewrite(rows, p, "id", {"project": "_was"}, {"project": "_will"})


def refuse_rollback(plan: DataFrame, links: DataFrame, rollups: DataFrame, applied_at) -> DataFrame:
    """(check, n): what forbids taking a plan back: rows outside it that link to a moved row, moved rows changed since.

    ``links``: id, rollup; ``rollups``: id, updated_at. The plan holds both the linked rows and the rollups, by id.
    """
    moved = plan.where("action = 'update'").select("id").distinct()
    outside = links.join(moved.withColumnRenamed("id", "rollup"), "rollup", "left_semi").join(moved, "id", "left_anti").agg(F.count("*").alias("n"))
    touched = rollups.join(moved, "id", "left_semi").where(F.col("updated_at") > applied_at).agg(F.count("*").alias("n"))
    return outside.select(F.lit("linked from outside").alias("check"), "n").unionByName(touched.select(F.lit("changed since").alias("check"), "n"))


def merge_plan(rollups: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, session, action, survivor, reason): of several rollups of a session the one with most linked rows survives (then the
    earliest, then the least id) and the others merge into it; sessions whose active rollups name more than one project
    beside the survivor's are skipped.

    ``rollups``: id, session, project, created, status; ``linked``: id, n.
    """
    r = rollups.where("session is not null").join(linked, "id", "left").fillna(0, ["n"])
    active = r.where("status = 'active'")
    s = active.groupBy("session").agg(F.min(F.struct((-F.col("n")).alias("n"), "created", "id")).alias("b"), F.count("*").alias("m"), F.count_distinct("project").alias("p")).where("m > 1")
    j = active.join(s.select("session", F.col("b.id").alias("survivor"), "p"), "session")
    act = F.when(F.col("p") > 1, "skip").when(F.col("id") == F.col("survivor"), "keep").otherwise("merge")
    return j.select("id", "session", act.alias("action"), F.when(F.col("p") == 1, F.col("survivor")).alias("survivor"), F.when(F.col("p") > 1, "several projects").otherwise("ok").alias("reason"))


def apply_merge(plan: DataFrame, rollups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshots of rollups (id, status, merged_into, ...) and links (id, rollup): merged rollups are archived and point
    to their survivor, their rows link to it."""
    p = plan.where("action = 'merge'").select(F.col("id").alias("_id"), "survivor")
    r = rollups.join(p, F.col("id") == F.col("_id"), "left")
    r, hit = r.withColumn("_hit", F.col("_id").isNotNull() & (F.col("status") == "active")), F.col("_hit")
    r = r.withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))).withColumn("merged_into", F.when(hit, F.col("survivor")).otherwise(F.col("merged_into"))).select(*rollups.columns)
    k = links.join(p, F.col("rollup") == F.col("_id"), "left").withColumn("rollup", F.coalesce("survivor", "rollup")).select(*links.columns)
    return r, k


def reverse_merge(plan: DataFrame, rollups: DataFrame, links: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshots before a merge: archived rollups that still point to their survivor are active again, and rows link to
    what ``before`` (id, rollup) had, if they still link to the survivor of that."""
    p = plan.where("action = 'merge'").select(F.col("id").alias("_id"), "survivor")
    r = rollups.join(p, F.col("id") == F.col("_id"), "left")
    r, hit = r.withColumn("_hit", F.col("_id").isNotNull() & (F.col("status") == "archived") & F.col("merged_into").eqNullSafe(F.col("survivor"))), F.col("_hit")
    r = r.withColumn("status", F.when(hit, "active").otherwise(F.col("status"))).withColumn("merged_into", F.when(hit, None).otherwise(F.col("merged_into"))).select(*rollups.columns)
    b = before.select(F.col("id").alias("_l"), F.col("rollup").alias("_was")).join(p, F.col("_was") == F.col("_id"))
    k = links.join(b, (F.col("id") == F.col("_l")) & (F.col("rollup") == F.col("survivor")), "left").withColumn("rollup", F.coalesce("_was", "rollup")).select(*links.columns)
    return r, k


def after_merge(plan: DataFrame, rollups: DataFrame, links: DataFrame) -> DataFrame:
    """(check, n) of a merged snapshot: rows that link to an archived rollup, merged ones that are not archived, survivors that
    are, archived ones that no plan names."""
    status = rollups.select(F.col("id").alias("rollup"), "status")
    stale = links.join(status, "rollup").where("status = 'archived'").agg(F.count("*").alias("n"))
    j = plan.join(rollups.select("id", "status", "merged_into"), "id", "left")
    a = j.agg(F.count_if((F.col("action") == "merge") & ((F.col("status") != "archived") | ~F.col("merged_into").eqNullSafe(F.col("survivor")))).alias("merged"), F.count_if((F.col("action") == "keep") & (F.col("status") != "active")).alias("kept"))
    other = rollups.where("merged_into is not null").join(plan.where("action = 'merge'"), "id", "left_anti").agg(F.count("*").alias("n"))
    one = a.select(F.expr("stack(2, 'not archived', merged, 'survivor gone', kept) as (check, n)"))
    return one.unionByName(stale.select(F.lit("stale link").alias("check"), "n")).unionByName(other.select(F.lit("unplanned").alias("check"), "n"))


def set_equality(have: DataFrame, want: DataFrame) -> DataFrame:
    """(side, n): members that only one of two sets has; both are zero for equal sets. Repeats do not count."""
    only = lambda x, y, s: x.distinct().join(y.distinct(), on=x.columns, how="left_anti").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return only(have, want, "unexpected").unionByName(only(want, have, "missing"))


def copy_rows(source: DataFrame, target: DataFrame, key: str, moves, checksum) -> tuple[DataFrame, DataFrame]:
    """(next target, gate): rows of a condition copied to a table that lacks them, and one row telling whether those of the source may
    be deleted: rows, copied, and equal checksums of what was to be copied and of what is there."""
    part = source.where(moves)
    nxt = target.unionByName(part.join(target.select(key), key, "left_anti").select(*target.columns))
    there = nxt.join(part.select(key), key, "left_semi")
    a, b = checksum(part).select(F.col("rows").alias("rows"), F.col("checksum").alias("_a")), checksum(there).select(F.col("rows").alias("copied"), F.col("checksum").alias("_b"))
    gate = a.join(b, F.lit(True)).select("rows", "copied", (F.col("_a") == F.col("_b")).alias("may_delete"))  # one row each
    return nxt, gate
