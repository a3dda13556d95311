"""Capture state as snapshots: checkpoints per source, holds, dead letters, rollups, repair invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def advance_checkpoints(state: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ranges to capture: (path, start, end, baseline) for each source whose boundary lies behind its checkpoint.

    ``state``: path, checkpoint; ``bounds``: path, boundary, any number of rows a path. A source that is seen for the
    first time only sets its baseline: one row with an empty range at its boundary. Null paths and boundaries are left out.
    """
    b = bounds.where("path is not null and boundary is not null").groupBy("path").agg(F.max("boundary").alias("end"))
    s = state.groupBy("path").agg(F.max("checkpoint").alias("start"))
    j = b.join(s, "path", "left").withColumn("baseline", F.col("start").isNull())
    return j.select("path", F.coalesce("start", "end").alias("start"), "end", "baseline").where("baseline or end > start")


def held(attempts: Column, last_try: Column, now: Column, min_minutes: int = 30) -> Column:
    """A source that failed waits for the interval; a last try in the future does not count."""
    age = (F.unix_micros(now) - F.unix_micros(last_try)) / 60e6
    return F.coalesce((attempts >= 1) & (age >= 0) & (age < min_minutes), F.lit(False))


def quiet(last_event: Column, now: Column, minutes: int) -> Column:
    """Nothing has come in for so long."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(last_event)) / 60e6 >= minutes, F.lit(False))


def finalise_due(sessions: DataFrame, now: Column, minutes: int = 360) -> DataFrame:
    """Sessions to finalise: nothing pending, and closed, marked for backfill, or quiet for the gap (six hours)."""
    ok = (F.coalesce("pending", F.lit(0)) == 0) & (F.coalesce("closed", F.lit(False)) | F.coalesce("backfill", F.lit(False)) | quiet(F.col("last_event"), now, minutes))
    return sessions.where(ok)


def malformed_only(parsed: DataFrame, key: str) -> DataFrame:
    """Keys of snapshots that hold lines but no good one."""
    return parsed.groupBy(key).agg(F.count_if(~F.col("malformed")).alias("_n")).where("_n = 0").select(key)


def drop_covered(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Retry entries and hints that a checkpoint has not yet passed."""
    c = checkpoints.groupBy("path").agg(F.max("checkpoint").alias("_c"))
    return entries.join(c, "path", "left").where("_c is null or end > _c").drop("_c")


def dead_letters(failed: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """New dead letters: ranges that failed ``most`` times, one per content hash, none that is known."""
    d = failed.where(F.col("attempts") >= most)
    digest = F.sha2(F.to_json(F.array("session", "path", F.col("start").cast("string"), F.col("end").cast("string"))), 256)
    d = d.withColumn("content_hash", digest).groupBy("content_hash").agg(*[F.min(c).alias(c) for c in ("session", "path", "start", "end")], F.max("attempts").alias("attempts"))
    return d.join(known.select("content_hash"), "content_hash", "left_anti")


def fold_rollups(current: DataFrame, windows: DataFrame) -> DataFrame:
    """The next rollup of each session: counters added, the newest summary, observation ids appended without repeats.

    ``current``: session, summary, summarize_count, discovery_tokens, observation_ids; ``windows`` has the same columns for
    each captured window and ``end``, its order within a session.
    """
    w = windows.groupBy("session").agg(
        F.max_by("summary", "end").alias("summary"), F.count("*").alias("n"), F.sum("discovery_tokens").alias("t"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("end", "observation_ids"))), lambda x: x["observation_ids"])).alias("ids"),
    )
    none = F.expr("cast(array() as array<bigint>)")
    j = current.alias("c").join(w.alias("w"), "session", "full_outer")
    return j.select(
        "session", F.coalesce("w.summary", "c.summary").alias("summary"),
        (F.coalesce("c.summarize_count", F.lit(0)) + F.coalesce("w.n", F.lit(0))).alias("summarize_count"),
        (F.coalesce("c.discovery_tokens", F.lit(0)) + F.coalesce("w.t", F.lit(0))).alias("discovery_tokens"),
        F.array_distinct(F.concat(F.coalesce("c.observation_ids", none), F.coalesce("w.ids", none))).alias("observation_ids"),
    )


def parse_extraction(text: Column, kinds: tuple[str, ...]) -> Column:
    """A struct of an extraction's fields and ``valid``: JSON with a non-empty summary, string arrays, and observations of
    known kinds with a title. What is malformed gives valid false and null fields."""
    obs = "array<struct<type:string,title:string,narrative:string,facts:array<string>>>"
    v = F.from_json(text, f"summary string, keywords array<string>, decisions array<string>, next_steps array<string>, observations {obs}")
    good = F.forall(F.coalesce(v["observations"], F.expr(f"cast(array() as {obs})")), lambda o: o["type"].isin(*kinds) & (F.coalesce(o["title"], F.lit("")) != ""))
    valid = F.coalesce((F.trim(v["summary"]) != "") & good & F.try_parse_json(text).isNotNull(), F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, v).alias("fields"))


def capture_metadata(meta: Column) -> Column:
    """The capture part of a metadata text: fields of a wrong type fall to their defaults, a text in a text is read."""
    v = F.try_parse_json(F.coalesce(F.try_variant_get(F.try_parse_json(meta), "$", "string"), meta))
    n = lambda p: F.coalesce(F.try_variant_get(v, p, "bigint"), F.lit(0))
    return F.struct(
        F.try_variant_get(v, "$.capture.session_id", "string").alias("session_id"), n("$.capture.summarize_count").alias("summarize_count"),
        n("$.capture.discovery_tokens").alias("discovery_tokens"), F.try_variant_get(v, "$.capture.observation_ids", "array<string>").alias("observation_ids"),
        F.try_variant_get(v, "$.capture", "variant").isNotNull().alias("present"),
    )


def drill_down(observations: Column, ids: Column) -> Column:
    """Whether a rollup's observations can be opened: available, legal-empty if it lists none, else inconsistent."""
    return F.when(observations > 0, "available").when(F.size(ids) == 0, "legal-empty").otherwise("inconsistent")


def resolve_verdicts(grades: DataFrame, scores: dict[str, int], systems: tuple[str, str]) -> DataFrame:
    """(question, winner, final_a, final_b) of two graders: equal order decides, with the lower grade where the grades
    differ; unequal order or an unknown grade leaves the question undecided and differing grades as DISAGREE."""
    table = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    pick = lambda g, s: F.max(F.when((F.col("grader") == g) & (F.col("system") == s), F.col("verdict")))
    q = grades.groupBy("question").agg(*[pick(g, s).alias(f"v{g}{k}") for g in (1, 2) for k, s in enumerate(systems)])
    sc = lambda c: F.try_element_at(table, F.col(c))
    win = lambda g: F.signum(sc(f"v{g}0") - sc(f"v{g}1"))
    decided = F.coalesce(win(1) == win(2), F.lit(False))
    low = lambda k: F.when(F.col(f"v1{k}") == F.col(f"v2{k}"), F.col(f"v1{k}")).when(~decided, "DISAGREE").when(sc(f"v1{k}") <= sc(f"v2{k}"), F.col(f"v1{k}")).otherwise(F.col(f"v2{k}"))
    winner = F.when(~decided, "undecided").when(win(1) > 0, systems[0]).when(win(1) < 0, systems[1]).otherwise("tie")
    return q.select("question", winner.alias("winner"), low(0).alias("final_a"), low(1).alias("final_b"))


def invariants(obs: DataFrame, rollups: DataFrame) -> DataFrame:
    """(rule, violations): references that lead nowhere, links across projects, active keys held twice."""
    r = rollups.select(F.col("id").alias("rollup_id"), F.col("project").alias("rp"))
    linked = obs.where("rollup_id is not null").join(r, "rollup_id", "left")
    a = linked.agg(F.count_if(F.col("rp").isNull()).alias("orphan"), F.count_if(F.col("rp") != F.col("project")).alias("cross_project"))
    d = rollups.where("status = 'active' and key is not null").groupBy("project", "key").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    return a.select(F.expr("stack(2, 'orphan', orphan, 'cross_project', cross_project) as (rule, violations)")).unionByName(d.select(F.lit("duplicate_key").alias("rule"), F.col("n").alias("violations")))
