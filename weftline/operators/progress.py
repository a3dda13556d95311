"""How capture moves forward: order of a tick and its budgets, attribution, splits, progress on two levels, claims, rollups."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_length
from weftline.operators.capture import window_ends
from weftline.operators.ranges import BLOCK, merge_ranges

# ---- the order of a tick -------------------------------------------------------------------------------------


def rotated(path: Column, cursor: str | None) -> list[Column]:
    """Sort columns: paths behind the cursor first, then those up to it, each in order; without a cursor in plain order."""
    return [path.asc()] if not cursor else [(path <= cursor).asc(), path.asc()]


def tick_order(sessions: DataFrame, now: Column, cursor: str | None, fresh_minutes: int, quiet_minutes: int) -> DataFrame:
    """Sessions of (path, last_event, closed) with ``tier``: closed 0, fresh 1, stale 2, held 3, and ``place`` within the
    tier: closed and fresh ones newest first, stale ones by path from behind the cursor on; held ones have none. An event
    in the future counts as just now."""
    age = (F.unix_micros(now) - F.unix_micros("last_event")) / 60e6
    tier = F.when(F.coalesce("closed", F.lit(False)), 0).when((F.lit(quiet_minutes) > 0) & (age < quiet_minutes), 3).when((F.lit(fresh_minutes) > 0) & (age <= fresh_minutes), 1).otherwise(2)
    return sessions.withColumn("tier", tier).withColumn("behind", F.when(F.col("tier") == 2, F.lit(cursor) >= F.col("path") if cursor else F.lit(False)))


def tick_sort() -> list[Column]:
    """The order in which a tick takes the sessions of :func:`tick_order`."""
    newest = F.when(F.col("tier") < 2, F.col("last_event"))
    return [F.asc("tier"), F.desc_nulls_last(newest), F.asc_nulls_last("behind"), F.asc("path")]


def within_budget(sessions: DataFrame, most_sessions: int, most_windows: int, windows: str = "windows") -> DataFrame:
    """The sessions one tick takes: the first ones in its order, at most so many, until their windows are used up; a
    session is taken as long as windows are left. ``sessions`` has the columns of :func:`tick_order`; held ones and those
    without windows do not count."""
    top = sessions.where((F.col("tier") < 3) & (F.col(windows) > 0)).orderBy(*tick_sort()).limit(most_sessions)
    w = Window.partitionBy(F.lit(1)).orderBy(*tick_sort()).rowsBetween(Window.unboundedPreceding, -1)  # one tick's sessions
    before = F.coalesce(F.sum(windows).over(w), F.lit(0))
    return top.withColumn("_before", before).where(F.col("_before") < most_windows).withColumn("taken", F.least(F.col(windows), most_windows - F.col("_before"))).drop("_before")


# ---- attribution ---------------------------------------------------------------------------------------------


def attribute(records: DataFrame, known: DataFrame, cutoff: Column) -> DataFrame:
    """(session, project, basis) by era: a record of the new era names its project itself (the first by place); records of the
    old era alone leave it to what is already known, then to the working folder, then to the record; without any dated
    record the known id comes before the record's.

    ``records``: session, place, project, time; ``known``: session, state, folder. Null projects name none.
    """
    named = (F.col("project").isNotNull()) & (F.col("project") != "")
    dated = named & F.col("time").isNotNull()
    first = lambda cond: F.min(F.when(cond, F.struct("place", "project")))["project"]
    r = records.groupBy("session").agg(first(named).alias("any"), first(dated & (F.col("time") >= cutoff)).alias("new"), F.max(F.coalesce(dated & (F.col("time") < cutoff), F.lit(False))).alias("old"))
    j = r.join(known, "session", "left")
    p = F.when(F.col("new").isNotNull(), F.col("new")).when(F.col("old"), F.coalesce("state", "folder", "any")).otherwise(F.coalesce("state", "any"))
    basis = (
        F.when(F.col("new").isNotNull(), "new era").when(F.col("state").isNotNull(), "state")
        .when(F.col("old") & F.col("folder").isNotNull(), "folder").when(F.col("any").isNotNull(), "record").otherwise("none")
    )
    return j.select("session", p.alias("project"), basis.alias("basis"))


# ---- splits --------------------------------------------------------------------------------------------------

#: Bytes below which a window is not divided further.
LEAST_SPLIT = 1024


def split_range(start: int, raw: bytes, hint: tuple[int, int, str] | None, whole: bytes) -> list[tuple[int, int]] | None:
    """Ranges of a window that was too long: at the boundary of a hint (start, end, hash of those bytes) that still holds,
    else halved at a natural boundary; None if it cannot be divided."""
    if hint is not None:
        a, z, digest = hint
        if a <= start < z < start + len(raw) and hashlib.sha256(whole[a:z]).hexdigest() == digest:
            return [(start, z), (z, start + len(raw))]
    if len(raw) <= LEAST_SPLIT:
        return None
    parts = window_ends(raw, 0, len(raw), max(LEAST_SPLIT, len(raw) // 2))
    return [(start + a, start + z) for a, z in parts] if len(parts) > 1 else None


def adaptive_split(windows: DataFrame, key: str, text: str, hints: DataFrame) -> DataFrame:
    """(key, part, start, end, by_hint) of windows that were too long; those that cannot be divided give no row. ``hints``:
    key, hint_start, hint_end, hint_hash, at most one a key."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t, a, z, h in pdf.itertuples(index=False, name=None):
                raw = t.encode()
                hint = None if h is None or pd.isna(a) else (int(a), int(z), h)
                parts = split_range(0, raw, hint, raw) or []
                used = hint is not None and len(parts) == 2 and parts[0][1] == hint[1]
                rows += [(k, n, s, e, used) for n, (s, e) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[key, "part", "start", "end", "by_hint"])

    j = windows.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), text).join(hints, key, "left")
    return j.select(key, text, "hint_start", "hint_end", "hint_hash").mapInPandas(run, f"{key} long, part int, start long, end long, by_hint boolean")


# ---- progress ------------------------------------------------------------------------------------------------


def progress(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """The next state on two levels: (spool, path, checkpoint, cursor). A transcript's checkpoint moves to the end of the
    chunks that were committed without a gap; the cursor of a spool moves only if every chunk of its snapshot was.

    ``chunks``: spool, path, place, end, committed, safe_end; ``state``: spool, path, checkpoint, cursor.
    """
    stop = chunks.where("not committed").groupBy("spool", "path").agg(F.min("place").alias("stop"))
    done = chunks.join(stop, ["spool", "path"], "left").where("committed and (stop is null or place < stop)").groupBy("spool", "path").agg(F.max("end").alias("done"))
    whole = chunks.groupBy("spool").agg(F.every("committed").alias("whole"), F.max("safe_end").alias("safe_end"))
    j = state.join(done, ["spool", "path"], "left").join(whole, "spool", "left")
    return j.select("spool", "path", F.greatest("checkpoint", "done").alias("checkpoint"), F.when(F.col("whole"), F.col("safe_end")).otherwise(F.col("cursor")).alias("cursor"))


def skip_past(state: DataFrame, dead: DataFrame) -> DataFrame:
    """(path, checkpoint, skipped): the checkpoint of a source passes its dead letters that begin at or before it, however
    many follow one another; those behind a gap wait."""
    s = state.groupBy("path").agg(F.max("checkpoint").alias("at"))
    ranges = dead.select("path", "start", "end").unionByName(s.select("path", F.lit(-1).cast("long").alias("start"), F.col("at").alias("end")))
    chain = merge_ranges(ranges, ["path"], block=BLOCK).where("start = -1").select("path", F.col("end").alias("checkpoint"))
    n = dead.join(s, "path").join(chain, "path").where("end <= checkpoint and end > at").groupBy("path").agg(F.count("*").alias("skipped"))
    return chain.join(n, "path", "left").select("path", "checkpoint", F.coalesce("skipped", F.lit(0)).alias("skipped"))


def missing_sources(spools: DataFrame, sources: DataFrame) -> DataFrame:
    """(session, cursor, missing): spools none of whose paths has a source. Their cursor moves to the end of the spool, they
    are counted, and no checkpoint changes. ``spools``: session, path, place."""
    j = spools.join(sources.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    g = j.groupBy("session").agg(F.max("place").alias("cursor"), F.count_distinct("path").alias("missing"), F.max(F.coalesce("there", F.lit(False))).alias("some"))
    return g.where("not some").select("session", "cursor", "missing")


def after_failed_write(state: DataFrame, failed: DataFrame) -> DataFrame:
    """A session whose sink failed stops where it is: checkpoint, cursor and attempts stay, and it takes no part until the
    next tick (``stopped``)."""
    f = failed.select("session").distinct().withColumn("_f", F.lit(True))
    return state.join(f, "session", "left").withColumn("stopped", F.coalesce("_f", F.lit(False))).drop("_f")


def rotates(size: Column, cursor: Column, last_change: Column, stopped: Column, finalising: Column, now: Column, most_bytes: int = 10 << 20, idle_hours: int = 24) -> Column:
    """Whether a spool is sealed: read to its end, stopped, not being finalised, and too large or idle too long."""
    idle = F.unix_micros(now) - F.unix_micros(last_change) > idle_hours * 3_600_000_000
    return F.coalesce((cursor >= size) & stopped & ~finalising & ((size > most_bytes) | idle), F.lit(False))


def corrupt_state(state: DataFrame) -> DataFrame:
    """(path, reason) of state rows that break a rule of their form: a hash of 64 hexadecimal signs, checkpoints, cursors
    and attempts of at least 0, ends not before starts, a generation that is not blank."""
    whole = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    why = (
        F.when(~F.coalesce(F.col("path_hash").rlike("^[a-f0-9]{64}$"), F.lit(False)), "path_hash").when(F.coalesce(F.trim("generation"), F.lit("")) == "", "generation")
        .when(~whole("cursor"), "cursor").when(~whole("checkpoint"), "checkpoint").when(~whole("attempts"), "attempts").when(~F.coalesce(F.col("end") >= F.col("start"), F.lit(False)), "range")
    )
    return state.withColumn("reason", why).where("reason is not null").select("path", "reason")


# ---- finalising ----------------------------------------------------------------------------------------------


def claim(rollups: DataFrame, now: Column, most: int = 3, retry_minutes: int = 30, lease_minutes: int = 5) -> DataFrame:
    """``rollups`` with claimed, attempts, next_at and lease_until of the next snapshot. A rollup is claimed if its
    generation is not finalised yet, no lease runs, and its attempts at this generation are neither used up nor too
    recent. Columns: generation, finalised_generation, retry_generation, attempts, next_at, lease_until."""
    same = F.coalesce(F.col("retry_generation") == F.col("generation"), F.lit(False))
    tries = F.when(same, F.coalesce("attempts", F.lit(0))).otherwise(0)
    free = ~F.coalesce(F.col("lease_until") > now, F.lit(False)) & ~(same & (F.coalesce(F.col("next_at") > now, F.lit(False)) | (tries >= most)))
    ok = F.coalesce((F.col("generation") >= 1) & ~F.coalesce(F.col("finalised_generation") == F.col("generation"), F.lit(False)) & free, F.lit(False))
    later = lambda minutes: now + F.make_interval(mins=F.lit(minutes))
    d = rollups.withColumn("claimed", ok).withColumn("attempts", F.when(ok, tries + 1).otherwise(F.col("attempts")))
    d = d.withColumn("next_at", F.when(ok, later(retry_minutes)).otherwise(F.col("next_at"))).withColumn("lease_until", F.when(ok, later(lease_minutes)).otherwise(F.col("lease_until")))
    return d.withColumn("retry_generation", F.when(ok, F.col("generation")).otherwise(F.col("retry_generation")))


def fenced(finished: DataFrame, current: DataFrame) -> DataFrame:
    """Results of finalising that may be written: their rollup is still of the generation and the attempt they were claimed at."""
    return finished.alias("f").join(current.alias("c"), "id").where("f.generation = c.generation and f.attempts = c.attempts").select("f.*")


def update_rollups(current: DataFrame, windows: DataFrame, least: int = 200, share: float = 0.4) -> DataFrame:
    """The next rollup of each session: (session, summary, pending, windows, tokens, replayed).

    A window whose range lies in one already taken in is a replay and counts for nothing. The summary is replaced by that of
    the last new window, unless it is much shorter than a long one it would replace: then it waits as ``pending``.
    ``current``: session, summary, windows, tokens; ``taken`` ranges come with ``windows``: session, path, start, end,
    summary, tokens, seen (whether a range of the session's path covers it).
    """
    new = windows.where("not seen").groupBy("session").agg(F.max_by("summary", F.struct("end", "path")).alias("next"), F.count("*").alias("n"), F.sum("tokens").alias("t"))
    old = windows.where("seen").groupBy("session").agg(F.count("*").alias("replayed"))
    j = current.join(new, "session", "full_outer").join(old, "session", "left")
    shrunk = F.coalesce((content_length(F.col("summary")) >= least) & (content_length(F.col("next")) < content_length(F.col("summary")) * share), F.lit(False))
    return j.select(
        "session", F.when(shrunk, F.col("summary")).otherwise(F.coalesce("next", "summary")).alias("summary"), F.when(shrunk, F.col("next")).alias("pending"),
        (F.coalesce("windows", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("windows"), (F.coalesce("tokens", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("tokens"), F.coalesce("replayed", F.lit(0)).alias("replayed"),
    )


def trim_activity(rows: DataFrame, order: list[Column], tokens, budget: int, short: int = 60) -> DataFrame:
    """The rows of a page within a budget of tokens: whole if they fit; else without their ids; else with shorter excerpts as
    well; else as many from the front as fit then. ``rows``: excerpt, ids and what ``order`` needs; ``tokens`` gives the
    estimate of a row's JSON. A page is a few rows."""
    one = Window.partitionBy(F.lit(1))
    none = F.expr("cast(array() as array<string>)")
    brief = F.when(F.char_length("excerpt") > short, F.concat(F.substring("excerpt", 1, short), F.lit("…"))).otherwise(F.col("excerpt"))
    d = rows.withColumn("_a", tokens(F.col("excerpt"), F.col("ids"))).withColumn("_b", tokens(F.col("excerpt"), none)).withColumn("_c", tokens(brief, none))
    d = d.withColumn("_step", F.when(F.sum("_a").over(one) <= budget, 0).when(F.sum("_b").over(one) <= budget, 1).otherwise(2))
    d = d.withColumn("_upto", F.sum("_c").over(one.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_step") < 2) | (F.col("_upto") <= budget))
    d = d.withColumn("ids", F.when(F.col("_step") == 0, F.col("ids")).otherwise(none)).withColumn("excerpt", F.when(F.col("_step") == 2, brief).otherwise(F.col("excerpt")))
    return d.drop("_a", "_b", "_c", "_step", "_upto")
