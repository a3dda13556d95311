"""Evaluation and audits: feedback of searches, tallies, estimators, scopes, completeness, samples, classes of what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranges import overlaps


def feedback(results: DataFrame) -> DataFrame:
    """One row a search (query, n, result_ids, project_ids, ranks, scores, valid): its results as lists in order of rank. Lists have
    one length, ranks run from 1, scores are all there or none is; ``valid`` tells.

    ``results``: query, rank, id, project, score, the page of a search each.
    """
    g = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "project", "score"))).alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    scores = part("score")
    some, every = F.exists(scores, lambda x: x.isNotNull()), F.forall(scores, lambda x: x.isNotNull())
    ranks = part("rank").cast("array<bigint>")
    good = (ranks == F.sequence(F.lit(1).cast("long"), F.size("r").cast("long"))) & (every | ~some) & F.forall(part("id"), lambda x: x.isNotNull())
    return g.select("query", F.size("r").alias("n"), part("id").alias("result_ids"), part("project").alias("project_ids"), ranks.alias("ranks"), F.when(some, scores).alias("scores"), good.alias("valid"))


def verdict_tally(verdicts: DataFrame, answers: DataFrame, systems: tuple[str, str]) -> DataFrame:
    """(system, win, tie, loss, undecided, confident_wrong, cost, turns) of two systems. ``verdicts``: question, winner, final_a,
    final_b (see :func:`weftline.operators.state.resolve_verdicts`); ``answers``: question, system, cost, turns."""
    both = None
    for k, s in enumerate(systems):
        other = systems[1 - k]
        one = verdicts.agg(
            F.count_if(F.col("winner") == s).alias("win"), F.count_if(F.col("winner") == "tie").alias("tie"), F.count_if(F.col("winner") == other).alias("loss"),
            F.count_if(F.col("winner") == "undecided").alias("undecided"), F.count_if(F.col("final_" + "ab"[k]) == "confident_wrong").alias("confident_wrong"),
        ).withColumn("system", F.lit(s))
        both = one if both is None else both.unionByName(one)
    cost = answers.groupBy("system").agg(F.sum("cost").alias("cost"), F.sum("turns").alias("turns"))
    return both.join(cost, "system", "left").select("system", "win", "tie", "loss", "undecided", "confident_wrong", "cost", "turns")


def estimator_error(df: DataFrame, estimate: Column, truth: Column, within: float = 0.2) -> DataFrame:
    """(n, mean_error, within): of an estimator, over rows with a truth above 0: the mean of the relative errors and how many
    are within a share of the truth."""
    e = F.abs(estimate - truth) / truth
    d = df.where(truth > 0).select(e.alias("e"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean_error"), F.count_if(F.col("e") <= within).alias("within"))


def verify_scope(rows: DataFrame, scope: str | None, wanted: int = 5, window: int = 50) -> DataFrame:
    """(query, verified, kept, excluded, reason) of result lists (query, project): a scope is proven only if one was asked for, every row
    names its project, and the list was not cut off before enough of its rows were seen."""
    g = rows.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("project") == scope).alias("own") if scope else F.lit(0).alias("own"), F.count_if(F.coalesce(F.col("project"), F.lit("")) == "").alias("unnamed"))
    why = F.when(F.lit(not scope), "no scope").when(F.col("unnamed") > 0, "no project named").when((F.col("n") >= window) & (F.col("own") < wanted), "saturated")
    kept = F.when(why.isNull(), F.col("own")).otherwise(0)
    return g.select("query", why.isNull().alias("verified"), kept.cast("long").alias("kept"), F.when(why.isNull(), F.col("n") - F.col("own")).otherwise(0).cast("long").alias("excluded"), F.coalesce(why, F.lit("ok")).alias("reason"))


def completeness(facts: DataFrame) -> DataFrame:
    """(status, issues) of a report from one row of counts: fixed, fixed_wanted, real, real_wanted, unverified, drill_errors,
    embedded, active. Anything missing makes it PARTIAL; a whole one is PENDING a person's judgement."""
    issues = F.array(
        F.when(F.col("fixed") < F.col("fixed_wanted"), "fixed queries"), F.when(F.col("real") < F.col("real_wanted"), "real queries"), F.when(F.col("unverified") > 0, "scope"),
        F.when(F.col("drill_errors") > 0, "drill-down"), F.when(F.col("active") == 0, "no corpus"), F.when(F.col("embedded") < F.col("active"), "embeddings"),
    )
    found = F.filter(issues, lambda x: x.isNotNull())
    return facts.select(F.when(F.size(found) > 0, "PARTIAL").otherwise("PENDING").alias("status"), F.array_join(found, ", ").alias("issues"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """(key, stratum) of ``n`` rows drawn in turns from the strata, the largest first, in an order that the seed fixes. Only the first
    ``n`` of a stratum can be drawn, so that is what is ranked."""
    size = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    top = df.select(key, stratum, draw.alias("_d")).withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_d", key))).where(F.col("_r") <= n)
    return top.join(size, stratum).orderBy("_r", F.desc("_size"), stratum).limit(n).select(key, stratum)


def dead_letter_class(error: Column, wanted: str, path_hash: Column, path: Column, length: Column, end: Column) -> Column:
    """Whether the source of a dead letter can be read again."""
    return (
        F.when(~error.eqNullSafe(F.lit(wanted)), "error-code-filtered").when(path_hash.isNull(), "no-source").when(path.isNull(), "path-unresolved")
        .when(length.isNull(), "transcript-deleted").when(length < end, "transcript-truncated").otherwise("READABLE")
    )


def replay_order() -> list[Column]:
    """The order in which dead letters are replayed: by project and session, then by place in the spool."""
    return [F.asc("project"), F.asc("session"), F.asc("spool_start"), F.asc("spool_end")]


def replay_verdict(raw: Column, digest: Column, marker: str) -> Column:
    """Whether a dead letter's bytes may be replayed: they still are what they were, and something is left of them without the lines
    that were put in."""
    left = F.array_join(F.filter(F.split(raw, "\n"), lambda x: ~x.contains(marker)), "\n")
    return F.when(digest.isNotNull() & (F.sha2(raw, 256) != digest), "content-hash-mismatch").when(F.trim(left) == "", "empty-transcript").otherwise("replay")


def recovery_audit(letters: DataFrame, records: DataFrame, sources: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(letter, classes, action): what is known about the source of each dead letter. Its spool range is met with the ranges of the
    records of its session, which name transcripts.

    ``letters``: letter, session, start, end, legacy; ``records``: session, start, end, path; ``sources``: path.
    """
    side = lambda df, *more: df.where("session is not null and end > start").select("session", "start", "end", *more)
    hit = overlaps(side(letters).distinct(), side(records).distinct(), ["session"], width)
    met = hit.select("session", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_start").alias("_s"), F.col("b_end").alias("_e"))
    named = met.join(side(records, "path").select("session", F.col("start").alias("_s"), F.col("end").alias("_e"), "path").distinct(), ["session", "_s", "_e"])
    there = sources.select("path", F.lit(True).alias("there")).distinct()
    g = named.where("path is not null").select("session", "start", "end", "path").distinct().join(there, "path", "left").groupBy("session", "start", "end")
    g = g.agg(F.count("*").alias("paths"), F.count_if(F.col("there").isNull()).alias("gone"))
    j = letters.join(g, ["session", "start", "end"], "left").fillna(0, ["paths", "gone"])
    one = (F.col("paths") == 1) & (F.col("gone") == 0) & ~F.col("legacy")
    classes = F.array(
        F.when(F.col("paths") == 1, "single_transcript_path"), F.when(F.col("paths") > 1, "mixed_transcript_paths"), F.when((F.col("paths") == 0) | (F.col("gone") > 0), "source_missing"),
        F.when(F.col("legacy"), "prior_chunk_commit_unknown"), F.when(one, "recoverable_single_path"),
    )
    return j.select("letter", F.array_join(F.filter(classes, lambda x: x.isNotNull()), ",").alias("classes"), F.when(one, "prepare").otherwise("review").alias("action"))


def checkpoint_classes(spools: DataFrame, sources: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(session, class, paths, pending): sessions by whether their transcripts are there: no_path, all_missing, all_present or mixed, and
    the bytes behind the checkpoints of those that are.

    ``spools``: session, path; ``sources``: path, size; ``checkpoints``: path, checkpoint.
    """
    s = spools.select("session", "path").distinct().join(sources, "path", "left").join(checkpoints, "path", "left")
    g = s.groupBy("session").agg(
        F.count("path").alias("paths"), F.count("size").alias("have"), F.sum(F.greatest(F.col("size") - F.coalesce("checkpoint", F.lit(0)), F.lit(0))).alias("pending")
    )
    cls = F.when(F.col("paths") == 0, "no_path").when(F.col("have") == 0, "all_missing").when(F.col("have") == F.col("paths"), "all_present").otherwise("mixed")
    return g.select("session", cls.alias("class"), "paths", F.coalesce("pending", F.lit(0)).alias("pending"))


def backlog_classes(sessions: DataFrame, window: int) -> DataFrame:
    """(class, sessions, pending, calls) of sessions (boundary, checkpoint, size), each in one class: no boundary, source missing,
    baseline only (never captured), complete, pending."""
    cls = (
        F.when(F.col("boundary").isNull(), "no_boundary").when(F.col("size").isNull(), "source_missing").when(F.col("checkpoint").isNull(), "baseline_only")
        .when(F.col("checkpoint") >= F.least("boundary", "size"), "complete").otherwise("pending")
    )
    d = sessions.withColumn("class", cls).withColumn("_p", F.when(F.col("class") == "pending", F.least("boundary", "size") - F.col("checkpoint")).otherwise(0))
    return d.groupBy("class").agg(F.count("*").alias("sessions"), F.sum("_p").alias("pending"), F.sum(F.ceil(F.col("_p") / window)).alias("calls"))


def exists_any(*parts: DataFrame) -> bool:
    """Whether any of the tables has a row: each is asked for one only."""
    return any(not p.limit(1).isEmpty() for p in parts)
