"""Problem 8: mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each source gets the token budget of its target share of the largest total that no source's repeat limit
forbids. Whole epochs of a source come first; the rest of its budget is a weighted sample without
replacement: every document draws an exponential key divided by its quality weight, and the documents with
the smallest keys are taken until their prefix sum reaches the budget.

The prefix sum needs no sort of a source: tokens are summed by buckets of the logarithm of the key (combined
before the shuffle), the bucket in which the budget ends is found on these sums, and only its documents are
sorted. Logarithms of such keys spread over several units whatever the scale of the weights, so no bucket holds
more than about 1 / (2 x STEPS) of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Buckets of a unit of the logarithm of the key.
STEPS = 4096


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential variate over the weight, the same for the same id and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / float(2**53)
    return -F.ln(u) / weight


def plan_mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of ``targets``: available tokens, budget, whole epochs and the rest.

    Shares are taken relative to the sources that have tokens. Of several rows of a source the largest share
    and the smallest limit count; null sources, shares or limits and non-positive ones supply nothing.
    """
    t = targets.where("source is not null").groupBy("source").agg(
        F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    good = F.when((F.col("weight") > 0) & (F.col("weight").cast("double") < float("inf")), F.col("weight").cast("double"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"), F.min(good).alias("least_weight"))
    p = t.join(have, "source", "left").fillna(0, ["available", "documents"])
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    one = Window.partitionBy(F.lit(1))  # as many rows as the configuration has sources
    p = p.withColumn("usable", usable)
    p = p.withColumn("share", F.when(F.col("usable"), F.col("target_share") / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(one)).otherwise(0.0))
    most = F.min(F.when(F.col("usable"), F.col("available") * F.col("max_repeats") / F.col("share"))).over(one)
    p = p.withColumn("total", most if total_tokens is None else F.least(most, F.lit(float(total_tokens))))
    p = p.withColumn("budget", F.when(F.col("usable"), F.least(F.floor(F.col("share") * F.col("total") + 1e-6), F.col("available") * F.col("max_repeats"))).otherwise(0))
    p = p.withColumn("epochs", F.when(F.col("usable"), F.floor(F.col("budget") / F.col("available"))).otherwise(0))
    return p.select("source", "target_share", "max_repeats", "available", "documents", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("available")).alias("rest"), F.coalesce("least_weight", F.lit(1.0)).alias("least_weight"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """Chosen documents: doc_id, source, n_tokens, repeats (at least 1).

    ``docs``: doc_id, source, n_tokens, weight. Documents without tokens, with a null source or id, or of a
    source without a target are not used. Weights may have any scale; one that is null, no number or not positive
    counts as the least positive finite one of its source (1 if there is none); infinite ones come first. Repeated rows of an id are separate
    documents. A source gives at most its budget, and less than the largest document of its sample under it. Empty
    tables give an empty result.
    """
    docs = docs.select("doc_id", "source", "n_tokens", "weight").where("n_tokens > 0 and source is not null and doc_id is not null")
    p = cut(plan_mix(docs, targets, total_tokens).select("source", "epochs", "rest", "least_weight"))
    weight = F.when((F.col("weight") > 0) & ~F.isnan(F.col("weight").cast("double")), F.col("weight")).otherwise(F.col("least_weight"))
    key = sampling_key(F.col("doc_id"), weight, seed)
    d = docs.join(F.broadcast(p), "source").select(  # p has one row for each source of the configuration
        "doc_id", "source", "n_tokens", "epochs", "rest", key.alias("key")
    )
    d = d.withColumn("bucket", F.when(F.col("key") > 0, F.floor(F.ln("key") * STEPS)).otherwise(-(2**62)))
    sums = d.where("rest > 0").groupBy("source", "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    order = Window.partitionBy("source").orderBy("bucket")  # a few hundred thousand buckets a source at most
    sums = sums.withColumn("upto", F.sum("t").over(order))
    edge = sums.where("upto > rest and upto - t <= rest").select("source", F.col("bucket").alias("edge"), (F.col("upto") - F.col("t")).alias("before"))
    d = d.join(F.broadcast(cut(edge)), "source", "left")  # one row a source
    inside = F.coalesce((F.col("rest") > 0) & (F.col("bucket") == F.col("edge")), F.lit(False))
    below = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    sure = d.where(~inside).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(below, 1).otherwise(0)).alias("repeats"))
    w = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at = d.where(inside).withColumn("upto", F.col("before") + F.sum("n_tokens").over(w))
    at = at.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("repeats"))
    return sure.unionByName(at).where("repeats > 0").withColumn("repeats", F.col("repeats").cast("int"))


def mix_report(chosen: DataFrame, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source of the targets: target and real share of all tokens, tokens used, documents, most repeats."""
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.count("*").alias("used_documents"), F.max("repeats").alias("most_repeats")
    )
    one = Window.partitionBy(F.lit(1))
    usable = docs.where("n_tokens > 0 and source is not null and doc_id is not null")
    r = plan_mix(usable, targets, total_tokens).join(used, "source", "left").fillna(0, ["used", "used_documents", "most_repeats"])
    share = F.col("used") / F.sum("used").over(one)
    return r.select("source", "target_share", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("actual_share"), "available", "budget", "used", "documents", "used_documents", "max_repeats", "most_repeats")
