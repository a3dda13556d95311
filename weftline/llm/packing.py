"""Problem 7: filling fixed-capacity containers, by conflict-constrained best fit.

Items are spread over shards of a bounded number of tokens and packed shard by shard in order of falling
size. The open containers of a shard are kept in order of their free space, each with a bitmap of sources
and one of duplicate clusters; the successor search starts at the tightest container that holds the item
and goes on until one is compatible. A shard leaves at most a few containers half empty, so the space lost
to sharding is below capacity / shard size.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tokens and items a shard holds at most, about: bound the work and memory of one task.
SHARD_TOKENS, SHARD_ITEMS = 8_000_000, 50_000
#: A container takes at most so many times the documents of a source that an even spread over all containers gives it.
SOURCE_SPREAD = 2.0
#: Share of containers that may be opened to keep to that.
SOURCE_ROOM = 0.005


def best_fit(
    sizes: list[int], sources: list, clusters: list, capacity: int, apart: frozenset = frozenset(), spread: float | None = None
) -> list[int]:
    """Container number per item; sizes are in 1..capacity and come in falling order.

    Members of one duplicate cluster share no container, unless a cluster has more members than the fewest
    containers that the items need: then each container takes at most the quota that spreads them evenly.
    Documents of a source in ``apart`` share no container with one another. With ``spread``, a container takes of every
    other source at most ``spread`` times the documents that an even spread over the fewest containers gives it, at
    least one; null sources are free. This rule alone opens no more than SOURCE_ROOM of the fewest containers beyond
    them: after that, a document that fits only where its source is at its quota goes into the tightest of those.
    """
    fewest = max(1, -(-sum(sizes) // capacity))
    most = math.ceil(fewest * (1 + SOURCE_ROOM))
    members = Counter(clusters)
    bit = {c: 1 << k for k, c in enumerate(c for c, n in members.items() if n > 1 and c is not None)}
    quota = {c: -(-members[c] // fewest) for c in bit}
    of_source = Counter(s for s in sources if s is not None)
    source_quota = {s: 1 if s in apart else max(1, math.ceil(spread * n / fewest)) for s, n in of_source.items() if s in apart or spread}
    source_bit = {s: 1 << k for k, s in enumerate(sorted(source_quota))}
    free: list[tuple[int, int]] = []  # (free space, container), ascending
    full_clusters: list[int] = []
    taken_sources: list[int] = []
    held: dict[tuple[int, object], int] = defaultdict(int)  # sources are texts, clusters numbers
    where = []
    for size, source, cluster in zip(sizes, sources, clusters):
        cb, sb = bit.get(cluster, 0), source_bit.get(source, 0)
        k = first = bisect_left(free, (size, -1))
        while k < len(free) and (full_clusters[free[k][1]] & cb or taken_sources[free[k][1]] & sb):
            k += 1
        if k == len(free) and sb and source not in apart and len(full_clusters) >= most:
            k = first
            while k < len(free) and full_clusters[free[k][1]] & cb:
                k += 1
        if k < len(free):
            space, box = free.pop(k)
        else:
            space, box = capacity, len(full_clusters)
            full_clusters.append(0)
            taken_sources.append(0)
        if sb:
            held[box, source] += 1
            if held[box, source] >= source_quota[source]:
                taken_sources[box] |= sb
        if cb:
            held[box, cluster] += 1
            if held[box, cluster] >= quota[cluster]:
                full_clusters[box] |= cb
        if space > size:
            insort(free, (space - size, box))
        where.append(box)
    return where


_OUT = "pack_name string, container_id long, doc_id long, piece_no int, start_token long, end_token long"


def _packer(apart: frozenset, spread: float | None):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        capacity = int(pdf.capacity.iloc[0])
        box = best_fit(pdf["size"].tolist(), pdf.source.tolist(), pdf.cluster.tolist(), capacity, apart, spread)
        return pd.DataFrame(
            {
                "pack_name": pdf.pack_name,
                "container_id": (int(key[1]) << 32) + pd.Series(box, index=pdf.index, dtype="int64"),
                "doc_id": pdf.doc_id,
                "piece_no": pdf.piece_no,
                "start_token": pdf.start_token,
                "end_token": pdf.start_token + pdf["size"],
            }
        )

    return run


def pack(
    items: DataFrame, capacities: DataFrame, shard_tokens: int = SHARD_TOKENS, apart: tuple[str, ...] = (),
    spread: float | None = None, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Container of every item, for every capacity; ``apart`` and ``spread`` as in :func:`best_fit`.

    ``items``: doc_id, source, cluster, n_tokens (cluster: items that may not meet, null for none).
    ``capacities``: pack_name, capacity_tokens; null or non-positive capacities are ignored.
    Result: pack_name, container_id, doc_id, piece_no, start_token, end_token. An item within the capacity is
    one row with piece_no 0; a larger one is divided into full containers and a rest that is packed like an
    item. Items without tokens need no space: one row with a null container_id. Repeated rows are packed
    each for itself. Container ids are unique within a pack. An empty table gives an empty result.
    """
    caps = capacities.where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(
        F.min("capacity_tokens").cast("long").alias("capacity")
    )
    items = items.select("doc_id", "source", "cluster", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    total, number = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-int(total) // shard_tokens), -(-number // shard_items))
    # every item once for each of the capacities, which are a configuration of a few rows
    packs = F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).alias("capacity")) for r in caps.collect()])
    each = items.select("*", F.explode(packs).alias("p")).select("doc_id", "source", "cluster", "n_tokens", "p.*")
    none = each.where("n_tokens <= 0").select(
        "pack_name", F.lit(None).cast("long").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("end_token")
    )
    pieces = each.where("n_tokens > 0").select(
        "pack_name",
        "capacity",
        "doc_id",
        "source",
        "cluster",
        F.posexplode(F.expr("transform(sequence(0L, (n_tokens - 1) div capacity), k -> named_struct('start', k * capacity, 'size', least(capacity, n_tokens - k * capacity)))")).alias("piece_no", "x"),
    )
    work = pieces.select(
        "pack_name",
        F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).alias("shard"),
        "capacity",
        "doc_id",
        "source",
        "cluster",
        "piece_no",
        F.col("x.start").alias("start_token"),
        F.col("x.size").alias("size"),
    )
    return work.groupBy("pack_name", "shard").applyInPandas(_packer(frozenset(apart), spread), _OUT).unionByName(none)


def duplicate_cluster(text: Column) -> Column:
    """Documents whose texts agree in all but case and blanks are one cluster; null for empty texts."""
    t = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.trim(t) != "", F.xxhash64(t))


def pack_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, and the share of the space that is used."""
    used = packed.where("container_id is not null").groupBy("pack_name").agg(
        F.count_distinct("container_id").alias("containers"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens")
    )
    return used.join(capacities, "pack_name").select(
        "pack_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill")
    )
