"""End-to-end search: candidates by keyword, by vector or by both, re-ranked, with a reserve for observations, joined back to
their rows.

Each source is cut to the over-fetched limit on narrow rows before anything is ranked across sources, so what is weighted,
floored and reserved is a few hundred rows whatever the size of the tables; wide rows are joined to the final page only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import index_title, keyword_hits, keyword_terms
from weftline.functions.vectors import cosine, literal
from weftline.operators import browse, retrieval

MODES = ("keyword", "semantic", "hybrid")
#: Columns of a source: key, class, scope and time of a row, its type, its search text and its vector.
SOURCE = ["id", "cls", "project", "session", "time", "type", "hay", "vector"]


@dataclass(frozen=True)
class Search:
    """What is asked for. ``vector`` is the query's vector, None where there is none: then the mode falls to keyword."""

    query: str
    mode: str = "hybrid"
    vector: tuple[float, ...] | None = None
    limit: int = 10
    project: str | None = None
    type: str | None = None
    include_reserved: bool = False
    reserved: tuple[str, ...] = ()
    include_observations: bool = True
    weights: dict | None = None
    recency_min: float = 0.95
    floor: bool = True
    reserve_share: float = retrieval.RESERVE

    def __post_init__(self) -> None:
        if not isinstance(self.query, str) or not self.query.strip():
            raise ValueError("the query is a text that is not blank")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        browse.check_page(self.limit)

    @property
    def effective_mode(self) -> str:
        return "keyword" if self.vector is None else self.mode

    @property
    def takes_observations(self) -> bool:
        """Only decisions among the observations have a type that a memory can have."""
        return self.include_observations and self.type in (None, "decision")

    @property
    def fetch(self) -> int:
        return retrieval.overfetch(self.limit, self.recency_min, float(self.floor)) if self.takes_observations else self.limit


def memory_class(metadata: Column) -> Column:
    """rollup for a memory whose metadata hold an object ``capture``, else manual; malformed metadata are none."""
    v = F.try_variant_get(F.try_parse_json(metadata), "$.capture", "variant")
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "rollup").otherwise("manual")


def scoped_source(df: DataFrame, s: Search) -> DataFrame:
    d = browse.scoped(df, "project", s.project, list(s.reserved), s.include_reserved)
    return d if s.type is None else d.where(F.col("type") == s.type)


def keyword_channel(df: DataFrame, s: Search, k: int) -> DataFrame:
    terms = keyword_terms(s.query)
    d = df.select(*SOURCE[:5], F.round(keyword_hits(F.col("hay"), terms) / len(terms), 6).alias("base")).where("base > 0")
    return d.orderBy(*channel_order()).limit(k)


def semantic_channel(df: DataFrame, s: Search, k: int) -> DataFrame:
    d = df.where("vector is not null").select(*SOURCE[:5], F.round(cosine(F.col("vector"), literal(list(s.vector))), 6).alias("base")).where("base is not null")
    return d.orderBy(*channel_order()).limit(k)


def channel_order() -> list[Column]:
    return [F.desc("base"), F.desc_nulls_last("time"), F.asc("id")]


def fuse(channels: list[list[DataFrame]], apart: bool) -> DataFrame:
    """Reciprocal rank fusion of channels, each a list of sources: ranks count within a source if ``apart``, else through
    the sources in their order. Adds ``place``, the order in which rows first occur."""
    both = None
    for c, sources in enumerate(channels):
        for n, df in enumerate(sources):
            part = df.withColumn("c", F.lit(c)).withColumn("n", F.lit(n))
            both = part if both is None else both.unionByName(part)
    place = Window.partitionBy("c", "n") if apart else Window.partitionBy("c")  # the over-fetched limit bounds them
    both = both.withColumn("r", F.row_number().over(place.orderBy("n", *channel_order())))
    first = F.min(F.struct("c", "n", "r")).alias("place")
    g = both.groupBy(*SOURCE[:5]).agg(F.round(F.sum(1.0 / (F.lit(retrieval.RRF_K) + F.col("r"))), 6).alias("base"), first)
    return g


def candidates(memories: DataFrame | None, observations: DataFrame | None, s: Search) -> DataFrame:
    """Narrow rows of all sources with their base score, at most the over-fetched limit from each source and channel."""
    sources = [scoped_source(df, s) for df in (memories, observations) if df is not None]
    k = s.fetch if memories is not None and observations is not None else s.limit
    if s.effective_mode == "hybrid":
        lists = [[f(df, s, k) for df in sources] for f in (keyword_channel, semantic_channel)]
        return fuse(lists, apart=k > s.limit)
    channel = keyword_channel if s.effective_mode == "keyword" else semantic_channel
    out = channel(sources[0], s, k)
    return out if len(sources) == 1 else out.unionByName(channel(sources[1], s, k))


def search_indexes(memories: DataFrame, observations: DataFrame, s: Search) -> DataFrame:
    """(rank, id, cls, score) of the best rows of both tables: weighted by class, faded by recency within a session, rollups
    lifted to their session's best observation, observations granted their reserve. Only a purely semantic search shows
    scores."""
    c = candidates(memories, observations if s.takes_observations else None, s).drop("place")
    ranked = retrieval.rerank(c, s.recency_min, s.floor, s.weights)
    page = retrieval.reserve(ranked, s.limit, s.reserve_share)
    return page.select(F.col("pos").cast("long").alias("rank"), "id", "cls", shown_score(s))


def search_memories(memories: DataFrame, s: Search) -> DataFrame:
    """(rank, id, cls, score) over memories alone: by score, then, for fused lists, in the order in which rows first occur."""
    c = candidates(memories, None, s)
    order = [F.desc("base"), F.asc("place")] if s.effective_mode == "hybrid" else channel_order()
    return _page(c, order, s)


def search_observations(observations: DataFrame, s: Search) -> DataFrame:
    """(rank, id, cls, score) over observations alone: by score, order of the class, time. Of types only decisions are known."""
    if s.type is not None and s.type != "decision":
        observations = observations.limit(0)
    c = candidates(None, observations, s).drop("place").withColumn("source_order", retrieval.by_class(F.col("cls"), retrieval.ORDER))
    return _page(c, [F.desc("base"), F.asc("source_order"), F.desc_nulls_last("time"), F.asc("id")], s)


def _page(c: DataFrame, order: list[Column], s: Search) -> DataFrame:
    top = c.orderBy(*order).limit(s.limit)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long").alias("rank"), "id", "cls", shown_score(s))


def shown_score(s: Search) -> Column:
    return (F.col("base") if s.effective_mode == "semantic" else F.lit(None)).cast("double").alias("score")


def with_rows(page: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The page with columns of its rows, in the order of its ranks: only the rows of the page are read in full."""
    return rows.select("id", *columns).join(F.broadcast(page), "id").orderBy("rank")  # the limit of the search


def index_row(summary: Column, keywords: Column) -> list[Column]:
    """Title and subtitle of a memory in an index."""
    first = F.array_join(F.slice(keywords, 1, 6), ", ")
    return [index_title(summary).alias("title"), F.when(F.size(keywords) > 0, first).alias("subtitle")]
