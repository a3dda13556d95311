"""One entry for all questions to a store of memories: a tool's name and its arguments as JSON, and a DataFrame as the answer.

Arguments are checked before anything is read; names that a tool does not know are refused. A store is read-only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import browse, search
from weftline.operators.search import Search


@dataclass(frozen=True)
class Argument:
    kind: type
    default: Any = None
    required: bool = False
    choices: tuple = ()
    least: int | None = None
    most: int | None = None

    def check(self, name: str, value: Any) -> Any:
        if value is None:
            if self.required:
                raise ValueError(f"{name} is missing")
            return self.default
        if not isinstance(value, self.kind) or self.kind is int and isinstance(value, bool):
            raise ValueError(f"{name} is no {self.kind.__name__}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} is one of {', '.join(map(str, self.choices))}")
        size = len(value) if isinstance(value, (str, list)) else value
        if self.kind is str and self.required and not value.strip() or self.least is not None and size < self.least or self.most is not None and size > self.most:
            raise ValueError(f"{name} is out of range")
        return value


LIMIT, PROJECT = Argument(int, 10, least=0, most=1000), Argument(str)


class Store:
    """Memories and observations in the columns of :data:`weftline.operators.search.SOURCE`, with ``title`` as a shown column."""

    def __init__(self, memories: DataFrame, observations: DataFrame, reserved: tuple[str, ...] = (), embed: Callable[[str], list[float] | None] | None = None, forced: str | None = None) -> None:
        self.memories, self.observations, self.reserved, self.embed, self.forced = memories, observations, reserved, embed, forced

    def _scope(self, project: str | None) -> str | None:
        return browse.scope_policy(project, list(self.reserved), self.forced)

    def _search(self, query: str, mode: str, limit: int, project: str | None, type: str | None, include_reserved: bool) -> Search:
        vector = self.embed(query) if self.embed is not None and mode != "keyword" else None
        own = self._scope(project)
        reserved = () if own == self.forced and own is not None else self.reserved
        return Search(query, mode, tuple(vector) if vector else None, limit, own, type, include_reserved, reserved)

    def search(self, **a) -> DataFrame:
        s = self._search(**a)
        page = search.search_indexes(self.memories, self.observations, s)
        every = self.memories.select("id", "title").unionByName(self.observations.select("id", "title"))
        return search.with_rows(page, every, ["title"])

    def search_memories(self, **a) -> DataFrame:
        return search.search_memories(self.memories, self._search(**a))

    def search_observations(self, **a) -> DataFrame:
        return search.search_observations(self.observations, self._search(**a))

    def list(self, limit: int, offset: int, project: str | None, type: str | None) -> DataFrame:
        d = browse.scoped(self.memories, "project", self._scope(project), list(self.reserved))
        d = d if type is None else d.where(F.col("type") == type)
        return browse.page(d.select("id", "project", "type", "time", "title"), [F.desc_nulls_last("time"), F.asc("id")], limit, offset)

    def get(self, ids: list[str]) -> DataFrame:
        want = self.observations.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
        return self.observations.join(F.broadcast(want), "id").orderBy("pos")  # at most fifty ids

    def timeline(self, id: str, before: int, after: int) -> DataFrame:
        return browse.timeline(self.observations, "session", F.col("time"), "id", id, before, after)

    def stats(self, project: str | None) -> DataFrame:
        d = browse.scoped(self.memories.unionByName(self.observations), "project", self._scope(project), list(self.reserved))
        return d.agg(F.count("*").alias("rows"), F.count_if(F.col("cls") == "rollup").alias("rollups"), F.count_if(F.col("cls") == "decision").alias("decisions"), F.min("time").alias("first"), F.max("time").alias("last"))

    def projects(self) -> DataFrame:
        d = self.memories.select("project").union(self.observations.select("project")).distinct()
        return browse.scoped(d, "project", self._scope(None), list(self.reserved)).orderBy("project")


_SEARCH = {"query": Argument(str, required=True), "mode": Argument(str, "hybrid", choices=search.MODES), "limit": LIMIT, "project": PROJECT, "type": Argument(str), "include_reserved": Argument(bool, False)}
#: The tools and their arguments.
TOOLS: dict[str, dict[str, Argument]] = {
    "search": _SEARCH,
    "search_memories": _SEARCH,
    "search_observations": _SEARCH,
    "list": {"limit": LIMIT, "offset": Argument(int, 0, least=0), "project": PROJECT, "type": Argument(str)},
    "get": {"ids": Argument(list, required=True, least=1, most=50)},
    "timeline": {"id": Argument(str, required=True), "before": Argument(int, 5, least=0, most=50), "after": Argument(int, 5, least=0, most=50)},
    "stats": {"project": PROJECT},
    "projects": {},
}


def call(store: Store, tool: str, arguments: str | dict | None = None) -> DataFrame:
    """The answer of a tool to arguments given as JSON or as a dictionary."""
    if tool not in TOOLS:
        raise ValueError(f"no tool {tool}")
    given = json.loads(arguments) if isinstance(arguments, str) else arguments or {}
    if not isinstance(given, dict):
        raise ValueError("arguments are an object")
    known = TOOLS[tool]
    if set(given) - set(known):
        raise ValueError(f"unknown arguments: {', '.join(sorted(set(given) - set(known)))}")
    return getattr(store, tool)(**{name: a.check(name, given.get(name)) for name, a in known.items()})
