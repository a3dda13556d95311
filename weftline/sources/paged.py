"""Sources that are read page by page, as a Python data source: the reader asks for a page by a cursor until there is none."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Rows of a page, and the most rows of one bounded read.
PAGE, CAP = 200, 1000

Fetch = Callable[[str | None, int], tuple[list[dict], str | None]]


def read_some(fetch: Fetch, cursor: str | None = None, page: int = PAGE, cap: int = CAP) -> tuple[list[dict], str | None]:
    """(rows, cursor): at most ``cap`` rows from a cursor on, and the cursor at which the next read goes on; None at the
    end. A cursor that comes again ends the reading."""
    rows: list[dict] = []
    seen = {cursor}
    while len(rows) < cap:
        got, cursor = fetch(cursor, min(page, cap - len(rows)))
        rows += got
        if not got or cursor is None or cursor in seen:
            return rows, None
        seen.add(cursor)
    return rows, cursor


def all_pages(fetch: Fetch, page: int = PAGE, cap: int = CAP) -> Iterator[dict]:
    """Rows of all pages, read ``cap`` at a time, each read going on where the one before it ended."""
    cursor, first = None, True
    while first or cursor is not None:
        rows, following = read_some(fetch, cursor, page, cap)
        yield from rows
        if following == cursor:
            return
        cursor, first = following, False


def delta(fetch: Callable[[str], tuple[list[dict], str]], token: str | None) -> tuple[list[dict], str, bool]:
    """(rows, next token, full): what has changed since a token, everything without one. The token is kept like an offset."""
    rows, following = fetch(token or "*")
    return rows, following, token is None


def paged_source(name: str, schema: str, fetch: Fetch) -> type[DataSource]:
    """A registrable source whose rows are the JSON objects of all pages, columns by name, values as strings."""
    names = [c.split()[0] for c in schema.split(",")]

    class Reader(DataSourceReader):
        def read(self, partition):
            for r in all_pages(fetch):
                yield tuple(r.get(c) if r.get(c) is None or isinstance(r.get(c), str) else json.dumps(r.get(c)) for c in names)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def read_paged(spark: SparkSession, name: str, schema: str, fetch: Fetch) -> DataFrame:
    spark.dataSource.register(paged_source(name, schema, fetch))
    return spark.read.format(name).load()
