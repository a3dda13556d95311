"""Markdown tables as a source of small fixtures and a sink of reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def parse_table(text: str) -> list[dict[str, str]]:
    """Rows of the first table of a text; ``\\|`` is a bar within a cell. Rows of another width are refused."""
    rows = [re.split(r"(?<!\\)\|", x.strip()[1:-1]) for x in text.splitlines() if x.strip().startswith("|") and x.strip().endswith("|")]
    rows = [[c.strip().replace(r"\|", "|") for c in r] for r in rows]
    if len(rows) < 2 or not all(re.fullmatch(r":?-+:?", c) for c in rows[1]):
        return []
    head, body = rows[0], rows[2:]
    if any(len(r) != len(head) for r in body):
        raise ValueError("a row has another number of cells than the head")
    return [dict(zip(head, r)) for r in body]


def parse_results(text: str, columns: list[str]) -> list[dict[str, str]]:
    """Rows of a search report: all its tables with these columns under a line ``Found n results``. A report of another
    form has drifted and is refused: no count, a table with other columns, or another number of rows than announced."""
    told = re.search(r"(?im)^\W*found\s+(\d+)\s+results?\b", text)
    if told is None:
        raise ValueError("drift: no number of results")
    rows: list[dict[str, str]] = []
    for part in re.split(r"\n(?=[^|])", text):
        table = parse_table(part)
        if table and set(table[0]) != set(columns):
            raise ValueError(f"drift: columns {sorted(table[0])}")
        rows += table
    if len(rows) != int(told[1]):
        raise ValueError(f"drift: {told[1]} results announced, {len(rows)} found")
    return rows


def read_table(spark: SparkSession, text: str, columns: list[str]) -> DataFrame:
    rows = [tuple(r.get(c) for c in columns) for r in parse_table(text)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def to_markdown(df: DataFrame, most: int = 200) -> str:
    """A report as a table; refuses results that are no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
