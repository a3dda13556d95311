"""Order-dependent pieces of incremental capture: byte windows, greedy selection, byte-bounded clamping."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_ends(raw: bytes, start: int, end: int, max_bytes: int) -> list[tuple[int, int]]:
    """Windows of at most ``max_bytes`` over [start, end): each ends after its last newline, else before a character
    that would be divided. A character longer than the limit is a window of its own."""
    lo = min(max(start, 0), len(raw))
    hi = min(max(end, lo), len(raw))
    signs = np.frombuffer(raw[lo:hi], np.uint8)
    lines = np.flatnonzero(signs == 10) + 1
    whole = np.append(np.flatnonzero((signs & 0xC0) != 0x80), hi - lo)  # where a character begins, and the end
    ends = [0]
    while ends[-1] < hi - lo:
        room = ends[-1] + max_bytes
        last = lambda at: at[np.searchsorted(at, room, side="right") - 1] if len(at) and at[0] <= room else -1  # noqa: E731, B023
        best = next((int(z) for z in (hi - lo if room >= hi - lo else -1, last(lines), last(whole)) if z > ends[-1]), None)
        ends.append(int(whole[np.searchsorted(whole, ends[-1], side="right")]) if best is None else best)
    return [(lo + a, lo + z) for a, z in zip(ends, ends[1:])]


def byte_windows(df: DataFrame, key: str, text: str, max_bytes: int) -> DataFrame:
    """(key, window_no, start, end): the windows of each text, by bytes; none for null and empty texts."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, a, z) for k, t in zip(pdf[key], pdf[text]) if t for n, (a, z) in enumerate(window_ends(t.encode(), 0, len(t.encode()), max_bytes))]
            yield pd.DataFrame(rows, columns=[key, "window_no", "start", "end"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, window_no int, start long, end long")


def greedy_fit(df: DataFrame, group: str, key: str, first: str, time: str, size: str, capacity: int) -> DataFrame:
    """Selected rows per group: those with ``first`` set before the others, each newest first; a row that does not fit
    the rest of the capacity is skipped and the next one tried.

    Groups that fit as a whole keep all their rows and never leave the JVM. In the others the choice is sequential, but
    bounded: room never grows, so of the rows of one size those taken are the first ones, at most capacity / size; the
    rest is dropped before a group is gathered, and no group has more than some capacity x log(capacity) rows of a key,
    a flag and two numbers. Rows without a size above 0 always fit, rows larger than the capacity never. Null groups and
    sizes are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([first, time, key], ascending=[False, False, False], kind="stable")
        room, take = capacity, []
        for s in pdf[size]:
            take.append(s <= room)
            room -= s if take[-1] else 0
        return pdf[take][[group, key, size]]

    d = df.select(group, key, F.coalesce(first, F.lit(False)).alias(first), time, size).where((F.col(size) <= capacity) & F.col(group).isNotNull())
    t = dict(d.dtypes)
    full = d.groupBy(group).agg(F.sum(F.greatest(F.col(size), F.lit(0))).alias("_n")).where(F.col("_n") > capacity).select(group)
    free = F.col(size) <= 0
    whole = d.where(free).unionByName(d.where(~free).join(full, group, "left_anti")).select(group, key, size)
    w = Window.partitionBy(group, size).orderBy(F.desc(first), F.desc_nulls_last(time), F.desc(key))
    some = d.where(~free).join(full, group, "left_semi").withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= capacity) & (F.col("_k") * F.col(size) <= capacity)).drop("_k")
    return whole.unionByName(some.groupBy(group).applyInPandas(run, f"{group} {t[group]}, {key} {t[key]}, {size} {t[size]}"))


def _json_size(x) -> int:
    return len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())


def clamp_summary(summary: str, decisions: list[str], next_steps: list[str], max_bytes: int, max_items: int = 20, max_chars: int = 4000, pending: dict | None = None) -> dict:
    """A summary block of at most ``max_bytes`` of JSON, with ``pending`` (a block of the same form) if it fits.

    Entries are kept from the front: decisions before next steps, as many as the prefix sums of their JSON sizes leave room
    for. A text that does not fit even alone is halved as often as it must be. A pending block is taken whole or not at
    all, after the summary itself. ``truncated`` marks that something was left out.
    """
    s = summary[:max_chars]
    lists = {"decisions": decisions[:max_items], "next_steps": next_steps[:max_items]}
    frame = {"summary": "", "decisions": [], "next_steps": []}
    whole = len(s) == len(summary) and len(lists["decisions"]) == len(decisions) and len(lists["next_steps"]) == len(next_steps)
    full = {**frame, "summary": s, **lists, **({} if whole else {"truncated": True})}
    if _json_size(full) <= max_bytes:
        out = full
    else:
        room = max_bytes - _json_size({**frame, "truncated": True})
        size = np.array([_json_size(s[: max(1, len(s) >> k)]) - 2 for k in range(len(s).bit_length() + 1)])
        halved = int(np.argmax(size <= room)) if (size <= room).any() else len(size) - 1
        out = {**frame, "summary": s[: max(1, len(s) >> halved)] if s else s}
        room -= int(size[halved])
        for name, items in lists.items():
            taken = np.cumsum([_json_size(x) + (k > 0) for k, x in enumerate(items)]) if items else np.zeros(0, int)
            n = int(np.searchsorted(taken, room, side="right"))
            out[name] = items[:n]
            room -= int(taken[n - 1]) if n else 0
            if n < len(items):
                break
        out["truncated"] = True
    if pending is not None:
        with_it = {**out, "pending": pending}
        out = with_it if _json_size(with_it) <= max_bytes else {**out, "truncated": True}
    return out


#: Bytes of the block of a prior summary.
PRIOR_BYTES = 16 * 1024


def clamp_prior(df: DataFrame, key: str, summary: str, decisions: str, next_steps: str, max_bytes: int = PRIOR_BYTES) -> DataFrame:
    """(key, block): the clamped block of each row as JSON, '' for a null summary."""

    def run(batches):
        for pdf in batches:
            texts = [json.dumps(clamp_summary(s, list(d if d is not None else []), list(n if n is not None else []), max_bytes), ensure_ascii=False, separators=(",", ":")) if s is not None else "" for s, d, n in zip(pdf.s, pdf.d, pdf.n)]
            yield pd.DataFrame({key: pdf[key], "block": texts})

    part = df.select(F.col(key).cast("long").alias(key), F.col(summary).alias("s"), F.col(decisions).alias("d"), F.col(next_steps).alias("n"))
    return part.mapInPandas(run, f"{key} long, block string")
