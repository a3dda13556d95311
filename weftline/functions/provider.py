"""Providers of vectors and extractions: any function from a batch of texts to results can stand in; the stubs here need no
network and always give the same.

A provider that fails for a text gives null; after ``most_failures`` in a row a batch gives up and leaves the rest null, to
be filled by a later run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str], list[float] | None]


def stub_vector(dimension: int = 64) -> Provider:
    """A unit vector from the hashes of a text's words: texts that share words are near each other."""

    def vector(text: str) -> list[float] | None:
        v = np.zeros(dimension)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % dimension] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        return [float(x) for x in v / n] if n else None

    return vector


def backfill(df: DataFrame, key: str, text: str, vector: str, provider: Provider, most_failures: int = 20) -> DataFrame:
    """(key, vector, filled): rows without a vector get one from the provider; those that have one stay and never leave the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, failed = [], 0
            for t in pdf["_t"]:
                v = None
                if failed < most_failures and isinstance(t, str) and t.strip():
                    try:
                        v = provider(t)
                    except Exception:  # noqa: BLE001 - a provider's failure is a null
                        v = None
                    failed = 0 if v is not None else failed + 1
                out.append(v)
            yield pd.DataFrame({key: pdf[key], vector: out, "filled": [v is not None for v in out]})

    t = dict(df.dtypes)
    have = df.where(F.col(vector).isNotNull()).select(key, vector, F.lit(False).alias("filled"))
    todo = df.where(F.col(vector).isNull()).select(key, F.col(text).alias("_t"))
    return have.unionByName(todo.mapInPandas(run, f"{key} {t[key]}, {vector} {t[vector]}, filled boolean"))


def stub_extraction(text: str) -> str:
    """An extraction of a transcript without a model: its first line as summary, its lines with a colon as decisions."""
    import json

    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return json.dumps({"summary": lines[0][:180] if lines else "", "keywords": [], "decisions": [x for x in lines if ":" in x][:5], "next_steps": [], "observations": []}, ensure_ascii=False)


def extract(df: DataFrame, key: str, text: str, providers: list[Callable[[str], str]]) -> DataFrame:
    """(key, extraction, provider): what the first provider that does not fail makes of a text; null where all fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["_t"]):
                got = (None, None)
                for n, p in enumerate(providers):
                    try:
                        got = (p(t), n)
                        break
                    except Exception:  # noqa: BLE001 - the next provider is asked
                        continue
                rows.append((k, *got))
            yield pd.DataFrame(rows, columns=[key, "extraction", "provider"]).astype({"provider": "Int32"})

    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).alias("_t")).mapInPandas(run, f"{key} long, extraction string, provider int")
