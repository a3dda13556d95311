"""Token counts by a public tokenizer, one Arrow batch at a time."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary is a parameter; it is shipped to the executors with the job and never copied into the repository.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns and n_tokens (long): tokens of the whole text; 0 for null and empty texts. Texts go to
    Python, the columns kept pass through it unchanged."""

    # shipped with the job, so that executors need no copy of it
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches):
        shipped = SparkFiles.get(name)
        enc = encoding(shipped if os.path.exists(shipped) else vocabulary)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = np.fromiter((len(enc.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=[*b.schema.names[:-1], "n_tokens"])

    part = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    return part.mapInArrow(count, f"{schema}, n_tokens long")
