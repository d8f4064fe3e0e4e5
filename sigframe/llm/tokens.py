"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank file of a byte-level BPE of 50,256 tokens; every executor reads it from this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    """The tokenizer whose ranks are in ``path``; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``df`` but ``text``, with the number of tokens of ``text`` as ``out`` (bigint).

    Whole texts are tokenized, one Arrow batch at a time, without a shuffle. A null text has
    a null size, an empty one 0. Rows keep their number and repeated rows count each; a
    column that is already named ``out`` is replaced.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [None if t is None else len(encode(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], names=[*keep, out])

    return df.select(F.col(text).cast("string").alias(text), *keep).mapInArrow(run, schema)
