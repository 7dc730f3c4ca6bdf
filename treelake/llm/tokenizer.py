"""Token counts by a public tokenizer whose file lies outside the repository."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file and word pattern; parameters of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the vocabulary's published word pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once a worker."""
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", to: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its text but with its count of tokens; whole texts are counted, null counts 0."""
    others = [c for c in df.columns if c != text]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*others, to])

    return df.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(count, ", ".join([*(f"`{c}` {fields[c]}" for c in others), f"`{to}` bigint"]))
