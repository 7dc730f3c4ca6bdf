"""Digests and keys that built-ins don't have, Arrow batch by Arrow batch."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType


def fnv1a32(values) -> int:
    """FNV-1a over numbers, 32 bits."""
    h = 0x811C9DC5
    for v in values:
        h = ((h ^ v) * 0x01000193) & 0xFFFFFFFF
    return h


def action_key(parts: list[str | None], prefix: str = "action:v1:") -> str:
    """Key of an action target: the digest of its telling parts as compact JSON, nulls for empties."""
    text = json.dumps([p or None for p in parts], separators=(",", ":"))
    return f"{prefix}{fnv1a32(map(ord, text)):08x}"


@F.pandas_udf(StringType())
def action_keys(parts: pd.Series) -> pd.Series:
    """``action_key`` of arrays of parts."""
    return parts.map(lambda p: action_key(list(p)))


@F.pandas_udf(DecimalType(20, 0))
def xxh3(texts: pd.Series) -> pd.Series:
    """Content hash (xxh3, 64 bits, unsigned) of UTF-8 text."""
    from decimal import Decimal

    return texts.map(lambda t: Decimal(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))), na_action="ignore")


def framed_hmac(key: bytes, parts: list[bytes]) -> str:
    """HMAC-SHA256 over parts, each with its length before it, so that no two lists run together."""
    mac = hmac.new(key, digestmod=hashlib.sha256)
    for part in parts:
        mac.update(len(part).to_bytes(8, "big"))
        mac.update(part)
    return mac.hexdigest()


def corpus_digest(tag: str, urls: list[str]) -> str:
    """Digest of an ordered list of urls: a tag, then length and bytes of each."""
    digest = hashlib.sha256(tag.encode())
    for url in urls:
        raw = url.encode("utf-8", "surrogatepass")
        digest.update(len(raw).to_bytes(8, "big"))
        digest.update(raw)
    return digest.hexdigest()


def ordered_digests(rows: DataFrame, tag: str, key: str, order: list[str], value: str) -> DataFrame:
    """(key, digest, n): ``corpus_digest`` of each key's values in order.

    A key's rows come to one task sorted, as the digest asks for, and stream through it: none are
    held. Rows with a null key or value are left out.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=[key, "digest", "n"])

        own, state, n = None, None, 0
        for batch in batches:
            done = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != own:
                    if state is not None:
                        done.append((own, state.hexdigest(), n))
                    own, state, n = k, hashlib.sha256(tag.encode()), 0
                raw = v.encode("utf-8", "surrogatepass")
                state.update(len(raw).to_bytes(8, "big") + raw)
                n += 1
            yield batch_of(done)
        yield batch_of([(own, state.hexdigest(), n)] if state is not None else [])

    slim = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return slim.select(F.col(key).cast("string"), F.col(value).cast("string")).mapInArrow(digest, f"`{key}` string, digest string, n bigint")
