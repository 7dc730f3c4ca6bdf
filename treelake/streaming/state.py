"""Keyed state over streams: page mutations, cached pages, trace logs, windows, append-only measurements.

Each state is bounded: one snapshot's digests a session, one hash a cached page, so many events and
bytes a trace. Batch twins of the same results are in operators.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treelake.functions.urls import cache_url
from treelake.operators.snapshots import elements_of
from treelake.sources.payload import read_tree

MUTATIONS = "session_id string, som_cursor bigint, mode string, added int, removed int, changed int"


def _digests(tree: str | None) -> dict[str, str] | None:
    read = read_tree(tree)
    if read is None:
        return None
    return {i: hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for i, form in elements_of(read)}


def _observe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cursor, held = state.get if state.exists else (None, "{}")
    old, out = json.loads(held), []
    rows = pd.concat(list(frames)).sort_values(["som_cursor", "received_at"], kind="stable")
    for at, tree in zip(rows["som_cursor"], rows["current_som"]):
        new = _digests(tree)
        if new is None or pd.isna(at):
            continue
        at = int(at)
        if cursor is None:
            out.append((key[0], at, "snapshot", len(new), 0, 0))
        elif at <= cursor:
            out.append((key[0], at, "unchanged", 0, 0, 0))
            continue
        else:
            both = old.keys() & new.keys()
            out.append((key[0], at, "mutations", len(new) - len(both), len(old) - len(both), sum(old[i] != new[i] for i in both)))
        cursor, old = at, new
    if cursor is not None:
        state.update((cursor, json.dumps(old)))
    yield pd.DataFrame(out, columns=["session_id", "som_cursor", "mode", "added", "removed", "changed"])


def observe_mutations(snapshots: DataFrame) -> DataFrame:
    """What each snapshot (session_id, som_cursor, received_at, current_som) of a stream changed in its session.

    The first is a snapshot; a cursor not above the last seen is unchanged; any other is compared
    with the last state by element id. Unreadable trees and null cursors are passed over.
    """
    rows = snapshots.filter("session_id is not null").select("session_id", "som_cursor", "received_at", "current_som")
    return rows.groupBy("session_id").applyInPandasWithState(_observe, MUTATIONS, "som_cursor bigint, digests string", "append", GroupStateTimeout.NoTimeout)


OUTCOMES = "cache_key string, fetch_id bigint, outcome string"


def cache_stream(fetches: DataFrame, max_age_seconds: int = 300, idle_ms: int = 3_600_000) -> DataFrame:
    """Cache result of each fetch (fetch_id, url, fetched_at, content_hash): hit, stale, expired or miss.

    A page not fetched for ``idle_ms`` of processing time is dropped from the state.
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, at = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values(["fetched_at", "fetch_id"], kind="stable").itertuples():
            now = int(r.fetched_at.timestamp() * 1_000_000)
            outcome = "miss" if at is None else "expired" if now - at > max_age_seconds * 1_000_000 else "hit" if r.content_hash == held else "stale"
            out.append((key[0], r.fetch_id, outcome))
            held, at = r.content_hash, now
        state.update((held, at))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["cache_key", "fetch_id", "outcome"])

    rows = fetches.select(cache_url(F.col("url")).alias("cache_key"), "fetch_id", "fetched_at", "content_hash").filter("cache_key is not null and fetched_at is not null")
    return rows.groupBy("cache_key").applyInPandasWithState(check, OUTCOMES, "content_hash string, fetched_us bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def trace_stream(events: DataFrame, most_events: int = 128, most_bytes: int = 48 * 1024, most_event_bytes: int = 4 * 1024) -> DataFrame:
    """Numbered events (session_id, at, action, payload) of each session, and what its bounded log holds.

    Numbers go on when old events are dropped. Events over the size limit get an empty payload.
    """

    def log(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, "[]")
        kept, out = json.loads(held), []
        for r in pd.concat(list(frames)).sort_values(["at", "action"], kind="stable").itertuples():
            number += 1
            payload = r.payload or ""
            size = len(payload.encode("utf-8", "surrogatepass"))
            payload, size = ("", 0) if size > most_event_bytes else (payload, size)
            kept.append([number, r.action, size])
            while len(kept) > most_events or sum(k[2] for k in kept) > most_bytes:
                kept.pop(0)
            out.append((key[0], number, r.action, payload, kept[0][0] if kept else number, len(kept)))
        state.update((number, json.dumps(kept)))
        yield pd.DataFrame(out, columns=["session_id", "sequence", "action", "payload", "first_retained", "retained"])

    rows = events.filter("session_id is not null").select("session_id", "at", "action", "payload")
    return rows.groupBy("session_id").applyInPandasWithState(log, "session_id string, sequence bigint, action string, payload string, first_retained bigint, retained int", "sequence bigint, events string", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per window and type; rows later than ``late`` are left out. An extension over event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "event_type", "events")


def measurements(deliveries: DataFrame) -> DataFrame:
    """Delivery rows as they are recorded: the url by its digest only, never less than nothing left out."""
    left = F.greatest(F.col("source_html_bytes") - F.col("delivered_bytes"), F.lit(0))
    return deliveries.select(F.lit("v1").alias("schema_version"), "recorded_at", "operation", "representation", F.sha2("url", 256).alias("url_sha256"), "selector", "source_html_bytes", "delivered_bytes", F.when(F.col("delivered_bytes").isNotNull(), left).alias("bytes_not_delivered"))


def append_json(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only JSON lines sink, exactly once by the checkpoint."""
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
