"""Streaming forms: receipts, leases, retries, superseding and upload counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_receipts(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each request within the watermark; replays are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def receipt_conflicts(rows: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Requests that came with different fingerprints."""
    return rows.groupBy(*keys).agg(F.countDistinct(fingerprint).alias("n")).filter("n > 1")


def upload_counts(stream: DataFrame, at: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *keys, "n")


def backoff(attempts: Column) -> Column:
    """Seconds until the next attempt: 4 to the power of the attempts, a minute at most; null after three."""
    return F.when(attempts < 3, F.least(F.pow(F.lit(4.0), attempts), F.lit(60.0)))


LEASE_OUT = "key_id long, owner string, token long, event string"
LEASE_STATE = "owner string, token long, until_s double, attempts int"


def leases(events: DataFrame, seconds: float = 60.0, most: int = 3) -> DataFrame:
    """Claims with fencing tokens per key.

    events: key_id, owner, action (claim or settle), token, at_s (event seconds). A claim is
    granted if no lease is in force and fewer than ``most`` attempts were made; settling needs
    the current token. Rows of a batch are handled in the order of at_s.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, token, until, attempts = state.get if state.exists else ("", 0, -1.0, 0)
        out = []
        for e in pd.concat(list(batches)).sort_values(["at_s", "owner"]).itertuples():
            if e.action == "claim":
                if e.at_s < until:
                    out.append((key[0], e.owner, int(token), "busy"))
                elif attempts >= most:
                    out.append((key[0], e.owner, int(token), "failed"))
                else:
                    owner, token, until, attempts = e.owner, token + 1, e.at_s + seconds, attempts + 1
                    out.append((key[0], e.owner, int(token), "granted"))
            elif e.token == token and e.at_s < until:
                until = -1.0
                out.append((key[0], e.owner, int(token), "settled"))
            else:
                out.append((key[0], e.owner, int(e.token), "fenced"))
        state.update((owner, int(token), float(until), int(attempts)))
        yield pd.DataFrame(out, columns=["key_id", "owner", "token", "event"])

    return events.groupBy("key_id").applyInPandasWithState(run, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.NoTimeout)


def superseded(tasks: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Tasks in flight whose key has a newer version now."""
    now = current.groupBy(key).agg(F.max(version).alias("_now"))
    return tasks.join(now, key).filter(F.col(version) < F.col("_now")).drop("_now")


def due(tasks: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """Queued tasks that weren't dispatched for a while, and those whose lease has run out; now is given."""
    t = F.expr(f"timestamp'{now}'")
    waiting = (F.col("state") == "queued") & (F.coalesce("dispatched_at", "created_at") <= t - F.expr(f"interval {seconds} seconds"))
    return tasks.filter(waiting | ((F.col("state") == "processing") & (F.col("lease_until") < t)))
