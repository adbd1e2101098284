"""Versions: what a reader sees of a change log, compaction, expiry and change feeds.

A change log has one row per version: key, commit_txn_id, deleted and the payload. The newest version per key is
found by maxima (partial aggregation before the shuffle, no sort of histories), not by a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, as_of: int | None = None, key: str = "key", version: str = "commit_txn_id") -> DataFrame:
    """The newest version of each key with ``version < as_of`` (any, if None), tombstones included."""
    if as_of is not None:
        log = log.where(F.col(version) < F.lit(as_of))
    rest = [c for c in log.columns if c not in (key, version)]
    # a maximum per column, so that columns which nobody asks for are neither read nor sent
    return log.groupBy(key).agg(F.max(version).alias(version), *(F.max_by(c, version).alias(c) for c in rest)).select(*log.columns)


def visible(log: DataFrame, as_of: int | None = None, key: str = "key", version: str = "commit_txn_id", deleted: str = "deleted") -> DataFrame:
    """What a reader sees: newest versions that aren't tombstones. A tombstone hides everything before it."""
    return newest(log, as_of, key, version).where(~F.col(deleted))


def overlaid(snapshot: DataFrame, staged: DataFrame, key: str = "key", deleted: str = "deleted") -> DataFrame:
    """A snapshot under a transaction's own writes: staged keys win, staged tombstones hide."""
    own = staged.where(~F.col(deleted)).select(*snapshot.columns)
    return snapshot.join(staged.select(key), key, "left_anti").select(*snapshot.columns).unionByName(own)


def compacted(log: DataFrame, oldest_reader: int | None = None, rule: Callable[[DataFrame], DataFrame] | None = None, key: str = "key", version: str = "commit_txn_id", deleted: str = "deleted") -> DataFrame:
    """The newest version of each key; of tombstones only those that a reader older than them may still need.

    With ``oldest_reader`` also the newest version that this reader sees is kept. ``rule`` keeps, changes or drops
    live rows.
    """
    if oldest_reader is None:
        out = visible(log, None, key, version, deleted)
        return rule(out) if rule else out
    last = newest(log, None, key, version)
    kept = last.unionByName(newest(log, oldest_reader, key, version)).distinct()
    kept = kept.where(~F.col(deleted) | (F.col(version) >= F.lit(oldest_reader)))
    if rule is None:
        return kept
    return rule(kept.where(~F.col(deleted))).unionByName(kept.where(F.col(deleted)))


def unexpired(log: DataFrame, now: Column, ttl: Column, ts: str = "ts") -> DataFrame:
    """Rows no older than ``ttl`` (an interval) at ``now``; the bound on ``ts`` prunes whole files by their statistics."""
    return log.where(F.col(ts) >= now - ttl)


def changes(log: DataFrame, key: str = "key", version: str = "commit_txn_id", deleted: str = "deleted") -> DataFrame:
    """The log with ``change``: added, modified or removed, by the version before; tombstones of absent keys are left out."""
    before = F.lag(~F.col(deleted)).over(Window.partitionBy(key).orderBy(version))
    there = F.coalesce(before, F.lit(False))
    kind = F.when(F.col(deleted) & there, "removed").when(~F.col(deleted) & there, "modified").when(~F.col(deleted), "added")
    return log.withColumn("change", kind).where(F.col("change").isNotNull())
