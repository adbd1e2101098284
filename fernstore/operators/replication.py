"""Replication between a local and a remote copy of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read(local: DataFrame, remote: DataFrame, strategy: str, key: str) -> DataFrame:
    """The documents that a read strategy gives; both sides have the same columns and unique keys.

    LocalFirst and CloudFirst take what only the other side has; LocalOnly and CloudOnly ignore it.
    """
    if strategy in ("LocalOnly", "CloudOnly"):
        return local if strategy == "LocalOnly" else remote
    if strategy not in ("LocalFirst", "CloudFirst"):
        raise TypeError(f"unknown read strategy {strategy!r}")
    first, then = (local, remote) if strategy == "LocalFirst" else (remote, local)
    return first.unionByName(then.join(first.select(key), key, "left_anti").select(*first.columns))


def take(local: DataFrame, strategy: str) -> DataFrame:
    """Collections are read locally; CloudOnly can't list them."""
    if strategy == "CloudOnly":
        raise NotImplementedError("collections can't be listed with the strategy CloudOnly")
    return local


def resolved(local: DataFrame, remote: DataFrame, key: str, policy: str | Callable[[Column, Column], Column], version: str = "version") -> DataFrame:
    """One row per key of both sides: the newer (LastWriteWins, the remote one on a tie), the remote one (CloudWins),
    or what a function of both rows' structs gives."""
    names = [c for c in local.columns if c != key]
    left = local.select(F.col(key).alias("_k"), F.struct(*names).alias("_l"))
    right = remote.select(F.col(key).alias("_r_k"), F.struct(*names).alias("_r"))
    both = left.join(right, F.col("_k") == F.col("_r_k"), "full_outer")
    one = F.coalesce(F.col("_l"), F.col("_r"))
    if callable(policy):
        pick = policy(F.col("_l"), F.col("_r"))
    elif policy == "CloudWins":
        pick = F.col("_r")
    elif policy == "LastWriteWins":
        pick = F.when(F.col(f"_l.{version}") > F.col(f"_r.{version}"), F.col("_l")).otherwise(F.col("_r"))
    else:
        raise TypeError(f"unknown conflict policy {policy!r}")
    out = both.select(F.coalesce("_k", "_r_k").alias(key), F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), pick).otherwise(one).alias("_d"))
    return out.select(key, *(F.col(f"_d.`{c}`").alias(c) for c in names)).select(*local.columns)
