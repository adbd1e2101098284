"""Change feeds of a database on Structured Streaming.

The stream's source is the folder of commit manifests, which appear by rename, so a reader never meets half a
commit; each micro-batch reads the data of its commits and derives the changes against the versions before. A
checkpoint folder remembers what has been delivered.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernstore.functions import paths
from fernstore.operators.versions import changes, newest
from fernstore.sources.changelog import ROW
from fernstore.sources.database import Database

PER_CALL = 10_000
MANIFEST = "txn long, stores array<string>, path string, replaces boolean"


def changes_between(db: Database, first: int, last: int, store: str | None = None) -> DataFrame:
    """The changes of the commits from ``first`` to ``last``: key, value, commit_txn_id, change."""
    log = db.changelog.log(store, last + 1)
    new = log.where(F.col("commit_txn_id") >= first)
    # the last version before, of the keys that changed
    old = newest(log.where(F.col("commit_txn_id") < first).join(new.select("key").distinct(), "key", "left_semi"))
    return changes(old.unionByName(new)).where(F.col("commit_txn_id") >= first).select("store_path", "key", "value", "commit_txn_id", "change")


class ChangeFeed:
    """A feed of one store's changes, or of all stores'."""

    def __init__(self, db: Database, store: str | None = None):
        self.db, self.store = db, store

    def start(self, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
        """Call ``handle(changes, batch number)`` for each micro-batch of commits; ``trigger`` as for writeStream."""
        db, store = self.db, self.store

        def batch(manifests: DataFrame, n: int) -> None:
            span = manifests.where("not coalesce(replaces, false)").agg(F.min("txn"), F.max("txn")).first()
            if span[0] is not None:
                handle(changes_between(db, span[0], span[1], store), n)

        stream = db.spark.readStream.schema(MANIFEST).json(db.files.at("_catalog/commits"))
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def as_stream(self) -> DataFrame:
        """All log rows as a streaming DataFrame, for windows and watermarks over ``ts``; new folders appear as they are committed."""
        stream = self.db.spark.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(self.db.files.at("_changelog"))
        return stream if self.store is None else stream.where(F.col("store_path") == F.lit(self.store))


def ingest_stream(db: Database, store: str, stream: DataFrame, id_column: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Write a streaming DataFrame into a store, one commit per micro-batch; of rows with equal ids in a batch one stays."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            db.write_frame(store, rows.dropDuplicates([id_column]), id_column)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def on_snapshot(db: Database, key: str, callback: Callable[[dict[str, Any] | None], None], checkpoint: str, trigger: dict[str, Any] | None = None) -> Callable[[], None]:
    """Call back with a document after each of its changes (None once it is removed); returns what ends the listening.

    With a trigger, such as {"processingTime": "1 second"}, it listens until it is ended; without one it delivers what there is.
    """
    key = paths.check_document(key)

    def handle(found: DataFrame, _: int) -> None:
        for r in found.where(F.col("key") == F.lit(key)).orderBy("commit_txn_id").collect():
            callback(None if r.change == "removed" else json.loads(r.value))

    query = ChangeFeed(db, paths.parent(key)).start(handle, checkpoint, trigger)
    if trigger is None:
        query.awaitTermination()
    return query.stop


def on_collection(db: Database, store: str, callback: Callable[[list[dict[str, Any]]], None], checkpoint: str, trigger: dict[str, Any] | None = None) -> Callable[[], None]:
    """The same for a whole store, with lists of at most ``PER_CALL`` {key, change, doc}, in order."""

    def handle(found: DataFrame, _: int) -> None:
        rows = found.orderBy("commit_txn_id", "key").toLocalIterator()  # a partition at a time
        while part := list(islice(rows, PER_CALL)):
            callback([{"key": r.key, "change": r.change, "doc": None if r.change == "removed" else json.loads(r.value)} for r in part])

    query = ChangeFeed(db, paths.check_store(store)).start(handle, checkpoint, trigger)
    if trigger is None:
        query.awaitTermination()
    return query.stop
