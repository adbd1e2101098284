"""The change log: one row per version of a document, in Parquet folders that commits name.

Rows: store_path, key, value (JSON), commit_txn_id, ts, deleted. A folder is sorted by store and key and has a Bloom
filter on the key, so that point and prefix reads skip files and row groups; the manifests say which stores a folder holds.

A folder of one store with a declared schema also holds the declared fields as typed columns beside the JSON (named ``f_`` and the
field), with Bloom filters on indexed ones. A folder that compaction wrote for one store has one live version per key
(``unique``): as long as it is the store's only folder, it is read without looking for newest versions, so that filters on
fields reach the scan; it is sorted by the store's first indexed field.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernstore.errors import IngestError
from fernstore.functions import paths
from fernstore.functions.schema import SPARK_TYPES, StoreSchema, typed
from fernstore.operators.versions import visible
from fernstore.sources.catalog import Catalog

ROW = "store_path string, key string, value string, commit_txn_id long, ts timestamp, deleted boolean"


def typed_columns(schema: StoreSchema) -> list[tuple[str, str]]:
    """The names and types of a schema's fields."""
    return [(c.name, SPARK_TYPES[c.type].simpleString()) for c in schema.columns]


class ChangeLog:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self.files = spark, catalog, catalog.files

    def _frame(self, folders: list[dict], ddl: str = ROW) -> DataFrame:
        """The rows of folders, without those of stores that were replaced later."""
        if not folders:
            return self.spark.createDataFrame([], ddl)
        out = None
        for gone in sorted({tuple(sorted(m["gone"])) for m in folders}):
            df = self.spark.read.schema(ddl).parquet(*(self.files.at(m["path"]) for m in folders if tuple(sorted(m["gone"])) == gone))
            df = df.where(~F.col("store_path").isin(*gone)) if gone else df
            out = df if out is None else out.unionByName(df)
        return out

    def log(self, store: str | None = None, as_of: int | None = None, ddl: str = ROW) -> DataFrame:
        """All versions that a reader may see, of one store or of all. Other stores' folders aren't opened."""
        df = self._frame(self.catalog.visible(as_of, store), ddl)
        if as_of is not None:
            df = df.where(F.col("commit_txn_id") < F.lit(as_of))
        return df if store is None else df.where(F.col("store_path") == F.lit(store))

    def documents(self, store: str | None = None, as_of: int | None = None, schema: StoreSchema | None = None) -> DataFrame:
        """The visible documents: key, value, and with a schema its fields, from typed columns where all folders have them."""
        folders = self.catalog.visible(as_of, store)
        stored = schema is not None and bool(folders) and all(m.get("typed") == schema.version for m in folders)
        fields = typed_columns(schema) if stored else []
        ddl = ROW + "".join(f", `f_{n}` {t}" for n, t in fields)
        if store is not None and len(folders) == 1 and folders[0].get("unique"):
            df = self._frame(folders, ddl).where(F.col("store_path") == F.lit(store))
        else:
            df = visible(self.log(store, as_of, ddl))
        df = df.select("key", "value", *(F.col(f"`f_{n}`").alias(n) for n, _ in fields))
        return df if schema is None or stored else typed(df, schema)

    def document(self, key: str, as_of: int | None = None) -> str | None:
        """The value of one key, by a scan that file statistics and Bloom filters narrow; collects one row."""
        rows = visible(self.log(paths.parent(key), as_of).where(F.col("key") == F.lit(key))).select("value").take(1)
        return rows[0].value if rows else None

    def values(self, keys: list[str], as_of: int | None = None) -> dict[str, str]:
        """The values of the given keys that exist; collects as many rows at most."""
        if not keys:
            return {}
        stores = {paths.parent(k) for k in keys}
        log = self.log(stores.pop() if len(stores) == 1 else None, as_of)
        wanted = self.spark.createDataFrame([(k,) for k in set(keys)], "key string")
        # the keys of one driver-side batch; the optimiser broadcasts them by their size, or doesn't
        return {r.key: r.value for r in visible(log.join(wanted, "key", "left_semi")).select("key", "value").collect()}

    def changed_since(self, keys: list[str], txn: int) -> str | None:
        """One of the keys that a commit from ``txn`` on has written, if any."""
        wanted = self.spark.createDataFrame([(k,) for k in set(keys)], "key string")
        late = self._frame([m for m in self.catalog.visible() if m["txn"] >= txn]).where(F.col("commit_txn_id") >= txn)
        found = late.join(wanted, "key", "left_semi").select("key").take(1)
        return found[0].key if found else None

    def append(self, rows: DataFrame, txn: int, stores: list[str], **more) -> None:
        """Write rows (store_path, key, value, deleted) as the transaction ``txn``. The caller holds the writer's lock."""
        path = f"_changelog/{txn:020d}-{uuid.uuid4().hex[:8]}"
        rows = rows.select("store_path", "key", "value", F.lit(txn).cast("long").alias("commit_txn_id"), F.current_timestamp().alias("ts"), "deleted")
        self.catalog.commit(txn, stores, path, **self._write(rows, path, stores), **more)

    def _write(self, rows: DataFrame, path: str, stores: list[str] | None, by: list[str] | None = None) -> dict:
        """Write a folder; returns what its manifest says of typed columns."""
        options = {"parquet.bloom.filter.enabled#key": "true", "compression": "zstd"}
        schema = self.catalog.schemas.latest(stores[0]) if stores is not None and len(stores) == 1 else None
        if schema is not None:
            names = {c.name for c in schema.columns}
            rows = typed(rows.select([c for c in rows.columns if not c.startswith("f_")]).withColumnRenamed("key", "_key").withColumnRenamed("value", "_value"), schema, "_value")
            rows = rows.select("store_path", F.col("_key").alias("key"), F.col("_value").alias("value"), "commit_txn_id", "ts", "deleted", *(F.col(f"`{c.name}`").alias(f"f_{c.name}") for c in schema.columns))
            options |= {f"parquet.bloom.filter.enabled#f_{f}": "true" for i in self.catalog.list_indexes(stores[0]) for f in i["fields"] if f in names}
        by = by or ["store_path", "key"]
        rows.sortWithinPartitions(*by).write.options(**options).parquet(self.files.at(path))
        return {} if schema is None else {"typed": schema.version}

    def replace(self, rows: DataFrame, txn: int, store: str | None = None, unique: bool = False) -> None:
        """Write whole log rows that stand for everything committed before ``txn``, of one store or of all."""
        path = f"_changelog/{txn:020d}-{uuid.uuid4().hex[:8]}"
        rows = rows.select(*(f.split()[0] for f in ROW.split(", ")))
        if store is not None:
            schema = self.catalog.schemas.latest(store)
            declared = {c.name for c in schema.columns} if schema else set()
            first = next((i["fields"][0] for i in self.catalog.list_indexes(store) if i["fields"][0] in declared and not i.get("multikey")), None)
            by = [f"f_{first}", "key"] if first else ["store_path", "key"]
            spread = rows.repartitionByRange("key") if first is None else rows
            if first is not None:
                ordered = typed(rows.withColumnRenamed("key", "_key").withColumnRenamed("value", "_value"), schema, "_value").repartitionByRange(F.col(f"`{first}`"), F.col("_key"))
                spread = ordered.select("store_path", F.col("_key").alias("key"), F.col("_value").alias("value"), "commit_txn_id", "ts", "deleted")
            self.catalog.commit(txn, [store], path, replaces=True, scope="stores", unique=unique, **self._write(spread, path, [store], by))
            return
        self._write(rows.repartitionByRange("store_path", "key"), path, None)
        # one name per store, which the manifest holds anyway
        stores = [r.store_path for r in self.spark.read.parquet(self.files.at(path)).select("store_path").distinct().toLocalIterator()]
        self.catalog.commit(txn, stores, path, replaces=True)

    def ingest(self, store: str, file: str, txn: int, move: bool = True, strict: bool = True) -> int:
        """Add a Parquet file or folder of (key, value[, deleted]) rows to a store as it is; returns its number of rows.

        Strict: keys must be direct children of the store, unique, and ascending within each file. Indexes and unique
        checks are passed over, as bulk loads do. ``move`` deletes the source after the commit.
        """
        from fernstore.sources.files import Files

        source = Files(self.spark, file)
        if not source.fs.exists(source._path(file)):
            raise IngestError(f"Failed to ingest file '{file}' into store '{store}': it does not exist")
        try:
            df = self.spark.read.parquet(file)
            if not {"key", "value"} <= set(df.columns):
                raise IngestError(f"Failed to ingest file '{file}' into store '{store}': it lacks the columns key and value")
        except IngestError:
            raise
        except Exception as e:
            raise IngestError(f"Failed to ingest file '{file}' into store '{store}': {str(e).splitlines()[0]}") from e
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in df.columns else F.lit(False)
        if strict:
            from pyspark.sql import Window

            by_file = Window.partitionBy("_file").orderBy("_row")
            placed = df.select("key", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            wrong = placed.withColumn("_last", F.lag("key").over(by_file)).where((F.col("_last") >= F.col("key")) | ~paths.is_child(F.col("key"), store) | F.col("key").isNull())
            if not wrong.isEmpty() or not df.groupBy("key").count().where("count > 1").isEmpty():
                raise IngestError(f"Failed to ingest file '{file}' into store '{store}': keys must be the store's, ascending and unique")
        rows = df.select(F.lit(store).alias("store_path"), "key", "value", deleted.alias("deleted"))
        n = rows.count()
        self.append(rows, txn, [store], ingested=file)
        if move:
            source.fs.delete(source._path(file), True)
        return n
