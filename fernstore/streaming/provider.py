"""A generic provider interface to document stores, and its implementation over a database."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from fernstore.functions import paths
from fernstore.operators.aggregates import Aggregate
from fernstore.plans.query import Query
from fernstore.sources.database import Database, Transaction
from fernstore.streaming.feed import on_collection, on_snapshot

Filters = list[tuple[str, str, Any]]


class Provider(Protocol):
    """What a store of documents offers: single documents, queries, batches, transactions, listeners, indexes, aggregates."""

    def get(self, store: str, item: str) -> dict[str, Any] | None: ...

    def set(self, store: str, item: str, data: dict[str, Any]) -> None: ...

    def update(self, store: str, item: str, patch: dict[str, Any]) -> None: ...

    def remove(self, store: str, item: str) -> None: ...

    def query(self, store: str, filters: Filters, order: tuple[str, str] | None, limit: int, offset: int) -> list[dict[str, Any]]: ...

    def batch(self, steps: list[tuple[str, str, str, dict[str, Any] | None]]) -> int: ...

    def run_transaction(self, fn: Callable[[Any], Any]) -> Any: ...

    def subscribe(self, path: str, callback: Callable[[Any], None], checkpoint: str) -> Callable[[], None]: ...

    def collections(self) -> list[str]: ...

    def aggregate(self, store: str, op: str, field: str, filters: Filters) -> Any: ...

    def search(self, store: str, field: str, text: str, limit: int) -> list[dict[str, Any]]: ...

    def health(self) -> dict[str, Any]: ...


class DatabaseProvider:
    """The interface over a ``Database``. Lists that a caller asks for are collected; ``limit`` 0 is all."""

    def __init__(self, db: Database):
        self.db = db

    def get(self, store: str, item: str) -> dict[str, Any] | None:
        return self.db.store(store).item(item).one()

    def set(self, store: str, item: str, data: dict[str, Any]) -> None:
        self.db.store(store).item(item).set(data)

    def update(self, store: str, item: str, patch: dict[str, Any]) -> None:
        self.db.store(store).item(item).modify(patch)

    def remove(self, store: str, item: str) -> None:
        self.db.store(store).item(item).remove()

    def _where(self, store: str, filters: Filters) -> Query:
        q = self.db.store(store).query()
        for f in filters:
            q = q.where(*f)
        return q

    def query(self, store: str, filters: Filters = (), order: tuple[str, str] | None = None, limit: int = 0, offset: int = 0) -> list[dict[str, Any]]:
        q = self._where(store, filters)
        return (q.sort_by(*order) if order else q).offset(offset).take(limit)

    def batch(self, steps: list[tuple[str, str, str, dict[str, Any] | None]]) -> int:
        """Steps (make, modify or remove; store; item; data), all or none."""
        out = self.db.batch()
        for op, store, item, data in steps:
            out = out.remove(store, item) if op == "remove" else getattr(out, op)(store, item, data)
        return out.commit()

    def run_transaction(self, fn: Callable[[Transaction], Any]) -> Any:
        return self.db.run(fn)

    def subscribe(self, path: str, callback: Callable[[Any], None], checkpoint: str, every: str = "1 second") -> Callable[[], None]:
        """Listens to a document or a store until what it returns is called."""
        listen = on_collection if paths.segments(path) % 2 else on_snapshot
        return listen(self.db, path, callback, checkpoint, {"processingTime": every})

    def collections(self) -> list[str]:
        return sorted(self.db.folders())

    def create_index(self, store: str, name: str, fields: list[str], **options: bool) -> str:
        return self.db.create_index(store, name, fields, **options)

    def indexes(self, store: str) -> list[dict]:
        return self.db.list_indexes(store)

    def aggregate(self, store: str, op: str, field: str, filters: Filters = ()) -> Any:
        found = self._where(store, filters).aggregate(out=Aggregate(op, field)).take()
        return found[0]["out"] if found else None

    def search(self, store: str, field: str, text: str, limit: int = 0) -> list[dict[str, Any]]:
        return self._where(store, [(field, "search", text)]).take(limit)

    def stats(self) -> dict[str, Any]:
        return self.db.engine_stats()

    def health(self) -> dict[str, Any]:
        """Whether the catalogue can be read, and its last commit."""
        try:
            return {"status": "ok", "last_txn": self.db.catalog.last()}
        except Exception as e:
            return {"status": "failed", "error": str(e).splitlines()[0]}
