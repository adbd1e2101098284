"""Paths: a store has an odd number of segments, a document an even number, ``store/id/store/id``.

Each rule exists for Python strings (checks at the API) and as a Column (over tables).
"""

from __future__ import annotations

import secrets
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernstore.errors import InvalidPath

_ALPHABET = string.ascii_letters + string.digits


def random_id() -> str:
    """20 random letters and digits."""
    return "".join(secrets.choice(_ALPHABET) for _ in range(20))


def segments(path: str | None) -> int:
    return sum(1 for s in (path or "").split("/") if s)


def document_key(store: str, item: str) -> str:
    """``store/item`` without a doubled slash between them."""
    if not store:
        raise InvalidPath("Store path cannot be empty.")
    if not item:
        raise InvalidPath("Item ID cannot be empty.")
    return f"{store.removesuffix('/')}/{item.removeprefix('/')}"


def check_store(path: str) -> str:
    if segments(path) % 2 == 0:
        raise InvalidPath(f'Invalid path for a store: "{path}". Store paths must have an odd number of segments. Found {segments(path)} segments.')
    return path.strip("/")


def check_document(key: str) -> str:
    if not key or segments(key) % 2:
        raise InvalidPath(f'Invalid path for a document: "{key}". Document paths must have an even number of segments. Found {segments(key)} segments.')
    return key.strip("/")


def parent(key: str) -> str:
    """The store of a document: all before the last slash."""
    return key.rpartition("/")[0]


def root(key: str) -> str:
    """The top-level store: all before the first slash, ``_root`` if there is none."""
    head, slash, _ = key.partition("/")
    return head if slash else "_root"


def n_segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def parent_of(key: Column) -> Column:
    return F.regexp_replace(key, "/[^/]*$", "")


def root_of(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("/")), F.substring_index(key, "/", 1)).otherwise(F.lit("_root"))


def id_of(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def is_child(key: Column, prefix: str) -> Column:
    """Keys with exactly one segment more than ``prefix``, below it. The prefix test reaches the Parquet scan."""
    prefix = prefix if prefix.endswith("/") else prefix + "/"
    return F.startswith(key, F.lit(prefix)) & (n_segments(key) == segments(prefix) + 1)
