"""Scalar functions of documents and fields as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernstore.functions.schema import json_field

__all__ = ["as_array", "checksum", "decrypted", "derived_key", "encrypted", "incremented", "json_array_contains", "json_field", "merged", "sanitized", "to_boolean", "to_number", "to_timestamp"]


def merged(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects: the patch's fields win, an explicit null is stored."""
    kind = "map<string,variant>"
    left, right = F.from_json(base, kind), F.from_json(patch, kind)
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.to_json(F.map_concat(kept, right))


def json_array_contains(value: Column, name: str, wanted: object) -> Column:
    """Whether a JSON field is an array with ``wanted``; false for anything else."""
    kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(wanted), "string")
    items = F.try_variant_get(F.try_parse_json(value), f"$.{name}", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: F.try_variant_get(x, "$", kind) == F.lit(wanted)), F.lit(False))


def incremented(field: Column, by: int | float) -> Column:
    """``field + by``; whole numbers stay whole."""
    return field + F.lit(by)


def checksum(value: Column) -> Column:
    return F.crc32(value)


def derived_key(password: str, salt: bytes, rounds: int = 600_000, size: int = 32) -> bytes:
    """A key for ``encrypted`` from a password, by PBKDF2 with HMAC-SHA-256; 32 bytes make it AES-256."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, size)


def encrypted(value: Column, key: Column, aad: Column) -> Column:
    """AES-GCM, with the strength of the key's size and with additional authenticated data."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad)


def decrypted(value: Column, key: Column, aad: Column) -> Column:
    """The plain bytes; null where the key or the authenticated data don't fit."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def sanitized(value: Column, trim: bool = False, lower: bool = False, upper: bool = False, no_space: bool = False, custom: Callable[[Column], Column] | None = None) -> Column:
    """Sanitising steps in their fixed order: trim, lower, upper, removal of white space, custom."""
    if trim:
        value = F.regexp_replace(value, r"^\s+|\s+$", "")
    if lower:
        value = F.lower(value)
    if upper:
        value = F.upper(value)
    if no_space:
        value = F.regexp_replace(value, r"\s", "")
    return custom(value) if custom else value


def to_number(value: Column) -> Column:
    """A number or numeric text as a double; null for anything else, NaN and infinities."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


#: Texts that stand for true and false, after trimming and lower-casing.
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")


def to_boolean(value: Column) -> Column:
    """Booleans, the numbers 1 and 0 and the usual words as a boolean; null for anything else."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def to_timestamp(value: Column, millis: bool = False) -> Column:
    """ISO text or, with ``millis``, epoch milliseconds as a timestamp; null if it is neither."""
    return F.timestamp_millis(value.cast("long")) if millis else F.try_to_timestamp(value)


def as_array(value: Column) -> Column:
    """A scalar as an array of one, null as an empty array."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))
