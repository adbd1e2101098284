"""Errors of the engine; ``code`` names the kind, as callers test for it."""


class StoreError(Exception):
    code = "UNKNOWN"

    def __init__(self, message: str, details: object = None):
        super().__init__(message)
        self.details = details


class DuplicateKey(StoreError):
    code = "DUPLICATE_KEY"


class KeyNotFound(StoreError):
    code = "KEY_NOT_FOUND"


class SchemaViolation(StoreError):
    code = "SCHEMA_VIOLATION"


class NotSupported(StoreError):
    code = "NOT_IMPLEMENTED"


class InvalidPath(StoreError):
    code = "INVALID_PATH"


class IndexRequired(StoreError):
    code = "INDEX_REQUIRED"


class Conflict(StoreError):
    code = "WRITE_CONFLICT"


class IngestError(StoreError):
    code = "INGEST_FAILED"
