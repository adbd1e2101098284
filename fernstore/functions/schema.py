"""Column types, declared store schemas and validation on write.

``StoreSchema`` is versioned; columns have ids, so that a column can be renamed between versions. Documents are
JSON text; ``typed`` projects the declared top-level fields to typed columns with one ``from_json``, and
``violation`` gives the first rule that a document breaks (null if none), in the order of the columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type -> Spark type. FLOAT is computed as a double; TIMESTAMP is whole microseconds; JSON is text.
SPARK_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "INT32": T.IntegerType(),
    "INT64": T.LongType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "BINARY": T.BinaryType(),
    "JSON": T.StringType(),
    "ARRAY_STRING": T.ArrayType(T.StringType()),
    "ARRAY_INT64": T.ArrayType(T.LongType()),
}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    column_id: int
    type: str
    nullable: bool = True
    max_length: int | None = None  # kept for callers; no rule enforces it

    def __post_init__(self):
        if self.type not in SPARK_TYPES:
            raise ValueError(f"unknown column type {self.type!r}; one of {', '.join(SPARK_TYPES)}")


@dataclass(frozen=True)
class StoreSchema:
    store_path: str
    columns: tuple[ColumnDef, ...]
    version: int = 1

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.type], True, {"column_id": c.column_id}) for c in self.columns])

    def to_dict(self) -> dict:
        return {"store_path": self.store_path, "version": self.version, "columns": [vars(c) for c in self.columns]}

    @staticmethod
    def from_dict(d: dict) -> StoreSchema:
        return StoreSchema(d["store_path"], tuple(ColumnDef(**c) for c in d["columns"]), d["version"])


@dataclass
class SchemaRegistry:
    """All versions of all stores' schemas; the latest is the highest version."""

    versions: dict[str, dict[int, StoreSchema]] = field(default_factory=dict)

    def register(self, schema: StoreSchema) -> bool:
        """Add a version; one that exists stays as it is."""
        self.versions.setdefault(schema.store_path, {}).setdefault(schema.version, schema)
        return True

    def latest(self, store_path: str) -> StoreSchema | None:
        found = self.versions.get(store_path)
        return found[max(found)] if found else None


def json_field(value: Column, name: str, type_: str) -> Column:
    """A top-level field of JSON text as a Spark type; null if missing, null or of another type."""
    return F.try_variant_get(F.try_parse_json(value), f"$['{name}']" if not name.isidentifier() else f"$.{name}", type_)


def typed(df: DataFrame, schema: StoreSchema, value: str = "value") -> DataFrame:
    """The declared fields of the JSON documents as typed columns, beside the columns of ``df``."""
    raw = T.StructType([T.StructField(c.name, T.LongType() if c.type == "TIMESTAMP" else SPARK_TYPES[c.type]) for c in schema.columns])
    parsed = df.withColumn("_doc", F.from_json(value, raw))
    pick = [(F.timestamp_micros(F.col(f"_doc.`{c.name}`")) if c.type == "TIMESTAMP" else F.col(f"_doc.`{c.name}`")).alias(c.name) for c in schema.columns]
    return parsed.select(*df.columns, *pick)


#: Variant type names that a column type takes. Whole numbers are BIGINT in variants, fractions DECIMAL or DOUBLE.
_KINDS = {
    "STRING": "^STRING$",
    "JSON": "^STRING$",
    "INT32": "^BIGINT$",
    "INT64": "^BIGINT$",
    "TIMESTAMP": "^BIGINT$",
    "FLOAT": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "DOUBLE": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "BOOLEAN": "^BOOLEAN$",
    "BINARY": "^BINARY$",
    "ARRAY_STRING": r"^ARRAY<(STRING|VOID)>$",
    "ARRAY_INT64": r"^ARRAY<(BIGINT|VOID)>$",
}


def violation(value: Column, schema: StoreSchema) -> Column:
    """The first rule that a JSON document breaks, as text; null if it keeps to the schema. Other fields are free."""
    doc = F.try_parse_json(value)
    out = [F.when(doc.isNull(), F.lit("document is not valid JSON"))]
    for c in schema.columns:
        got = F.try_variant_get(doc, f"$.{c.name}" if c.name.isidentifier() else f"$['{c.name}']", "variant")
        kind = F.schema_of_variant(got)
        missing = got.isNull() | (kind == "VOID")
        if not c.nullable:
            out.append(F.when(missing, F.lit(f"{c.name}: required")))
        out.append(F.when(~missing & ~F.rlike(kind, F.lit(_KINDS[c.type])), F.concat(F.lit(f"{c.name}: expected {c.type}, got "), kind)))
        if c.type == "INT32":
            number = F.try_variant_get(got, "$", "bigint")
            out.append(F.when(~missing & ~number.between(-(2**31), 2**31 - 1), F.lit(f"{c.name}: out of range of INT32")))
    return F.coalesce(*out)

