"""Column declarations: physical type, logical kind, dictionary and scale as field metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import invalid

PHYSICAL = {"i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(), "fixed_binary": T.BinaryType()}
LOGICAL = ("plain", "timestamp_nanos_like", "scaled_integer", "dictionary_code", "enum_code", "opaque_key")


@dataclass(frozen=True)
class Column:
    name: str
    physical: str
    logical: str = "plain"
    nullable: bool = False
    dictionary_id: int | None = None
    scale: int | None = None
    width: int | None = None

    def __post_init__(self):
        if self.physical not in PHYSICAL or self.logical not in LOGICAL:
            raise invalid(f"column {self.name}: unknown type {self.physical} / {self.logical}")
        if self.physical == "fixed_binary" and not (self.width and self.width > 0):
            raise invalid(f"column {self.name}: fixed binary needs a positive width")
        if self.logical == "dictionary_code" and (self.dictionary_id is None or self.physical not in ("i32", "i64")):
            raise invalid(f"column {self.name}: dictionary codes are integers with a dictionary")

    @property
    def scalar(self) -> bool:
        return self.physical != "fixed_binary"

    def field(self, column_id: int) -> T.StructField:
        meta = {"column_id": column_id, "physical": self.physical, "logical_kind": self.logical}
        meta |= {k: v for k, v in (("dictionary_id", self.dictionary_id), ("scale", self.scale), ("width", self.width)) if v is not None}
        return T.StructField(self.name, PHYSICAL[self.physical], self.nullable, meta)


def schema_of(columns: list[Column]) -> T.StructType:
    if len({c.name for c in columns}) != len(columns):
        raise invalid("duplicate column name")
    return T.StructType([c.field(i) for i, c in enumerate(columns)])


def columns_of(schema: T.StructType) -> list[Column]:
    """Declarations of a schema; plain fields without metadata are inferred."""
    names = {v: k for k, v in PHYSICAL.items()}
    out = []
    for f in schema.fields:
        m = f.metadata or {}
        if f.dataType not in names:
            raise invalid(f"column {f.name}: type {f.dataType.simpleString()} is not supported")
        width = m.get("width") or (1 if isinstance(f.dataType, T.BinaryType) else None)
        out.append(Column(f.name, names[f.dataType], m.get("logical_kind", "plain"), f.nullable, m.get("dictionary_id"), m.get("scale"), width))
    return out
