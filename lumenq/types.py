"""Logical types, their Spark counterparts and the rules between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RANK = {"INTEGER": 0, "BIGINT": 1, "FLOAT": 2, "DOUBLE": 3}


@dataclass(frozen=True)
class Type:
    name: str
    size: int | None = None  # bytes of VARCHAR, elements of VECTOR

    @property
    def numeric(self) -> bool:
        return self.name in RANK

    @property
    def floating(self) -> bool:
        return self.name in ("FLOAT", "DOUBLE")

    def spark(self) -> T.DataType:
        return _SPARK[self.name]

    def __str__(self) -> str:
        return f"{self.name}({self.size})" if self.size is not None else self.name


_SPARK = {
    "NULL": T.NullType(),
    "BOOLEAN": T.BooleanType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "VECTOR": T.ArrayType(T.DoubleType()),
}
NULL, BOOLEAN, INTEGER, BIGINT, FLOAT, DOUBLE = (Type(n) for n in ("NULL", "BOOLEAN", "INTEGER", "BIGINT", "FLOAT", "DOUBLE"))
VARCHAR = Type("VARCHAR")


def from_spark_type(kind: T.DataType, size: int | None = None) -> Type | None:
    """The logical type of a Parquet column, or None where the dialect has none."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return Type("VECTOR", size)
    if isinstance(kind, (T.ShortType, T.ByteType)):
        return INTEGER
    return next((Type(n) for n, s in _SPARK.items() if type(s) is type(kind) and n not in ("NULL", "VECTOR")), None)


def cast_cost(a: Type, b: Type) -> int | None:
    """What an implicit cast costs; None where there is none."""
    if a == b:
        return 0
    if a.name == "NULL":
        return 1
    if a.name == b.name == "VECTOR":
        return 1 if None in (a.size, b.size) else None
    if a.name == b.name == "VARCHAR":
        return 1
    if a.numeric and b.numeric and RANK[a.name] < RANK[b.name]:
        return 10 + RANK[b.name] - RANK[a.name]
    return None


def common_numeric(a: Type, b: Type) -> Type | None:
    return (a if RANK[a.name] >= RANK[b.name] else b) if a.numeric and b.numeric else None


def comparable(a: Type, b: Type, ordered: bool) -> bool:
    if a.numeric and b.numeric or a.name == b.name == "VARCHAR":
        return True
    return not ordered and (a == b or a.name == b.name == "VECTOR" and None in (a.size, b.size))
