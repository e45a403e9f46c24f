"""The dialect over streams: a statement's filter and projection on a streaming DataFrame.

An extension; only what needs no order over the whole input is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenq.errors import BinderError
from lumenq.functions.registry import builtin
from lumenq.operators.query import select
from lumenq.plans import ast
from lumenq.plans.binder import Binder, Field, bind_select
from lumenq.plans.parser import parse
from lumenq.types import from_spark_type


def follow(stream: DataFrame, name: str, sql: str) -> DataFrame:
    """The rows that ``sql`` (a SELECT from ``name``) returns of a stream, as they come."""
    s = parse(sql)
    if not isinstance(s, ast.Select) or s.order or s.limit is not None or s.offset is not None or s.table.lower() != name.lower():
        raise BinderError("UnsupportedStatement", "a stream takes SELECT ... FROM it [WHERE ...] only")
    fields = [Field(f.name, kind, f.nullable) for f in stream.schema.fields if (kind := from_spark_type(f.dataType))]
    return select(stream, bind_select(s, Binder(fields, name, builtin())))
