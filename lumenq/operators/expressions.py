"""Typed expressions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenq.plans.binder import Typed

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compile_(e: Typed) -> Column:
    a = [compile_(x) for x in e.args]
    if e.op == "literal":
        return F.lit(e.value).cast(e.type.spark()) if e.type.name != "NULL" else F.lit(None)
    if e.op == "column":
        return column(e.value)
    if e.op == "cast":
        return a[0].cast(e.type.spark())
    if e.op == "neg":
        return -a[0]
    if e.op in ("not",):
        return ~a[0]
    if e.op in ("+", "-", "*", "/", "%"):
        return _arithmetic(e, *a)
    if e.op == "AND":
        # What may raise runs only where the left side lets it.
        return F.when(a[0].eqNullSafe(F.lit(False)), False).otherwise(a[0] & a[1]) if e.args[1].can_raise else a[0] & a[1]
    if e.op == "OR":
        return F.when(a[0].eqNullSafe(F.lit(True)), True).otherwise(a[0] | a[1]) if e.args[1].can_raise else a[0] | a[1]
    if e.op in _COMPARE:
        return _comparison(e, *a)
    if e.op == "in":
        return _signed(_is_in(e, a), e)
    if e.op == "between":
        return _signed(a[0] & a[1], e)
    if e.op == "like":
        return _signed(_like(e.args[1], *a), e)
    if e.op == "vector":
        missing = F.lit(False)
        for x in a:
            missing = missing | x.isNull()
        # A vector of plain literals needs no test for nulls.
        return F.array(*a) if all(x.op in ("literal", "cast") and x.constant and "NULL" not in (x.type.name, *(y.type.name for y in x.args)) for x in e.args) else F.when(~missing, F.array(*a))
    return e.value.column(a)


def _signed(x: Column, e: Typed) -> Column:
    return ~x if e.negated else x


def _arithmetic(e: Typed, a: Column, b: Column) -> Column:
    if e.op == "/" and not e.type.floating:
        out = F.call_function("div", a, b)
    else:
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[e.op]()
    return out.cast(e.type.spark())


def _plain(e: Typed) -> bool:
    """Whether an expression is a literal, which is never NaN."""
    return e.op == "literal" or e.op in ("cast", "neg") and _plain(e.args[0])


_MIRRORED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _comparison(e: Typed, a: Column, b: Column) -> Column:
    """A NaN equals nothing and comes before nothing; for Spark it equals itself and comes last.

    Against a literal both agree but for > and >=, and the comparison can be pushed to the scan.
    """
    if not e.args[0].type.floating:
        return _COMPARE[e.op](a, b)
    if _plain(e.args[0]) or _plain(e.args[1]):
        op, x, c = (e.op, a, b) if _plain(e.args[1]) else (_MIRRORED[e.op], b, a)
        return _COMPARE[op](x, c) & ~F.isnan(x) if op in (">", ">=") else _COMPARE[op](x, c)
    return F.when(a.isNotNull() & b.isNotNull() & (F.isnan(a) | F.isnan(b)), e.op == "<>").otherwise(_COMPARE[e.op](a, b))


def _is_in(e: Typed, a: list[Column]) -> Column:
    if not e.args[0].type.floating or all(_plain(x) for x in e.args[1:]):
        return a[0].isin(*a[1:])
    return F.when(F.isnan(a[0]), F.lit(False)).otherwise(a[0].isin(*a[1:]))


def _like(pattern: Typed, a: Column, b: Column) -> Column:
    if pattern.op == "literal" and ("_" in pattern.value):
        # `_` is one byte: compare bytes as Latin-1 characters.
        body = pattern.value.encode("utf-8").decode("latin-1")
        rule = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in body)
        return F.decode(F.encode(a, "UTF-8"), "ISO-8859-1").rlike(f"(?s)^{rule}\\z")
    return F.like(a, b, F.lit("￿"))
