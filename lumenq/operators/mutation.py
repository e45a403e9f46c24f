"""INSERT, UPDATE and DELETE: new files and rows for a collection's next snapshot.

UPDATE and DELETE rewrite only the files that hold a matching row; all others stay in
the snapshot as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.errors import BinderError, ExecutionError
from lumenq.operators.expressions import column, compile_
from lumenq.plans import ast
from lumenq.plans.binder import Binder, Field, Typed, cast
from lumenq.sources.catalog import INLINE_ROWS, RID, Catalog, spark_schema


def _assign(f: Field, e: Typed) -> Typed:
    if e.op == "literal" and e.type.name == "NULL" and not f.nullable:
        raise BinderError("NotNullable", f.name)
    return cast(e, f.type)


def _violations(f: Field, c: Column, keyed: bool = False) -> list[tuple[str, Column]]:
    """What a stored value may not be, with the error's code."""
    out = []
    if not f.nullable:
        out.append(("NotNullable", c.isNull()))
    if f.type.name == "VARCHAR":
        out.append(("ValueTooLong", F.octet_length(c) > f.type.size))
    if f.type.name == "VECTOR":
        out.append(("DimensionMismatch", F.size(c) != f.type.size))
        out.append(("NullElement", F.exists(c, lambda x: x.isNull())))
    if keyed and f.type.floating:
        out.append(("InvalidKey", F.isnan(c)))
    return out


def _check(df: DataFrame, fields: list[Field], at: dict[str, Column], keyed: list[str] = ()) -> None:
    """Raise for values that a column can't hold; ``keyed`` columns are keys of an index."""
    tests = [(code, f.name, bad) for f in fields for code, bad in _violations(f, at[f.name], f.name in keyed)]
    if not tests:
        return
    found = df.agg(*[F.max(F.coalesce(bad, F.lit(False))).alias(f"t{k}") for k, (_, _, bad) in enumerate(tests)]).first()
    for k, (code, name, _) in enumerate(tests):
        if found[k]:
            raise ExecutionError(code, name)


def unique_columns(c: dict, fields: list[Field]) -> list[str]:
    """Columns held unique by themselves or by an index."""
    named = {i["column"].lower() for i in c["indexes"] if i["unique"]}
    return [f.name for f in fields if f.unique or f.name.lower() in named]


def keyed_columns(c: dict, fields: list[Field]) -> list[str]:
    """Columns that are unique or have an index."""
    named = {i["column"].lower() for i in c["indexes"]}
    return [f.name for f in fields if f.unique or f.name.lower() in named]


def insert(catalog: Catalog, c: dict, s: ast.Insert, binder: Binder) -> int:
    fields = catalog.fields(c)
    by_name = {f.name.lower(): f for f in fields}
    names = s.columns or [f.name for f in fields]
    if len({n.lower() for n in names}) < len(names):
        raise BinderError("DuplicateColumn", ", ".join(names))
    for n in names:
        if n.lower() not in by_name:
            raise BinderError("ColumnNotFound", n)
    if len(s.values) != len(names):
        raise BinderError("InvalidValueCount", f"{len(s.values)} values for {len(names)} columns")
    given = {}
    for n, node in zip(names, s.values, strict=True):
        e = Binder([], "", binder.functions, binder.strict).bind(node) if not _has_column(node) else None
        if e is None:
            raise BinderError("UnsupportedExpression", "VALUES holds no columns")
        given[n.lower()] = compile_(_assign(by_name[n.lower()], e))
    for f in fields:
        if f.name.lower() not in given:
            if not f.has_default and not f.nullable:
                raise BinderError("NotNullable", f.name)
            value = F.lit(f.default) if not isinstance(f.default, list) else F.array(*map(F.lit, f.default))
            given[f.name.lower()] = value.cast(f.type.spark())
    one = catalog.spark.range(1).select(*[given[f.name.lower()].alias(f.name) for f in fields])
    row = one.first()
    _check(catalog.spark.createDataFrame([tuple(row)], one.schema), fields, {f.name: column(f.name) for f in fields}, keyed_columns(c, fields))
    unique = [(n, row[n]) for n in unique_columns(c, fields) if row[n] is not None]
    if unique:
        same = reduce(lambda a, b: a | b, [column(n) == F.lit(v) for n, v in unique])
        if not catalog.read(c).filter(same).isEmpty():
            raise ExecutionError("UniqueViolation", ", ".join(n for n, _ in unique))
    c["inline"].append([c["next_rid"], *row])
    c["next_rid"] += 1
    if len(c["inline"]) > INLINE_ROWS:
        c["files"] += catalog.write(catalog.spark.createDataFrame([tuple(r) for r in c["inline"]], spark_schema(fields)).coalesce(1))
        c["inline"] = []
    return 1


def _has_column(n: ast.Node) -> bool:
    return n.kind == "column" or any(_has_column(a) for a in n.args)


def _touched(catalog: Catalog, c: dict, hit: Column) -> tuple[list[str], DataFrame]:
    """The files with a matching row, and the rows of those files and of the inline ones."""
    schema = spark_schema(catalog.fields(c))
    files, parts = [], []
    if c["files"]:
        stored = catalog.spark.read.schema(schema).parquet(*c["files"])
        # File names hold the id of the job that wrote them, so they are unique without their folders.
        found = {r.f for r in stored.filter(hit).select(F.col("_metadata.file_name").alias("f")).distinct().toLocalIterator()}
        files = [f for f in c["files"] if f.rsplit("/", 1)[1] in found]
    if files:
        parts.append(catalog.spark.read.schema(schema).parquet(*files))
    if c["inline"] or not parts:
        parts.append(catalog.spark.createDataFrame([tuple(r) for r in c["inline"]], schema))
    return files, reduce(DataFrame.unionByName, parts)


def _swap(catalog: Catalog, c: dict, files: list[str], rows: DataFrame) -> None:
    new = catalog.write(rows)
    c["files"] = [f for f in c["files"] if f not in files] + new
    c["inline"] = []


def delete(catalog: Catalog, c: dict, where: Typed | None) -> int:
    hit = F.coalesce(compile_(where), F.lit(False)) if where is not None else F.lit(True)
    n = catalog.read(c).filter(hit).count()
    if n:
        files, rows = _touched(catalog, c, hit)
        _swap(catalog, c, files, rows.filter(~hit))
    return n


def update(catalog: Catalog, c: dict, sets: list[tuple[Field, Typed]], where: Typed | None) -> int:
    fields = catalog.fields(c)
    hit = F.coalesce(compile_(where), F.lit(False)) if where is not None else F.lit(True)
    fresh = {f.name: compile_(_assign(f, e)) for f, e in sets}
    matched = catalog.read(c).filter(hit)
    n = matched.count()
    if not n:
        return 0
    targets = [f for f, _ in sets]
    # Every new value is computed from the old row.
    files, rows = _touched(catalog, c, hit)
    new = rows.select(RID, *[(F.when(hit, fresh[f.name]).otherwise(column(f.name)) if f.name in fresh else column(f.name)).alias(f.name) for f in fields])
    staged = matched.select(RID, *[column(f.name).alias(f"old{k}") for k, f in enumerate(targets)], *[fresh[f.name].alias(f"new{k}") for k, f in enumerate(targets)])
    _check(staged, targets, {f.name: F.col(f"new{k}") for k, f in enumerate(targets)}, keyed_columns(c, fields))
    for k, f in enumerate(targets):
        if f.name in unique_columns(c, fields):
            _check_unique(catalog.read(c), staged.select(RID, F.col(f"old{k}").alias("old"), F.col(f"new{k}").alias("new")), f.name)
    _swap(catalog, c, files, new)
    return n


def _check_unique(everything: DataFrame, changed: DataFrame, name: str) -> None:
    """Rows change in the order of their ids, so a key is free only once its holder has moved on."""
    moved = changed.filter(F.col("new").isNotNull())
    if not moved.groupBy("new").count().filter("count > 1").isEmpty():
        raise ExecutionError("UniqueViolation", name)
    held = everything.select(F.col(RID).alias("other"), column(name).alias("held")).join(changed.select(F.col(RID).alias("other"), F.lit(1).alias("moves")), "other", "left")
    clash = moved.join(held, F.col("new") == F.col("held")).filter((F.col(RID) != F.col("other")) & (F.col("moves").isNull() | (F.col("other") > F.col(RID))))
    if not clash.isEmpty():
        raise ExecutionError("UniqueViolation", name)
