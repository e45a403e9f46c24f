"""Sessions: one statement in, one result out."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import BinderError, EngineError, ExecutionError, from_spark
from lumenq.functions.registry import Function, Registry, builtin
from lumenq.operators import mutation, query
from lumenq.plans import ast
from lumenq.plans.binder import Binder, Field, Typed, bind_select, cast
from lumenq.plans.parser import parse
from lumenq.sources.catalog import RID, Catalog, field_to_json
from lumenq.types import NULL, Type, from_spark_type

VINDEX_OPTIONS = {"metric": "l2", "max_neighbors": 16, "ef_construction": 200, "ef_search": 64, "random_seed": 0}
_METRICS = {"l2": "L2", "inner_product": "INNER_PRODUCT", "cosine": "COSINE"}


@dataclass
class Result:
    """kind: Command, RowSet or UseDatabase.  A RowSet's rows are computed when asked for."""

    kind: str
    affected_rows: int = 0
    df: DataFrame | None = None
    database: str | None = None
    columns: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """All rows, on the driver; use ``df`` to go on with them on the cluster."""
        try:
            return [tuple(r) for r in self.df.collect()] if self.df is not None else []
        except (PySparkException, Py4JJavaError) as e:
            raise from_spark(e) from e


class Session:
    """Executes statements over the catalog under ``root``; ``strict`` keeps the dialect's literal rules."""

    _lock = threading.RLock()

    def __init__(self, spark: SparkSession, root: str, strict: bool = True, functions: Registry | None = None):
        if spark.conf.get("spark.sql.ansi.enabled") != "true":
            raise ExecutionError("Unsupported", "checked arithmetic needs spark.sql.ansi.enabled")
        self.spark, self.strict = spark, strict
        self.catalog, self.functions = Catalog(spark, root), functions or builtin()
        self.database: str | None = None
        self.tables: dict[str, tuple[DataFrame, list[Field], list[str]]] = {}

    # -- sources besides collections

    def register(self, name: str, df: DataFrame, key: list[str] = (), skip_unsupported: bool = False) -> Session:
        """Make a DataFrame selectable under ``name``; ``key`` columns give its input order.

        Arrays of floats become vectors.  Columns of types that the dialect lacks are an
        error, or left out with ``skip_unsupported``.
        """
        fields, cols = [], []
        for f in df.schema.fields:
            kind = from_spark_type(f.dataType, (f.metadata or {}).get("dimension"))
            if kind is not None and f.name != RID:
                fields.append(Field(f.name, kind, f.nullable))
                c = F.col(f"`{f.name}`")
                cols.append(c.cast("array<double>").alias(f.name) if kind.name == "VECTOR" and f.dataType != T.ArrayType(T.DoubleType()) else c)
            elif not skip_unsupported:
                raise BinderError("UnsupportedType", f"{f.name} {f.dataType.simpleString()}")
        self.tables[name.lower()] = (df.select(*cols), fields, list(key))
        return self

    def register_parquet(self, name: str, path: str, key: list[str] = (), skip_unsupported: bool = False) -> Session:
        return self.register(name, self.spark.read.parquet(path), key, skip_unsupported)

    def register_function(self, f: Function) -> Session:
        self.functions.register(f)
        return self

    def load(self, name: str, df: DataFrame) -> int:
        """Append a DataFrame's rows to a collection in one statement, checked as INSERT checks them."""
        with self._lock:
            state = self.catalog.begin()
            c = self.catalog.collection(state, self.database, name)
            fields = self.catalog.fields(c)
            for k, f in enumerate(fields):
                if f.name not in df.columns:
                    df = df.withColumn(f.name, F.lit(None) if not f.has_default else F.lit(f.default) if not isinstance(f.default, list) else F.array(*map(F.lit, f.default)))
            rows = df.select(*[F.col(f"`{f.name}`").cast(f.type.spark()).alias(f.name) for f in fields])
            mutation._check(rows, fields, {f.name: F.col(f"`{f.name}`") for f in fields}, mutation.keyed_columns(c, fields))
            for n in mutation.unique_columns(c, fields):
                both = rows.select(n).unionByName(self.catalog.read(c).select(n)).filter(F.col(n).isNotNull())
                if not both.groupBy(n).count().filter("count > 1").isEmpty():
                    raise ExecutionError("UniqueViolation", n)
            # Row ids: consecutive by partition, from counts of each partition.
            staged = self.spark.read.schema(rows.schema).parquet(*self._staged(rows))
            numbered = staged.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
            starts, n = [], 0
            for r in numbered.groupBy("_p").count().orderBy("_p").collect():
                starts.append((r["_p"], n))
                n += r["count"]
            table = F.broadcast(self.spark.createDataFrame(starts, "_p int, _start long"))
            out = numbered.join(table, "_p").select((F.col("_start") + F.col("_k") + c["next_rid"]).alias(RID), *[f.name for f in fields])
            c["files"] += self.catalog.write(out)
            c["next_rid"] += n
            self.catalog.commit(state)
            return n

    def _staged(self, rows: DataFrame) -> list[str]:
        import uuid

        path = f"{self.catalog.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return [path]

    # -- statements

    def execute(self, sql: str) -> Result:
        """Parse, bind and run one statement; ParserError, BinderError or ExecutionError."""
        statement = parse(sql)
        with self._lock:
            try:
                self.catalog.refresh()
                return getattr(self, f"_{type(statement).__name__.lower()}")(statement)
            except EngineError:
                raise
            except (PySparkException, Py4JJavaError) as e:
                raise from_spark(e) from e

    def sql(self, sql: str) -> DataFrame:
        """The DataFrame of a statement that returns rows."""
        out = self.execute(sql)
        if out.df is None:
            raise ExecutionError("NoRows", "the statement returns no rows")
        return out.df

    def explain(self, sql: str) -> str:
        """The access path that declared indexes would give a SELECT."""
        s = parse(sql)
        self.catalog.refresh()
        if not isinstance(s, ast.Select):
            raise BinderError("UnsupportedStatement", "explain takes a SELECT")
        _, fields, _, c = self._source(s.table)
        bound = bind_select(s, Binder(fields, s.table, self.functions, self.strict))
        return query.access_path(bound, c["indexes"] if c else [], c["vindexes"] if c else [])

    def _source(self, name: str):
        if self.database is not None:
            c = self.catalog.database(self.catalog.state, self.database)["collections"].get(name.lower())
            if c is not None:
                return self.catalog.read(c), self.catalog.fields(c), [RID], c
        if name.lower() in self.tables:
            return *self.tables[name.lower()], None
        return self.catalog.read(c := self.catalog.collection(self.catalog.state, self.database, name)), self.catalog.fields(c), [RID], c

    def _select(self, s: ast.Select) -> Result:
        df, fields, order, _ = self._source(s.table)
        out = query.select(df, bind_select(s, Binder(fields, s.table, self.functions, self.strict)), order)
        return Result("RowSet", df=out, columns=out.columns)

    def _write(self, s, run) -> Result:
        state = self.catalog.begin()
        c = self.catalog.collection(state, self.database, s.table)
        n = run(c, Binder(self.catalog.fields(c), s.table, self.functions, self.strict))
        if n:
            self.catalog.commit(state)
        return Result("Command", n)

    def _insert(self, s: ast.Insert) -> Result:
        return self._write(s, lambda c, b: mutation.insert(self.catalog, c, s, b))

    def _delete(self, s: ast.Delete) -> Result:
        return self._write(s, lambda c, b: mutation.delete(self.catalog, c, b.predicate(s.where)))

    def _update(self, s: ast.Update) -> Result:
        def run(c: dict, b: Binder) -> int:
            names = [n.lower() for n, _ in s.sets]
            if len(set(names)) < len(names):
                raise BinderError("DuplicateColumn", ", ".join(names))
            sets = []
            for n, node in s.sets:
                if n.lower() not in b.fields:
                    raise BinderError("ColumnNotFound", n)
                f = b.fields[n.lower()]
                e = b.bind(node)
                mutation._assign(f, e)
                sets.append((f, e))
            return mutation.update(self.catalog, c, sets, b.predicate(s.where))

        return self._write(s, run)

    def _use(self, s: ast.Use) -> Result:
        self.database = self.catalog.database(self.catalog.state, s.database)["name"]
        return Result("UseDatabase", database=self.database)

    # -- definitions

    def _create(self, s: ast.Create) -> Result:
        state = self.catalog.begin()
        done = getattr(self, f"_create_{s.kind}")(state, s)
        if done:
            self.catalog.commit(state)
        return Result("Command", int(done))

    def _exists(self, s, found: bool, code: str) -> bool:
        if found and not s.if_not_exists:
            raise BinderError(code, s.name)
        return found

    def _create_database(self, state: dict, s: ast.Create) -> bool:
        if self._exists(s, s.name.lower() in state["databases"], "DatabaseExists"):
            return False
        state["databases"][s.name.lower()] = {"name": s.name, "collections": {}}
        return True

    def _create_collection(self, state: dict, s: ast.Create) -> bool:
        there = self.catalog.database(state, self.database)["collections"]
        if self._exists(s, s.name.lower() in there, "CollectionExists"):
            return False
        names = [d.name.lower() for d in s.columns]
        if len(set(names)) < len(names) or RID in names:
            raise BinderError("DuplicateColumn", ", ".join(names))
        fields = [self._field(d) for d in s.columns]
        there[s.name.lower()] = {"name": s.name, "comment": s.comment, "fields": [field_to_json(f) for f in fields], "files": [], "inline": [], "next_rid": 1, "indexes": [], "vindexes": []}
        for f in fields:
            if f.unique:
                self._add_index(state, there[s.name.lower()], f"__unique_{f.name.lower()}", f.name, True, implicit=True)
        return True

    def _field(self, d: ast.ColumnDef) -> Field:
        kind = Type(d.type, d.size)
        if d.size is not None and d.size <= 0:
            raise BinderError("InvalidType", f"{kind} needs a positive size")
        if d.unique and kind.name == "VECTOR":
            raise BinderError("InvalidType", "a vector can't be UNIQUE")
        value = None
        if d.default is not None:
            e = Binder([], "", self.functions, self.strict).bind(d.default)
            plain = e.op == "literal" or e.op == "vector" and all(self._literal(a) is not None for a in e.args)
            if not plain:
                raise BinderError("UnsupportedExpression", "DEFAULT takes a literal")
            if e.type == NULL and not d.nullable:
                raise BinderError("NotNullable", d.name)
            cast(e, kind)
            value = [self._literal(a) for a in e.args] if e.op == "vector" else e.value
        return Field(d.name, kind, d.nullable, d.unique, value, d.default is not None, d.comment)

    @staticmethod
    def _literal(e: Typed) -> float | None:
        inner = e.args[0] if e.op == "cast" else e
        return float(inner.value) if inner.op == "literal" and inner.value is not None else None

    def _add_index(self, state: dict, c: dict, name: str, column: str, unique: bool, implicit: bool = False) -> None:
        c["indexes"].append({"id": state["next_id"], "name": name, "column": column, "unique": unique, "implicit": implicit})
        state["next_id"] += 1

    def _target(self, state: dict, s: ast.Create) -> tuple[dict, Field, bool]:
        c = self.catalog.collection(state, self.database, s.table)
        f = next((f for f in self.catalog.fields(c) if f.name.lower() == s.column.lower()), None)
        if f is None:
            raise BinderError("ColumnNotFound", s.column)
        return c, f, any(i["name"].lower() == s.name.lower() for i in (*c["indexes"], *c["vindexes"]))

    def _create_index(self, state: dict, s: ast.Create) -> bool:
        c, f, found = self._target(state, s)
        if self._exists(s, found, "IndexExists"):
            return False
        if f.type.name == "VECTOR":
            raise BinderError("InvalidType", "a scalar index takes no vector")
        if f.type.floating and not self.catalog.read(c).filter(F.isnan(f"`{f.name}`")).isEmpty():
            raise ExecutionError("InvalidKey", f"NaN in {f.name}")
        if s.unique:
            kept = self.catalog.read(c).select(F.col(f"`{f.name}`").alias("k")).filter("k IS NOT NULL")
            if not kept.groupBy("k").count().filter("count > 1").isEmpty():
                raise ExecutionError("UniqueViolation", f.name)
        self._add_index(state, c, s.name, f.name, s.unique)
        return True

    def _create_vindex(self, state: dict, s: ast.Create) -> bool:
        c, f, found = self._target(state, s)
        if self._exists(s, found, "IndexExists"):
            return False
        if f.type.name != "VECTOR":
            raise BinderError("InvalidType", "a vector index takes a vector")
        o = VINDEX_OPTIONS | s.options
        if unknown := set(o) - set(VINDEX_OPTIONS):
            raise BinderError("InvalidOption", ", ".join(sorted(unknown)))
        if o["metric"] not in _METRICS or any(not isinstance(o[k], int) for k in VINDEX_OPTIONS if k != "metric"):
            raise BinderError("InvalidOption", str(s.options))
        if not 0 < o["max_neighbors"] <= o["ef_construction"] or o["ef_search"] <= 0:
            raise BinderError("InvalidOption", "0 < max_neighbors <= ef_construction and 0 < ef_search must hold")
        c["vindexes"].append(o | {"id": state["next_id"], "name": s.name, "column": f.name, "metric": _METRICS[o["metric"]], "dimension": f.type.size})
        state["next_id"] += 1
        return True

    def _drop(self, s: ast.Drop) -> Result:
        state = self.catalog.begin()
        if s.kind == "database":
            there, key, code = state["databases"], s.name.lower(), "DatabaseNotFound"
        elif s.kind == "collection":
            there, key, code = self.catalog.database(state, self.database)["collections"], s.name.lower(), "CollectionNotFound"
        else:
            c = self.catalog.collection(state, self.database, s.table)
            group = "indexes" if s.kind == "index" else "vindexes"
            found = next((i for i in c[group] if i["name"].lower() == s.name.lower()), None)
            if found is not None:
                if found.get("implicit"):
                    raise BinderError("ImplicitIndex", f"{s.name} goes with its column's UNIQUE")
                c[group].remove(found)
                self.catalog.commit(state)
                return Result("Command", 1)
            there, key, code = {}, s.name, "IndexNotFound"
        if key not in there:
            if not s.if_exists:
                raise BinderError(code, s.name)
            return Result("Command", 0)
        del there[key]
        self.catalog.commit(state)
        if s.kind == "database" and self.database and self.database.lower() == key:
            self.database = None
        return Result("Command", 1)

    # -- listings, in the order of creation

    def _listing(self, rows: list[tuple], schema: str) -> Result:
        df = self.spark.createDataFrame(rows, schema)
        return Result("RowSet", df=df, columns=df.columns)

    def _show(self, s: ast.Show) -> Result:
        state = self.catalog.state
        if s.kind == "databases":
            return self._listing([(d["name"],) for d in state["databases"].values()], "database_name string")
        if s.kind == "collections":
            d = self.catalog.database(state, s.name or self.database)
            return self._listing([(c["name"],) for c in d["collections"].values()], "collection_name string")
        c = self.catalog.collection(state, self.database, s.name)
        if s.kind == "indexes":
            return self._listing([(i["name"], i["column"], "BTREE", i["unique"]) for i in c["indexes"]], "index_name string, column_name string, type string, unique boolean")
        keys = ("name", "column", "metric", "dimension", "max_neighbors", "ef_construction", "ef_search", "random_seed")
        rows = [(*(v[k] for k in keys[:2]), "HNSW", *(v[k] for k in keys[2:])) for v in c["vindexes"]]
        return self._listing(rows, "index_name string, column_name string, type string, metric string, dimension bigint, max_neighbors bigint, ef_construction bigint, ef_search bigint, random_seed bigint")

    def _describe(self, s: ast.Describe) -> Result:
        c = self.catalog.collection(self.catalog.state, self.database, s.table)
        rows = [(f.name, str(f.type), f.nullable, f.unique, f.comment, c["comment"]) for f in self.catalog.fields(c)]
        return self._listing(rows, "column_name string, type string, nullable boolean, unique boolean, comment string, collection_comment string")
