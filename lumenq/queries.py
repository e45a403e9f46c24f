"""Named queries over the driver's tables, in the dialect, with the equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.errors import EngineError
from lumenq.session import Session

_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "embeddings": ["vec_id"],
}
_V = "[" + ", ".join(["0.1"] * 64) + "]"
_SQ = "list_transform(embedding, lambda v: (v::DOUBLE - 0.1::DOUBLE) * (v::DOUBLE - 0.1::DOUBLE))"
_L2 = f"sqrt(list_reduce({_SQ}, lambda x, y: x + y))"
_IP = "list_reduce(list_transform(embedding, lambda v: v::DOUBLE * 0.1::DOUBLE), lambda x, y: x + y)"
_NORM = "sqrt(list_reduce(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE), lambda x, y: x + y))"
_UNIT = "sqrt(list_reduce(list_transform(embedding, lambda v: 0.1::DOUBLE * 0.1::DOUBLE), lambda x, y: x + y))"
_COS = f"1 - {_IP} / ({_NORM} * {_UNIT})"

#: name -> (table, statement, DuckDB's statement; None where both are the same)
SELECTS: dict[str, tuple[str, str, str | None]] = {
    "scan_project": ("nation", "SELECT n_nationkey, n_name FROM nation", None),
    "wildcard": ("region", "SELECT * FROM region", None),
    "qualified_wildcard": ("region", "SELECT region.*, r_regionkey + 1 AS next_key FROM region", None),
    "expr_naming": ("nation", "SELECT n_nationkey + 1 AS next_key, n_regionkey * 2 FROM nation", "SELECT n_nationkey + 1 AS next_key, n_regionkey * 2 AS expr2 FROM nation"),
    "cmp_filter": ("part", "SELECT p_partkey FROM part WHERE p_size >= 25 AND p_size <> 30", None),
    "and_or_not": ("part", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40)", None),
    "in_list": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", None),
    "not_in_list": ("customer", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)", None),
    "between_f": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", None),
    "not_between": ("part", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", None),
    "like_f": ("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'", None),
    "not_like": ("part", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%e%'", None),
    "int_arith": (
        "part",
        "SELECT p_partkey, p_size + 7 AS a, p_size - 7 AS s, p_size * 3 AS m, p_size / 3 AS d, p_size % 4 AS r FROM part",
        "SELECT p_partkey, p_size + 7 AS a, p_size - 7 AS s, p_size * 3 AS m, CAST(p_size // 3 AS INTEGER) AS d, p_size % 4 AS r FROM part",
    ),
    "float_arith": (
        "lineitem",
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit, l_extendedprice % 7.0 AS rem FROM lineitem WHERE l_quantity > 0",
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit, l_extendedprice % 7.0::DOUBLE AS rem FROM lineitem WHERE l_quantity > 0",
    ),
    "float_compare": ("customer", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000.0 AND 9000.0 >= c_acctbal AND c_acctbal <> 6000", None),
    "qualified_column": ("nation", "SELECT nation.n_name, nation.n_regionkey + 1 AS r FROM nation WHERE nation.n_nationkey < 20 ORDER BY nation.n_name", None),
    "unary_plus": ("supplier", "SELECT s_suppkey, +s_nationkey AS p, - + s_acctbal AS n FROM supplier", None),
    "boolean_key": ("part", "SELECT p_partkey FROM part ORDER BY p_size > 25 DESC, p_partkey LIMIT 30", "SELECT p_partkey FROM part ORDER BY p_size > 25 DESC NULLS LAST, p_partkey LIMIT 30"),
    "vector_key": ("embeddings", "SELECT vec_id FROM embeddings ORDER BY embedding, vec_id LIMIT 12", None),
    "literals": ("region", "SELECT r_regionkey, TRUE AS t, FALSE AS f, 'it' AS s, 1.5 AS d FROM region WHERE TRUE", "SELECT r_regionkey, TRUE AS t, FALSE AS f, 'it' AS s, 1.5::DOUBLE AS d FROM region"),
    "duplicate_alias_order": ("nation", "SELECT n_regionkey AS r, n_nationkey AS k FROM nation ORDER BY r DESC, k", None),
    "float_in": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IN (1, 2.5, 7)", None),
    "neg": ("customer", "SELECT c_custkey, -c_acctbal AS neg FROM customer", None),
    "guarded_division": ("part", "SELECT p_partkey FROM part WHERE p_size - 10 <> 0 AND 100 / (p_size - 10) > 5", "SELECT p_partkey FROM part WHERE p_size <> 10 AND 100 // (p_size - 10) > 5"),
    "sort_multi": ("supplier", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC NULLS LAST, s_suppkey"),
    "sort_alias": ("customer", "SELECT c_custkey, -c_acctbal AS k FROM customer ORDER BY k, c_custkey LIMIT 20", None),
    "sort_hidden": ("part", "SELECT p_partkey FROM part ORDER BY p_size % 7, p_partkey LIMIT 15", None),
    "sort_stable": ("part", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC LIMIT 40", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40"),
    "sort_constant": ("part", "SELECT p_partkey FROM part ORDER BY 1 + 1 LIMIT 9", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 9"),
    "limit_offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", None),
    "offset_only": ("nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "limit_zero": ("region", "SELECT r_regionkey FROM region LIMIT 0", None),
    "l2_topk": ("embeddings", f"SELECT vec_id FROM embeddings ORDER BY l2_distance(embedding, {_V}) LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10"),
    "ip_topk": ("embeddings", f"SELECT vec_id FROM embeddings ORDER BY inner_product(embedding, {_V}) DESC LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_IP} DESC NULLS LAST, vec_id LIMIT 10"),
    "cosine_topk": ("embeddings", f"SELECT vec_id FROM embeddings ORDER BY cosine_distance(embedding, {_V}) LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_COS}, vec_id LIMIT 10"),
    "filtered_topk": ("embeddings", f"SELECT vec_id FROM embeddings WHERE label = 1 ORDER BY l2_distance(embedding, {_V}) LIMIT 10", f"SELECT vec_id FROM embeddings WHERE label = 1 ORDER BY {_L2}, vec_id LIMIT 10"),
    "topk_offset": ("embeddings", f"SELECT vec_id FROM embeddings ORDER BY l2_distance(embedding, {_V}) LIMIT 10 OFFSET 10", f"SELECT vec_id FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10 OFFSET 10"),
    "distance_values": (
        "embeddings",
        f"SELECT vec_id, l2_distance(embedding, {_V}) AS l2, inner_product(embedding, {_V}) AS ip, cosine_distance(embedding, {_V}) AS cosine FROM embeddings",
        f"SELECT vec_id, {_L2} AS l2, {_IP} AS ip, {_COS} AS cosine FROM embeddings",
    ),
    "vector_literal": ("part", "SELECT p_partkey, inner_product([p_size, 2], [1.5, p_partkey]) AS dot FROM part", "SELECT p_partkey, p_size * 1.5::DOUBLE + 2.0::DOUBLE * p_partkey AS dot FROM part"),
}


def session(spark: SparkSession, root: str | None = None) -> Session:
    """A session for registered tables; its own catalog lies in the cluster's shared folder."""
    if root is None:
        import tempfile
        import uuid

        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{shared}/lumenq-catalog-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='lumenq-')}"
    return Session(spark, root)


def run_select(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql, _ = SELECTS[name]
    s = session(spark)
    s.register_parquet(table, f"{sf_dir}/{table}.parquet", _KEYS[table], skip_unsupported=True)
    return s.sql(sql)


def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("sz"))
    return session(spark).register("part", part, ["p_partkey"]).sql("SELECT p_partkey, sz FROM part ORDER BY sz DESC LIMIT 50")


def null_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("sz"))
    sql = "SELECT p_partkey, sz > 20 AND sz < 30 AS both, NOT (sz IN (1, 2, 3)) AS out, sz BETWEEN 5 AND 9 AS inside, -sz + 1 AS shifted FROM part"
    return session(spark).register("part", part, ["p_partkey"]).sql(sql)


def script(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of the last of some statements run in a new catalog."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark)
        for sql in ("CREATE DATABASE d", "USE d", *statements[:-1]):
            s.execute(sql)
        return s.sql(statements[-1])

    return run


_USERS = "CREATE COLLECTION users (id BIGINT UNIQUE NOT NULL, name VARCHAR(64) COMMENT 'n' DEFAULT 'unknown', age INTEGER, e VECTOR(2)) COMMENT 'people'"
_ROWS = ("INSERT INTO users VALUES (1, 'ann', 18, [0, 0])", "INSERT INTO users (id, age, e) VALUES (2, 20, [1, 0])", "INSERT INTO users (id, name) VALUES (3, 'cy')")
SCRIPTS = {
    "ddl_describe": (script(_USERS, "DESCRIBE users"), "SELECT * FROM (VALUES ('id', 'BIGINT', false, true, '', 'people'), ('name', 'VARCHAR(64)', true, false, 'n', 'people'), ('age', 'INTEGER', true, false, '', 'people'), ('e', 'VECTOR(2)', true, false, '', 'people')) AS t(column_name, type, nullable, \"unique\", comment, collection_comment)"),
    "ddl_show_databases": (script("CREATE DATABASE b", "DROP DATABASE b", "CREATE DATABASE IF NOT EXISTS c", "SHOW DATABASES"), "SELECT * FROM (VALUES ('d'), ('c')) AS t(database_name)"),
    "ddl_show_collections": (script(_USERS, "CREATE COLLECTION t (a INTEGER)", "CREATE COLLECTION u (a INTEGER)", "DROP COLLECTION t", "SHOW COLLECTIONS"), "SELECT * FROM (VALUES ('users'), ('u')) AS t(collection_name)"),
    "ddl_show_indexes": (script(_USERS, "CREATE INDEX by_age ON users (age) USING BTREE", "CREATE UNIQUE INDEX by_name ON users (name)", "DROP INDEX by_name ON users", "SHOW INDEXES FROM users"), "SELECT * FROM (VALUES ('__unique_id', 'id', 'BTREE', true), ('by_age', 'age', 'BTREE', false)) AS t(index_name, column_name, type, \"unique\")"),
    "ddl_show_vindexes": (script(_USERS, "CREATE VINDEX near ON users (e) USING HNSW WITH (metric = cosine, ef_search = 32)", "SHOW VINDEXES FROM users"), "SELECT * FROM (VALUES ('near', 'e', 'HNSW', 'COSINE', 2::BIGINT, 16::BIGINT, 200::BIGINT, 32::BIGINT, 0::BIGINT)) AS t(index_name, column_name, type, metric, dimension, max_neighbors, ef_construction, ef_search, random_seed)"),
    "dml_insert": (script(_USERS, *_ROWS, "SELECT id, name, age FROM users"), "SELECT * FROM (VALUES (1::BIGINT, 'ann', 18), (2, 'unknown', 20), (3, 'cy', NULL)) AS t(id, name, age)"),
    "dml_update": (script(_USERS, *_ROWS, "UPDATE users SET age = age + 1, name = 'old' WHERE age >= 20", "SELECT id, name, age FROM users"), "SELECT * FROM (VALUES (1::BIGINT, 'ann', 18), (2, 'old', 21), (3, 'cy', NULL)) AS t(id, name, age)"),
    "dml_delete": (script(_USERS, *_ROWS, "DELETE FROM users WHERE age < 19", "SELECT id, name FROM users"), "SELECT * FROM (VALUES (2::BIGINT, 'unknown'), (3, 'cy')) AS t(id, name)"),
    "dml_vector_search": (script(_USERS, *_ROWS, "CREATE VINDEX near ON users (e) USING HNSW", "SELECT id, l2_distance(e, [0.9, 0.0]) AS d FROM users ORDER BY d LIMIT 3"), "SELECT * FROM (VALUES (1::BIGINT, 0.9::DOUBLE), (2, sqrt((1.0::DOUBLE - 0.9::DOUBLE) * (1.0::DOUBLE - 0.9::DOUBLE))), (3, NULL)) AS t(id, d)"),
}


def outcomes(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """step, code: what each of some statements run in a new catalog ends with, ok or an error's code."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, out = session(spark), []
        for sql in ("CREATE DATABASE d", "USE d"):
            s.execute(sql)
        for k, sql in enumerate(statements):
            try:
                s.execute(sql).rows()
                out.append((k, "ok"))
            except EngineError as e:
                out.append((k, e.code))
        return spark.createDataFrame(out, "step int, code string")

    return run


def _coded(*pairs: tuple[str, str]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    rows = ", ".join(f"({k}, '{code}')" for k, (_, code) in enumerate(pairs))
    return outcomes(*[sql for sql, _ in pairs]), f"SELECT * FROM (VALUES {rows}) AS t(step, code)"


_K = "CREATE COLLECTION k (id BIGINT UNIQUE NOT NULL, name VARCHAR(4), x DOUBLE, e VECTOR(2))"
SCRIPTS |= {
    "not_null": _coded((_K, "ok"), ("INSERT INTO k (id) VALUES (NULL)", "NotNullable"), ("INSERT INTO k (name) VALUES ('a')", "NotNullable"), ("INSERT INTO k (id) VALUES (1)", "ok"), ("UPDATE k SET id = NULL", "NotNullable")),
    "value_length": _coded((_K, "ok"), ("INSERT INTO k (id, name) VALUES (1, 'abcd')", "ok"), ("INSERT INTO k (id, name) VALUES (2, 'abcde')", "ValueTooLong"), ("UPDATE k SET name = 'abcde'", "ValueTooLong")),
    "vector_dimension": _coded((_K, "ok"), ("INSERT INTO k (id, e) VALUES (1, [1, 2])", "ok"), ("INSERT INTO k (id, e) VALUES (2, [1, 2, 3])", "InvalidType"), ("SELECT l2_distance(e, [1, 2, 3]) FROM k", "InvalidType")),
    "unique_keys": _coded((_K, "ok"), ("INSERT INTO k (id) VALUES (1)", "ok"), ("INSERT INTO k (id) VALUES (1)", "UniqueViolation"), ("INSERT INTO k (id) VALUES (2)", "ok"), ("UPDATE k SET id = id + 1", "UniqueViolation"), ("UPDATE k SET id = id - 1", "ok")),
    "unique_index": _coded((_K, "ok"), ("INSERT INTO k (id, x) VALUES (1, 0.5)", "ok"), ("INSERT INTO k (id, x) VALUES (2, 0.5)", "ok"), ("CREATE UNIQUE INDEX u ON k (x)", "UniqueViolation"), ("DELETE FROM k WHERE id = 2", "ok"), ("CREATE UNIQUE INDEX u ON k (x)", "ok"), ("INSERT INTO k (id, x) VALUES (3, 0.5)", "UniqueViolation"), ("INSERT INTO k (id, x) VALUES (4, NULL)", "ok"), ("INSERT INTO k (id, x) VALUES (5, NULL)", "ok")),
    "atomic_update": _coded((_K, "ok"), ("INSERT INTO k (id) VALUES (1)", "ok"), ("INSERT INTO k (id) VALUES (2)", "ok"), ("UPDATE k SET id = 10 / (id - 2)", "DivisionByZero"), ("INSERT INTO k (id) VALUES (2)", "UniqueViolation")),
    "binder_errors": _coded((_K, "ok"), ("SELECT missing FROM k", "ColumnNotFound"), ("SELECT other.id FROM k", "InvalidQualifier"), ("SELECT id FROM k WHERE id + 1", "InvalidType"), ("SELECT id AS a, x AS a FROM k ORDER BY a", "AmbiguousAlias"), ("SELECT id AS a, x AS a FROM k", "ok"), ("INSERT INTO k (id, id) VALUES (1, 2)", "DuplicateColumn"), ("INSERT INTO k (id) VALUES (1, 2)", "InvalidValueCount"), ("SELECT FROM", "Syntax")),
    "drop_vindex": (script(_USERS, "CREATE VINDEX near ON users (e) USING HNSW WITH (metric = inner_product, random_seed = 4294967296)", "CREATE VINDEX far ON users (e) USING HNSW", "DROP VINDEX far ON users", "SHOW VINDEXES FROM users"), "SELECT * FROM (VALUES ('near', 'e', 'HNSW', 'INNER_PRODUCT', 2::BIGINT, 16::BIGINT, 200::BIGINT, 64::BIGINT, 4294967296::BIGINT)) AS t(index_name, column_name, type, metric, dimension, max_neighbors, ef_construction, ef_search, random_seed)"),
    "update_then_delete": (script(_USERS, *_ROWS, "UPDATE users SET age = age + 1 WHERE id = 1", "DELETE FROM users WHERE id = 3", "SELECT id, age FROM users ORDER BY id"), "SELECT * FROM (VALUES (1::BIGINT, 19), (2, 20)) AS t(id, age)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, name=name: run_select(spark, sf_dir, name)) for name in SELECTS}
    return out | {"null_order": null_order, "null_logic": null_logic} | {name: run for name, (run, _) in SCRIPTS.items()}


def oracle_sql() -> dict[str, str]:
    sized = "(SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS sz FROM part)"
    out = {name: other or sql for name, (_, sql, other) in SELECTS.items()}
    out["null_order"] = f"SELECT p_partkey, sz FROM {sized} ORDER BY sz DESC NULLS LAST, p_partkey LIMIT 50"
    out["null_logic"] = f"SELECT p_partkey, sz > 20 AND sz < 30 AS both, NOT (sz IN (1, 2, 3)) AS out, sz BETWEEN 5 AND 9 AS inside, -sz + 1 AS shifted FROM {sized}"
    return out | {name: sql for name, (_, sql) in SCRIPTS.items()}
