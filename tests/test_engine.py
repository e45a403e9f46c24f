"""Statements end to end, over facts of the dialect."""

import math
import random
import re

import pytest

from lumenq.api import table
from lumenq.errors import BinderError, EngineError, ExecutionError, ParserError
from lumenq.functions.registry import Function
from lumenq.session import Session
from lumenq.types import BIGINT, DOUBLE, INTEGER


@pytest.fixture
def s(spark, tmp_path):
    out = Session(spark, f"file://{tmp_path}")
    out.execute("CREATE DATABASE d")
    out.execute("USE d")
    return out


def rows(s, sql):
    return s.execute(sql).rows()


def test_life_of_a_row(s):
    s.execute("CREATE COLLECTION users (id BIGINT, name VARCHAR(64), age INTEGER)")
    assert s.execute("INSERT INTO users VALUES (1, 'alice', 18)").affected_rows == 1
    assert rows(s, "SELECT name, age FROM users WHERE id = 1") == [("alice", 18)]
    assert rows(s, "SELECT age + 1 AS next_age FROM users ORDER BY next_age") == [(19,)]
    assert s.execute("UPDATE users SET age = 20 WHERE id = 1").affected_rows == 1
    assert s.execute("DELETE FROM users WHERE id = 1").affected_rows == 1
    assert rows(s, "SELECT * FROM users") == []


def test_sort_limit_update_delete(s):
    s.execute("CREATE COLLECTION u (id BIGINT, age INTEGER)")
    for i, a in ((1, 18), (2, 20), (3, 15)):
        s.execute(f"INSERT INTO u VALUES ({i}, {a})")
    assert rows(s, "SELECT id FROM u WHERE age >= 18 ORDER BY age DESC LIMIT 2") == [(2,), (1,)]
    assert s.execute("UPDATE u SET age = age + 1 WHERE age >= 20").affected_rows == 1
    assert s.execute("DELETE FROM u WHERE age < 18").affected_rows == 1
    assert sorted(rows(s, "SELECT id, age FROM u")) == [(1, 18), (2, 21)]
    s.execute("INSERT INTO u VALUES (3, NULL)")
    assert rows(s, "SELECT id FROM u ORDER BY age") == [(1,), (2,), (3,)]
    assert rows(s, "SELECT id FROM u ORDER BY age DESC") == [(2,), (1,), (3,)]


def test_unique(s):
    s.execute("CREATE COLLECTION u (id BIGINT UNIQUE, name VARCHAR(64))")
    s.execute("INSERT INTO u VALUES (1, 'alice')")
    with pytest.raises(ExecutionError, match="UniqueViolation"):
        s.execute("INSERT INTO u VALUES (1, 'bob')")
    assert rows(s, "SELECT * FROM u") == [(1, "alice")]
    s.execute("INSERT INTO u VALUES (2, 'bob')")
    with pytest.raises(ExecutionError, match="UniqueViolation"):  # 1 -> 2 while 2 is still held
        s.execute("UPDATE u SET id = id + 1")
    s.execute("UPDATE u SET id = id - 1")
    assert sorted(rows(s, "SELECT id FROM u")) == [(0,), (1,)]
    s.execute("INSERT INTO u VALUES (NULL, 'x')")
    s.execute("INSERT INTO u VALUES (NULL, 'y')")
    with pytest.raises(BinderError, match="ImplicitIndex"):
        s.execute("DROP INDEX __unique_id ON u")


def test_vector_search(s):
    s.execute("CREATE COLLECTION docs (id BIGINT, category INTEGER, e VECTOR(3))")
    for v in ("1, 1, [0, 0, 0]", "2, 2, [1, 0, 0]", "3, 1, [0.2, 0, 0]", "4, 2, [2, 0, 0]", "5, 9, NULL"):
        s.execute(f"INSERT INTO docs VALUES ({v})")
    near = "ORDER BY l2_distance(e, [0.1, 0, 0])"
    assert rows(s, f"SELECT id FROM docs {near} LIMIT 2") == [(1,), (3,)]
    assert rows(s, f"SELECT id FROM docs {near} LIMIT 2 OFFSET 1") == [(3,), (2,)]
    assert rows(s, f"SELECT id FROM docs WHERE category = 1 {near} LIMIT 5") == [(1,), (3,)]
    assert rows(s, f"SELECT id FROM docs {near} LIMIT 3 OFFSET 3") == [(4,), (5,)]
    assert rows(s, "SELECT id FROM docs ORDER BY inner_product(e, [1, 0, 0]) DESC LIMIT 1") == [(4,)]
    s.execute("CREATE VINDEX v ON docs (e) USING HNSW WITH (metric = l2, max_neighbors = 8)")
    s.execute("CREATE INDEX c ON docs (category)")
    assert s.explain(f"SELECT id FROM docs {near} LIMIT 2") == "VectorSearch v"
    assert s.explain("SELECT id FROM docs ORDER BY l2_distance(e, [0, 0, 0]) DESC LIMIT 2") == "SeqScan"
    assert s.explain("SELECT id FROM docs WHERE 2 < category") == "IndexScan Range c"
    assert s.explain("SELECT id FROM docs WHERE category = 2") == "IndexScan Equal c"
    assert s.explain("SELECT id FROM docs WHERE category = 2 AND id = 1") == "SeqScan"
    assert table(s, "docs").filter("category = 1").nearest("e", [0.1, 0.0, 0.0], 1).df().first().id == 1


def test_exact_search_finds_every_nearest(spark, s):
    points = [(i, [10 * math.sin(0.37 * i), 10 * math.cos(0.61 * i)]) for i in range(128)]
    s.register("p", spark.createDataFrame(points, "id long, e array<double>"), ["id"])
    for j in range(4):
        q = [9 * math.sin(0.43 * j), 9 * math.cos(0.29 * j)]
        want = min(points, key=lambda p: math.dist(p[1], q))[0]
        assert table(s, "p").select("id").nearest("e", q, 1).df().first().id == want


def test_values(s):
    s.execute("CREATE COLLECTION t (a INTEGER, b BIGINT, f FLOAT, x VARCHAR(9))")
    s.execute("INSERT INTO t VALUES (7, 5, 1, 'é_x')")
    one = rows(s, "SELECT a + 5, a - 5, a * 5, a / 5, a % 5, -a / 5, -a % 5, b / 2, a + f FROM t")
    assert one == [(12, 2, 35, 1, 2, -1, -2, 2, 8.0)]
    assert dict(s.sql("SELECT a + f AS k FROM t").dtypes) == {"k": "float"}
    assert rows(s, "SELECT x LIKE '__\\_x' FROM t") == [(False,)]
    for bad in ("2147483647 + a", "(0 - 2147483647 - 2) * a", "a * 2147483647"):
        with pytest.raises(ExecutionError, match="NumericOverflow"):
            rows(s, f"SELECT {bad} FROM t")
    for bad in ("a / 0", "a % 0", "f / 0"):
        with pytest.raises(ExecutionError, match="DivisionByZero"):
            rows(s, f"SELECT {bad} FROM t")
    assert rows(s, "SELECT a FROM t WHERE a <> 7 AND 10 / (a - 7) > 1") == []


def test_like_counts_bytes(s):
    s.execute("CREATE COLLECTION t (x VARCHAR(9))")
    s.execute("INSERT INTO t VALUES ('éa')")
    assert rows(s, "SELECT x LIKE '__a', x LIKE '_a', x LIKE '%a', x NOT LIKE 'b%' FROM t") == [(True, False, True, True)]


def test_three_valued_logic(spark, s):
    data = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    s.register("t", spark.createDataFrame(data, "a boolean, b boolean"))

    def also(a, b):
        return False if a is False or b is False else None if a is None or b is None else True

    def either(a, b):
        return True if a or b else None if a is None or b is None else False

    assert set(rows(s, "SELECT a, b, a AND b AS c, a OR b AS d FROM t")) == {(a, b, also(a, b), either(a, b)) for a, b in data}


BAD = [
    ("SELECT missing FROM users", BinderError, "ColumnNotFound"),
    ("SELECT other.id FROM users", BinderError, "InvalidQualifier"),
    ("SELECT id FROM users WHERE age + 1", BinderError, "InvalidType"),
    ("SELECT age AS x, name AS x FROM users ORDER BY x", BinderError, "AmbiguousAlias"),
    ("SELECT id FROM users WHERE id = 3000000000", BinderError, "InvalidLiteral"),
    ("SELECT age + NULL FROM users", BinderError, "InvalidType"),
    ("SELECT id FROM users WHERE NULL", BinderError, "InvalidType"),
    ("SELECT id FROM users WHERE name < 1", BinderError, "InvalidType"),
    ("SELECT l2_distance(e, [1, 2]) FROM users", BinderError, "InvalidType"),
    ("SELECT nothing(e) FROM users", BinderError, "FunctionNotFound"),
    ("INSERT INTO users (id, id) VALUES (1, 2)", BinderError, "DuplicateColumn"),
    ("INSERT INTO users (id) VALUES (1, 2)", BinderError, "InvalidValueCount"),
    ("INSERT INTO users (id, e) VALUES (1, [0.1, 0.2])", BinderError, "InvalidType"),
    ("INSERT INTO users (id) VALUES (NULL)", BinderError, "NotNullable"),
    ("INSERT INTO users (id) VALUES (age)", BinderError, "UnsupportedExpression"),
    ("INSERT INTO users (id, name) VALUES (1, 'much too long')", ExecutionError, "ValueTooLong"),
    ("UPDATE users SET age = 1, AGE = 2", BinderError, "DuplicateColumn"),
    ("UPDATE users SET id = NULL", BinderError, "NotNullable"),
    ("CREATE COLLECTION c (id BIGINT, ID INTEGER)", BinderError, "DuplicateColumn"),
    ("CREATE COLLECTION c (age INTEGER DEFAULT 'old')", BinderError, "InvalidType"),
    ("CREATE COLLECTION c (id BIGINT PRIMARY KEY)", ParserError, "Syntax"),
    ("CREATE COLLECTION users (a INTEGER)", BinderError, "CollectionExists"),
    ("SELECT FROM", ParserError, "Syntax"),
    ("SELECT 1 < 2 < 3 FROM users", ParserError, "Syntax"),
    ("SELECT id FROM users -- all", ParserError, "Syntax"),
    ("SELECT id FROM users OFFSET 1 LIMIT 1", ParserError, "Syntax"),
    ("DROP COLLECTION none", BinderError, "CollectionNotFound"),
]


def test_statements_that_must_fail(s):
    s.execute("CREATE COLLECTION users (id BIGINT NOT NULL, name VARCHAR(8) DEFAULT 'x', age INTEGER, e VECTOR(3))")
    for sql, kind, code in BAD:
        with pytest.raises(kind, match=code):
            s.execute(sql)
    assert rows(s, "SELECT * FROM users") == []
    with pytest.raises(BinderError, match="NoDatabase"):
        Session(s.spark, s.catalog.root).execute("SHOW COLLECTIONS")


def test_failed_update_changes_nothing_and_catalog_survives(s):
    s.execute("CREATE COLLECTION u (id BIGINT UNIQUE, name VARCHAR(32))")
    s.execute("INSERT INTO u VALUES (1, 'one')")
    s.execute("INSERT INTO u VALUES (2, 'two')")
    with pytest.raises(ExecutionError, match="DivisionByZero"):
        s.execute("UPDATE u SET id = 10 / (id - 2)")
    again = Session(s.spark, s.catalog.root)
    again.execute("USE d")
    assert rows(again, "SELECT * FROM u ORDER BY id") == [(1, "one"), (2, "two")]
    again.execute("DELETE FROM u WHERE id = 1")
    assert s.execute("DELETE FROM u WHERE id = 1").affected_rows == 0


def test_sessions_see_each_other_and_racing_commits_have_one_winner(s):
    other = Session(s.spark, s.catalog.root)
    s.execute("CREATE COLLECTION u (id BIGINT)")
    other.execute("USE d")
    for k in range(4):
        (s, other)[k % 2].execute(f"INSERT INTO u VALUES ({k})")
    assert sorted(rows(s, "SELECT id FROM u")) == sorted(rows(other, "SELECT id FROM u")) == [(0,), (1,), (2,), (3,)]
    mine, theirs = s.catalog.begin(), other.catalog.begin()
    other.catalog.commit(theirs)
    with pytest.raises(ExecutionError, match="Conflict"):
        s.catalog.commit(mine)
    s.catalog.commit(s.catalog.begin())  # tried again, it succeeds
    for k in range(12):
        s.catalog.commit(s.catalog.begin())
    assert len(s.catalog._versions()) <= 8
    assert sorted(rows(Session(s.spark, s.catalog.root), "SHOW DATABASES")) == [("d",)]


def test_vector_index_metrics(s):
    s.execute("CREATE COLLECTION v (e VECTOR(2))")
    for metric in ("ip", "'l2'", "3", "euclid"):
        with pytest.raises(EngineError):
            s.execute(f"CREATE VINDEX i ON v (e) USING HNSW WITH (metric = {metric})")
    s.execute("CREATE VINDEX i ON v (e) USING HNSW WITH (metric = Inner_Product)")
    assert rows(s, "SHOW VINDEXES FROM v")[0][3] == "INNER_PRODUCT"


def test_roots_with_spaces(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/a b%20c")
    s.execute("CREATE DATABASE d")
    s.execute("USE d")
    s.execute("CREATE COLLECTION t (id BIGINT)")
    s.load("t", spark.range(20))
    assert s.execute("UPDATE t SET id = 100 WHERE id = 3").affected_rows == 1
    assert s.execute("DELETE FROM t WHERE id < 3").affected_rows == 3
    assert s.catalog.vacuum() == 0 and s.catalog.vacuum(0) > 0
    assert len(rows(s, "SELECT id FROM t")) == 17


def test_float_comparisons_reach_the_scan_and_keep_their_rules(spark, s, tmp_path):
    nan = float("nan")
    data = [(0, nan), (1, None), (2, 1.0), (3, 5.0), (4, -2.0)]
    spark.createDataFrame(data, "id long, x double").write.parquet(f"{tmp_path}/t")
    s.register_parquet("t", f"{tmp_path}/t", ["id"])
    want = {"x > 1": [3], "x >= 1": [2, 3], "x < 1": [4], "x <= 1": [2, 4], "x = 1": [2], "x <> 1": [0, 3, 4], "1 < x": [3], "1 >= x": [2, 4], "x BETWEEN 0 AND 9": [2, 3], "x IN (1, 5)": [2, 3], "NOT (x > 1)": [0, 2, 4], "x NOT IN (1, 5)": [0, 4], "x NOT BETWEEN 0 AND 9": [0, 4], "x = x": [2, 3, 4], "x <> x": [0]}
    for test, ids in want.items():
        df = s.sql(f"SELECT id FROM t WHERE {test}")
        assert [r.id for r in df.collect()] == ids or sorted(r.id for r in df.collect()) == ids, test
        if "NOT" not in test and "x = x" not in test and "x <> x" not in test:
            plan = df._jdf.queryExecution().executedPlan().toString()
            pushed = plan.split("PushedFilters: [")[1].split("]")[0]
            assert "(x," in pushed.replace("IsNotNull(x)", ""), (test, pushed)


def test_keys_and_vectors_are_checked_on_every_way_in(spark, s):
    nan = float("nan")
    s.execute("CREATE COLLECTION k (x DOUBLE UNIQUE, y DOUBLE, e VECTOR(2))")
    bad = spark.createDataFrame([(nan, 1.0, [1.0, 2.0])], "x double, y double, e array<double>")
    with pytest.raises(ExecutionError, match="InvalidKey"):
        s.load("k", bad)
    with pytest.raises(ExecutionError, match="NullElement"):
        s.load("k", spark.createDataFrame([(1.0, 1.0, [1.0, None])], bad.schema))
    s.load("k", spark.createDataFrame([(1.0, nan, [1.0, 2.0])], bad.schema))
    with pytest.raises(ExecutionError, match="InvalidKey"):
        s.execute("UPDATE k SET x = y")
    for unique in ("", "UNIQUE "):
        with pytest.raises(ExecutionError, match="InvalidKey"):
            s.execute(f"CREATE {unique}INDEX i ON k (y)")
    with pytest.raises(BinderError, match="UnsupportedType"):
        s.register("d", spark.sql("SELECT DATE'2020-01-01' AS d, 1 AS i"))
    s.register("d", spark.sql("SELECT DATE'2020-01-01' AS d, 1 AS i"), skip_unsupported=True)
    assert rows(s, "SELECT * FROM d") == [(1,)]


def test_random_statements_against_a_dict(s):
    s.execute("CREATE COLLECTION m (k INTEGER UNIQUE, v INTEGER)")
    rng, model = random.Random(7), {}
    for _ in range(25):
        k, v = rng.randrange(8), rng.randrange(100)
        op = rng.choice(["insert", "insert", "update", "delete"])
        if op == "insert":
            if k in model:
                with pytest.raises(EngineError):
                    s.execute(f"INSERT INTO m VALUES ({k}, {v})")
            else:
                s.execute(f"INSERT INTO m VALUES ({k}, {v})")
                model[k] = v
        elif op == "update":
            assert s.execute(f"UPDATE m SET v = v + {v} WHERE k <= {k}").affected_rows == sum(x <= k for x in model)
            model = {x: y + v if x <= k else y for x, y in model.items()}
        else:
            assert s.execute(f"DELETE FROM m WHERE k = {k}").affected_rows == (k in model)
            model.pop(k, None)
    assert dict(rows(s, "SELECT k, v FROM m")) == model


def test_load_and_functions(spark, s):
    s.execute("CREATE COLLECTION t (id BIGINT UNIQUE, x INTEGER DEFAULT 4)")
    assert s.load("t", spark.range(100)) == 100
    assert rows(s, "SELECT x, id FROM t ORDER BY id DESC LIMIT 1") == [(4, 99)]
    with pytest.raises(ExecutionError, match="UniqueViolation"):
        s.load("t", spark.range(1))
    assert s.execute("UPDATE t SET x = 5 WHERE id = 3").affected_rows == 1
    assert sorted(rows(s, "SELECT id FROM t WHERE x = 5 OR id > 98")) == [(3,), (99,)]
    s.catalog.vacuum(0)
    assert len(rows(s, "SELECT id FROM t")) == 100
    s.register_function(Function("twice", (INTEGER,), INTEGER, lambda a: a * 2)).register_function(Function("twice", (DOUBLE,), DOUBLE, lambda a: a * 2))
    assert rows(s, "SELECT twice(x), twice(1.5) FROM t LIMIT 1") == [(8, 3.0)]
    assert s.functions.resolve("twice", [BIGINT]).result == DOUBLE


def test_stream(spark, tmp_path):
    from lumenq.streaming.follow import follow

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = follow(stream, "t", "SELECT id * 2 AS k FROM t WHERE id > 6").writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("followed").collect()) == [14, 16, 18]
    with pytest.raises(BinderError):
        follow(stream, "t", "SELECT id FROM t LIMIT 1")


def test_approximate_search(spark, tmp_path):
    """Recall against exact distances, the fallback where lists hold too few rows, NULL vectors and an empty table."""
    import numpy as np
    from pyspark.sql import functions as F

    from lumenq.operators import ann

    rng = np.random.default_rng(1)
    points = rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] * 4 + rng.normal(size=(3000, 8))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(3000, None), (3001, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, e array<double>").withColumn("v", F.lit("x"))
    for metric in ("l2", "cosine"):
        index = ann.build(df.withColumnRenamed("v", "w"), "e", f"file://{tmp_path}/{metric}", metric, ["id"], lists=16)
        assert spark.read.parquet(index.path).count() == len(rows)
        hits = 0
        for q in points[:8] + 0.1:
            d = np.linalg.norm(points - q, axis=1) if metric == "l2" else 1 - points @ q / np.linalg.norm(points, axis=1) / np.linalg.norm(q)
            got = index.search(q.tolist(), 10, probes=4)
            assert re.search(r"PartitionFilters: \[.*_list#\d+ IN", got._jdf.queryExecution().toString())
            hits += len({r.id for r in got.collect()} & set(np.argsort(d)[:10].tolist()))
        assert hits >= 0.9 * 80
    few = index.search(points[0].tolist(), 3, probes=1, where=F.col("id").isin(5, 3000, 2999))
    assert {r.id for r in few.collect()} == {5, 2999, 3000} and few.collect()[-1].id == 3000
    with pytest.raises(BinderError, match="dimensions"):
        index.search([1.0], 1)
    with pytest.raises(BinderError, match="inner_product"):
        ann.build(df, "e", f"file://{tmp_path}/no", "inner_product")
    assert ann.build(df.limit(0), "e", f"file://{tmp_path}/empty", key=["id"]).search([0.0] * 8, 3).count() == 0
