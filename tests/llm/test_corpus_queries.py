"""The registered corpus queries against DuckDB, and the pipeline stage by stage against brute force."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenq.llm import classifier, decontamination, mixing, near_dedup
from lumenq.llm import queries as corpus

from test_operators import WORDS, brute_components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = corpus.queries()[name](spark, SF)
    found = con.execute(corpus.oracle_sql()[name])
    names = [c[0] for c in found.description]
    key = lambda rows, cols: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert sorted(df.columns) == sorted(names)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(found.fetchall(), names)


def test_links_of_two_texts_as_long_under_one_id(spark):
    rng = random.Random(8)
    a, b = ([rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "something else")]
    got = near_dedup.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_other_similarities(spark):
    a = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:78], *[f"x{i}" for i in range(22)]]))]  # 74 of 118 shingles
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, linked in ((40, True), (62, True), (64, False)):
        assert (near_dedup.near_dups(d, percent=percent).filter("component_id = 1").count() == 2) == linked
    with pytest.raises(ValueError):
        near_dedup.near_dups(d, percent=10)
    assert near_dedup.fewest(64, 75) < near_dedup.fewest(64, 90) <= near_dedup.fewest(64, 100) == 64


def test_few_heads_change_no_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR", 1)
    rng = random.Random(12)
    rows, base = [], [f"w{rng.randrange(10000)}" for _ in range(80)]
    for i in range(150):  # each near the base or near an earlier copy, some just below the similarity asked for
        w = list(base if i % 3 else rows[-1][1].split() if rows else base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"x{rng.randrange(10000)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_a_group_around_one_text_leaves_few_open_pairs(spark, monkeypatch):
    """Copies far from each other but near their origin come together by it, before members of a list are paired with each other."""
    left, rest = [], near_dedup._rest

    def counted(*args):
        pairs = rest(*args)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_rest", counted)
    rng = random.Random(31)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(300):
        w = list(base)
        for _ in range(1 + i % 4):
            w[rng.randrange(120)] = f"x{rng.randrange(100000)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert sum(left) <= len(rows) // 4


def test_workers_of_near_dedup_get_short_batches(spark, monkeypatch):
    """Batches are bounded by bytes, so that an executor's memory doesn't follow the texts' length."""
    plain = {name: getattr(near_dedup, name) for name in ("_sign", "_sets")}

    def bounded(name):
        def run(batches):
            for batch in batches:
                assert batch.nbytes < 8 << 20, (name, batch.nbytes)
                yield from plain[name](iter([batch]))

        return run

    for name in plain:
        monkeypatch.setattr(near_dedup, name, bounded(name))
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "concat('word', id div 2, repeat(' of a text', 3000), ' end', id) AS text")
    got = near_dedup.near_dups(rows).select("doc_id", "n_shingles").collect()
    assert len(got) == 1200 and all(r.n_shingles == 5 for r in got)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == was


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    """Documents good and bad, copies, leaks, null and empty texts, null ids, repeated rows and columns with operators' own names."""
    rng, rows, labels = random.Random(4), [], []
    item = " ".join(f"quiz{i}" for i in range(12))
    for i in range(240):
        w = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(40)]
        good = i % 4 > 0
        rows.append((i, " ".join(w if good else [x + "###" for x in w]), "en", "abc"[i % 3] if i % 7 else None))
        labels.append((i, int(good), 0))
        if i % 10 == 1:
            rows.append((1000 + i, " ".join([*w[:-1], "end"]), "en", "a"))
        if i % 16 == 2:
            rows.append((2000 + i, " ".join(w[:20]) + " " + item + " " + " ".join(w[20:]), "de", "b"))
    rows += [(3000, None, None, None), (3001, "", "en", "c"), (None, rows[1][1], "en", "a"), rows[5], rows[5], (3002, "long " * 50000, "en", "a")]
    out = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n_chars", "score", "kept", "size", "shard_", "row", "block", "h"):
        docs = docs.withColumn(name, F.lit(7))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("q", item), ("none", None)], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_pipeline_against_brute_force(spark, corpus_dir, tmp_path):
    key = lambda r: (r.doc_id, r.text, r.source)
    docs, kept = spark.read.parquet(f"{corpus_dir}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, corpus_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == before.columns, name
        kept[name] = (sorted(map(key, before.collect()), key=repr), sorted(map(key, docs.collect()), key=repr))
    was, now = kept["quality classifier"]
    base = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    table, net = classifier.train(base, spark.read.parquet(f"{corpus_dir}/labels.parquet").select("doc_id", "quality"))
    assert now == [r for r in was if net.score(classifier.pool((r[1] or "").encode(), table).astype(float)[None])[0] >= 0.5]
    assert not [r for r in now if "###" in (r[1] or "")] and sum("###" not in (r[1] or "") for r in was) - len(now) <= 4
    was, now = kept["near dedup"]
    comp = brute_components([r[:2] for r in was])
    assert now == [r for r in was if r[0] is None or comp[r[0]] == r[0]] and len(now) < len(was)
    was, now = kept["decontamination"]
    hits = decontamination.brute_force([r[:2] for r in was], [("q", " ".join(f"quiz{i}" for i in range(12)))])
    assert now == [r for r, h in zip(was, hits, strict=True) if not h[2]] and len(now) < len(was)
    was, now = kept["mixing"]
    words = lambda r: len((r[1] or "").split())
    assert set(now) <= set(was) and all(now.count(r) <= mixing.MOST * was.count(r) for r in set(now))
    own = {s: sum(words(r) for r in was if r[2] == s) for s in {r[2] for r in was}}
    target = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(own.items()), "source string, source_size long")).collect()}
    for s, want in target.items():
        assert abs(sum(words(r) for r in now if r[2] == s) - want) <= max(words(r) for r in was if r[2] == s)
    was, now = kept["sharding"]
    assert now == was
    rows = docs.select("shard", "slot").collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_pipeline_over_empty_documents(spark, corpus_dir, tmp_path):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0 and {"shard", "slot"} < set(docs.columns)
