"""Corpus operators against brute force, exact round trips and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.llm import chat, classifier, decontamination, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_output
from lumenq.llm._text import _SEGMENT, hash_buffer, windows, word_hashes

WORDS = ["alpha", "beta", "Gamma", "délta", "eps.", "zeta,", "eta", "theta", "iota", "kappa"]


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty and long texts, ties, repeated rows, null ids and columns with operators' own names."""
    rng = random.Random(11)
    a = text(rng, 120)
    rows = [(0, a, "s"), (1, a, "s"), (2, a + "one more end", None), (3, None, "s"), (4, "", "t"), (5, "one", "t"), (6, "\x00\x0b odd\u2028sep|a|b", "t"), (7, text(rng, 60000), "u")]
    rows += [(8, "a b c", "u"), (8, "a b c", "u"), (None, a, "v"), (9, a.upper(), "v"), (10, " ".join(a.split()[20:]), "v"), (11, text(rng, 40) + a, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit("x").alias("kept"), F.lit(1).alias("size"), F.lit("y").alias("shard"), F.lit(0).alias("_size"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(t):
    return (t or "").encode().split()


def test_word_hashes_agree_at_every_length():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdef", k=rng.randint(1, 9))) for _ in range(80_000)]
    whole = word_hashes(words)
    assert (whole[:1000] == word_hashes(words[:1000])).all()
    assert len(set(words)) == len(set(whole.tolist()))
    for kind in (0, 1):
        assert (windows(whole, 13, kind)[5:100] == windows(whole[5:112], 13, kind)).all()
    huge = [b"x" * (_SEGMENT + 5), b"y", b"x" * (_SEGMENT + 5)]
    h = word_hashes(huge)
    assert h[0] == h[2] != h[1]
    long = np.tile(whole, 4)
    assert (windows(long, 13)[: len(whole) - 12] == windows(whole, 13)).all()
    assert (hash_buffer(np.frombuffer(b"a bc a ", np.uint8)) == word_hashes([b"a", b"bc", b"a"])).all()


def test_quality_counts(docs):
    got = {(r.doc_id, r.t): r for r in quality_rules.quality_rules(docs).select("doc.doc_id", F.col("doc.text").alias("t"), *quality_rules.COLUMNS).collect()}
    for (_, t), r in got.items():
        w = split(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, g in enumerate(grams) if len(w) < 5000 and grams.count(g) > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert r.n_words == len(w) and r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert len(w) >= 5000 or r.n_repeat_words == len(hit)
    assert not got[3, None].kept and got[3, None].base_failed


def test_quality_lines(spark):
    rows = [("Home",), ("a | b | c | d",), ("This is a sentence, and a good one.",), ("### $$$ ***",), ("See our privacy policy.",)]
    d = spark.createDataFrame(rows, "text string").select(F.concat(F.col("text"), F.lit("\nA fine closing line.")).alias("text"))
    got = [r.clean_text for r in quality_rules.quality_rules(d).select("clean_text").collect()]
    assert sorted(len(x.split("\n")) for x in got) == [1, 1, 1, 1, 2]


def test_lines_of_a_host(spark):
    rows = [(i, f"http://a.x/{i}", f"<p>menu</p><p>text {i}</p>") for i in range(5)] + [(9, None, None), (9, "http://b.x", "<p>menu</p>"), (9, "http://b.x", "<p>menu</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = line_dedup.line_dedup(d, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).select("doc.page_id", "host", "n_dropped", "kept").collect()
    assert sorted((r.page_id, r.n_dropped) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 0), (9, 0), (9, 0)]
    assert line_dedup.line_dedup(d.limit(0), line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).count() == 0


def test_lines_of_hosts_with_and_without_broadcasts(spark, monkeypatch):
    """Against brute force: long pages, null and repeated ones, a column with an operator's own name."""
    rng = random.Random(5)
    lines = [f"line {k}" for k in range(60)]
    rows = [(k, f"http://h{k % 3}.x/{k}", "<br>".join(rng.choices(lines, k=rng.choice([0, 5, 40])))) for k in range(60)]
    rows += [(60, "http://h0.x/long", "<br>".join(f"only {k} <b>line {k % 60}</b>" for k in range(20_000))), (61, None, None), (62, "http://h1.x", None), rows[0], rows[0]]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("drop", F.lit("x"))
    want = []
    cut = [(p, (u or "://").split("/")[2] if u else "", [x.strip() for x in (h or "").replace("<b>", "<br>").replace("</b>", "<br>").split("<br>") if x.strip()]) for p, u, h in rows]
    for p, host, has in cut:
        pages = [set(x) for _, other, x in cut if other == host]
        on = {x: sum(x in q for q in pages) for x in set(has)}
        want.append((p, host, [x for x in has if on[x] < 3 or on[x] * 100 <= 20 * len(pages)]))
    for most in (line_dedup.small.__defaults__[1], -1):
        monkeypatch.setattr(line_dedup.small, "__defaults__", (None, most))
        got = line_dedup.line_dedup(d, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).select("doc.page_id", "host", "kept").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    comp = {i: i for i, _ in known}
    edges = [(i, j) for i, a in known for j, b in known if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return comp


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 9000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n // 3, dtype=np.uint64)]))
        bits = sum(int(x).bit_count() for x in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
    assert (near_dedup.parities(a) == near_dedup.parities(a[::-1])).all()


def test_near_dups_against_all_pairs(docs, empty, spark):
    rng = random.Random(5)
    base = [[rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(rng.choice([6, 20, 90]))] for _ in range(12)]
    rows, k = [], 100
    for b in base:
        for _ in range(rng.choice([1, 3, 25])):
            w = list(b)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = str(rng.randrange(10**6))
            rows.append((k, " ".join(w), "s"))
            k += 1
    both = docs.select("doc_id", "text", "source").union(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = brute_components([(r.doc_id, r.text) for r in both.collect()])
    got = near_dedup.near_dups(both).collect()
    assert len(got) == both.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_dups(empty).count() == 0


def brute_substrings(rows, width=13):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


def test_substrings_against_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for batches in (1, 3):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs, batches=batches).collect()]
        assert sorted(got, key=repr) == brute_substrings(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_index_compacts_to_the_same_fingerprints(docs, spark):
    index = substring_dedup.FingerprintIndex(spark, fanout=1)
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    for lo, hi in ((0, 3), (4, 8), (9, 99)):
        index.add(known.filter(f"doc_id BETWEEN {lo} AND {hi}"))
    assert len(index.runs) == 1
    run = spark.table(index.runs[0])
    assert run.count() == substring_dedup.anchor_rows(known).select("fp").distinct().count() == run.select("fp").distinct().count()
    first = {r.fp: (r.lo, r.hi) for r in substring_dedup.anchor_rows(known).groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()}
    assert {r.fp: (r["first"], r["last"]) for r in run.collect()} == first
    index.delete()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lumenq_run")]


def test_a_later_job_adds_a_batch_to_the_index(docs, spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = docs.select("doc_id", "text")
    got = []
    for lo, hi in ((0, 1), (2, 8), (9, 10), (11, 99)):
        index = substring_dedup.FingerprintIndex(spark, fanout=2, path=path)  # opened anew, as by another job
        batch = known.filter(f"doc_id BETWEEN {lo} AND {hi}")
        out = substring_dedup.add_batch(index, batch, known.filter(f"doc_id < {lo}"))
        got += [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
        index.close()
    assert sorted(got, key=repr) == [x for x in brute_substrings(rows) if x[0] is not None]
    assert len(substring_dedup.FingerprintIndex(spark, path=path).runs) <= 2
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, width=5, path=path)


def test_equal_hashes_of_other_words_remove_nothing():
    """Words decide: a passage sent by its hash alone counts only where it is the same."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(30)]
    passages = [{"at": 2, "words": " ".join(words[2:14] + ["x"] + words[15:29]).encode()}]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)]), pa.array([passages], kind)], ["doc_id", "text", "passages"])
    (out,) = substring_dedup._cut(13)(iter([batch]))
    assert out.column(2).to_pylist() == [14]


def test_flow_moves_the_fewest_bytes():
    flow = sharding.min_cost_flow([10, 0, 5], [5, 5, 5])
    assert flow == {(0, 0): 5, (0, 1): 5, (2, 2): 5}
    assert sum(x for (i, j), x in sharding.min_cost_flow([9, 9, 9], [7, 7, 7, 6]).items() if i != j) == 6


def test_shards(docs, empty):
    rows = sharding.reshard_slots(docs, n_old=2, n_new=3, blocks=8).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.reshard_slots(empty).count() == 0


def test_files_are_resharded_in_place(docs, empty, spark, tmp_path):
    key = lambda r: repr((r.doc_id, r.text, r.source, r.shard))
    want = sorted(key(r) for r in docs.collect())
    path = f"file://{tmp_path}/a b"
    layout = sharding.lay_out(docs, path, shards=3, blocks=16, parts=4)
    for n in (3, 5, 2):
        layout = sharding.Layout(spark, path)  # as another job opens it
        before = {f for _, f in layout.held["folders"]}
        done = sharding.reshard_files(layout, n)
        assert len(before & {f for _, f in layout.held["folders"]}) == done["kept"]
        got = sharding.read_shards(layout)
        assert sorted(key(r.doc) for r in got.collect()) == want
        assert {r.shard for r in got.collect()} <= set(range(n))
    same = sharding.Layout(spark, path)
    assert sharding.reshard_files(same, 2)["moved"] == 0  # even already: no move, no file lost
    assert sorted(key(r.doc) for r in sharding.read_shards(same).collect()) == want
    none = sharding.lay_out(empty, f"file://{tmp_path}/none")
    assert sharding.reshard_files(none)["rewritten"] == 0 and sharding.read_shards(none).count() == 0


def test_shards_are_even_with_a_third_of_null_ids_and_move_the_fewest_bytes(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, "t" * (i % 50), i % 4) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    layout = sharding.lay_out(d, f"file://{tmp_path}/s", shards=4, shard="shard")
    size = lambda: {r.shard: r.b for r in sharding.read_shards(layout).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    old = size()
    done = sharding.reshard_files(layout, 6)
    new = size()
    assert max(new.values()) - min(new.values()) <= 0.02 * max(new.values()) and len(new) == 6
    least = sum(x for (i, j), x in sharding.min_cost_flow([old[i] for i in range(4)], [done["bytes"] * (j + 1) // 6 - done["bytes"] * j // 6 for j in range(6)]).items() if i != j)
    assert done["moved"] <= 1.05 * least and done["kept"] > 0


def test_decontamination_against_brute_force(docs, empty, spark, monkeypatch):
    a = docs.filter("doc_id = 0").first().text
    items = [(1, " ".join(a.split()[30:45])), (2, "ONE!"), (3, None), (4, "..."), (None, "alpha, beta"), (5, " ".join(a.split()[50:60]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = decontamination.brute_force(rows, [("" if i is None else i, t) for i, t in items])

    def run():
        out = decontamination.decontaminate(docs, bench)
        out = out.select("doc.doc_id", "n_words", decontamination.n_hit().alias("h"), F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s"))
        return sorted(((r.doc_id, r.n_words, r.h, r.n, r.s, r.h > 0) for r in out.collect()), key=repr)

    assert run() == sorted(want, key=repr)
    monkeypatch.setattr(decontamination, "PIECE", 7)  # items in pieces
    assert run() == sorted(want, key=repr)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)  # several blocks
    assert run() == sorted(want, key=repr)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).filter(decontamination.n_hit() > 0).count() == 0


def test_mixing(docs, empty, spark):
    rows = [(i, " w" * (1 + i % 7), "abc"[min(i % 9, 2)]) for i in range(3000)]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(big).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("own")).collect()
    total = sum(r.own for r in got)
    assert abs(sum(r.target for r in got) - total) < 1e-6
    for r in got:
        assert abs(r.taken - r.target) <= 7 and r.target <= 3 * r.own + 1e-9
    # A third of the ids null, their texts different.
    without = big.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id"), F.concat_ws(" ", "text", "doc_id").alias("text"), "source")
    for r in mixing.mix(without).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 8
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(empty).count() == 0


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "a\\", "\\b\\e", None, "", "plain", "</turn>"]
    rows = [(1, k, ["user", "assistant", "a: b", None][k % 4], t) for k, t in enumerate(odd)] + [(2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (None, None, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chat(d).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert got[1].escaped and not got[2].escaped and len(got[2].turns) == 2
    for turns, body in ((8, got[1].formatted), (2, got[2].formatted)):  # no mark but the template's own
        assert body.count("</turn>") == body.count("### ") == turns
    long = spark.createDataFrame([(1, 1, "user", "a </turn> ### : " * 30000)], d.schema)
    (r,) = chat.format_chat(long).collect()
    assert r.turns[0].text == "a </turn> ### : " * 30000 and r.formatted.count("</turn>") == 1
    body = got[2].formatted
    assert [body[s.start : s.end] for s in got[2].loss_spans] == ["tie", "tie"]
    assert chat.format_chat(d.limit(0)).count() == 0


def test_classifier(spark, docs, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        w = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60)]
        rows.append((i, " ".join(w if good else [x + "###" for x in w])))
        labels.append((i, int(good)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    table, net = classifier.train(d, lab)
    got = classifier.score(d, table, net).select("doc.doc_id", "score", classifier.held_out("doc.doc_id").alias("h")).collect()
    held = [(r.score >= 0.5) == bool(dict(labels)[r.doc_id]) for r in got if r.h]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in classifier.score(docs, table, net).collect())
    assert classifier.score(empty, table, net).count() == 0
    assert [r.score for r in classifier.score(d.limit(2), *classifier.train(d, lab.limit(0))).collect()] == [0.5, 0.5]


def test_tokens_round_trip(docs, empty, spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    odd = [(20, "<|endoftext|>It's naïve\u0301 don't... 1234 ǅ İstanbul\u00a0x ﬁ ße\u0308ß THE the, the!? 'll a.b,c \U0001f600"), (21, "e\u0301 \u0301e ΑΣ. ÀÉÎ.")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    token_output.write_tokens(both, f"file://{tmp_path}/t", path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, f"file://{tmp_path}/t").collect())
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    want = sorted((r.doc_id is not None, r.doc_id, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes())) for r in both.collect() if r.doc_id is not None)
    assert [x[1:] for x in got if x[1] is not None] == [x[1:] for x in want]
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    token_output.write_tokens(empty, f"file://{tmp_path}/e", path)
    assert token_output.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_letters_before_any_marks_pass_by_the_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    encoder = token_output.Encoder(str(P.path("word_bpe_49k.json")))
    tokenizer, asked = encoder.tokenizer, []

    class Spy:
        def encode(self, text, **kw):
            asked.append(text)
            return tokenizer.encode(text, **kw)

    assert encoder.agrees()
    encoder.clear()
    encoder.tokenizer = Spy()
    rng = random.Random(5)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    chunks = [rng.choice(["word", "The", "été", "STRASSE", "don", "it's"]) + "".join(rng.choice(marks) for _ in range(rng.randrange(5))) for _ in range(3000)]
    text = " ".join(chunks + ["'s", "'", "they'll'd", "x<|endoftext|>", "<|startoftext|>y", "é́*"])
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not [x for x in asked if x.rstrip(marks).isalpha()]


def test_segment_planes():
    bodies = [np.arange(k, 3 * k, dtype="<u4").tobytes() for k in (1, 70000, 0, 5)]
    docs, lengths, ids = token_output.unpack_segment(token_output.pack_segment([3, None, 5, 6], bodies))
    assert docs == [3, None, 5, 6] and lengths.tolist() == [2, 140000, 0, 10] and ids.tobytes() == b"".join(bodies)
    assert hashlib.sha256(ids.tobytes()).digest()


def test_near_dups_ties_the_texts_of_one_id_without_candidates(spark):
    """Rows of one doc_id tie the classes of their texts, also where no two texts are near."""
    rows = [(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (7, "h i j k l m n"), (9, None)]
    got = near_dedup.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]
