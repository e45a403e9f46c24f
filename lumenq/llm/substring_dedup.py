"""Substring dedup with a log-structured fingerprint index.

Batches of documents come in ascending order of doc_id.  Each batch leaves one immutable
run: a table bucketed and sorted by fingerprint.  A new batch is merge-joined with the
runs before it, bucket by bucket and without moving them again; after ``FANOUT`` runs they
are merge-joined into one, again in place.  A manifest in the index's folder names the
runs, so that a later job opens the index and adds a batch.

The fingerprint of a 13-word window is its *anchor*, the least hash of the 4-word grams in
it.  Equal windows have equal anchors and neighbouring windows mostly share one, so the
index is a sixth of the size of one by window hashes and misses no window.  Windows
above a fingerprint that two documents share, and only those, are compared by 96 bits of
hash of their word sequence, and the smallest doc_id of each is found.  Last, words are
compared: the passages of that document are sent to the one that repeats them, and a
window counts only where its words are the same.

What is broadcast is a Bloom filter of the shared anchors of at most ``MOST_BITS`` bits.
It only saves work: a false hit posts a window that no other document has.

Defined results: null or short texts have no windows and lose nothing; rows with a null
doc_id neither lose words nor cost others any; rows with equal doc_id don't remove each
other's words.  All windows are judged on the input.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm._store import BROADCAST_ROWS, Scratch, file_system, shuffles_end, small
from lumenq.llm._text import mix, windows, word_hashes

WIDTH, GRAM, FANOUT, BATCHES = 13, 4, 2, 3
MOST_BITS = 1 << 29
RANGES = 2
PROBES = 4
ROWS = 512  # rows that a Python worker holds in its own form at a time


def _words(text) -> list[bytes]:
    return (text.as_py() or b"").split()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of every window, in order."""
    low = windows(hashes, GRAM)
    span, held = width - GRAM + 1, 1
    if len(low) < span:
        return np.empty(0, np.uint64)
    while held < span:  # minima of twice as many grams each time
        step = min(held, span - held)
        low, held = np.minimum(low[:-step], low[step:]), held + step
    return low


def anchor_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp: the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = [np.unique(_anchors(word_hashes(_words(t)), width)) for t in batch.column(1).cast(pa.binary())]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "fps"])

    return docs.mapInArrow(run, "doc_id long, fps array<long>").select("doc_id", F.explode("fps").alias("fp"))


class FingerprintIndex:
    """Sorted immutable runs of (fp, first, last): the smallest and largest doc_id with an anchor.

    ``path`` is the index's folder in shared storage; without one it lies among the scratch
    tables.  Opening a folder that holds an index goes on with its runs.  Manifests are
    numbered and never overwritten: of two jobs that add to one index, one fails.
    """

    def __init__(self, spark, width: int = WIDTH, fanout: int = FANOUT, path: str | None = None):
        self.spark, self.width, self.fanout = spark, width, fanout
        self.scratch = Scratch(spark, "runs")
        self.path = path or self.scratch.path("index")
        self.version, self.runs, self.buckets = 0, [], int(spark.conf.get("spark.sql.shuffle.partitions"))
        fs, at = file_system(spark, self.path)
        if fs.exists(at):
            names = [f.getPath().getName() for f in fs.listStatus(at)]
            self.version = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
        if self.version:
            held = json.loads("".join(r[0] for r in spark.read.text(self._manifest(self.version)).collect()))
            if held["width"] != width:
                raise ValueError(f"the index holds windows of {held['width']} words")
            self.runs, self.buckets = held["runs"], held["buckets"]
        for run in self.runs:
            self._declare(run)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}.json"

    def _declare(self, run: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (fp BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")

    def _commit(self, runs: list[str]) -> None:
        fs, at = file_system(self.spark, self._manifest(self.version + 1))
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"width": self.width, "buckets": self.buckets, "runs": runs}).encode()))
        out.close()
        self.version, old, self.runs = self.version + 1, self.runs, runs
        for run in set(old) - set(runs):
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            self.scratch.delete(f"{self.path}/{run}")

    def _write(self, run: DataFrame) -> str:
        name = f"lumenq_run_{uuid.uuid4().hex}"
        with shuffles_end(self.spark):
            run.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch (doc_id, text) of larger doc_ids than any before; returns fp of the anchors it shares."""
        # The aggregation deals rows by fp into as many partitions as buckets: one file each.
        name = self._write(anchor_rows(docs, self.width).groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        run = self.spark.table(name)
        shared = run.filter("first < last").select("fp")
        for old in self.runs:
            shared = shared.unionByName(run.join(self.spark.table(old).hint("merge"), "fp").select(run["fp"]))
        shared = self.scratch.save(shared, "shared")
        self._commit([*self.runs, name])
        if len(self.runs) > self.fanout:
            self.compact()
        return shared

    def compact(self) -> None:
        """Merge all runs into one; the old ones go only when the new one is written and named."""
        merged = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            more = self.spark.table(run).select("fp", F.col("first").alias("f"), F.col("last").alias("l"))
            merged = merged.join(more.hint("merge"), "fp", "full_outer").select("fp", F.least("first", "f").alias("first"), F.greatest("last", "l").alias("last"))
        self._commit([self._write(merged)])

    def close(self) -> None:
        """Forget the runs' names in the session's catalog; their files and the manifest stay."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def delete(self) -> None:
        self.close()
        self.scratch.delete(self.path)


def _bloom(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of 16 bits or more a fingerprint, up to MOST_BITS; built on executors, merged by bucket."""
    n = shared.count()
    bits = min(MOST_BITS, max(1 << 20, 1 << (16 * n - 1).bit_length())) if n else 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = mix(fp) | np.uint64(1)
            at = [(fp + step * np.uint64(k)) & np.uint64(bits - 1) for k in range(PROBES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).view(np.int64))], ["at"])

    at = F.col("at") + 1
    set_ = shared.mapInArrow(run, "at long").select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p"))
    table = np.zeros(bits // 8, np.uint8)
    for r in set_.groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).toLocalIterator():  # at most MOST_BITS / 32768 rows of 4 KB
        table[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.b, np.uint8)
    return table


def _holds(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each fingerprint; later probes are for those that passed the ones before."""
    out, left = np.zeros(len(fp), bool), np.arange(len(fp))
    step, low = mix(fp) | np.uint64(1), np.uint64(len(table) * 8 - 1)
    for k in range(PROBES):
        at = (fp[left] + step[left] * np.uint64(k)) & low
        left = left[((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
    out[left] = True
    return out


def window_rows(docs: DataFrame, table: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id, at, h1, h2 of the windows whose anchor is in the filter, as one row of arrays per document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in _pieces(batches):
            ids, ends, at, h1, h2 = [], [0], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                hashes = word_hashes(_words(text))
                anchors = _anchors(hashes, width)
                hit = np.flatnonzero(_holds(bits, anchors))
                if len(hit):
                    ids.append(doc.as_py())
                    ends.append(ends[-1] + len(hit))
                    at.append(hit.astype(np.int32))
                    h1.append(windows(hashes, width)[hit].view(np.int64))
                    h2.append((windows(hashes, width, 1)[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if ids:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (at, h1, h2)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "at", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, at array<int>, h1 array<long>, h2 array<int>")


def repeated_windows(docs: DataFrame, shared: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, src, at, src_at: the windows of a document whose hash also starts in documents with smaller doc_ids.

    src is the smallest of them, src_at the window's place there.  Windows meet their sources
    in ``RANGES`` ranges of their hash one after another, so that a part of the shuffle is on disk at a time.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    packed = scratch.save(window_rows(docs, _bloom(shared), width), "windows")
    rows = packed.select("doc_id", F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select("doc_id", "w.at", "w.h1", "w.h2")
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("src_at"))
    first = scratch.save(first.filter("src < last").select("h1", "h2", "src", "src_at"), "first")
    parts = []
    for k in range(RANGES):
        inside = F.pmod("h1", F.lit(RANGES)) == k
        later = rows.filter(inside).join(first.filter(inside).hint("merge"), ["h1", "h2"]).filter("doc_id > src")
        parts.append(scratch.save(later.select("doc_id", "src", "at", "src_at"), "later"))
    scratch.drop(packed, first)
    # A document's windows meet again by document and source, as one row of arrays.
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    grouped = all_.groupBy("doc_id", "src").agg(F.sort_array(F.collect_list(F.struct("at", "src_at"))).alias("w"))
    out = scratch.save(grouped.select("doc_id", "src", F.col("w.at").alias("at"), F.col("w.src_at").alias("src_at")), "repeated")
    scratch.drop(*parts)
    return out


def _passages(width: int):
    """doc_id, at, words: what the source says where the document repeats it, windows in a row joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, words = None, []
        for batch in _pieces(batches):
            ids, ats, said = [], [], []
            for doc, at, place, text in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3).cast(pa.binary()), strict=True):
                raw = text.as_py()
                if raw != was:  # rows come sorted by source
                    was, words = raw, (raw or b"").split()
                at, place = at.values.to_numpy(zero_copy_only=False), place.values.to_numpy(zero_copy_only=False)
                cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1)) + 1
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                    ids.append(doc.as_py())
                    ats.append(int(at[lo]))
                    said.append(b" ".join(words[place[lo] : place[hi - 1] + width]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(said, pa.binary())], ["doc_id", "at", "words"])

    return run


def _cut(width: int):
    def covered(words: list[bytes], passages) -> np.ndarray:
        """Which words stand in a window that a passage repeats word by word."""
        edge = np.zeros(len(words) + 1, np.int64)
        for p in passages or ():
            at, run, said = p["at"], 0, p["words"].split(b" ")
            if len(said) >= width and words[at : at + len(said)] == said:
                edge[at] += 1
                edge[at + len(said)] -= 1
                continue
            for k, w in enumerate(said):
                run = run + 1 if at + k < len(words) and words[at + k] == w else 0
                if run >= width:
                    edge[at + k - width + 1] += 1
                    edge[at + k + 1] -= 1
        return np.cumsum(edge[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            n, removed, kept = [], [], []
            for text, passages in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = _words(text)
                n.append(len(words))
                gone = covered(words, passages.as_py()) if passages.is_valid else None
                removed.append(0 if gone is None else int(gone.sum()))
                if removed[-1]:
                    words = [w for w, c in zip(words, gone.tolist(), strict=True) if not c]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, history: DataFrame, shared: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of ``docs``, which ``history`` holds too, after windows above the shared anchors."""
    scratch = Scratch(docs.sparkSession, "passages")
    found = repeated_windows(history.filter(F.col("doc_id").isNotNull()), shared, width)
    sources = scratch.save(found.select("src").distinct(), "sources")
    source_texts = history.join(small(sources.withColumnRenamed("src", "doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("src"), "text")
    said = found.join(source_texts.hint("merge"), "src").select("doc_id", "at", "src_at", "text").mapInArrow(_passages(width), "doc_id long, at int, words binary")
    passages = scratch.save(said.groupBy("doc_id").agg(F.collect_list(F.struct("at", "words")).alias("passages")), "passages")
    scratch.delete(found._lumenq_path)
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    none = F.lit(None).cast(passages.schema["passages"].dataType).alias("passages")
    if passages.count() > BROADCAST_ROWS:
        return docs.join(passages, "doc_id", "left").select("doc_id", "text", "passages").mapInArrow(_cut(width), schema)
    # Few documents lose words: only their texts move, to meet what they lose.
    ids = F.broadcast(passages.select("doc_id"))
    clean = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", none).mapInArrow(_cut(width), schema)
    hit = docs.join(ids, "doc_id", "left_semi").join(passages.hint("merge"), "doc_id").select("doc_id", "text", "passages").mapInArrow(_cut(width), schema)
    return clean.unionByName(hit)


def add_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame) -> DataFrame:
    """Dedup a batch (doc_id, text) of larger doc_ids against ``history``, the documents already in the index, and add it."""
    shared = index.add(batch.filter(F.col("doc_id").isNotNull()))
    return remove_repeats(batch, history.unionByName(batch), shared, index.width)


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by spaces) of every row."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = docs.filter(F.col("doc_id").isNotNull())
    bounds = sorted(set(known.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    index = FingerprintIndex(df.sparkSession, width, fanout)
    shared = None
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        batch = known
        if lo is not None:
            batch = batch.filter(F.col("doc_id") > int(lo))
        if hi is not None:
            batch = batch.filter(F.col("doc_id") <= int(hi))
        found = index.add(batch)
        shared = found if shared is None else shared.unionByName(found)
    index.delete()  # a batch job; a store that goes on keeps its index
    return remove_repeats(docs, docs, shared, width)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM m, range({WIDTH}) AS v(k) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM c) r ON x.doc_id = r.doc_id AND x.i = r.i WHERE r.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
