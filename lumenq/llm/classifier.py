"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: each of ``BUCKETS`` token buckets has a fixed sparse ternary index
vector; a bucket's word vector is the sum of the index vectors of the tokens around its
occurrences.  Tokens are the lower-cased words and their shapes (runs of letters, digits
and each kind of mark), so that unseen words still carry what they look like.  A
document is pooled to the mean and the spread of its tokens' vectors; nothing else is
seen by the network, in particular neither labels, lang, source nor doc_id.

Fitting uses at most ``SAMPLE`` labelled documents, picked by the hash of their id (the
documented bound), and runs the network on the driver in numpy; executors return pooled
vectors and integer co-occurrence sums of fixed size.  The temperature is fitted on a
fifth of the sample that the network did not learn from.  Every document is scored
whole, where it lies.

Defined results: null and empty texts are pooled to zeros and scored so; without any
label every score is 0.5, with labels of one kind it is their smoothed share; repeated
rows get equal scores; of several labels or texts of an id the least is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.llm._text import hash_buffer

BUCKETS, DIM, REACH, NONZERO = 1 << 14, 64, 2, 8
SAMPLE, HIDDEN, EPOCHS, TASKS = 6000, 32, 400, 6
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(41)
    out = np.zeros((BUCKETS, DIM), np.int32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def tokens(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and of their shapes."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = b" ".join(words) + b" "
    kinds = _KIND[np.frombuffer(joined, np.uint8)]
    shape = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
    mask = np.uint64(BUCKETS - 1)
    low = hash_buffer(np.frombuffer(joined.lower(), np.uint8)) & mask
    look = (hash_buffer(shape) ^ np.uint64(0x55AA)) & mask
    return low.astype(np.int64), look.astype(np.int64)


def pool(text: bytes | None, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the token vectors of one text."""
    sums = np.zeros((2, DIM))
    low, look = tokens(text)
    n = 2 * len(low)
    if not n:
        return np.zeros(2 * DIM, np.float32)
    for part in (low, look):
        used, counts = np.unique(part, return_counts=True)
        for at in range(0, len(used), 4096):
            v, c = table[used[at : at + 4096]], counts[at : at + 4096]
            sums[0] += c @ v
            sums[1] += c @ (v * v)
    mean = sums[0] / n
    return np.concatenate([mean, np.sqrt(np.maximum(sums[1] / n - mean * mean, 0))]).astype(np.float32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = _index_vectors()
    total = np.zeros((BUCKETS, DIM), np.int32)
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            low, look = tokens(text.as_py())
            around = index[low] + index[look]
            near = np.zeros_like(around)
            for k in range(1, REACH + 1):
                near[k:] += around[:-k]
                near[:-k] += around[k:]
            np.add.at(total, low, near + index[look])
            np.add.at(total, look, near + index[low])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of unit vectors learned from a bounded set of texts."""
    total = _index_vectors()
    for row in texts.repartition(TASKS).mapInArrow(_contexts, "sums binary").toLocalIterator():
        total = total + np.frombuffer(row.sums, np.int32).reshape(BUCKETS, DIM)
    table = total.astype(np.float32)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


class Network:
    """Two layers, tanh and a logit, with a temperature."""

    def __init__(self, features: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w = [rng.normal(0, features**-0.5, (features, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self.constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the log loss with weight decay, over four fifths; the rest fits the temperature."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = 0.5 if len(y) == 0 else float((y.sum() + 1) / (len(y) + 2))
            return self
        rest = np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x[~rest].mean(0), np.maximum(x[~rest].std(0), 1e-3)
        a, t = (x[~rest] - self.mean) / self.scale, y[~rest]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, EPOCHS + 1):
            w1, b1, w2, b2 = self.w
            h = np.tanh(a @ w1 + b1)
            d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40))) - t) / len(t)
            back = np.outer(d, w2) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * w1, back.sum(0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        z, t = self.logit(x[rest]), y[rest]
        if len(t):
            grid = np.exp(np.linspace(np.log(0.5), np.log(10), 60))
            losses = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in grid]
            self.temperature = float(grid[int(np.argmin(losses))])
        return self


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _pooled(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pool(t.as_py(), table.value) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and the network, from labelled documents that aren't held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most `sample` rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # one text an id: at most `sample`
    # Word vectors come from one half and the network's examples from the other: on its own
    # texts, a table knows every word, which no text that is scored later can match.
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    table = word_vectors(texts.filter(half == 0).select("text"))
    shared = spark.sparkContext.broadcast(table)
    rows = texts.filter(half == 1).mapInArrow(_pooled(shared), "doc_id long, x array<float>").join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in rows], np.float64).reshape(-1, 2 * DIM)
    order = np.random.default_rng(3).permutation(len(rows))
    return table, Network(2 * DIM).fit(x[order], np.array([float(r.quality) for r in rows])[order])


def score(docs: DataFrame, table: np.ndarray, network: Network) -> DataFrame:
    """The columns of ``docs`` in a struct ``doc``, then score."""
    model = docs.sparkSession.sparkContext.broadcast((table, network))
    staged = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.text").cast("string").alias("t"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        for batch in batches:
            x = np.array([pool(t.as_py(), vectors) for t in batch.column(1).cast(pa.binary())], np.float64).reshape(-1, 2 * DIM)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(net.score(x), pa.float64())], schema=batch.schema)

    return staged.mapInArrow(run, staged.schema).select("doc", "score")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, *train(docs, labels)).select(F.col("doc.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
