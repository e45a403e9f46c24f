r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are lower-cased runs of ASCII letters and digits or non-ASCII characters.  A
pattern is a run of ten consecutive words of a benchmark item, or a whole shorter item.
For each pattern length a shift table over blocks of two words says how far the search
may skip; where it may not, the block's suffix bucket lists the patterns to compare
word by word.  Documents are searched whole where they lie: nothing is shuffled.

The benchmark is cut into pieces of at most ``PIECE`` words that overlap by a window less
one, and the pieces are dealt to blocks of about ``BLOCK_BYTES``; tasks get a block's text and
build its tables themselves.  A benchmark of one block is searched for in one pass that
shuffles nothing.  A larger one takes a pass a block, each written as rows of hits only, and
the hits of all passes are merged by row at the end: what is broadcast stays bounded
however large the benchmark is, and no number of blocks is too many.

Defined results: null texts have no words, items without words no pattern, so neither
is ever hit; repeated rows are judged one by one; a null item_id counts as ''.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch

WINDOW = 10
BLOCK_BYTES = 2_000_000
PIECE = 4096
_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_TABLE = bytes(32 if c in _OTHER else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_TABLE).split()


class WuManber:
    """Search for word sequences of several lengths."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for p, items in patterns.items():
            by_length.setdefault(len(p), {})[p] = items
        self.tables = []
        for m, group in sorted(by_length.items()):
            block = min(2, m)
            far = m - block + 1
            shift: dict = {}
            suffix: dict = {}
            for p, items in group.items():
                for end in range(block, m + 1):
                    key = p[end - 1] if block == 1 else (p[end - 2], p[end - 1])
                    shift[key] = min(shift.get(key, far), m - end)
                suffix.setdefault(key, []).append((list(p), items))
            self.tables.append((m, block, far, shift, suffix))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of every occurrence."""
        n = len(words)
        for m, block, far, shift, suffix in self.tables:
            i = m - 1
            if block == 1:
                for i, w in enumerate(words):
                    if w in shift:
                        for _, items in suffix[w]:
                            yield i, 1, items
                continue
            get = shift.get
            while i < n:
                key = (words[i - 1], words[i])
                skip = get(key, far)
                if skip:
                    i += skip
                    continue
                at = i - m + 1
                for p, items in suffix[key]:
                    if words[at : i + 1] == p:
                        yield at, m, items
                i += 1


def item_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


def _join_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> tuple[DataFrame, int]:
    """Pieces of items (id, t, block), and the number of blocks."""
    lower = F.translate(F.coalesce(F.col(item_text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1), F.lit(PIECE))
    pieces = items.select("id", "w", F.explode(starts).alias("at"))
    pieces = pieces.select("id", F.array_join(F.slice("w", F.col("at"), F.lit(PIECE + window - 1)), " ").alias("t")).distinct()
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("id") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    return pieces.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n))), n


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns of ``df`` in a struct ``doc``, then n_words, spans of hit words and items."""
    spark = df.sparkSession
    pieces, n = _blocks(benchmark, item_id, item_text, window)
    out = df.select(F.struct("*").alias("doc")).select("doc", F.col(f"doc.{text}").cast("string").alias("t"))
    empty = (F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"))

    def search(rows: DataFrame, block: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast([(r.id, r.t.encode()) for r in block.toLocalIterator()])
        rows = rows.select("*", *empty)
        return rows.mapInArrow(_search(held, window), rows.schema).drop("t")

    if n == 1:
        return search(out, pieces)
    scratch = Scratch(spark, "leaks")
    pieces = scratch.save(pieces, "pieces")
    docs = scratch.save(out.withColumn("row", F.monotonically_increasing_id()), "documents")  # numbered once, as written
    hits = None
    for k in range(n):
        found = search(docs.select("row", "t"), pieces.filter(F.col("block") == k))
        found = scratch.save(found.filter(F.size("items") > 0) if k else found, "hits")  # the first pass counts words
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return docs.join(hits, "row").select("doc", "n_words", _merged("spans").alias("spans"), "items")


def _merged(spans: str):
    """Spans in order, those that touch or overlap as one."""
    none = F.array().cast("array<array<int>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when(F.size(done) == 0, F.array(s)).when(s[0] <= F.try_element_at(done, F.lit(-1))[1], grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def _search(held, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = WuManber(item_patterns(held.value, window))
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            n_words, spans, items = [], [], []
            for text in batch.column(at["t"]).cast(pa.binary()):
                w = words_of(text.as_py())
                hits = list(search.find(w))
                n_words.append(len(w))
                spans.append(_join_spans([[a, a + m] for a, m, _ in hits]))
                items.append(sorted({x for h in hits for x in h[2]}))
            made = {"n_words": pa.array(n_words, pa.int64())} | {k: pa.array(x, batch.schema.field(at[k]).type) for k, x in (("spans", spans), ("items", items))}
            yield pa.RecordBatch.from_arrays([made.get(name, batch.column(i)) for name, i in at.items()], schema=batch.schema)

    return run


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return out.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The query's rows by comparing every window of every item at every position."""
    def tokens(t):
        out, now = [], []
        for c in t or "":
            c = c.lower() if c.isascii() else c
            if ord(c) > 127 or c.isascii() and c.isalnum():
                now.append(c)
            elif now:
                out.append("".join(now))
                now = []
        return out + (["".join(now)] if now else [])

    rows = []
    parsed = [(str(i), tokens(t)) for i, t in items]
    for doc, t in docs:
        w, hit, found = tokens(t), set(), set()
        for i, p in parsed:
            m = min(window, len(p))
            grams = {tuple(p[j : j + m]) for j in range(len(p) - m + 1)} if p else set()
            for j in range(len(w) - m + 1 if p else 0):
                if tuple(w[j : j + m]) in grams:
                    hit.update(range(j, j + m))
                    found.add(i)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return rows
