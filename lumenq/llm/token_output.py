"""Token ids in a binary format of shuffled byte planes.

Texts are encoded where they lie.  Documents are dealt to parts by ranges of doc_id, and
each part is written in ascending order as segments: binary records of about
``SEGMENT_IDS`` ids, each with whole documents, so that a lost task is simply run again
and no file holds half a document.

A segment: magic ``LQT1``; numbers of documents, ids, blocks (u32); per block of
``BLOCK_IDS`` ids the sizes of its four compressed planes (the chunk index, u32); the size
of the document index (u32); the document index (doc_ids, null marks and lengths,
zstandard); the planes.  Plane k holds byte k of every id of the block, compressed by
zstandard: ids below 65,536 leave two planes of zeros that take a few bytes.

Segments are written by Spark's own writer (one binary column and its place), so they
reach any storage that Spark writes to.  Starts are a part's base plus the place in the
part; bases come from one figure per part, of which there are at most ``MOST_PARTS``.

Defined results: a null text is empty and becomes the end id alone; null doc_ids come
first; rows with equal doc_id follow one another by their ids' checksum.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch

BLOCK_IDS, SEGMENT_IDS = 1 << 16, 1 << 20
ROWS_A_PART, MOST_PARTS = 1024, 16384
MEMO = 400_000
END_ID = 2
MAGIC = b"LQT1"
#: Letters for which lower-casing and composing are plain, by character.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = string.punctuation


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(plain)))
    return table


class Encoder(dict):
    """Ids (little-endian u32 bytes) of chunks between ASCII white space, remembered.

    The vocabulary drops white space and never joins text across it, so a text's ids
    are its chunks' ids in order.  Chunks of plain letters go straight to the merge
    model, with or without marks behind them; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = _byte_letters()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        text = chunk.decode("utf-8")
        core = text.rstrip(_MARKS)
        if core and _LETTERS.fullmatch(core):
            if len(core) < len(text):
                ids = self[core.encode()] + self[text[len(core) :].encode()]
            elif (low := core.lower()) != core:
                ids = self[low.encode()]
            else:
                ids = self._pack([t.id for t in self.model.tokenize("".join(map(self.table.__getitem__, chunk)))])
        else:
            ids = self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[chunk] = ids
        return ids

    def agrees(self) -> bool:
        """Whether the tokenizer splits, lowers and joins as the shortcut supposes, on every kind of chunk that it takes."""
        probe = ["The", "naive", "Straße", "ÀÉÎ", "garçon,", "end.", "why?!", "a;b", "x:", "É", "zzzzqj", "Hello", "ÿþ"]
        probe += [f"end{m}" for m in _MARKS] + [f"Été{m}{m}{m}" for m in _MARKS] + ["dogs'", "they're", "it's.", "etc.,***", f"z{_MARKS}"]
        probe += [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        text = " ".join(probe) + "\n" + "  ".join(reversed(probe)) + "\t"
        return np.frombuffer(self.encode(text.encode()), "<u4").tolist() == self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


class Whole:
    """Ids of whole texts, for tokenizers that join text across white space or keep it."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, text: bytes | None) -> bytes:
        return Encoder._pack(self.tokenizer.encode((text or b"").decode("utf-8"), add_special_tokens=False).ids)


_ENCODERS: dict[str, Encoder | Whole] = {}


def encoder_of(path: str) -> Encoder | Whole:
    """The worker's encoder: tasks that it runs one after another share what it remembers."""
    if path not in _ENCODERS:
        fast = Encoder(path)
        _ENCODERS[path] = fast if fast.agrees() else Whole(fast.tokenizer)
    return _ENCODERS[path]


def pack_segment(doc_ids: list[int | None], bodies: list[bytes]) -> bytes:
    """A segment of documents, given their ids as little-endian u32 bytes."""
    ids = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 4)
    press = zstandard.ZstdCompressor(level=3)
    sizes, planes = [], []
    for at in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[at : at + BLOCK_IDS].T)
        for plane in block:
            planes.append(press.compress(plane.tobytes()))
            sizes.append(len(planes[-1]))
    null = np.array([x is None for x in doc_ids], np.uint8)
    index = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + null.tobytes() + np.array([len(b) // 4 for b in bodies], "<u8").tobytes()
    index = press.compress(index)
    head = struct.pack("<4sIII", MAGIC, len(doc_ids), len(ids), len(sizes) // 4) + np.array(sizes, "<u4").tobytes() + struct.pack("<I", len(index))
    return b"".join([head, index, *planes])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a segment."""
    magic, n_docs, n_ids, n_blocks = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    sizes = np.frombuffer(data, "<u4", 4 * n_blocks, 16)
    at = 16 + 16 * n_blocks
    (n_index,) = struct.unpack_from("<I", data, at)
    open_ = zstandard.ZstdDecompressor()
    index = open_.decompress(data[at + 4 : at + 4 + n_index])
    docs = np.frombuffer(index, "<i8", n_docs)
    null = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    lengths = np.frombuffer(index, "<u8", n_docs, 9 * n_docs)
    at += 4 + n_index
    ids = np.empty((n_ids, 4), np.uint8)
    for k in range(n_blocks):
        for plane in range(4):
            size = int(sizes[4 * k + plane])
            raw = open_.decompress(data[at : at + size])
            ids[k * BLOCK_IDS : k * BLOCK_IDS + len(raw), plane] = np.frombuffer(raw, np.uint8)
            at += size
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], lengths.astype(np.int64), ids.reshape(-1).view("<u4")


def _encode(path: str, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            bodies = [encoder.encode(t.as_py()) + end for t in batch.column(1).cast(pa.binary())]
            ids = batch.column(0)
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, ids.fill_null(0).to_numpy(), side="left"))
            packed = [np.frombuffer(b, "<u4") for b in bodies]
            # Two bytes an id where that holds them; the first byte says which.
            packed = [b"\x02" + p.astype("<u2").tobytes() if p.max() < 65536 else b"\x04" + p.tobytes() for p in packed]
            columns = [pa.array(part, pa.int32()), ids, pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "crc", "ids"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "first", "n_ids", "data"]
    part, first, n, docs, bodies = None, 0, 0, [], []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([pack_segment(docs, bodies)], pa.binary())], names)

    for batch in batches:
        for p, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            raw = x.as_py()
            body = np.frombuffer(raw[1:], "<u2").astype("<u4").tobytes() if raw[0] == 2 else raw[1:]
            if docs and (p != part or n >= SEGMENT_IDS):
                yield flush()
                first, docs, bodies = first + n, [], []
                n = 0
            if p != part:
                part, first = p, 0
            docs.append(d)
            bodies.append(body)
            n += len(body) // 4
    if docs:
        yield flush()


def write_tokens(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write segments, in ascending doc_id order, under ``path``."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = docs.count()
    parts = max(1, min(MOST_PARTS, n // ROWS_A_PART))
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    rows = docs.mapInArrow(_encode(tokenizer, sorted({int(b) for b in bounds})), "part int, doc_id long, crc long, ids binary")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts // 4))
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "crc")
    rows.mapInArrow(_segments, "part int, first long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, lengths, ids = unpack_segment(data.as_py())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(docs, pa.int64()), pa.array(base + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segments."""
    segments = spark.read.parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # at most MOST_PARTS rows
    base, bases = 0, []
    for r in sizes:
        bases.append((r.part, base))
        base += r.n
    table = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return segments.join(table, "part").select((F.col("base") + F.col("first")).alias("start"), "data").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = Scratch(spark, "tokens").path("segments")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
