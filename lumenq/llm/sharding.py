"""Resharding by minimum-cost flow: near-equal bytes, fewest bytes moved.

Rows lie in old shards, each cut into hash blocks.  One aggregation gives the bytes and
rows of every (old shard, block), a number of figures that doesn't grow with the input;
these alone go to the driver.  A minimum-cost flow from old shard sizes to new capacities
(a byte that stays costs 0, one that moves costs 1) says how many bytes each old shard
sends to each new one; blocks are dealt to those amounts in the order of the files that
hold them, so that few files are touched, and single blocks are moved until that evens
the shards no more.  Rows follow their block by a broadcast of that bounded table, and
slots are counted per block, so no task holds a shard.

``lay_out`` writes a table in shards, ``reshard_files`` solves the transfers for another
number of shards and rewrites only the files that hold a block that moves; a numbered
manifest names the files of each shard, so that readers see the old layout or the new
one, and files of untouched shards stay as they are.  ``read_shards`` reads it back.

Defined results: a null text has 0 bytes; equal rows share a block, but rows without an id
are dealt by their place in the input; slots within a block go by id, size and checksum,
so that reruns agree on everything that can be told apart.  All columns, whatever their
names, come back from the files.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch, file_system, shuffles_end

N_OLD, N_NEW, BLOCKS, PARTS = 16, 24, 1024, 8
OVERHEAD = 8  # bytes a row takes besides its text


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving as few as can be.

    Successive shortest paths on the bipartite network source -> old -> new -> sink,
    with cost 0 where old and new are the same shard and 1 elsewhere.
    """
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, room, cost, index of the way back]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, int(i != j))
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    potential = [0] * len(graph)
    while True:
        dist, via = [float("inf")] * len(graph), [None] * len(graph)
        dist[s] = 0
        heap = [(0, s)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room and (x := d + cost + potential[a] - potential[b]) < dist[b]:
                    dist[b], via[b] = x, (a, k)
                    heapq.heappush(heap, (x, b))
        if via[t] is None:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        path, b = [], t
        while b != s:
            a, k = via[b]
            path.append((a, k))
            b = a
        push = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= push
            graph[graph[a][k][0]][graph[a][k][3]][1] += push
    return {(i, e[0] - n): supply[i] - e[1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and e[2] >= 0 and supply[i] - e[1] > 0}


def plan(sizes: dict[tuple, int], n_new: int) -> dict[tuple, int]:
    """(old shard, file, block) -> new shard."""
    total = sum(sizes.values())
    supply = [0] * (max((k[0] for k in sizes), default=0) + 1)
    for key, x in sizes.items():
        supply[key[0]] += x
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    room: list[dict[int, int]] = [{} for _ in supply]
    for (i, j), x in min_cost_flow(supply, capacity).items():
        room[i][j] = x
    owner: dict[tuple, int] = {}
    load = [0] * n_new
    for key, x in sorted(sizes.items()):
        i = key[0]
        # What stays comes first, then each target until half a block is all that it still takes.
        targets = sorted(room[i], key=lambda j: (j != i, j))
        j = next((j for j in targets if 2 * room[i][j] >= x), None)
        if j is None:
            j = max(targets, key=lambda j: room[i][j], default=min(range(n_new), key=load.__getitem__))
        owner[key] = j
        room[i][j] = room[i].get(j, 0) - x
        load[j] += x
    held: list[set[tuple[int, tuple]]] = [set() for _ in range(n_new)]
    for key, j in owner.items():
        held[j].add((sizes[key], key))
    touched = {key[:2] for key, j in owner.items() if key[0] != j}
    for _ in range(8 * n_new):  # even out what whole blocks left over, in files that are written anyway where that will do
        hi, lo = max(range(n_new), key=load.__getitem__), min(range(n_new), key=load.__getitem__)
        gap = load[hi] - load[lo]
        fits = [b for b in held[hi] if 0 < b[0] < gap]
        close = [b for b in fits if b[1][:2] in touched and abs(2 * b[0] - gap) <= gap // 2]
        fit = min(close or fits, key=lambda b: (abs(2 * b[0] - gap), b), default=None)
        if fit is None:
            break
        held[hi].remove(fit)
        held[lo].add(fit)
        owner[fit[1]] = lo
        touched.add(fit[1][:2])
        load[hi] -= fit[0]
        load[lo] += fit[0]
    return owner


def _sized(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of ``df`` in a struct ``doc``, then id, size and crc."""
    body = F.coalesce(F.col(f"doc.{text}").cast("string"), F.lit(""))
    return df.select(F.struct("*").alias("doc")).select(
        "doc",
        F.col(f"doc.{doc_id}").alias("id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
    )


def _hash(salt=None):
    return F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "crc", *([salt] if salt is not None else []))


def _slot(first_slot: str, *block: str):
    order = Window.partitionBy(*block).orderBy(F.col("id").asc_nulls_first(), "size", "crc")
    return (F.col(first_slot) + F.row_number().over(order) - 1).alias("slot")


def reshard(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_old: int = N_OLD, n_new: int = N_NEW, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc, id, size, crc, old, block, shard, first_slot), and the moves: old, block, shard, first_slot, bytes, rows.

    Old shards are those of a layout by hash.
    """
    sized = _sized(df, doc_id, text).withColumns({"old": F.pmod(_hash(), F.lit(n_old)).cast("int"), "block": F.pmod(F.shiftright(_hash(), 20), F.lit(blocks)).cast("int")})
    figures = sized.groupBy("old", "block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # at most n_old * blocks rows
    owner = plan({(r.old, 0, r.block): r.b for r in figures}, n_new)
    seen, moves = [0] * n_new, []
    for r in sorted(figures, key=lambda r: (r.old, r.block)):
        j = owner[r.old, 0, r.block]
        moves.append((r.old, r.block, j, seen[j], r.b, r.n))
        seen[j] += r.n
    table = df.sparkSession.createDataFrame(moves, "old int, block int, shard int, first_slot long, block_bytes long, block_rows long")
    return sized.join(F.broadcast(table.select("old", "block", "shard", "first_slot")), ["old", "block"]), table


def reshard_slots(df: DataFrame, **options) -> DataFrame:
    """The columns of ``df``, then shard and slot; columns of those names give way.

    Slots count from 0 in each shard without gaps: a block's first slot is known from the
    figures, and rows are numbered within their block.
    """
    rows, _ = reshard(df, **options)
    own = [F.col("doc")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return rows.select(*own, "shard", _slot("first_slot", "old", "block"))


class Layout:
    """The files of a table in shards: [shard, folder] as the newest manifest has them."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.version, self.held = spark, path.rstrip("/"), 0, {"shards": 0, "folders": []}
        fs, at = file_system(spark, self.path)
        if fs.exists(at):
            names = [f.getPath().getName() for f in fs.listStatus(at)]
            self.version = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
        if self.version:
            self.held = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/manifest-{self.version:08d}.json").collect()))

    def commit(self, shards: int, folders: list[list], schema: str) -> None:
        fs, at = file_system(self.spark, f"{self.path}/manifest-{self.version + 1:08d}.json")
        out = fs.create(at, False)  # of two jobs one fails
        out.write(bytearray(json.dumps({"shards": shards, "folders": folders, "schema": schema}).encode()))
        out.close()
        self.version, self.held = self.version + 1, {"shards": shards, "folders": folders, "schema": schema}

    def write(self, rows: DataFrame) -> list[list]:
        """Write rows with to_shard and to_part; returns the new folders."""
        name = f"g{self.version + 1:08d}"
        with shuffles_end(self.spark):
            # Rebalanced, not repartitioned: a folder larger than a task's share is written by several tasks.
            rows.hint("rebalance", F.col("to_shard"), F.col("to_part")).write.partitionBy("to_shard", "to_part").parquet(f"{self.path}/{name}")
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        out = []
        for s in fs.listStatus(at):
            if s.isDirectory() and "=" in (shard := s.getPath().getName()):
                out += [[int(shard.split("=")[1]), f"{name}/{shard}/{p.getPath().getName()}"] for p in fs.listStatus(s.getPath())]
        return sorted(out)

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        """Rows as written, then folder: the folder's number in the manifest."""
        schema = self.held["schema"] + ", to_shard INT, to_part INT"
        folders = self.held["folders"]
        numbers = list(range(len(folders))) if numbers is None else numbers
        if not numbers:
            return self.spark.createDataFrame([], schema).withColumn("folder", F.lit(0))
        out = None
        for name in sorted({folders[k][1].split("/")[0] for k in numbers}):  # one scan for each generation
            own = [k for k in numbers if folders[k][1].startswith(f"{name}/")]
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{folders[k][1]}" for k in own])
            place = [tuple(int(x.split("=")[1]) for x in folders[k][1].split("/")[1:]) + (k,) for k in own]
            table = F.broadcast(self.spark.createDataFrame(place, "to_shard int, to_part int, folder int"))
            rows = rows.join(table, ["to_shard", "to_part"])
            out = rows if out is None else out.unionByName(rows)
        return out


def lay_out(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shards: int = N_OLD, shard: str | None = None, blocks: int = BLOCKS, parts: int = PARTS) -> Layout:
    """Write ``df`` in shards, by the column ``shard`` (0 to shards - 1) or by hash; returns the layout."""
    layout = Layout(df.sparkSession, path)
    # A row without an id is dealt by its place, which is stored here and so can't change later.
    salt = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    rows = _sized(df, doc_id, text).withColumn("h", _hash(salt))
    own = F.pmod("h", F.lit(shards)).cast("int") if shard is None else F.col(f"doc.{shard}").cast("int")
    rows = rows.select("doc", "id", "size", "crc", F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int").alias("block"), own.alias("to_shard"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" if f.name != "doc" else f"doc {_ddl(f.dataType)}" for f in rows.schema if f.name != "to_shard")
    rows = rows.withColumn("to_part", F.floor(F.col("block") * parts / blocks).cast("int"))
    layout.commit(shards, layout.write(rows), schema)
    return layout


def _ddl(kind) -> str:
    return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in kind.fields) + ">"


def _figures(layout: Layout) -> list:
    """folder, block, bytes and rows of every block: a number that doesn't grow with the rows."""
    return layout.read().groupBy("folder", "block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("folder", "block").collect()


def reshard_files(layout: Layout, n_new: int = N_NEW, parts: int = PARTS) -> dict:
    """Change a layout to ``n_new`` shards; returns bytes, moved bytes, and folders kept and rewritten."""
    folders = layout.held["folders"]
    figures = _figures(layout)
    owner = plan({(folders[r.folder][0], r.folder, r.block): r.b for r in figures}, n_new)
    touched = sorted({k[1] for k, j in owner.items() if k[0] != j})
    kept = [f for k, f in enumerate(folders) if k not in set(touched)]
    made = []
    if touched:
        inside = set(touched)
        moves = [(f, b, j) for (_, f, b), j in owner.items() if f in inside]
        table = F.broadcast(layout.spark.createDataFrame(moves, "folder int, block int, shard int"))
        rows = layout.read(touched).join(table, ["folder", "block"])
        made = layout.write(rows.select("doc", "id", "size", "crc", "block", F.col("shard").alias("to_shard"), F.pmod("folder", F.lit(parts)).alias("to_part")))
    layout.commit(n_new, kept + made, layout.held.get("schema", ""))
    return {"bytes": sum(r.b for r in figures), "moved": sum(r.b for r in figures if (s := folders[r.folder][0]) != owner[s, r.folder, r.block]), "kept": len(kept), "rewritten": len(touched)}


def read_shards(layout: Layout) -> DataFrame:
    """doc (a struct of the table's own columns), id, size, crc, folder, block, shard and the block's first slot, from the layout's files."""
    folders, seen, first = layout.held["folders"], {}, []
    for r in _figures(layout):
        s = folders[r.folder][0]
        first.append((r.folder, r.block, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + r.n
    table = F.broadcast(layout.spark.createDataFrame(first, "folder int, block int, shard int, first_slot long"))
    rows = layout.read().join(table, ["folder", "block"])
    return rows.select("doc", "id", "size", "crc", "folder", "block", "shard", "first_slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents laid out in 16 shards, resharded to 24 by rewriting affected files, and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    layout = lay_out(docs, Scratch(spark, "shards").path("layout"))
    reshard_files(layout)
    rows = read_shards(layout)
    # Sizes and checksums are those of the texts that were read back; texts stay where they are.
    body = F.coalesce("doc.text", F.lit(""))
    rows = rows.select(F.col("doc.doc_id").alias("id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("crc"), "folder", "block", "shard", "first_slot")
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        _slot("first_slot", "folder", "block"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
