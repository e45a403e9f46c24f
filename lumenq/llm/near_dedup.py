"""MinHash near-dedup as an inverted join of signature coordinates.

1. Each row becomes the set of hashes of its 5-word shingles and a MinHash signature of
   ``COORDS`` coordinates.  Rows with equal sets form a class, a node from here on.
2. The first ``POSTED`` coordinates of each node are posted as (coordinate, value).
   Values of one node only are dropped; a node left with fewer than ``least`` postings
   can't collide often enough and is skipped, before any pair is made.  Of m postings
   left, the m - least + 1 on the shortest lists are the prefix: nodes that collide
   ``least`` times meet in their prefixes, so longer lists are never read.
3. Stars: every posting list has two heads, its least member and one picked by hash.  A
   node's collisions with heads are counted over its lists and it is paired with the
   ``STAR`` heads that it meets most often.  Pairs are narrow: two longs.  Signatures, then
   full sets join only those pairs; links merge nodes into components, and lists whose
   members are by then all in one component are skipped.
4. What is left are members of different components in one list.  They are not paired by
   these lists, which may be long where many texts share a passage, but posted once more
   under the shingles of their full sets, with the same prefix rule, which is exact there
   and much shorter: only the rarest shingles post, those of one node alone not at all.
   Lists of one component are skipped again; in the others a pair is made unless places in
   the prefix, sizes or ``BITS`` parity bits (sets differ in at least as many shingles as
   bits) rule it out.
   Signatures and sets follow as in step 3.  One round as in step 3 comes first: a list's
   head is its member with the least share of shingles of its own and only nodes of other
   components are paired with it.  That member is the nearest to the common origin of a group
   of near copies, and so to copies that are far from each other: what links to it comes
   together by pairs that grow with the group's size.  Pairs just below ``percent`` stay open
   and still grow with the square.
5. Every link is confirmed on the full sets: 100 * intersection >= percent * union.

``least`` and the signatures' match threshold come from ``percent``: a pair at just that
similarity is lost with a probability of at most ``LOSS`` by either.  No list, group or
candidate is capped.

Defined results: a document without words has no shingles, no links and is kept; a
null doc_id links with nothing, has no component and is kept; rows with equal doc_id are
tied together with all their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch, short_batches, small
from lumenq.llm._text import mix, shingle_set

WIDTH, PERCENT = 5, 75
COORDS, POSTED = 128, 64
STAR = 4
BITS = 2048
LOSS = 1e-8
ROWS = 256  # rows that a Python worker holds in its own form at a time
_RNG = np.random.default_rng(977)
_MUL = (_RNG.integers(0, 2**31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, COORDS, dtype=np.uint32)[:, None]


def fewest(coords: int, percent: int) -> int:
    """The matches of ``coords`` coordinates that a pair at ``percent`` falls short of with a probability of ``LOSS`` at most."""
    p, below = percent / 100, 0.0
    for k in range(coords + 1):
        below += math.comb(coords, k) * p**k * (1 - p) ** (coords - k)
        if below > LOSS:
            return k
    return coords


def signature(shingles: np.ndarray) -> np.ndarray:
    """The shingle (its 64-bit hash) that comes first under each coordinate's 32-bit order."""
    best = np.full(COORDS, 2**32 - 1, np.uint32)
    out = np.full(COORDS, shingles[0], np.uint64)
    rows = np.arange(COORDS)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        h = (part >> np.uint64(32)).astype(np.uint32)[None, :] * _MUL
        h += _ADD
        first = h.argmin(axis=1)
        low = h[rows, first]
        better = low < best
        best[better] = low[better]
        out[better] = part[first[better]]
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` buckets, whether an odd number of the shingles falls into it; packed."""
    bucket = (mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set of shingles."""
    h = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64)
    return int(h[0]), int(h[1])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coord = np.arange(POSTED, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in _pieces(batches):
        n, prints, posts, packed, odd = [], [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), WIDTH)
            n.append(len(s))
            prints.append(_print(s))
            sig = signature(s) if len(s) else None
            posts.append(None if sig is None else mix(sig[:POSTED] + coord).view(np.int64))
            packed.append(None if sig is None else sig.astype(np.uint16).view(np.int64))
            odd.append(None if sig is None else parities(s))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (posts, packed, odd)]
        c1, c2 = (pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), c1, c2, *lists], ["doc_id", "n", "c1", "c2", "posts", "sig", "odd"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        sets = [shingle_set(t.as_py(), WIDTH) for t in batch.column(0)]
        prints = [_print(s) for s in sets]
        c1, c2 = (pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([c1, c2, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c1", "c2", "set"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp of the nodes on edges (a, b): the least node reachable.

    Each node takes the least label next to it, then the label of that label; a round
    writes one table, and rounds go on until one changes nothing.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    table = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("new")), "labels")
    while True:
        labels = table.select("node", F.col("new").alias("comp"))
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        near = near.select(F.col("a").alias("node"), "near").join(labels, "node").select("node", "comp", F.least("comp", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("comp").alias("jump"))
        step = near.join(jump, "best", "left").select("node", F.least("best", F.coalesce("jump", "best")).alias("new"), "comp")
        step = scratch.save(step, "labels")
        done = step.filter("new <> comp").isEmpty()
        scratch.drop(table)
        table = step
        if done:
            scratch.drop(both)
            return table.select("node", F.col("new").alias("comp"))


def _matches(a: str, b: str):
    """In how many of the 16-bit values, packed by four, two signatures agree."""
    same = lambda x, k: (F.shiftright(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
    each = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    return F.aggregate(each, F.lit(0), lambda n, x: n + same(x, 0) + same(x, 1) + same(x, 2) + same(x, 3))


def _near_enough(n1: str, n2: str, odd1: str, odd2: str, percent: int):
    """False only for sets whose sizes, or parities of bits, rule the similarity out."""
    bits = sum((F.bit_count(F.get(odd1, F.lit(i)).bitwiseXOR(F.get(odd2, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (bits * (100 + percent) <= (F.col(n1) + F.col(n2)) * (100 - percent))


def _ends(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both ends, numbered 1 and 2."""
    for k, end in ((1, "a"), (2, "b")):
        pairs = pairs.join(table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}{k}") for c in columns]).hint("merge"), end)
    return pairs


def _links(pairs: DataFrame, info: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; signatures are compared first."""
    pairs = scratch.save(pairs, "pairs")
    likely = _ends(pairs, info, ["n", "sig", "odd"]).filter(_near_enough("n1", "n2", "odd1", "odd2", percent))
    likely = scratch.save(likely.filter(_matches("sig1", "sig2") >= fewest(COORDS, percent)).select("a", "b"), "likely")
    both = _ends(likely, sets, ["set"])
    inter = F.size(F.array_intersect("set1", "set2"))
    union = F.size("set1") + F.size("set2") - inter
    links = scratch.save(both.filter(inter * 100 >= union * percent).select("a", "b"), "links")
    scratch.drop(pairs, likely)
    return links


def _star(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of each node and the heads that it meets in most of its lists."""
    heads = lists.groupBy("p").agg(F.min("node").alias("head"), F.min_by("node", F.xxhash64("p", "node")).alias("other"))
    met = lists.join(scratch.save(heads, "heads"), "p").select("node", F.explode(F.array("head", "other")).alias("h")).filter("node <> h")
    return _most_met(met)


def _most_met(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node and the ``STAR`` heads h that it meets most often."""
    # A node has at most two heads for each posting, so its group is bounded.
    most = met.groupBy("node", "h").agg(F.count("*").alias("c")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "h"))).alias("all"))
    picked = most.select("node", F.explode(F.slice("all", 1, STAR)["h"]).alias("h"))
    return picked.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()


def _open(lists: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows, with comp, of the lists that hold more than one component."""
    known = lists.join(comp, "node")
    mixed = known.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("p")
    return scratch.save(known.join(scratch.save(mixed, "mixed"), "p").select(*lists.columns, "comp"), "open")


def _rare(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """p, node, n, alone, at, inner: the rarest shingles of the nodes in ``rows``, by their place in the order of rarity.

    Of a similar pair the larger set shares percent of its n shingles, so it has a shared one
    among its n - percent of n + 1 rarest; the smaller set shares 2 percent / (1 + percent) of
    its own, which leaves fewer still, the inner ones.  Shingles that one node alone has come
    first and post nothing; alone is their number.
    """
    nodes = rows.select("node").distinct()
    each = sets.join(nodes, "node").select("node", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    shared = each.join(often.hint("merge"), "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all"))
    prefix = lambda part, of: F.col("n") - F.ceil(F.col("n") * part / of).cast("int") + 1
    few = shared.withColumns({"alone": F.col("n") - F.size("all"), "outer": prefix(percent, 100), "inner": prefix(2 * percent, 100 + percent)})
    few = few.filter("outer > alone").select("node", "n", "alone", "inner", F.posexplode(F.slice("all", F.lit(1), F.col("outer") - F.col("alone"))["s"]).alias("at", "p"))
    return few.select("p", "node", "n", "alone", (F.col("alone") + F.col("at") + 1).alias("at"), (F.col("alone") + F.col("at") < F.col("inner")).alias("inner"))


def _central(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of each node and heads of its lists in other components, the heads with the least share of shingles alone."""
    order = [(F.col("alone") / F.col("n")).alias("share"), F.xxhash64("node").alias("order"), F.col("node").alias("h"), F.col("comp").alias("of")]
    heads = rows.groupBy("p").agg(F.min(F.struct(*order)).alias("head"))
    met = rows.join(scratch.save(heads.select("p", "head.h", "head.of"), "heads"), "p").filter("comp <> of").select("node", "h")
    return _most_met(met)


def _gather(rows: DataFrame, labels: DataFrame, info: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """The open rows and components after a round of central heads."""
    found = _links(_central(rows, scratch), info, sets, scratch, percent)
    labels, old = _merge(labels, found, scratch), rows
    rows = _open(old.drop("comp"), labels, scratch)
    scratch.drop(old, found)
    return rows, labels


def _rest(rows: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list: inner postings of the smaller set and any of the larger."""
    full = rows.join(info.select("node", "odd"), "node")
    side = lambda part, k: part.select("p", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "comp", "at", "odd")])
    left, right = side(full.filter("inner"), 1), side(full, 2)
    most = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) + 1  # shingles that can be shared from here on
    cond = (
        (left["p"] == right["p"])
        & (F.struct("n1", "node1") < F.struct("n2", "node2"))
        & (F.col("comp1") != F.col("comp2"))
        & (most * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)
        & _near_enough("n1", "n2", "odd1", "odd2", percent)
    )
    return left.join(right.hint("merge"), cond).select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the components of their ends."""
    for end in ("a", "b"):
        known_as = labels.select(F.col("node").alias(end), F.col("comp").alias("_comp"))
        edges = edges.join(known_as, end, "left").withColumn(end, F.coalesce("_comp", end)).drop("_comp")
    return edges.select("a", "b").filter("a <> b")


def _merge(labels: DataFrame, late: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after late links between them."""
    edges = scratch.save(_relabel(late, labels), "late")
    if edges.isEmpty():
        return labels
    merged = scratch.save(components(edges, scratch).withColumnRenamed("comp", "best"), "merged")
    old = labels.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("best", "comp").alias("comp"))
    # Nodes that have late links only.
    new = merged.join(labels.select("node"), "node", "left_anti").select("node", F.col("best").alias("comp"))
    return scratch.save(old.unionByName(new), "labels")


def near_dups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    ``percent`` may be any similarity at which a pair is bound to collide: from 25 to 100.
    """
    least = fewest(POSTED, percent)
    if not (least >= 1 and percent <= 100):
        raise ValueError(f"signatures of {POSTED} postings can't promise links at {percent} percent")
    scratch = Scratch(df.sparkSession, "near")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = docs.mapInArrow(_sign, "doc_id long, n long, c1 long, c2 long, posts array<long>, sig array<long>, odd array<long>")
    # Rows are numbered as they are written, so the numbers stay.
    with short_batches(df.sparkSession):
        signed = scratch.save(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    known = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = scratch.save(known.groupBy("c1", "c2").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")), "classes")
    members = scratch.save(known.select("doc_id", "n", "row", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "n", "row", "node", "rep"), "members")
    # A class posts once, whatever the number of its copies; only few numbers of copies are broadcast.
    copies = members.filter("row <> node").select("row")
    posted = known.select("row", "posts").join(small(copies), "row", "left_anti").select(F.col("row").alias("node"), F.explode("posts").alias("p"))
    shared = posted.withColumn("df", F.count("*").over(Window.partitionBy("p"))).filter("df > 1")
    kept = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "p"))).alias("all")).filter(F.size("all") >= least)
    kept = scratch.save(kept.select("node", F.slice("all", F.lit(1), F.size("all") - least + 1)["p"].alias("ps")), "postings")
    n_kept = kept.count()
    labels = members.select("node", F.col("node").alias("comp")).limit(0)
    if n_kept:
        ids = kept.select("node")
        wide = signed.select(F.col("row").alias("node"), "n", "c1", "c2", "sig", "odd")
        info = scratch.save(wide.join(small(ids, n_kept), "node", "left_semi").join(kept.hint("merge"), "node"), "candidates")
        # Full sets are made for nodes that share postings only; their texts are picked where they lie.
        reps = scratch.save(classes.join(small(ids, n_kept), "node", "left_semi").select(F.col("rep").alias("doc_id")), "reps").distinct()
        chosen = docs.join(small(reps, n_kept), "doc_id", "left_semi").select("text")
        sets = chosen.mapInArrow(_sets, "c1 long, c2 long, set array<long>").groupBy("c1", "c2").agg(F.first("set").alias("set"))
        with short_batches(df.sparkSession):
            sets = scratch.save(sets.join(info.select("node", "c1", "c2"), ["c1", "c2"]).select("node", "set"), "sets")
        lists = info.select("node", F.explode("ps").alias("p"))
        linked = components(_links(_star(lists, scratch), info, sets, scratch, percent), scratch)
        labels = scratch.save(ids.join(linked, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")
        rows = _open(lists, labels, scratch)
        if not rows.isEmpty():
            rows = _open(scratch.save(_rare(rows, sets, percent), "rare"), labels, scratch)
            rows, labels = _gather(rows, labels, info, sets, scratch, percent)
            labels = _merge(labels, _links(_rest(rows, info, percent), info, sets, scratch, percent), scratch)
        scratch.drop(sets, info)
    # A doc_id with several texts stands for several nodes and ties them together.
    ties = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    ties = members.select("doc_id", F.col("node").alias("b")).join(ties, "doc_id").select("a", "b").filter("a <> b").distinct()
    labels = _merge(labels, ties, scratch)
    # A component is called by the least doc_id of its nodes.
    named = labels.join(classes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = scratch.save(labels.join(named, "comp").select("node", "component_id"), "named")
    out = members.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    none = signed.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""
