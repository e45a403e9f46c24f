"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Every document has a point in [0, 2^48) from the MD5 of its id (of its text, if the id
is null).  A source's target is
met by whole copies of all its documents plus those below a threshold of the point.
Thresholds come from histograms of sizes by source and bucket: the bucket in which a
budget ends is found on cumulated sums, then only that bucket is split into finer
ones, twice.  Nothing is sorted by document and no document is gathered.

Targets share the total of all sizes by weight; a source stops at ``most`` times its
own size and the excess goes to the others by weight (a water level, solved on one row
per source).

Defined results: a null text has size 0; a null source is a source, ranked last; a
source without words has target 0 and takes nothing; rows with equal doc_id share a
point and so stand or fall together, as do equal texts without a doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch, small

LEVELS = 3  # histograms: one over each source, then two of the boundary bucket alone
BITS = 12  # of the point, for each level
MOST = 3  # copies of a document, and target over size of a source
WORD_SPACE = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_SPACE[1:-1]}]+")), F.lit(0)).cast("long")


def _point(doc_id: Column, text: Column) -> Column:
    """A point in [0, 2^48) of the id, or of the text where there is no id: many null ids must not fall on one point."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 12), 16, 10).cast("long")


def _by_source(df: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """Join a table with a row per source; null is a source too."""
    return df.join(small(table, rows), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size -> also weight and target; a row per source."""
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    level = Window.orderBy(F.col("source_size") * F.lit(float(most)) / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    staged = ranked.select(
        "*",
        (F.sum("source_size").over(everyone) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("free"),
    )
    # Sources are filled in the order in which they reach their caps.
    fits = F.col("left") * F.col("weight") <= F.col("source_size") * most * F.col("free")
    staged = staged.withColumn("at", F.row_number().over(level)).withColumn("fits", fits)
    first = F.min(F.when(F.col("fits"), F.struct("at", "left", "free"))).over(everyone)
    return staged.withColumn("first", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("source_size") * F.lit(float(most)))
        .otherwise(F.col("first.left") * F.col("weight") / F.col("first.free"))
        .alias("target"),
    )


def thresholds(sized: DataFrame, most: int = MOST) -> tuple[DataFrame, int]:
    """From source, size, point: a row per source with target, whole copies and threshold, and the number of rows."""
    scratch = Scratch(sized.sparkSession, "mix")
    bucket = lambda level: F.shiftright("point", 48 - BITS * (level + 1))
    # The first histogram also holds the sources' sizes.
    counted = scratch.save(sized.groupBy("source", bucket(0).alias("b")).agg(F.sum("size").alias("words")), "histogram")
    table = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    whole = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size"))).cast("int")
    table = table.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0))
    table = table.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    table = scratch.save(table, "targets")
    rows = table.count()
    for level in range(LEVELS):
        if level:
            inside = _by_source(sized, table.select(F.col("source").alias("_s"), "prefix"), rows)
            inside = inside.filter(bucket(level - 1) == F.col("prefix"))
            counted = scratch.save(inside.groupBy("source", bucket(level).alias("b")).agg(F.sum("size").alias("words")), "boundary")
        run = Window.partitionBy("source").orderBy("b")
        summed = counted.select(F.col("source").alias("_s"), "b", F.sum("words").over(run).alias("upto"), "words")
        joined = summed.join(small(table.select("source", "need"), rows), F.col("source").eqNullSafe(F.col("_s")))
        last = level == LEVELS - 1
        # The budget ends in the first bucket that reaches it; at the last level, a bucket goes in if that comes nearer.
        reach = F.col("upto") - F.col("words") / 2 > F.col("need") if last else F.col("upto") > F.col("need")
        edge = joined.filter(reach).groupBy("_s").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("below"))).alias("edge"))
        table = table.join(small(edge, rows), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        # Without such a bucket, everything below the end of the range goes in.
        end = F.shiftleft(F.col("prefix") + 1, BITS) if level else F.lit(1 << BITS).cast("long")
        table = table.select(
            "source",
            "source_size",
            "target",
            "whole",
            F.greatest(F.lit(0.0), F.col("need") - F.coalesce("edge.below", F.lit(0))).alias("need"),
            F.coalesce("edge.b", end).alias("prefix"),
        )
        table = scratch.save(table, f"level{level}")
    return table.select("source", "source_size", "target", "whole", F.shiftleft("prefix", 48 - BITS * LEVELS).alias("threshold")), rows


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", most: int = MOST) -> DataFrame:
    """The columns of ``df`` in a struct ``doc``, then size, source_size, target and copies."""
    sized = df.select(F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), _point(F.col(doc_id), F.col(text)).alias("point"))
    sized = Scratch(df.sparkSession, "mix").save(sized, "sizes")
    table, rows = thresholds(sized, most)
    docs = df.select(F.struct("*").alias("doc"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), _point(F.col(doc_id), F.col(text)).alias("point"))
    out = _by_source(docs, table.withColumnRenamed("source", "_s"), rows)
    copies = F.least(F.lit(most), F.col("whole") + (F.col("point") < F.col("threshold")).cast("int"))
    return out.select("doc", "source", "size", "source_size", "target", copies.alias("copies"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # The digest needs no texts, so documents are read once, for their sizes.
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _point(F.col("doc_id"), F.col("text")).alias("point"))
    sized = Scratch(spark, "mix").save(sized, "sizes")
    table, rows = thresholds(sized)
    out = _by_source(sized, table.withColumnRenamed("source", "_s"), rows)
    copies = F.least(F.lit(MOST), F.col("whole") + (F.col("point") < F.col("threshold")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def _level(level: int) -> str:
    return f"(point >> {48 - BITS * (level + 1)})"


def _step(level: int) -> str:
    reach = "upto - words / 2.0 > need" if level == LEVELS - 1 else "upto > need"
    inside = f"WHERE {_level(level - 1)} = prefix" if level else ""
    end = f"((prefix + 1) << {BITS})" if level else f"{1 << BITS}"
    return f"""
h{level} AS (SELECT d.source, {_level(level)} AS b, sum(size) AS words FROM d JOIN t{level} t ON d.source IS NOT DISTINCT FROM t.source {inside} GROUP BY 1, 2),
u{level} AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY b) AS upto FROM h{level}),
e{level} AS (SELECT u.source, min(b) AS b, min_by(upto - words, b) AS below FROM u{level} u JOIN t{level} t ON u.source IS NOT DISTINCT FROM t.source WHERE {reach} GROUP BY 1),
t{level + 1} AS (SELECT t.source, source_size, target, whole, greatest(0.0::DOUBLE, need - coalesce(below, 0)) AS need, coalesce(b, {end}) AS prefix FROM t{level} t LEFT JOIN e{level} e ON t.source IS NOT DISTINCT FROM e.source),"""


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{WORD_SPACE}+'), lambda x: x <> '')) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12))::BIGINT AS point
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY source_size * {MOST}::DOUBLE / weight, source NULLS LAST) AS pos,
    CAST(sum(source_size) OVER () AS BIGINT) - {MOST} * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size * {MOST}::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * {MOST}::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM r
), f AS (SELECT min(pos) AS k, min_by(rest, pos) AS rest, min_by(free, pos) AS free FROM l WHERE rest * weight <= source_size * {MOST} * free),
g AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR pos < f.k THEN source_size * {MOST}::DOUBLE ELSE f.rest * weight / f.free END AS target FROM l, f),
t0 AS (SELECT *, target - whole * source_size AS need, 0 AS prefix FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(least({MOST}, floor(target / source_size)) AS INTEGER) ELSE 0 END AS whole FROM g)),
{"".join(_step(i) for i in range(LEVELS))}
z AS (SELECT d.*, source_size, target, CAST(least({MOST}, whole + CASE WHEN point < prefix << {48 - BITS * LEVELS} THEN 1 ELSE 0 END) AS INTEGER) AS copies
  FROM d JOIN t{LEVELS} t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM z
"""
