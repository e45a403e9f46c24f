r"""Site-relative line frequency, in DataFrame functions only.

A line is boilerplate of a host if it stands on more than ``max_percent`` of the
host's pages, and on ``min_pages`` at least.  Pages are cut into lines at tags and line ends.

Scale: lines are counted by fingerprint before the shuffle, so a host or a line that
holds a third of all rows sends one row per task, and only fingerprints move.  A host's
boilerplate is one list: each of its lines stands on more than ``max_percent`` of the
pages, so a list is shorter than 100 / max_percent times the host's mean number of
distinct lines a page.  The lists are broadcast if counted to hold few fingerprints, and
pages then stay where they are; otherwise pages meet their host's list by sort-merge,
whose hot partitions Spark splits.

Defined results: a null html has no lines; a null or unparsable url belongs to host
''.  Each row counts as a page of its own, repeated rows too, and equal rows get
equal results.  A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch, small

MAX_PERCENT, MIN_PAGES = 20, 3
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
#: Regular expressions taken out of the html, in this order, before it is cut at tags.
UNSEEN = ["(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->"]
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def html_lines(html: Column) -> Column:
    for pattern in UNSEEN:
        html = F.regexp_replace(html, pattern, "\n")
    cut = F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, TRIM, "")), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def _print(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(17), x).alias("b"))


def line_dedup(df: DataFrame, host: Column, lines: Column, max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df``, or those in ``carry``, in a struct ``doc``, then host, n_lines, n_dropped and kept lines."""
    scratch = Scratch(df.sparkSession, "lines")
    host, lines = F.coalesce(host, F.lit("")), F.coalesce(lines, F.array().cast("array<string>"))
    totals = scratch.save(df.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("pages")), "totals")
    posted = df.select(host.alias("host"), F.explode(F.array_distinct(F.transform(lines, _print))).alias("p")).select("host", "p.a", "p.b")
    often = scratch.save(posted.groupBy("host", "a", "b").agg(F.count("*").alias("on")).filter(F.col("on") >= min_pages), "often")
    bad = often.join(small(totals), "host").filter(F.col("on") * 100 > F.col("pages") * max_percent)
    bad = scratch.save(bad.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("drop")), "boilerplate")
    prints = bad.agg(F.sum(F.size("drop"))).first()[0] or 0
    scratch.drop(totals, often)
    pages = df.select(F.struct(*(carry or ["*"])).alias("doc"), host.alias("host"), lines.alias("lines"))
    out = pages.join(small(bad, prints), "host", "left")
    # Long keys first, which Spark meets by a hash set; the whole fingerprint is compared for those found.
    hits = F.array_intersect(F.transform("lines", lambda x: _print(x)["a"]), F.col("drop.a"))
    stays = lambda hits: F.filter("lines", lambda x: ~(F.array_contains(hits, _print(x)["a"]) & F.array_contains("drop", _print(x))))
    # As a lambda's argument the hits of a page are computed once, not once a line.
    clean = F.transform(F.array(hits), stays)[0]
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(clean)
    out = out.select("doc", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), "kept")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = line_dedup(pages, host_of(F.col("url")), html_lines(F.col("html")), carry=["page_id"])
    return out.select(F.col("doc.page_id").alias("page_id"), "host", "n_lines", "n_dropped", F.array_join("kept", "\n").alias("clean_text"))


def _unseen() -> str:
    sql = "coalesce(html, '')"
    for pattern in UNSEEN:
        sql = f"regexp_replace({sql}, '{pattern}', chr(10), 'g')"
    return f"regexp_replace({sql}, '<[^>]*>', chr(10), 'g')"


ORACLE = rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    list_filter(list_transform(string_split({_unseen()}, chr(10)), lambda x: regexp_replace(x, '{TRIM}', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line HAVING count(*) >= {MIN_PAGES}),
b AS (SELECT c.host, list(line) AS drops FROM c JOIN t USING (host) WHERE n * 100 > pages * {MAX_PERCENT} GROUP BY c.host),
k AS (SELECT page_id, p.host, lines, CASE WHEN drops IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(drops, x)) END AS kept FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS clean_text FROM k
"""
