"""Line-first quality rules, in DataFrame functions only and without a shuffle.

Every line is judged first, by punctuation, navigation and boilerplate rules.  Lines
that fail are removed; a document that loses too much of its text that way is
rejected, as is one that fails the base rules on its counts.

Defined results: a null or empty text has no words and no lines, fails the base rules
and has clean text ''.  Rows are judged one by one, so repeated rows get equal
results; all other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
#: Phrases of page furniture, their first letter in either case.
BOILERPLATE = "[Aa]ll rights reserved|[Tt]erms of (use|service)|[Pp]rivacy policy|[Cc]ookie policy|[Uu]ses cookies|[Ll]orem ipsum|[Ee]nable javascript|[Cc]lick here|[Ss]ign up for our|[Ss]ubscribe to our"
#: A phrase above can only stand in a text that holds one of these.
STEMS = ["ll rights res", "erms of ", "rivacy pol", "ookie", "orem ip", "nable java", "lick here", "ign up for", "ubscribe to"]
#: Words that alone make up a line of a menu.
NAVIGATION = "home|menu|login|log in|sign in|sign up|register|next|previous|back|search|contact|contact us|about|about us|sitemap|skip to content|share|print|read more|more"
#: A long line without any of these closes no sentence.
CLOSING = r"[.!?:;…。！？]"
MARKS = r"[!-/:-@\[-`{-~]"
CELLS = "[|»›•·]"
MAX_MARKS = 20  # percent of a line's characters that may be ASCII marks
OPEN_WORDS = 30  # words from which a line has to close a sentence somewhere
MAX_LOST = 50  # percent of a document's non-space characters that its failed lines may hold
MIN_WORDS = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _count(x: Column, pattern: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, f"{pattern}+", ""))


def line_fails(line: Column) -> Column:
    """Whether a line with at least one word fails the rules on marks, closings or menu words."""
    n_words = F.size(F.split(F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+"))
    return (
        (_count(line, MARKS) * 100 > F.length(line) * MAX_MARKS)
        | (~line.rlike(CLOSING) & (n_words >= OPEN_WORDS))
        | ((F.length(line) <= 24) & F.lower(line).rlike(f"^{SPACE}*({NAVIGATION}){SPACE}*$"))
    )


def line_is_furniture(line: Column) -> Column:
    """The rules on cells and phrases, for documents that hold a cell mark or a phrase's stem at all."""
    n_words = F.size(F.split(F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+"))
    n_cells = F.size(F.split(line, CELLS))
    return ((n_cells >= 4) & (n_words <= n_cells * 4)) | line.rlike(BOILERPLATE)


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` in a struct ``doc``, then the counts, the verdict and the clean text."""
    t = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    staged = df.select(F.struct("*").alias("doc")).select("doc", t.alias("t"))
    furniture = F.col("t").rlike(CELLS)
    for stem in STEMS:
        furniture = furniture | F.col("t").contains(stem)
    staged = staged.select(
        "doc",
        words(F.col("t")).alias("w"),
        _count(F.col("t"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")).alias("lines"),
        furniture.alias("furniture"),
    )
    n = F.size("w")
    staged = staged.select(
        "doc",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "lines",
        n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("furniture"), F.filter("lines", lambda x: ~(line_fails(x) | line_is_furniture(x)))).otherwise(F.filter("lines", lambda x: ~line_fails(x))).alias("good"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("tri"),
    )
    # Only where some window stands twice are windows sorted; equal ones then stand side by side.
    repeats = F.size(F.array_distinct("tri")) < F.size("tri")
    staged = staged.withColumn("tri", F.when(repeats, F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        "tri",
        lambda x, i: F.coalesce(F.get("tri", i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("tri", i - 1)["h"] == x["h"], F.lit(False)),
    )
    good_chars = F.length(F.regexp_replace(F.array_join("good", ""), f"{SPACE}+", "")).cast("long")
    staged = staged.select(
        "*",
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"),
        F.when(F.size("good") == F.size("lines"), F.col("word_chars")).otherwise(good_chars).alias("kept_chars"),
    )
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    staged = staged.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    lost = F.col("word_chars") - F.col("kept_chars")
    return staged.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (lost * 100 <= F.col("word_chars") * MAX_LOST)).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        "kept_chars",
        F.array_join("good", "\n").alias("clean_text"),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "kept_chars"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(F.col("doc.doc_id").alias("doc_id"), *COLUMNS)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), e AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE[1:-1]}]')) AS lines
  FROM d
), g AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri,
    list_filter(lines, lambda x: NOT (
        (length(x) - length(regexp_replace(x, '{MARKS}+', '', 'g'))) * 100 > length(x) * {MAX_MARKS}
        OR (len(string_split_regex(regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+')) >= {OPEN_WORDS} AND NOT regexp_matches(x, '{CLOSING}'))
        OR (len(string_split_regex(x, '{CELLS}')) >= 4 AND len(string_split_regex(regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+')) <= 4 * len(string_split_regex(x, '{CELLS}')))
        OR (length(x) <= 24 AND regexp_matches(lower(x), '^{SPACE}*({NAVIGATION}){SPACE}*$'))
        OR regexp_matches(x, '{BOILERPLATE}'))) AS good
  FROM e
), x AS (
  SELECT doc_id AS id, t AS body, unnest(tri) AS g3, unnest(range(1, len(tri) + 1)) AS i FROM (SELECT DISTINCT doc_id, t, tri FROM g)
), y AS (
  SELECT id, body, i FROM (SELECT *, count(*) OVER (PARTITION BY id, body, g3) AS c FROM x) WHERE c > 1
), z AS (
  SELECT id, body, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM y, (VALUES (0), (1), (2)) AS v(k) GROUP BY id, body
), r AS (
  SELECT g.*, coalesce(z.n, 0) AS n_repeat_words,
    CAST(length(regexp_replace(t, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(array_to_string(good, ''), '{SPACE}+', '', 'g')) AS BIGINT) AS kept_chars
  FROM g LEFT JOIN z ON g.doc_id IS NOT DISTINCT FROM z.id AND g.t = z.body
)
SELECT doc_id, n_words, word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  n_repeat_words,
  n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50) AND (word_chars - kept_chars) * 100 <= word_chars * {MAX_LOST} AS kept,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(good) AS BIGINT) AS n_lines_removed,
  kept_chars
FROM r
"""
