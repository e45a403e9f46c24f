r"""Chat formatting checked by a grammar round trip, in DataFrame functions only.

Template: every turn is ``### <role>: <text></turn>`` and a line end.  A conversation is
rendered as it is, parsed again by the deterministic grammar below and compared with its
turns; conversations that come back different are rendered again with their conflicting
roles and texts escaped, and only what then parses to the source is returned.

Grammar: cut at ``</turn>`` plus line end; drop ``### ``; the role ends at the first
``: ``; a role or text that holds a raw ``</turn>`` or ``### ``, or a text that starts with
``: ``, is no turn; then undo the escapes ``\e`` (``</turn>``), ``\h`` (``### ``), ``\c``
(``: ``) and ``\b`` (a backslash).  Escaped text holds no control string, and each of its
backslashes starts an escape, so a second rendering always parses back, and no mark
stands in the output but those of the template.

One output row holds a whole conversation, which is what formatting is for; turns are
gathered by the hash of conv_id.

Defined results: null text and role count as empty; turns sort by turn (nulls first),
then role and text, so ties and repeated rows have one order; turns with a null conv_id
form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE, OPEN, SEP = "</turn>", "### ", ": "
END = CLOSE + "\n"
#: Escapes in the order in which they are undone; applied from the last to the first.
ESCAPES = [("\\e", CLOSE), ("\\h", OPEN), ("\\c", SEP), ("\\b", "\\")]


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(x: Column) -> Column:
    for code, plain in reversed(ESCAPES):
        x = _replace(x, plain, code)
    return x


def unescape(x: Column) -> Column:
    for code, plain in ESCAPES:
        x = _replace(x, code, plain)
    return x


def _marked(x: Column) -> Column:
    """Whether raw marks of the template stand in a role or text."""
    return x.contains(CLOSE) | x.contains(OPEN)


def _render(turn: Column, escaped: bool) -> Column:
    role, text = turn["role"], turn["text"]
    if escaped:
        role = F.when((unescape(role) != role) | _marked(role) | role.contains(SEP), escape(role)).otherwise(role)
        text = F.when((unescape(text) != text) | _marked(text) | text.startswith(SEP), escape(text)).otherwise(text)
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text (null where raw marks stand) and the offset and length of the body."""
    pieces = F.split(formatted, END)

    def turn(piece: Column) -> Column:
        at = F.locate(SEP, piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        body = F.substring(piece, at + len(SEP), F.length(piece))
        odd = _marked(role) | _marked(body) | body.startswith(SEP)
        return F.struct(unescape(role).alias("role"), F.when(~odd, unescape(body)).alias("text"), (at + len(SEP) - 1).alias("head"), F.length(piece).alias("size"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_chat(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (as parsed back), loss_spans (start, end) into formatted, escaped."""
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    render = lambda escaped: F.array_join(F.transform("source", lambda t: _render(t, escaped)), "")
    said = lambda turns: F.transform(turns, lambda t: F.struct(t["role"], t["text"]))
    same = lambda turns: said(turns).eqNullSafe(said("source"))
    convs = convs.withColumn("formatted", render(False))
    convs = convs.withColumn("turns", parse(F.col("formatted")))
    convs = convs.withColumn("escaped", ~same(F.col("turns")))
    convs = convs.withColumn("formatted", F.when(F.col("escaped"), render(True)).otherwise(F.col("formatted")))
    convs = convs.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("turns")))
    checked = F.when(same(F.col("turns")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not parse back")))
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["size"] + len(END)).alias("at"),
            F.when(
                t["role"] == loss_role,
                F.concat(a["spans"], F.array(F.struct((a["at"] + t["head"]).alias("start"), (a["at"] + t["size"]).alias("end")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return convs.select("conv_id", checked.alias("formatted"), "turns", starts.alias("loss_spans"), "escaped")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = format_chat(convs.unionByName(more))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    out = out.withColumn("loss", loss)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# Written from the contract, not from the functions above: a text is changed if and only if
# the template's marks or its own escapes would be read from it.
_LONGER = """length({0}) + 1 * (length({0}) - length(replace({0}, '\\', '')))
  + (length({0}) - length(replace({0}, '</turn>', ''))) // 7 * (2 - 7)
  + (length({0}) - length(replace({0}, '### ', ''))) // 4 * (2 - 4)
  + (length({0}) - length(replace({0}, ': ', ''))) // 2 * (2 - 2)"""
_MARKED = "regexp_matches({0}, '</turn>|### |\\\\[ehcb]') OR {1}"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.* FROM (VALUES (0, 'user', '\\### Assistant: </turn> ok'), (1, 'assistant', '\\### Assistant: </turn> ok')) AS v(turn, role, text)
), t AS (
  SELECT *, length('### ' || ': ' || '</turn>' || chr(10))
    + CASE WHEN {_MARKED.format("role", "contains(role, ': ')")} THEN {_LONGER.format("role")} ELSE length(role) END
    + CASE WHEN {_MARKED.format("text", "starts_with(text, ': ')")} THEN {_LONGER.format("text")} ELSE length(text) END AS chars
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
