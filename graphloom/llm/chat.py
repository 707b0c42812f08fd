"""Chat formatting, checked by parsing what was rendered.

A turn is rendered as ``### role: text </turn>`` and a line end.  The grammar is
deterministic: ``### `` begins a turn, the first ``: `` ends its role, and
`` </turn>`` ends its text; a backslash stands before a character that is meant
literally.  A turn is first rendered as it is and parsed again.  Where the parse
doesn't give back the source, the control strings in role and text are escaped and
the parse is repeated; should that differ as well, every character that a control
string can have is escaped, after which none is left to be mistaken.
Everything is an expression of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """text with a backslash inside each control string, and before each backslash."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("### "), F.lit("##\\# "))
    # what is written after a text begins with a blank
    text = F.regexp_replace(text, r"###\z", r"##\\#")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    """role escaped as a text is, without the string that ends a role."""
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def escape_all(text: Column) -> Column:
    """text with a backslash inside every control string: before each mark, blank, slash and backslash."""
    return F.regexp_replace(text, r"([\\# /])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role, text, n_chars (of the text as it is written) and sound, whether the grammar holds."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        body = F.substring(piece, at + len(MIDDLE), F.length(piece) - at - (len(MIDDLE) + len(CLOSE) - 1))
        sound = (at > 0) & F.endswith(piece, F.lit(CLOSE)) & ~F.contains(body, F.lit("</turn>"))
        role = F.substring(piece, F.lit(1), at - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"), F.length(body).alias("n_chars"), sound.alias("sound"))

    pieces = F.split(formatted, r"### ", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def faithful(formatted: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn parses to exactly that turn."""
    turns = parse(formatted)
    first = F.get(turns, F.lit(0))
    return (F.size(turns) == 1) & first["sound"] & (first["role"] == role) & (first["text"] == text)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, n_chars, sound, parsed from formatted), loss (start, length) of each conversation.

    rows has conv_id, turn, role, text, in any order and with any further columns.
    Turns go by turn, then role and text; a null role or text counts as empty, a
    null conv_id is a conversation of its own, and repeated rows are turns.  Very long
    texts and conversations stay whole; of an empty table nothing comes.  loss
    marks the code points of formatted, from 0, that are an assistant's text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), role.alias("role"), text.alias("text"))
    pieces = [render(*x) for x in ((F.col("role"), F.col("text")), (escape_role(F.col("role")), escape(F.col("text"))), (escape_all(F.col("role")), escape_all(F.col("text"))))]
    sound = [faithful(x, F.col("role"), F.col("text")) for x in pieces[:2]]
    rows = rows.withColumn("piece", F.when(sound[0], pieces[0]).when(sound[1], pieces[1]).otherwise(pieces[2]))
    # where each turn begins, in code points, before the turns are gathered
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = parse(F.col("piece"))[0]
    start = before + F.length("piece") - turn["n_chars"] - F.lit(len(CLOSE))
    rows = rows.select("conv_id", "turn", "role", "text", "piece", start.cast("int").alias("start"), turn["n_chars"].alias("length"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", "length", "piece")))
    out = rows.groupBy("conv_id").agg(turns.alias("given"))
    learned = F.transform(F.filter("given", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["length"]))
    out = out.select("conv_id", F.array_join(F.col("given")["piece"], "").alias("formatted"), learned.alias("loss"))
    return out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), "loss")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of format_conversations."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    return digests(format_conversations(rows.unionByName(more)))


OP4_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, contains(role, '\') OR contains(text, '\') OR contains(role, '### ') OR contains(text, '### ')
    OR contains(role, '</turn>') OR contains(text, '</turn>') OR contains(role, ': ') AS odd,
    replace(replace(replace(text, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>') AS etext,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>'), ': ', ':\ ') AS erole
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(CASE WHEN odd THEN length(erole) + length(etext) ELSE length(role) + length(text) END + 15) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
