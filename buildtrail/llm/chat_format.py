"""Chat formatting with prefix-target expansion.

A turn is written as <|role|>text<|end|>. In roles and texts the control strings can't occur: "<|" is
written as "<\\|" with as many backslashes as there were and one more, so that reading back takes one off. Every
assistant turn becomes an example of its own: the turns before it are context, its text is what is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escape(text: Column) -> Column:
    """Put a backslash into every "<", backslashes, "|" so that OPEN can't occur; ``unescape`` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As escape; a role's "|>" gets a backslash too, as its end is what closes the mark."""
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|\\$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, formatted, turns): a row a conversation; turns: array of {turn, role, start, size} of the written texts, in code points from 0.

    Rows go by turn (null first), then role and text; repeated rows are turns each. Null text or role: empty. Null conversation ids form one conversation.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE))
    parts = rows.select("c", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    # running sums over a conversation's rows, so that time is linear in its turns; every turn has a length, so starts sort them
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    before = Window.partitionBy("c").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int")
    row = F.struct(start.alias("start"), F.length("body").alias("size"), "turn", "role", F.concat("head", "body", F.lit(END)).alias("written"))
    grouped = parts.select("c", row.alias("t")).groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("p"))
    spans = F.transform("p", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["start"].alias("start"), x["size"].alias("size")))
    return grouped.select(F.col("c").alias(conv_col), F.array_join(F.transform("p", lambda x: x["written"]), "").alias("formatted"), spans.alias("turns"))


def examples(formatted: DataFrame, conv_col: str = "conv_id", role: str = "assistant", with_text: bool = True) -> DataFrame:
    """Explode ``conversations``: a row for each turn of ``role``: (conv_col, turn, example, loss_start, loss_size, chars, reply[, text]).

    The example is the conversation's formatted text up to the end of that turn, its first ``chars`` code points; loss_start and
    loss_size mark the reply in it, and reply is what they mark, still escaped. Without text, an example stays a reference to the
    conversation's row, so long conversations aren't multiplied by their turns.
    """
    mine = F.filter("turns", lambda t: t["role"] == role)
    cut = F.transform(mine, lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["size"].alias("size"), F.col("formatted").substr(t["start"] + 1, t["size"]).alias("reply")))
    out = formatted.select(conv_col, *(["formatted"] if with_text else []), F.posexplode(cut).alias("example", "t"))
    chars = F.col("t.start") + F.col("t.size") + len(END)
    text = [F.substring("formatted", F.lit(1), chars).alias("text")] if with_text else []
    return out.select(conv_col, F.col("t.turn").alias("turn"), "example", F.col("t.start").alias("loss_start"), F.col("t.size").alias("loss_size"), chars.alias("chars"), F.col("t.reply").alias("reply"), *text)


def read_turns(formatted: Column) -> Column:
    """The turns {role, text} of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(unescape_role(F.substring(x, F.lit(3), mark_of(x) - 3)).alias("role"), unescape(x.substr(mark_of(x) + 2, F.length(x))).alias("text")))


def mark_of(x: Column) -> Column:
    """Where the first mark's CLOSE begins."""
    return F.locate(CLOSE, x, 3)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    formatted = conversations(turns.unionByName(extra))
    replies = examples(formatted, with_text=False)
    loss = replies.select("conv_id", "example", unescape(F.col("reply")).alias("said"), "chars").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", "said"))).alias("s"), F.sum("chars").alias("example_chars"))
    loss = loss.select(F.col("conv_id").alias("of"), F.array_join(F.transform("s", lambda x: x["said"]), "").alias("loss"), "example_chars")
    back = read_turns(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    read = formatted.select("conv_id", back.alias("back"), F.length("formatted").cast("long").alias("formatted_chars"))
    read = read.select("conv_id", F.size("back").cast("long").alias("n_turns"), digest.alias("turns_sha256"), "formatted_chars")
    said = F.coalesce("loss", F.lit(""))
    return read.join(loss, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", "n_turns", "turns_sha256", F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), "formatted_chars", F.coalesce("example_chars", F.lit(0)).cast("long").alias("example_chars"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 4 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 7 AS size FROM turns
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS example_chars
FROM placed GROUP BY conv_id
"""
