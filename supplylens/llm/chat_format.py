"""Chat conversations as training windows within a token budget.

Prefix sums of turn tokens choose the spans of turns that are new in each window; a window starts with the system turn, then repeats
the turns that end right before its span as far as they fit the history budget, then brings the new
turns. Only new assistant turns are under the loss mask, so no target is learned twice. All of it is DataFrame code.

Text is escaped so that it cannot contain the template's markers: a backslash is doubled and ``<|`` becomes ``<\\|``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4


def escape(s) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s) -> Column:
    return F.replace(F.replace(s, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(s) -> Column:
    """Roles also end at the first line break, which becomes a backslash and n."""
    return F.replace(escape(s), F.lit("\n"), F.lit("\\n"))


def unescape_role(s) -> Column:
    """Undo :func:`escape_role`. Doubled backslashes become ``<|`` first, which an escaped role cannot contain."""
    shown = F.replace(F.replace(s, F.lit("\\\\"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    parts = F.split(shown, r"<\\\|", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("<|"), F.lit("\\"))), "<|")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, n_new, formatted, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``. New turns of a window take at most half of what the
    history leaves of the budget plus one turn no longer than that half; a longer turn has a span of its own, so only
    a turn (or a system turn) that is itself over the budget makes a window that is.

    * null texts and roles are empty; a null conversation id is a conversation; a null turn number comes first;
    * turns that tie in number are ordered by role and text, and repeated rows are turns of their own;
    * a conversation of nothing but a system turn is one window; an empty table gives no rows; other columns aren't read.
    """
    half = max(1, (budget - history) // 2)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(order))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("is_system", system).withColumn(
        "tokens", F.when(F.col("is_system"), F.lit(0)).otherwise(F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long")
    )
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    rows = rows.withColumn("before", F.sum("tokens").over(by_pos) - F.col("tokens"))
    message = F.struct("pos", "role", "text")
    rows = rows.withColumn("system", F.when(F.first("is_system").over(by_pos), F.first(message).over(by_pos)))
    long_ = F.col("tokens") > half
    cell = F.floor(F.col("before") / half)
    rows = rows.withColumn("long", long_).withColumn("cell", cell)
    starts = (F.col("pos") > 1) & ~F.coalesce(F.lag("is_system").over(by_pos), F.lit(False))
    starts = starts & (F.col("long") | F.lag("long").over(by_pos) | (F.col("cell") != F.lag("cell").over(by_pos)))
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("window", F.sum(F.col("starts").cast("long")).over(by_pos))
    behind = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    told = F.collect_list(F.when(~F.col("is_system"), message)).over(behind)
    rows = rows.withColumn("history", F.when(F.col("starts"), told))
    grouped = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(message)).alias("new"),
        F.first("history", ignorenulls=True).alias("history"),
        F.first("system", ignorenulls=True).alias("system"),
    )
    none = F.array().cast("array<struct<pos:int,role:string,text:string>>")
    again = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.array("system")).otherwise(none)
    repeated = F.concat(again, F.coalesce(F.sort_array("history"), none))
    grouped = grouped.select("conv_id", "window", F.size(repeated).alias("n_repeated"), F.size("new").alias("n_new"), F.concat(repeated, "new").alias("messages"))
    shown = F.transform(
        "messages",
        lambda m, i: F.struct(
            F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"),
            escape(m["text"]).alias("body"),
            ((i >= F.col("n_repeated")) & (m["role"] == "assistant")).alias("learn"),
        ),
    )
    grouped = grouped.withColumn("shown", shown)
    spans = F.aggregate(
        "shown",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.char_length(m["head"]) + F.char_length(m["body"]) + len(END)).alias("at"),
            F.when(
                m["learn"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(m["head"])).alias("start"), F.char_length(m["body"]).cast("long").alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    return grouped.select("conv_id", "window", "n_repeated", "n_new", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted) -> Column:
    """The (role, text) structs that a formatted window holds."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)

    def read(p):
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, read)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    new = F.slice(parse(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.col("n_new"), F.lit(1)))
    turns = F.array_join(F.transform(new, lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = made.select("conv_id", "window", F.size(new).alias("n"), turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").alias("chars"))
    joined = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.char_length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c
), t AS (
  SELECT *, pos = 1 AND role = 'system' AS sys,
    CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) + 4 END AS tokens,
    13 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 AS chars
  FROM p
), b AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS before FROM t
), s AS (
  SELECT *, pos > 1 AND NOT lag(sys) OVER w AND (tokens > 384 OR lag(tokens) OVER w > 384 OR before // 384 <> lag(before // 384) OVER w) AS starts
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), h AS (
  SELECT *, sum(CASE WHEN sys THEN 0 ELSE chars END) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING) AS told,
    first_value(CASE WHEN sys THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS sys_chars
  FROM s
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN starts THEN coalesce(told, 0) + sys_chars ELSE 0 END) AS BIGINT) AS formatted_chars,
  CAST(1 + sum(CASE WHEN starts THEN 1 ELSE 0 END) AS BIGINT) AS n_windows
FROM h GROUP BY conv_id
"""
