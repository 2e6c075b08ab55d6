r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as
context and only its text trainable. A conversation whose last turn is not an
assistant's (or that has none) gives one more example of all its turns with
nothing trainable, so that no turn is lost.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a
backslash is doubled, and a backslash is put after the first character of every
control string (those of this template and of widespread ones: anything with
``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``).
So no control string occurs inside an escaped text, and reading back is exact:
a doubled backslash stands for one, a single one for nothing.

As each example repeats all turns before it, the output grows with the square
of the turns of one conversation; that is the method.

Cases: rows are ordered by turn, ties by role and text (nulls first); repeated
rows are turns of their own; a null role or text counts as empty; rows with a
null conv_id form one conversation; empty and very long texts are written
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First character of a control string, then what makes it one.
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(rows: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length): examples in order of their target.

    ``loss_start`` counts code points from 0; a length of -1 marks the example
    that holds no target. The mask covers the escaped text of the target alone.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = talks.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.when(t["role"] == trainable_role, F.length(escape(t["text"]))).otherwise(-1)).alias("sizes"),
    )
    wanted = F.filter(F.sequence(F.lit(1), F.size("sizes")), lambda i: (F.element_at("sizes", i) >= 0) | (i == F.size("sizes")))
    cut = written.select("conv_id", "parts", "sizes", F.posexplode(wanted).alias("example", "upto"))
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "")
    return cut.select("conv_id", "example", formatted.alias("formatted"), F.element_at("sizes", F.col("upto")).alias("loss_length")).select(
        "conv_id", "example", "formatted", F.when(F.col("loss_length") >= 0, F.length("formatted") - len(END) - F.col("loss_length")).alias("loss_start"), "loss_length"
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted examples alone."""
    target = F.when(F.col("loss_length") >= 0, unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))))
    by_talk = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", target.alias("target")))), lambda x: F.coalesce(x["target"], F.lit(""))), "").alias("learned"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = F.filter(F.split("whole", r"<\|end\|>"), lambda x: x != "")
    plain = F.transform(turns, lambda x: F.concat(unescape(F.regexp_extract(x, r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1)), F.lit("\n"), unescape(F.regexp_extract(x, r"(?s)<\|text\|>(.*)$", 1)), F.lit("\n")))
    return by_talk.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(plain, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_SPECIAL = "</s>[INST] ok [/INST]"

ORACLE_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SPECIAL}' UNION ALL SELECT -1, 1, 'assistant', '{_SPECIAL}'),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '{CONTROL}', '\1\3\\\2\4', 'g') AS etext, regexp_replace(replace(role, '\', '\\'), '{CONTROL}', '\1\3\\\2\4', 'g') AS erole FROM rows),
placed AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_all,
         sum(length(erole) + length(etext) + {len(TURN) + len(TEXT) + len(END)}) OVER w AS chars
  FROM escaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) FILTER (role = 'assistant' OR n = n_all) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
