"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all turns before it as context
and only that reply under the loss mask.  Turns after the last reply (or a
conversation without one) give one more example without a target, so no turn
is lost.  Control strings inside texts and roles are escaped reversibly: a
backslash doubles, and a backslash goes behind the first character of each
control string.

Defined results: null texts and roles count as empty; turns are ordered by
(turn, role, text), null turns first, and repeated rows stay repeated; rows
with a null conv_id form one conversation; an empty table gives no example.
Examples of a conversation grow with the square of its turns by definition of
the method; no group other than a conversation is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template (fixed values); all are escaped inside texts, with control strings of common chat models.
OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|close|>"
CONTROL = (OPEN, BODY, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURN = r"(?s)<\|turn\|>(.*?)<\|close\|>"


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), n_context, text, loss_start (from 1), loss_length, last.

    loss_length is null where nothing is trainable.  The rows stay partitioned by conv_id.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("_r"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    turns = turns.withColumn(
        "_parts",
        F.transform("_r", lambda r: F.struct(
            r.getField("role").alias("role"),
            F.concat(F.lit(OPEN), escaped(r.getField("role")), F.lit(BODY)).alias("head"),
            escaped(r.getField("text")).alias("body"),
        )),
    )
    targets = F.filter(F.transform("_r", lambda r, i: F.when(r.getField("role") == target_role, i)), lambda i: i.isNotNull())
    turns = turns.select("conv_id", "_parts", targets.alias("_targets"), F.size("_r").alias("_n"))
    tail = F.coalesce(F.get("_targets", F.size("_targets") - 1) < F.col("_n") - 1, F.lit(True))
    turns = turns.withColumn("_cuts", F.when(tail, F.concat("_targets", F.array("_n"))).otherwise(F.col("_targets")))
    each = turns.select("conv_id", "_parts", "_n", F.size("_cuts").alias("_k"), F.posexplode_outer("_cuts").alias("example", "_cut"))
    whole = lambda p: F.concat(p.getField("head"), p.getField("body"), F.lit(CLOSE))
    context = F.array_join(F.transform(F.slice("_parts", F.lit(1), F.col("_cut")), whole), "")
    each = each.select("conv_id", "example", F.col("_cut").alias("n_context"), context.alias("_context"), F.get("_parts", F.col("_cut")).alias("_t"), (F.col("example") == F.col("_k") - 1).alias("last"))
    return each.select(
        "conv_id", "example", "n_context",
        F.concat("_context", F.coalesce(F.concat("_t.head", "_t.body", F.lit(CLOSE)), F.lit(""))).alias("text"),
        F.when(F.col("_t").isNotNull(), F.length("_context") + F.length("_t.head") + 1).alias("loss_start"),
        F.length("_t.body").alias("loss_length"),
        "last",
    )


def parsed_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    blocks = F.regexp_extract_all(text, F.lit(_TURN), F.lit(1))
    mark = len(BODY)
    return F.transform(blocks, lambda b: F.struct(
        unescaped(F.substring_index(b, BODY, 1)).alias("role"),
        unescaped(F.substring(b, F.locate(BODY, b) + mark, F.length(b))).alias("text"),
    ))


def loss_text(row_text: Column, start: Column, length: Column) -> Column:
    return F.coalesce(unescaped(F.substring(row_text, start, length)), F.lit(""))
