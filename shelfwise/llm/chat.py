"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its own text
is trainable. A conversation that does not end with an assistant turn gets one more example without a
target, so that the examples hold every turn and the conversations can be read back from them.

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n ...

Inside texts a backslash is doubled and "<|" becomes "<\\|", so no text can hold a mark of the template,
and dropping each backslash but a doubled one's second undoes it. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, alone, example (from 0), n_turns, formatted, loss_start, loss_length (code points of formatted; null without a target).

    turns: conv_id, turn, role, text. A null role or text is empty; turns of one number follow each other
    by role and text, null numbers come first. A row without conv_id is a conversation of its own: alone tells it apart, and
    is null for the others. One conversation's turns meet in one row, as each example has to hold all of them anyway; texts of any length are whole.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    one = turns.select("conv_id", alone.alias("alone"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    whole = one.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    whole = whole.select("conv_id", "alone", "turns", F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(f"{END}\n"))).alias("shown"))
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(F.col("turns"), i)["role"] == "assistant") | (i == last))
    each = whole.select("conv_id", "alone", "turns", "shown", F.posexplode(targets).alias("example", "at"))
    target = F.get("turns", F.col("at"))
    return each.select(
        "conv_id",
        "alone",
        "example",
        (F.col("at") + 1).alias("n_turns"),
        F.array_join(F.slice("shown", F.lit(1), F.col("at") + 1), "").alias("formatted"),
        F.when(target["role"] == "assistant", F.length(F.array_join(F.slice("shown", F.lit(1), F.col("at")), "")) + F.length(head(target))).alias("loss_start"),
        F.when(target["role"] == "assistant", F.length(escaped(target["text"]))).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, from the longest example), losses (all masked text, unescaped, in order), formatted_chars."""
    masked = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    parts = examples.select("conv_id", "alone", "example", "formatted", F.length("formatted").cast("long").alias("chars"), F.coalesce(masked, F.lit("")).alias("masked"))
    whole = parts.groupBy("conv_id", "alone").agg(F.max_by("formatted", "example").alias("last"), F.array_sort(F.collect_list(F.struct("example", "masked"))).alias("masked"), F.sum("chars").alias("formatted_chars"))
    pieces = F.slice(F.split("last", r"<\|im_start\|>"), F.lit(2), F.size(F.split("last", r"<\|im_start\|>")))
    cut = lambda p: F.struct(
        F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring_index(F.substring(p, F.locate("\n", p) + 1, F.length(p)), END, 1)).alias("text"),
    )
    return whole.select("conv_id", F.transform(pieces, cut).alias("turns"), F.array_join(F.col("masked.masked"), "").alias("losses"), "formatted_chars")
