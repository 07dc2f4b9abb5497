"""Relational chat formatting: sorted turn structs, same-role neighbours merged with array functions, Spark expressions only.

A formatted conversation is a sequence of blocks ``<|start|>role<|message|>text<|end|>\\n``. Adjacent turns of one role
share a block, their texts parted by ``<|next|>``. Control strings all begin with ``<|`` and a letter; inside roles and
texts every ``<|`` is written ``<||``, which no control string begins with, so that the original comes back exactly.
``loss`` has, for each assistant text, its block and its code-point range in that block (start from 0, end exclusive).

Escaping happens row by row before the turns of a conversation meet. A conversation is one output value, so its own
turns must meet in one task; no other state grows with the input. Where a text lies in its block follows from a running
sum over the conversation's rows, so that a long run of one role costs time in proportion.

Defined cases: turns are ordered by turn (null first), then role, then text, so ties and repeated rows have one order and
all are kept; a null text or role is empty; rows of a null conv_id form one conversation; an empty table gives no
conversation; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeingraph.sources.tables import table

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>\n"
#: The role whose texts are trained on.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss: array of (block, start, end)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("order"), escape(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    # where a text would begin if all texts of the conversation were joined; rows that are equal may change places
    upto = F.sum(F.length("body").cast("long") + len(NEXT)).over(Window.partitionBy("conv_id").orderBy("turn", "role", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("conv_id", F.struct("turn", "role", "order", (upto - F.length("body") - len(NEXT)).alias("at"), "head", "body").alias("_turn"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    # positions at which a block begins: the first turn, and those whose role differs from the one before
    begins = F.filter(F.sequence(F.lit(1), F.size("_turns")), lambda k: (k == 1) | (F.element_at("_turns", k)["role"] != F.element_at("_turns", F.greatest(k - 1, F.lit(1)))["role"]))
    grouped = grouped.withColumn("_begins", begins).withColumn("_ends", F.concat(F.slice("_begins", 2, F.size("_turns")), F.array(F.size("_turns") + 1)))
    blocks = F.zip_with("_begins", "_ends", lambda a, b: F.slice("_turns", a, b - a))
    grouped = grouped.withColumn("_blocks", blocks)
    text = F.array_join(F.transform("_blocks", lambda x: F.concat(F.lit(START), x[0]["head"], F.lit(MESSAGE), F.array_join(F.transform(x, lambda t: t["body"]), NEXT), F.lit(END))), "")
    def ranges(x: Column, k: Column) -> Column:
        """The ranges of a block's texts."""
        begin = F.length(F.concat(F.lit(START), x[0]["head"], F.lit(MESSAGE)))
        start = lambda t: (begin + t["at"] - x[0]["at"]).cast("int")
        return F.transform(x, lambda t: F.struct(k.cast("int").alias("block"), start(t).alias("start"), (start(t) + F.length(t["body"])).alias("end")))

    loss = F.flatten(F.transform("_blocks", lambda x, k: F.when(x[0]["role"] == LEARNED, ranges(x, k)).otherwise(F.array().cast("array<struct<block:int,start:int,end:int>>"))))
    return grouped.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text), parsed from ``formatted``, and ``learned``: the texts that ``loss`` marks, unescaped."""
    blocks = F.slice(F.split("formatted", r"<\|start\|>"), 2, F.length("formatted") + 1)
    inner = lambda x: F.substring(x, F.lit(1), F.length(x) - len(END))

    def parts(x: Column) -> Column:
        split = lambda y: _let(F.substring_index(y, MESSAGE, 1), lambda head: _let(F.substring(y, F.length(head) + 1 + len(MESSAGE), F.length(y)), lambda body: turns(head, body)))
        return _let(inner(x), split)

    def turns(head: Column, body: Column) -> Column:
        return _let(unescape(head), lambda role: F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))))

    # code points of equal width, so that a range is cut out without counting from the block's start
    wide = F.transform("_parts", lambda x: F.encode(F.concat(F.lit(START), x), "UTF-32"))
    cut = lambda parts, m: F.decode(F.substring(F.element_at(parts, m["block"] + 1), 4 * m["start"] + 1, 4 * (m["end"] - m["start"])), "UTF-32")
    learned = _let(wide, lambda parts: F.transform("loss", lambda m: unescape(cut(parts, m))))
    return chats.withColumn("_parts", blocks).withColumn("turns", F.flatten(F.transform("_parts", parts))).withColumn("learned", learned).drop("_parts")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although ``body`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))]
    probe = spark.range(1).select(F.inline(F.array(*own)))
    return digests(read_back(formatted(turns.unionByName(probe))))


def _sql() -> str:
    """The same digests computed from the rows; only formatted_chars needs the template's lengths."""
    parts = ["role", "text"]
    escaped = {p: f"length(replace({p}, '<|', '<||'))" for p in parts}
    fixed = {"start": len(START) + len(MESSAGE) + len(END), "next": len(NEXT)}
    rows = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
    rows += "".join(f" UNION ALL SELECT -1, {k}, '{r}', '</s>[INST] ok [/INST]'" for k, r in enumerate(("user", "assistant")))
    order = "ORDER BY turn NULLS FIRST, role, text"
    merged = f"SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM ({rows}) WINDOW w AS (PARTITION BY conv_id {order})"
    chars = f"sum({escaped['text']} + CASE WHEN before = role THEN {fixed['next']} ELSE {fixed['start']} + {escaped['role']} END)"
    said = reduce(lambda a, b: f"{a} || chr(10) || {b}", parts) + " || chr(10)"
    learned = f"coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{LEARNED}'), '')"
    return f"SELECT conv_id, count(*) AS n_turns, sha256(string_agg({said}, '' ORDER BY k)) AS turns_sha256, CAST(length({learned}) AS BIGINT) AS loss_chars, sha256({learned}) AS loss_sha256, CAST({chars} AS BIGINT) AS formatted_chars FROM ({merged}) GROUP BY conv_id"


OP6_SQL = _sql()
