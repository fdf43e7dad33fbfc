"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (then role and text). Neighbours of the
same role are merged into one message. The template is

    <|start|>role<|sep|>text<|cont|>text of the same role<|end|>

for each message. Inside roles and texts a backslash is doubled, and one is put behind every < and [, so no control string of this or
another template (</s>, [INST], <|...|>) survives in a text; dropping one backslash before any character restores it.

Output of `format_chats`: conv_id, formatted, loss_spans (start and end of every text of a loss role in `formatted`, in
code points). `read_back` parses that text alone.

A conversation is one output string, so its turns are gathered in one row; that bounds a conversation by what one cell can
hold (2 GB) and needs no more than that. Different conversations are independent, so many or equal ones add no skew.
Work is linear in the turns: offsets come from sums over slices of 64 turns, not from a growing array.

Defined cases: null texts and roles are empty. Rows with a null conversation id are one conversation without id. Equal turn numbers
are ordered by role and text, null turns come first; repeated rows are repeated turns. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, CONT, END = "<|start|>", "<|sep|>", "<|cont|>", "<|end|>"
SLICE = 64
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def running_sums(numbers: Column) -> Column:
    """Sum of all earlier elements, for each element of an array of bigint."""
    zero = F.array(F.lit(0).cast("bigint"))

    def run(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def whole(xs: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SLICE).cast("int")), lambda k: run(F.slice(xs, k * SLICE + 1, F.lit(SLICE))))
        return let(slices, lambda inner: let(
            run(F.transform(inner, lambda s: F.element_at(s, -1))),
            lambda base: F.flatten(F.transform(inner, lambda s, k: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + base[k])))))

    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(numbers, whole))


def messages(turns: Column) -> Column:
    """Sorted turns (structs with role, text) merged: array of (role, texts)."""
    def merged(ts: Column) -> Column:
        n = F.size(ts)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (ts[i]["role"] != F.get(ts, i - 1)["role"]))
        return let(first, lambda f: F.transform(f, lambda a, k: let(
            F.slice(ts, a + 1, F.coalesce(F.get(f, k + 1), n) - a),
            lambda run: F.struct(run[0]["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts")))))
    return let(turns, merged)


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, end>>."""
    empty = F.lit("")
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", messages(F.col("turns")).alias("messages"))

    def pieces(m: Column) -> Column:
        """lead (control strings before the text), body, loss of each text of a message."""
        last = F.size(m["texts"]) - 1
        return F.transform(m["texts"], lambda x, i: F.struct(
            F.when(i == 0, F.concat(F.lit(START), escape(m["role"]), F.lit(SEP))).otherwise(F.lit(CONT)).alias("lead"),
            escape(x).alias("body"), F.when(i == last, F.lit(END)).otherwise(empty).alias("tail"), m["role"].isin(*loss_roles).alias("loss")))

    cut = chats.select("conv_id", F.flatten(F.transform("messages", pieces)).alias("pieces"))

    def spans(p: Column) -> Column:
        size = lambda x: (F.length(x["lead"]) + F.length(x["body"]) + F.length(x["tail"])).cast("bigint")
        return let(running_sums(F.transform(p, size)), lambda at: F.transform(
            F.filter(F.transform(p, lambda x, i: F.struct(
                x["loss"].alias("loss"), (at[i] + F.length(x["lead"])).alias("start"), (at[i] + F.length(x["lead"]) + F.length(x["body"])).alias("end"))),
                lambda s: s["loss"]),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    return cut.select(
        "conv_id", F.array_join(F.transform("pieces", lambda x: F.concat(x["lead"], x["body"], x["tail"])), "").alias("formatted"),
        let(F.col("pieces"), spans).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), one per turn, from a formatted conversation alone."""
    quoted = lambda s: "".join("\\" + c if c in "<|>" else c for c in s)
    blocks = F.filter(F.split(formatted, quoted(END)), lambda b: b != "")
    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, F.length(block)), quoted(SEP))
        return let(parts, lambda p: F.transform(F.split(p[1], quoted(CONT)), lambda x: F.struct(unescape(p[0]).alias("role"), unescape(x).alias("text"))))
    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """All text inside the loss spans, unescaped, with nothing between. Spans are cut from blocks of BLOCK characters, not from the whole."""
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(bs: Column, s: Column) -> Column:
        first = F.floor(s["start"] / BLOCK).cast("int")
        near = F.array_join(F.slice(bs, first + 1, F.floor(s["end"] / BLOCK).cast("int") - first + 1), "")
        return F.when(s["start"] == s["end"], "").otherwise(F.substring(near, (s["start"] - first * F.lit(BLOCK) + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return let(blocks, lambda bs: F.array_join(F.transform(loss_spans, lambda s: unescape(cut(bs, s))), ""))
