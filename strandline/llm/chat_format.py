"""Chat formatting as relational expressions: one marked-up string and loss spans for each conversation.

Turns are collected and sorted as structs, adjacent turns of one role share a block, and blocks
are concatenated. A block is ``<|im_start|>role``, a line feed, the turns' texts with
``<|im_sep|>`` between them, ``<|im_end|>`` and a line feed. Inside texts and roles every ``<|``
is written ``<||``, so no text contains a control string, and replacing ``<||`` by ``<|`` gives
the text back. In roles, a backslash and a line feed are written ``\\\\`` and ``\\n``.

Only Spark expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # Pairs of backslashes are set aside as a control string, which no role contains.
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted (string) and loss_spans (array of structs at, length: code points of formatted, from 0).

    The spans cover the texts of ``trained_role``, each by itself, and no control string.

    Defined cases: turns are ordered by turn, then role, then text, nulls first; a null text or
    role is empty; repeated rows are turns of their own; a null conv_id is a conversation of its
    own; texts may be long or hold control strings; extra columns are not read; an empty table
    gives an empty table.
    """
    said = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    firsts = F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[i - 2].role)")
    blocks = F.expr("transform(firsts, (i, k) -> struct(turns[i - 1].role AS role, transform(slice(turns, i, coalesce(get(firsts, k + 1), size(turns) + 1) - i), x -> x.text) AS texts))")
    out = grouped.withColumn("firsts", firsts).withColumn("blocks", blocks)
    written = F.transform(
        "blocks", lambda b: F.struct(b["role"].alias("role"), F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n")).alias("head"), F.transform(b["texts"], escape).alias("texts"))
    )
    out = out.select("conv_id", written.alias("blocks"), F.lit(trained_role).alias("trained"))
    piece = F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], SEPARATOR), F.lit(END)))
    span = "struct(cast(acc.at AS bigint) AS at, cast(length(x.text) AS bigint) AS length)"
    parts = f"""flatten(transform(blocks, b -> transform(b.texts, (t, k) -> struct(
        t AS text, b.role AS role, CASE WHEN k = 0 THEN length(b.head) ELSE {len(SEPARATOR)} END AS before,
        CASE WHEN k = size(b.texts) - 1 THEN {len(END)} ELSE 0 END AS after))))"""
    spans = f"""aggregate({parts}, struct(0L AS at, cast(array() AS array<struct<at: bigint, length: bigint>>) AS spans), (done, x) ->
        transform(array(struct(done.at + x.before AS at, done.spans AS spans)), acc -> struct(
            cast(acc.at + length(x.text) + x.after AS bigint) AS at,
            CASE WHEN x.role = trained THEN concat(acc.spans, array({span})) ELSE acc.spans END AS spans))[0]).spans"""
    return out.select("conv_id", F.array_join(piece, "").alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of structs role and text."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(block: Column) -> Column:
        role = _unescape_role(F.substring_index(block, "\n", 1))
        at = F.locate("\n", block)
        body = F.substring(block, at + 1, F.length(block) - at - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss spans, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["at"] + 1).cast("int"), s["length"].cast("int"))))
