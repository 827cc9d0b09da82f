"""O-11..O-14: generic instruction / chat rows -> (prompt, reference).

Field probing happens once, at plan time, from ``df.schema``; per row only
``coalesce`` / ``when`` run, inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.chat import flatten_chat
from ..functions.text import py_strip
from ..functions.variant import as_text, field, flatten_variant, is_true


def _truthy(c: Column, dtype: T.DataType) -> Column:
    """Python truthiness per column type (Q-17): '' / 0 / False / [] are falsy."""
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (F.length(c) > 0)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(dtype, T.BooleanType):
        return c.isNotNull() & c
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    if isinstance(dtype, T.VariantType):
        return is_true(c)
    return c.isNotNull()


def _is_text(schema: dict[str, T.DataType], name: str) -> Column:
    """The column as text, whatever its type."""
    return as_text(F.col(name)) if isinstance(schema[name], T.VariantType) else F.col(name).cast("string")


def _stripped_or_empty(df: DataFrame, name: str) -> Column:
    """``str(ex.get(name, '')).strip()`` with null read as missing (Q-11)."""
    if name not in df.columns:
        return F.lit("")
    return py_strip(F.coalesce(_is_text({f.name: f.dataType for f in df.schema}, name), F.lit("")))


def synthesize_prompt(df: DataFrame, combine: bool = False) -> Column:
    """O-11: the prompt text of a row of any shape.

    First truthy primary field as is; then the first non-empty flattened chat;
    then instruction/input and context/question combinations; last the whole
    row as JSON (nulls kept). ``combine=True`` tries the two-field forms
    before the single fields, which the original precedence never reaches (Q-12).
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    options: list[Column] = []

    def combos() -> list[Column]:
        instr = _stripped_or_empty(df, "instruction")
        inp = _stripped_or_empty(df, "input")
        ctx = _stripped_or_empty(df, "context")
        q = _stripped_or_empty(df, "question")
        return [
            F.when((instr != "") & (inp != ""), F.concat(instr, F.lit(K.INSTRUCTION_INPUT_SEPARATOR), inp)),
            F.when(instr != "", instr),
            F.when(inp != "", inp),
            F.when((ctx != "") & (q != ""), F.concat(ctx, F.lit(K.CONTEXT_QUESTION_SEPARATOR), q)),
            F.when(q != "", q),
        ]

    if combine:
        options += combos()
    for name in K.PROMPT_FIELDS:
        if name in schema:
            col = F.col(name)
            options.append(F.when(_truthy(col, schema[name]), _is_text(schema, name)))
    for name in K.CHAT_FIELDS:
        # a chat that is not a list gives no prompt (only lists are flattened)
        if name in schema and isinstance(schema[name], (T.ArrayType, T.VariantType)):
            col = F.col(name)
            flat = flatten_chat(col, schema[name])
            options.append(F.when(_truthy(col, schema[name]) & (F.length(flat) > 0), flat))
    if not combine:
        options += combos()
    whole_row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    options.append(whole_row)
    return F.coalesce(*options)


def pick_reference(df: DataFrame) -> Column:
    """O-12: first non-null reference-like field as text ('' counts); else null."""
    schema = {f.name: f.dataType for f in df.schema}
    present = []
    for n in K.REFERENCE_FIELDS:
        if n in schema:
            null = F.is_variant_null(n) if isinstance(schema[n], T.VariantType) else F.lit(False)
            present.append(F.when(~null, _is_text(schema, n)))
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*present) if len(present) > 1 else present[0]


def to_prompt_reference(df: DataFrame, keep: list[str] | None = None, combine: bool = False) -> DataFrame:
    """O-14: (prompt, reference), every other column dropped except ``keep`` keys."""
    keep = list(keep or [])
    return df.select(
        *[F.col(k) for k in keep],
        synthesize_prompt(df, combine=combine).alias("prompt"),
        pick_reference(df).alias("reference"),
    )


def variant_prompt_reference(df: DataFrame, row: str = "row", keep: list[str] | None = None) -> DataFrame:
    """O-11, O-12 and O-14 where each row is a Variant object with fields of its
    own (``readers.read_variant_rows``): (prompt, reference) and ``keep`` fields.

    The same precedence as ``to_prompt_reference``, decided row by row: a
    field that only some rows have, or that is text in one row and a list of
    messages in the next, needs no common schema. An explicit null counts as a
    missing field. A row without any of them is its own JSON, keys in order.
    """
    v = F.col(row)
    blank = F.lit("")
    named = lambda name: field(v, name)
    options = [F.when(is_true(named(n)), as_text(named(n))) for n in K.PROMPT_FIELDS]
    for n in K.CHAT_FIELDS:
        flat = flatten_variant(named(n))
        options.append(F.when(F.length(flat) > 0, flat))

    def text(name: str) -> Column:
        return py_strip(F.coalesce(F.when(~F.is_variant_null(named(name)), as_text(named(name))), blank))

    instr, inp, ctx, q = map(text, ("instruction", "input", "context", "question"))
    options += [
        F.when((instr != "") & (inp != ""), F.concat(instr, F.lit(K.INSTRUCTION_INPUT_SEPARATOR), inp)),
        F.when(instr != "", instr),
        F.when(inp != "", inp),
        F.when((ctx != "") & (q != ""), F.concat(ctx, F.lit(K.CONTEXT_QUESTION_SEPARATOR), q)),
        F.when(q != "", q),
        F.to_json(v),
    ]
    references = [F.when(~F.is_variant_null(named(n)), as_text(named(n))) for n in K.REFERENCE_FIELDS]
    return df.select(
        *[as_text(named(k)).alias(k) for k in keep or []],
        F.coalesce(*options).alias("prompt"),
        F.coalesce(*references).alias("reference"),
    )


def flatten_turns(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    out: str = "prompt",
    bucket_turns: int = 256,
) -> DataFrame:
    """O-10 on a table of turns (one row per message) instead of an array:
    ``role: content`` lines in turn order, joined by newline and stripped.

    Lines are built per row, then joined inside buckets of ``bucket_turns``
    consecutive turns (many tasks, even for one huge conversation), and only
    the bucket strings are concatenated per conversation. The result row is
    the whole conversation by definition.
    """
    line = F.concat(
        F.coalesce(F.col(role).cast("string"), F.lit("user")),
        F.lit(": "),
        py_strip(F.coalesce(F.col(content).cast("string"), F.lit(""))),
    )
    lines = turns.select(F.col(conv), F.col(turn), line.alias("_gw_line"))
    ordered = lambda items, field: F.array_join(
        F.transform(F.array_sort(items), lambda x: x[field]), "\n"
    )
    chunks = lines.groupBy(F.col(conv), F.floor(F.col(turn) / bucket_turns).alias("_gw_bucket")).agg(
        ordered(F.collect_list(F.struct(F.col(turn).alias("k"), F.col("_gw_line").alias("v"))), "v").alias("_gw_chunk")
    )
    joined = chunks.groupBy(conv).agg(
        ordered(F.collect_list(F.struct(F.col("_gw_bucket").alias("k"), F.col("_gw_chunk").alias("v"))), "v").alias("_gw_all")
    )
    return joined.select(F.col(conv), py_strip("_gw_all").alias(out))
