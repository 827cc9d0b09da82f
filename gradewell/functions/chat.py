"""Chat-shaped columns: flattening, completion text, template rendering, length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .text import py_strip
from .variant import flatten_variant, variant_completion


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _content_text(content: Column, content_type: T.DataType | None) -> Column:
    """Message content as text: a string as is, a list of parts as their ``text``
    joined by one space (the type is known at plan time from the schema)."""
    if isinstance(content_type, T.ArrayType):
        element = content_type.elementType
        if isinstance(element, T.StructType) and "text" in element.fieldNames():
            parts = F.transform(content, lambda p: F.coalesce(p["text"].cast("string"), F.lit("")))
        else:
            parts = F.transform(content, lambda p: F.coalesce(p.cast("string"), F.lit("")))
        return F.array_join(parts, " ")
    return F.coalesce(content.cast("string"), F.lit(""))


def _field(m: Column, element: T.DataType, name: str) -> Column | None:
    """A field of a message, or None if its type has no such field."""
    if isinstance(element, T.StructType):
        return m[name] if name in element.fieldNames() else None
    if isinstance(element, T.MapType):
        return F.try_element_at(m, F.lit(name))
    return None


def _field_type(element: T.DataType, name: str) -> T.DataType | None:
    if isinstance(element, T.StructType) and name in element.fieldNames():
        return element[name].dataType
    return element.valueType if isinstance(element, T.MapType) else None


def flatten_chat(
    msgs: Column | str,
    msgs_type: T.DataType | None = None,
    role_field: str = "role",
    content_field: str = "content",
) -> Column:
    """O-10: ``role: content`` lines joined by newline and stripped.

    A message may be a struct or a map. Missing role -> ``user``, missing
    content -> '' (also if the messages have no such field at all; name the
    fields, such as ``from`` and ``value``, to read others). Messages of any
    other type, such as plain strings, are lines as they are. An empty or null
    list gives null. ``msgs_type`` is the column's Spark type (from
    ``df.schema``); without it the messages are structs of strings. In a
    Variant column each row and each message may have its own shape.
    """
    msgs = _col(msgs)
    if isinstance(msgs_type, T.VariantType):
        return flatten_variant(msgs, role_field, content_field)
    element = msgs_type.elementType if isinstance(msgs_type, T.ArrayType) else None
    if element is None:
        text = T.StringType()
        element = T.StructType([T.StructField(role_field, text), T.StructField(content_field, text)])

    def line(m: Column) -> Column:
        if not isinstance(element, (T.StructType, T.MapType)):
            return F.coalesce(m.cast("string"), F.lit(""))
        role, content = _field(m, element, role_field), _field(m, element, content_field)
        named = F.lit("user") if role is None else F.coalesce(role.cast("string"), F.lit("user"))
        if content is None:
            return F.concat(named, F.lit(": "))
        return F.concat(named, F.lit(": "), py_strip(_content_text(content, _field_type(element, content_field))))

    joined = py_strip(F.array_join(F.transform(msgs, line), "\n"))
    return F.when(F.size(msgs) > 0, joined)


def completion_text(c: Column | str, c_type: T.DataType) -> Column:
    """O-13: completion value as text; the shape is read from the schema.

    string -> as is; list of messages -> their ``content`` joined by newline;
    struct or map -> ``content``, else ``text``. In a Variant column each row
    has its own shape.
    """
    c = _col(c)
    if isinstance(c_type, T.VariantType):
        return variant_completion(c)
    if isinstance(c_type, T.StringType):
        return c
    if isinstance(c_type, T.ArrayType):
        element = c_type.elementType
        if isinstance(element, T.StructType) and "content" in element.fieldNames():
            parts = F.transform(c, lambda m: F.coalesce(m["content"].cast("string"), F.lit("")))
        else:
            parts = F.transform(c, lambda m: F.coalesce(m.cast("string"), F.lit("")))
        return F.array_join(parts, "\n")
    if isinstance(c_type, T.StructType):
        names = c_type.fieldNames()
        options = [c[n].cast("string") for n in ("content", "text") if n in names]
        return F.coalesce(*options, F.lit("")) if options else F.lit("")
    if isinstance(c_type, T.MapType):
        return F.coalesce(
            F.try_element_at(c, F.lit("content")).cast("string"),
            F.try_element_at(c, F.lit("text")).cast("string"),
            F.lit(""),
        )
    return c.cast("string")


@dataclass(frozen=True)
class ChatTemplate:
    """A chat template as literals: ``prefix + role + role_suffix + content +
    message_suffix`` per message, then ``generation_prompt`` when the
    conversation is left open for the model. Default: ChatML."""

    prefix: str = "<|im_start|>"
    role_suffix: str = "\n"
    message_suffix: str = "<|im_end|>\n"
    generation_prompt: str = "<|im_start|>assistant\n"
    bos: str = ""


CHATML = ChatTemplate()


def render_messages(
    messages: list[tuple[str, Column | str]],
    template: ChatTemplate = CHATML,
    add_generation_prompt: bool = False,
) -> Column:
    """O-17 for a fixed list of (role, content) pairs: one flat ``concat``
    (stays inside whole-stage code generation)."""
    pieces: list[Column] = [F.lit(template.bos)] if template.bos else []
    for role, content in messages:
        content_col = F.lit(content) if isinstance(content, str) else content
        pieces += [
            F.lit(template.prefix + role + template.role_suffix),
            content_col,
            F.lit(template.message_suffix),
        ]
    if add_generation_prompt:
        pieces.append(F.lit(template.generation_prompt))
    return F.concat(*pieces)


def render_chat(
    msgs: Column | str,
    template: ChatTemplate = CHATML,
    add_generation_prompt: bool = False,
    msgs_type: T.DataType | None = None,
) -> Column:
    """O-17 for an array of messages. ``msgs_type`` (from ``df.schema``) tells
    string content from a list of typed parts, whose texts are joined without
    a separator, as chat templates write them one after the other; parts
    without text (images) add nothing."""
    element = msgs_type.elementType if isinstance(msgs_type, T.ArrayType) else None
    content_type = _field_type(element, "content") if element is not None else None

    def content_of(m: Column) -> Column:
        if not isinstance(content_type, T.ArrayType):
            return F.coalesce(m["content"].cast("string"), F.lit(""))
        part = content_type.elementType
        has_text = isinstance(part, T.StructType) and "text" in part.fieldNames()
        texts = F.transform(m["content"], lambda p: p["text"] if has_text else p.cast("string"))
        return F.coalesce(F.array_join(texts, ""), F.lit(""))

    body = F.array_join(
        F.transform(
            _col(msgs),
            lambda m: F.concat(
                F.lit(template.prefix),
                F.coalesce(m["role"], F.lit("user")),
                F.lit(template.role_suffix),
                content_of(m),
                F.lit(template.message_suffix),
            ),
        ),
        "",
    )
    parts = [F.lit(template.bos), body] if template.bos else [body]
    if add_generation_prompt:
        parts.append(F.lit(template.generation_prompt))
    return F.concat(*parts)


def token_length(c: Column | str, given: Column | str | None = None) -> Column:
    """O-18: a given token count wins; else the estimate ``max(1, chars // 4)``."""
    estimate = F.greatest(F.lit(1), F.floor(F.length(_col(c)) / F.lit(K.CHARS_PER_TOKEN))).cast("int")
    if given is None:
        return estimate
    return F.coalesce(_col(given).cast("int"), estimate)
