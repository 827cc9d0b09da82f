"""Values of any shape, told apart row by row (``VariantType``).

A column whose rows hold strings, lists, messages and numbers side by side has
no one schema. Read as Variant (a JSON reader's ``variant`` column, or
``parse_json``), each value carries its own type, and a missing field differs
from an explicit null. Everything here is a JVM expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip


def field(v: Column, name: str) -> Column:
    """A field of an object; SQL null where there is none or ``v`` is no object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def items(v: Column) -> Column:
    """The items of a list."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def as_text(v: Column) -> Column:
    """The value as Python's ``str`` gives it: strings as they are, ``None``,
    ``True`` and ``False``, numbers; lists and objects as JSON. SQL null stays."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def is_true(v: Column) -> Column:
    """Python's truth: not missing, null, false, zero or empty."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.coalesce(number != 0, F.lit(True))),
        F.lit(False),
    )


def content_text(content: Column) -> Column:
    """O-10, message content: the texts of a list's parts joined by a space (a
    part without text adds an empty one), any other value as text."""
    part = lambda p: F.when(is_object(p), F.coalesce(as_text(field(p, "text")), F.lit(""))).otherwise(as_text(p))
    joined = F.array_join(F.transform(items(content), part), " ")
    return F.when(is_list(content), joined).otherwise(as_text(content))


def flatten_variant(msgs: Column, role_field: str = "role", content_field: str = "content") -> Column:
    """O-10 where each message has its own shape: ``role: content`` lines for
    objects, any other message as text. Null unless the value is a list with
    an item. A missing role is ``user``, missing content empty."""

    def line(m: Column) -> Column:
        role = F.coalesce(as_text(field(m, role_field)), F.lit("user"))
        content = F.coalesce(content_text(field(m, content_field)), F.lit(""))
        return F.when(is_object(m), F.concat(role, F.lit(": "), py_strip(content))).otherwise(as_text(m))

    own = items(msgs)
    joined = py_strip(F.array_join(F.transform(own, line), "\n"))
    return F.when(is_list(msgs) & (F.size(own) > 0), joined)


def variant_completion(c: Column) -> Column:
    """O-13 where each completion has its own shape: a list's contents line by
    line, an object's ``content``, else its ``text``, any other value as text."""
    empty = F.lit("")
    own = lambda m: F.when(is_object(m), F.coalesce(as_text(field(m, "content")), empty)).otherwise(as_text(m))
    listed = F.array_join(F.transform(items(c), own), "\n")
    single = F.coalesce(as_text(field(c, "content")), as_text(field(c, "text")), empty)
    return F.when(is_list(c), listed).when(is_object(c), single).otherwise(as_text(c))
