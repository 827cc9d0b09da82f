"""String column functions (Column -> Column), all JVM-side.

Python's ``str.strip`` / ``\\s`` cover Unicode spaces and 0x1C-0x1F, while
Spark's ``trim`` removes only blanks and Java's ``\\s`` is ASCII. The
character set below is Python's whitespace, written so that the same class
is valid in Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Characters for which Python's str.isspace() is true.
PY_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
PY_SPACE = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Python's Unicode \d.
PY_DIGIT = r"\p{Nd}"
NUMBER_AT_END = rf"(?:####{PY_SPACE}*)?(-?{PY_DIGIT}+(?:\.{PY_DIGIT}+)?){PY_SPACE}*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove Python whitespace from both ends."""
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def normalize_text(c: Column | str) -> Column:
    """O-9: null -> '', strip, whitespace runs -> one space, lower-case."""
    stripped = py_strip(F.coalesce(_col(c), F.lit("")))
    return F.lower(F.regexp_replace(stripped, PY_SPACE + "+", " "))


def is_truthy_string(c: Column | str) -> Column:
    """Python truthiness of a string value: not null and not empty."""
    c = _col(c)
    return c.isNotNull() & (F.length(c) > 0)


def extract_number(c: Column | str) -> Column:
    """O-27: last number ending the stripped text (optional '#### '), else null."""
    found = F.regexp_extract(py_strip(F.coalesce(_col(c), F.lit(""))), NUMBER_AT_END, 1)
    return F.when(found != "", found)


# Non-ASCII letters that Python's case-insensitive matching equates with an
# ASCII letter (dotless/dotted i, long s, Kelvin sign). Listing them in
# character classes makes ASCII-only (?i) exact, and faster than (?iu).
_FOLD_CLASSES = {"i": "[iI\\x{131}\\x{130}]", "s": "[sS\\x{17f}]", "k": "[kK\\x{212a}]"}


def _ci_literal(literal: str) -> str:
    """A literal as a pattern that matches it case-insensitively like Python ``re.I``."""
    out = []
    for ch in literal:
        low = ch.lower()
        if low in _FOLD_CLASSES:
            out.append(_FOLD_CLASSES[low])
        else:
            out.append(_quote(ch))
    return "".join(out)


def extract_tagged(c: Column | str, start: str, end: str) -> Column:
    """First ``start(.*?)end``, dot matches newline, case-insensitive, stripped.

    The text between is written as runs without the end's first character, which
    Java's matcher passes faster than it tries ``end`` at every place.
    """
    first, rest = _ci_literal(end[0]), _ci_literal(end[1:])
    run = "[^" + first.strip("[]") + "]*+" if first[0] == "[" else f"[^{first}]*+"
    between = f"({run}(?:{first}(?!{rest}){run})*+)"
    pattern = "(?is)" + _ci_literal(start) + between + first + rest
    return py_strip(F.regexp_extract(F.coalesce(_col(c), F.lit("")), pattern, 1))


def _quote(literal: str) -> str:
    out = []
    for ch in literal:
        out.append("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch)
    return "".join(out)


def text_after(c: Column | str, key: str) -> Column:
    """Everything after the first ``key``, stripped; '' when the key is absent (O-26)."""
    c = _col(c)
    pos = F.instr(c, key)
    rest = F.substring(c, pos + F.lit(len(key)), F.lit(2**31 - 1))
    return F.when(pos > 0, py_strip(rest)).otherwise(F.lit(""))


def news_from_prompt(c: Column | str) -> Column:
    """O-26: the news text after the fixed instruction line."""
    return text_after(F.coalesce(_col(c), F.lit("")), K.NEWS_PREFIX)


def extract_answer(c: Column | str) -> Column:
    """O-28: short answer from a raw generation.

    After the last ``Assistant:`` if present, else the last line; end tokens
    removed; above ten words keep the first five when one of them is all
    digits, else the first word.
    """
    raw = F.coalesce(_col(c), F.lit(""))
    after_marker = F.substring_index(raw, K.ASSISTANT_MARKER, -1)
    last_line = F.substring_index(py_strip(raw), "\n", -1)
    answer = py_strip(F.when(F.instr(raw, K.ASSISTANT_MARKER) > 0, after_marker).otherwise(last_line))
    for token in K.END_TOKENS:
        answer = F.replace(answer, F.lit(token), F.lit(""))
    answer = py_strip(answer)
    words = F.split(answer, PY_SPACE + "+")
    head = F.array_join(F.slice(words, 1, K.ANSWER_DIGIT_WINDOW), " ")
    # every word is space-free, so "some word is all digits" is a token test on the join
    head_has_number = head.rlike(rf"(^| ){PY_DIGIT}+( |$)")
    shortened = F.when(head_has_number, head).otherwise(F.element_at(words, 1))
    return F.when(F.size(words) > K.ANSWER_MAX_WORDS, shortened).otherwise(answer)


def preview(c: Column | str, n: int = K.PREVIEW_CHARS) -> Column:
    """O-29: newlines to spaces, cut at n characters, ellipsis only when cut."""
    flat = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(
        F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit(K.PREVIEW_ELLIPSIS))
    ).otherwise(flat)
