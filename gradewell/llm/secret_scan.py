"""Secret scan by a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean trigram query: alternatives of trigram sets
that every match must contain. An index of postings (trigram, doc_id) covers
the trigrams of all queries; intersecting postings gives each rule's candidate
documents, and the regex verifies only those. A rule whose regex has no
mandatory trigram verifies every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Segment marks. Neither can be part of a match; in the texts they are first
# replaced by another control character, which keeps every offset.
HEAD, TAIL, PLAIN = "\x01", "\x02", "\x03"
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` has two groups: what comes before the value, and the value.

    A match counts if its value has ``min_value`` code points or more; a
    shorter one is dropped, yet uses up its text (leftmost, non-overlapping).
    """

    kind: str
    pattern: str
    min_value: int = 1


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
        6,
    ),
    Rule("access", r"(AKIA)([A-Z0-9]+)", 16),
    # a run of the class is one match, so the length can be asked for at once
    Rule("hex", r"()([0-9a-f]{24,})", 24),
)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _smallest(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    return {c for c in clauses if not any(d < c for d in clauses)}


def _both(a: set, b: set) -> set:
    joined = _smallest({x | y for x, y in product(a, b)})
    return joined if len(joined) <= MAX_STRINGS else min(a, b, key=len)


def _strings(op, arg) -> set[str] | None:
    """All texts one parsed element can match, or None if they are many."""
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a) for _, a in arg}
    if op is sre.SUBPATTERN:
        return _joined(arg[-1])
    if op is sre.BRANCH:
        each = [_joined(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _joined(arg[2])
        return inner if inner is None or arg[0] else inner | {""}
    return None


def _joined(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(parts) -> set[frozenset[str]]:
    """Alternatives of trigram sets; one of them is in every match."""
    need, run = {frozenset()}, {""}
    for op, arg in parts:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        need, run = _both(need, _smallest({_grams(x.translate(FOLD)) for x in run})), {""}
        if op is sre.SUBPATTERN:
            need = _both(need, _query(arg[-1]))
        elif op is sre.BRANCH:
            need = _both(need, _smallest(set().union(*(_query(x) for x in arg[1]))))
        elif op is sre.MAX_REPEAT and arg[0]:
            need = _both(need, _query(arg[2]))
    return _both(need, _smallest({_grams(x.translate(FOLD)) for x in run}))


FOLD = str.maketrans(UPPER, LOWER)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Trigram sets (letters A-Z folded), one of which any match contains in
    whole; empty if the regex has no mandatory trigram."""
    need = _query(sre_parse.parse(pattern))
    return [] if frozenset() in need else sorted(need, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over folded texts."""
    folded = docs.select("doc_id", F.translate(F.col("text"), UPPER, LOWER).alias("folded"))
    found = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per doc_id with a flag ``may_<kind>`` for each indexed rule."""
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    flags = []
    for rule in rules:
        clauses = [
            F.size(F.array_intersect("have", F.array(*[F.lit(t) for t in sorted(c)]))) == len(c)
            for c in trigram_query(rule.pattern)
        ]
        if clauses:
            any_of = clauses[0]
            for c in clauses[1:]:
                any_of = any_of | c
            flags.append(any_of.alias(f"may_{rule.kind}"))
    return have.select("doc_id", *flags)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of the rule's matches in ``text``.

    The replacement wraps each match in marks, so that splitting at the marks
    gives gap, head, value, gap, head, value, ..., gap; offsets are running
    sums of the lengths.
    """
    parts = F.split(F.regexp_replace(text, rule.pattern, f"{HEAD}$1{TAIL}$2{HEAD}"), f"[{HEAD}{TAIL}]")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("head"), none.alias("out"))

    def step(acc, part):
        end = acc["at"] + F.length(part)
        span = F.struct(acc["head"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        hit = (acc["i"] == 2) & (F.length(part) >= rule.min_value)
        return F.struct(
            ((acc["i"] + 1) % 3).alias("i"),
            end.alias("at"),
            F.when(acc["i"] == 1, acc["at"]).otherwise(acc["head"]).alias("head"),
            F.when(hit, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of structs
    (start, rank, end) sorted by start, then by the rule's place in ``rules``.

    Offsets are code points, the end exclusive. A null text is empty. Rows
    that share a doc_id (null included) share candidate flags, which only
    widens what is verified. Columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trigrams = sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})
    kept = rows.withColumn("text", F.translate("text", HEAD + TAIL, PLAIN + PLAIN))
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    if indexed:
        may = candidates(trigram_index(rows, trigrams), rules).withColumnRenamed("doc_id", "may_id")
        kept = kept.join(may, F.col("doc_id").eqNullSafe(F.col("may_id")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = [
        F.when(F.col(f"may_{r.kind}"), _spans(F.col("text"), r, k)).otherwise(none)
        if r.kind in indexed
        else F.when(F.col("text").rlike(r.pattern), _spans(F.col("text"), r, k)).otherwise(none)
        for k, r in enumerate(rules)
    ]
    return kept.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def summary(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per kind, the listing ``kind:start:end,...`` and its SHA-256."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listing = F.array_join(
        F.transform(
            "spans",
            lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )

    def of_rank(rank: int):
        return lambda s: s["rank"] == rank

    counts = [
        F.size(F.filter("spans", of_rank(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules)
    ]
    return scanned.select("doc_id", *counts, listing.alias("spans")).select(
        "doc_id",
        *[f"n_{r.kind}" for r in rules],
        F.sha2(F.col("spans"), 256).alias("base_sha256"),
        "spans",
    )
