"""O-25..O-42: reward scoring over completion tables.

Every score is a column expression; the only join is completions x teacher
on the prompt key. Components are extracted once into columns and reused,
so each regex runs once per row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from os.path import commonprefix
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.numeric import (
    calibration,
    parse_python_float,
    softmax,
    uniform_probabilities,
)
from ..functions.chat import completion_text
from ..functions.text import (
    PY_SPACE,
    _quote,
    extract_number,
    extract_tagged,
    is_truthy_string,
    news_from_prompt,
    normalize_text,
)
from .skew import salted_join


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- verifiable


def verifiable_reward(completion: Column | str, reference: Column | str | None = None) -> Column:
    """O-30: length band + answer format + reference match + number match - boilerplate.

    Terms are added in the reference's order so the double result is the same.
    """
    txt = F.coalesce(_col(completion), F.lit(""))
    tokens = F.greatest(F.lit(1), F.floor(F.length(txt) / F.lit(K.CHARS_PER_TOKEN)))
    (limit_a, bonus_a), (limit_b, bonus_b) = K.LENGTH_BANDS
    r_len = F.when(tokens <= limit_a, F.lit(bonus_a)).when(tokens <= limit_b, F.lit(bonus_b)).otherwise(
        F.lit(K.LENGTH_PENALTY)
    )
    fmt = txt.rlike("(?iu)" + K.ANSWER_FORMAT_PATTERN + PY_SPACE + r"*[:\-]")
    r_fmt = F.when(fmt, F.lit(K.FORMAT_BONUS)).otherwise(F.lit(0.0))
    norm_txt = normalize_text(txt)
    total = r_len + r_fmt
    if reference is not None:
        ref = _col(reference)
        has_ref = is_truthy_string(ref)
        r_exact = F.when(has_ref & (norm_txt == normalize_text(ref)), F.lit(K.EXACT_BONUS)).otherwise(F.lit(0.0))
        ns, nr = extract_number(txt), extract_number(ref)
        same_number = has_ref & ns.isNotNull() & nr.isNotNull() & (ns == nr)
        r_num = F.when(same_number, F.lit(K.NUMBER_BONUS)).otherwise(F.lit(0.0))
        total = total + r_exact + r_num
    r_ai = F.when(norm_txt.contains(K.BOILERPLATE_PHRASE), F.lit(K.BOILERPLATE_PENALTY)).otherwise(F.lit(0.0))
    return total - r_ai


def score_verifiable(
    completions: DataFrame,
    references: DataFrame | None,
    key: str | list[str],
    completion: str = "completion",
    reference: str = "reference",
    out: str = "reward",
    hot: list[int] | None = None,
) -> DataFrame:
    """O-30 + O-44: completions LEFT JOIN references on the prompt key, then score.

    The join is an equi-join (sort-merge or size-checked broadcast, chosen by
    adaptive execution from runtime sizes); a completion without a reference
    scores without the reference terms. ``key`` is a column or a list of
    them. A completion may be text or chat-shaped (O-13 gives its text). The
    rows of ``hot`` keys (``skew.hot_keys``) are salted, for streams and joins
    that adaptive execution does not split.
    """
    keys = [key] if isinstance(key, str) else list(key)
    text = completion_text(completion, completions.schema[completion].dataType)
    if references is None:
        return completions.withColumn(out, verifiable_reward(text))
    refs = references.select(*keys, F.col(reference).alias("_gw_ref"))
    joined = salted_join(completions, refs, keys, hot or [])
    return joined.withColumn(out, verifiable_reward(text, "_gw_ref")).drop("_gw_ref")


# ---------------------------------------------------------------- financial


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has(col_sql: str, term: str) -> str:
    return f"contains({col_sql}, {_lit(term)})"


def _in(col_sql: str) -> Callable[[str], str]:
    """Test of a term in a text, as SQL."""
    return lambda term: _has(col_sql, term)


def _count(has: Callable[[str], str], terms) -> str:
    return "(" + " + ".join(f"CAST({has(t)} AS INT)" for t in terms) + ")"


def _any(has: Callable[[str], str], terms) -> str:
    return "(" + " OR ".join(has(t) for t in terms) + ")"


def _overlap_free(tags: list[str]) -> bool:
    """No tag occurs inside another and no suffix of one is a prefix of another,
    so a left-to-right scan sees every occurrence of every tag."""
    for a in tags:
        for b in tags:
            if a != b and a in b:
                return False
            for k in range(1, min(len(a), len(b))):
                if a[-k:] == b[:k]:
                    return False
    return True


def _any_tag(tags: list[str]) -> str:
    """Pattern of any of the tags; what all begin with is written once, so most places fail at its first character."""
    head = commonprefix(tags)
    return _quote(head) + "(?:" + "|".join(_quote(t[len(head) :]) for t in tags) + ")"


def format_gate(c: str, tag_pairs=K.TAG_PAIRS) -> Column:
    """O-31: 1.0 when each of the six tags occurs exactly once (case-sensitive).

    One scan finds the tags of a text; sorted, they must be the list of tags.
    Tags that could overlap fall back to counting each by replacement.
    """
    tags = [t for pair in tag_pairs for t in pair]
    if _overlap_free(tags):
        found = F.sort_array(F.regexp_extract_all(F.coalesce(F.col(_q(c)), F.lit("")), F.lit(_any_tag(tags)), F.lit(0)))
        return F.when(found == F.array(*[F.lit(t) for t in sorted(set(tags))]), F.lit(1.0)).otherwise(F.lit(0.0))
    txt = f"coalesce({_q(c)}, '')"
    guard = " AND ".join(_has(txt, t) for t in tags)
    exact = " AND ".join(
        f"octet_length({txt}) - octet_length(replace({txt}, {_lit(t)}, '')) = {len(t.encode('utf-8'))}" for t in tags
    )
    return F.expr(f"CASE WHEN {guard} AND {exact} THEN 1.0D ELSE 0.0D END")


def component_columns(completion: Column | str) -> dict[str, Column]:
    """O-25 as named columns: reasoning / sentiment (lower-cased) / confidence text."""
    c = _col(completion)
    return {
        "reasoning": extract_tagged(c, K.REASONING_START, K.REASONING_END),
        "sentiment": F.lower(extract_tagged(c, K.SENTIMENT_START, K.SENTIMENT_END)),
        "confidence_text": extract_tagged(c, K.CONFIDENCE_START, K.CONFIDENCE_END),
    }


def extract_components(df: DataFrame, completion: str = "completion") -> DataFrame:
    """O-25: reasoning / sentiment (lower-cased) / confidence text, '' when missing."""
    return df.withColumns(component_columns(completion))


def _text(reasoning: str, lowered: bool) -> str:
    c = f"coalesce({_q(reasoning)}, '')"
    return c if lowered else f"lower({c})"


def _clamp01_sql(x: str) -> str:
    return f"greatest(0.0D, least(1.0D, {x}))"


def _quality(has: Callable[[str], str]) -> Column:
    pos, neg = _any(has, K.QUALITY_POSITIVE_CUES), _any(has, K.QUALITY_NEGATIVE_CUES)
    terms = f"least({_count(has, K.FINANCIAL_TERMS)} / {K.QUALITY_TERMS_FULL}D, 1.0D) * {K.QUALITY_TERMS_WEIGHT}D"
    links = f"least({_count(has, K.CONNECTIVES)} / {K.QUALITY_LINKS_FULL}D, 1.0D) * {K.QUALITY_LINKS_WEIGHT}D"
    balance = (
        f"CASE WHEN {pos} THEN CASE WHEN {neg} THEN {K.QUALITY_BOTH_CUES}D ELSE {K.QUALITY_ONE_CUE}D END "
        f"WHEN {neg} THEN {K.QUALITY_ONE_CUE}D ELSE 0.0D END"
    )
    return F.expr(_clamp01_sql(f"{terms} + {links} + {balance}"))


def reasoning_quality(reasoning: str, lowered: bool = False) -> Column:
    """O-35: 0.4 x min(finance terms / 3, 1) + 0.3 x min(connectives / 2, 1)
    + cue balance (0.3 both polarities, 0.15 one), clamped to [0, 1]."""
    return _quality(_in(_text(reasoning, lowered)))


def _logic(has: Callable[[str], str]) -> Column:
    contradictory = " OR ".join(f"({has(a)} AND {has(b)})" for a, b in K.LOGIC_CONTRADICTIONS)
    base = f"CASE WHEN {contradictory} THEN {K.LOGIC_CONTRADICTED}D ELSE {K.LOGIC_BASE}D END"
    conclusion = f"CASE WHEN {_any(has, K.LOGIC_CONCLUSION_WORDS)} THEN {K.LOGIC_CONCLUSION}D ELSE 0.0D END"
    hedge = f"CASE WHEN {_any(has, K.LOGIC_HEDGE_WORDS)} THEN {K.LOGIC_HEDGE}D ELSE 0.0D END"
    return F.expr(_clamp01_sql(f"{base} + {conclusion} + {hedge}"))


def reasoning_logic(reasoning: str, lowered: bool = False) -> Column:
    """O-36: 0.5 (0.2 when growth & decline or profit & loss) + 0.3 for a
    conclusion word + 0.2 for a hedge word, clamped."""
    return _logic(_in(_text(reasoning, lowered)))


def _context(has: Callable[[str], str]) -> Column:
    terms = f"least({_count(has, K.CONTEXT_TERMS)} / {K.CONTEXT_TERMS_FULL}D, 1.0D) * {K.CONTEXT_TERMS_WEIGHT}D"
    timing = (
        f"CASE WHEN {_any(has, K.TIMING_TERMS)} THEN {K.CONTEXT_HORIZON}D "
        f"WHEN {has(K.FUTURE_TERM)} THEN {K.CONTEXT_FUTURE}D ELSE 0.0D END"
    )
    return F.expr(_clamp01_sql(f"{terms} + {timing}"))


def reasoning_context(reasoning: str, lowered: bool = False) -> Column:
    """O-37: 0.6 x min(context terms / 3, 1) + timing (0.4 horizon, 0.2 future), clamped."""
    return _context(_in(_text(reasoning, lowered)))


@dataclass(frozen=True)
class BundleWeights:
    quality: float = K.BUNDLE_WEIGHTS["quality"]
    logic: float = K.BUNDLE_WEIGHTS["logic"]
    context: float = K.BUNDLE_WEIGHTS["context"]


@dataclass(frozen=True)
class FinanceWeights:
    """Weights of the finance reward; they total 0.95 as in the reference (Q-1)."""

    sentiment: float = K.FINANCE_WEIGHTS["sentiment"]
    reasoning: float = K.FINANCE_WEIGHTS["reasoning"]
    calibration: float = K.FINANCE_WEIGHTS["calibration"]
    direction: float = K.FINANCE_WEIGHTS["direction"]


def _direction(has: Callable[[str], str], sentiment: str) -> Column:
    s = _q(sentiment)
    pos, neg = _any(has, K.DIRECTION_POSITIVE_CUES), _any(has, K.DIRECTION_NEGATIVE_CUES)
    agree = f"CASE WHEN {pos} THEN {s} = CASE WHEN {neg} THEN 'neutral' ELSE 'positive' END ELSE {s} = 'negative' AND {neg} END"
    return F.expr(f"CASE WHEN {agree} THEN 1.0D ELSE 0.0D END")


def directional(reasoning: str, sentiment: str, lowered: bool = False) -> Column:
    """O-40: cue direction agrees with the stated sentiment (own cue lists)."""
    return _direction(_in(_text(reasoning, lowered)), sentiment)


_LC = "_gw_reasoning_lc"


def score_reasoning(df: DataFrame, bundle: BundleWeights = BundleWeights(), with_direction: bool = False) -> DataFrame:
    """O-35..O-38 (and O-40) over an extracted ``reasoning`` column.

    The reasoning is lower-cased once into its own column, and a term that
    several lexicons share is looked for once, into a column that they read
    (separate projections, so the optimizer does not inline the costly ``lower``
    and ``contains`` into every test).
    """
    rules = {"quality": _quality, "logic": _logic, "context": _context}
    if with_direction:
        rules["direction"] = lambda has: _direction(has, "sentiment")
    uses: Counter[str] = Counter()
    for rule in rules.values():
        rule(lambda term: uses.update([term]) or "true")
    shared = {term: f"_gw_has_{i}" for i, term in enumerate(t for t, n in uses.items() if n > 1)}
    test = _in(_q(_LC))
    out = df.withColumn(_LC, F.lower(F.coalesce(F.col("reasoning"), F.lit(""))))
    out = out.withColumns({c: F.expr(test(term)) for term, c in shared.items()})
    out = out.withColumns({name: rule(lambda term: shared.get(term) or test(term)) for name, rule in rules.items()})
    weighted = (
        F.lit(bundle.quality) * F.col("quality")
        + F.lit(bundle.logic) * F.col("logic")
        + F.lit(bundle.context) * F.col("context")
    )
    return out.select(*[c for c in out.columns if c not in (_LC, *shared.values())], weighted.alias("bundle"))


def teacher_probabilities(
    teacher: DataFrame,
    key: str,
    text: str = "text",
    logits: str = "logits",
    labels=K.TEACHER_LABELS,
) -> DataFrame:
    """O-32/O-33 (table form): (key, probs) with ``probs`` an array aligned with
    ``labels`` (narrower than a map, so the side stays broadcastable longer).
    A row without logits is no prediction (null); blank text -> 1/n each, as
    the teacher returns for an empty input; otherwise softmax of the logits."""
    blank = F.col(text).isNull() | (F.col(text) == "")
    probs = (
        F.when(F.col(logits).isNull(), F.lit(None).cast("array<double>"))
        .when(blank, uniform_probabilities(labels))
        .otherwise(softmax(logits))
    )
    return teacher.select(F.col(key), probs.alias("probs"))


def teacher_alignment(probs: Column | str, sentiment: Column | str, labels=K.TEACHER_LABELS) -> Column:
    """O-34: teacher probability of the model's sentiment; unknown -> 0.

    ``probs`` is an array aligned with ``labels`` or a ``map<label, p>``
    (as :func:`score_teacher` returns)."""
    p, s = _col(probs), _col(sentiment)
    picked = None
    for i, label in enumerate(labels):
        picked = (picked.when if picked is not None else F.when)(s == label, F.get(p, i))
    return F.coalesce(picked, F.lit(0.0))


def teacher_alignment_map(probs: Column | str, sentiment: Column | str) -> Column:
    """O-34 for a ``map<label, p>`` of probabilities."""
    return F.coalesce(F.try_element_at(_col(probs), _col(sentiment)), F.lit(0.0))


def finance_components(df: DataFrame, completion: str = "completion", prompt: str | None = None) -> DataFrame:
    """Gate, components, parsed confidence, news text and reasoning scores in one
    projection chain (no shuffle)."""
    first = {"gate": format_gate(completion), **component_columns(completion)}
    if prompt is not None:
        first["news"] = news_from_prompt(prompt)
    out = df.withColumns(first).withColumn("confidence", parse_python_float("confidence_text"))
    return score_reasoning(out, with_direction=True)


def finance_reward(
    completions: DataFrame,
    teacher_probs: DataFrame,
    key: str,
    completion: str = "completion",
    prompt: str | None = None,
    weights: FinanceWeights = FinanceWeights(),
) -> DataFrame:
    """O-41 (+O-34, O-39, O-45): ``gate * (w1 p + w2 bundle + w3 calibration + w4 direction)``.

    ``teacher_probs`` is (key, probs) from :func:`teacher_probabilities` or
    :func:`with_teacher` (:func:`finance_reward_by_news` does the whole path
    from a prompt). The join is a LEFT equi-join on the prompt key; a
    prompt without a prediction aligns to 0. Adaptive execution broadcasts the
    prediction side only when its measured size is under the broadcast
    threshold and splits skewed prompt keys otherwise.
    """
    scored = finance_components(completions, completion, prompt)
    joined = scored.join(teacher_probs.select(F.col(key), F.col("probs")), key, "left")
    p = teacher_alignment("probs", "sentiment")
    total = (
        F.lit(weights.sentiment) * F.col("p_teacher")
        + F.lit(weights.reasoning) * F.col("bundle")
        + F.lit(weights.calibration) * F.col("calibration")
        + F.lit(weights.direction) * F.col("direction")
    )
    keep = [c for c in joined.columns if c != "probs"]
    aligned = joined.select(*keep, p.alias("p_teacher"))
    with_cal = aligned.withColumn("calibration", calibration("p_teacher", "confidence"))
    return with_cal.withColumn(
        "finance_reward", F.when(F.col("gate") == 0.0, F.lit(0.0)).otherwise(F.col("gate") * total)
    )


def total_reward(gate: Column | str, finance: Column | str, gate_weight: float = 1.0, finance_weight: float = 1.0) -> Column:
    """O-42: the two rewards the trainer receives, summed with weights (1, 1 by default)."""
    return F.lit(gate_weight) * _col(gate) + F.lit(finance_weight) * _col(finance)


# ---------------------------------------------------------------- teacher model


Predictor = Callable[[list[str]], list[list[float]]]


def _ship_by_value() -> None:
    """Serialise this package's functions by value for Python workers, so a
    predictor defined here runs even where the package is not installed on
    the executors (it only has to be importable on the driver)."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def text_key(text: Column | str) -> Column:
    """A narrow join key of a text: its SHA-256; null for a null or blank one."""
    t = _col(text)
    return F.when(t != "", F.sha2(t.cast("binary"), 256))


def score_teacher(
    df: DataFrame,
    text: str,
    predictor_factory: Callable[[], Predictor],
    labels=K.TEACHER_LABELS,
    max_chars: int | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """O-33 with a user model: (text_key, probs) for every distinct text in
    ``df`` that is not blank (``probs`` aligned with ``labels``).

    Each distinct text is predicted once (six generations share a prompt).
    Whole texts go to the model; pass ``max_chars`` for a model with a fixed
    window. Null and blank texts never reach the model nor the shuffle:
    :func:`with_teacher` gives them 1/n each. The model is built once per task
    by ``predictor_factory`` and fed Arrow batches through ``mapInPandas``.
    """
    _ship_by_value()
    some = df.select(F.col(text).alias("text")).filter(F.col("text") != "")
    distinct = some.groupBy(text_key("text").alias("text_key")).agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor_factory()
        for pdf in batches:
            probs: list[list[float]] = []
            texts = [t if max_chars is None else t[:max_chars] for t in pdf["text"]]
            for lo in range(0, len(texts), batch_size):
                probs += [list(p) for p in predict(texts[lo : lo + batch_size])]
            yield pd.DataFrame({"text_key": pdf["text_key"], "probs": probs})

    kind = T.StructType([T.StructField("text_key", T.StringType()), T.StructField("probs", T.ArrayType(T.DoubleType()))])
    return distinct.mapInPandas(run, kind)


def with_teacher(df: DataFrame, text: str, scored: DataFrame, labels=K.TEACHER_LABELS) -> DataFrame:
    """``df`` with ``probs`` of its texts from :func:`score_teacher`, joined by
    the texts' digests; a null or blank text gets 1/n each.

    Blank rows have no join key: they are spread by a hash of the row, since
    one key for all of them would put them in one task.
    """
    keyed = df.withColumn("_gw_key", F.coalesce(text_key(text), F.concat(F.lit("blank "), F.xxhash64(*df.columns).cast("string"))))
    joined = keyed.join(scored.withColumnRenamed("text_key", "_gw_key"), "_gw_key", "left").drop("_gw_key")
    blank = F.col(text).isNull() | (F.col(text) == "")
    return joined.withColumn("probs", F.when(blank, uniform_probabilities(labels)).otherwise(F.col("probs")))


def finance_reward_by_news(
    completions: DataFrame,
    predictor_factory: Callable[[], Predictor],
    prompt: str = "prompt",
    completion: str = "completion",
    key: str = "prompt_id",
    weights: FinanceWeights = FinanceWeights(),
    **teacher,
) -> DataFrame:
    """The whole reward path: prompt -> news -> teacher model -> reward.

    The news is cut out and scored once per prompt key, and only the narrow
    (key, probs) meets the generations. Generations of one key share their
    prompt.
    """
    news = completions.groupBy(key).agg(F.any_value(prompt).alias("_gw_prompt"))
    news = news.select(key, news_from_prompt("_gw_prompt").alias("_gw_news"))
    probs = with_teacher(news, "_gw_news", score_teacher(news, "_gw_news", predictor_factory, **teacher))
    return finance_reward(completions.drop(prompt), probs.select(key, "probs"), key, completion, weights=weights)


# ---------------------------------------------------------------- several rewards


@dataclass(frozen=True)
class NamedReward:
    """A reward of the registry: a name and a column over a completion table."""

    name: str
    column: Callable[[DataFrame], Column]
    weight: float = 1.0


def apply_rewards(df: DataFrame, rewards: list[NamedReward], out: str = "total_reward") -> DataFrame:
    """Several rewards on one completion table, as a trainer takes a list of
    callables: a column per reward under its name and their weighted sum, in
    the order given, in one projection each."""
    names = [r.name for r in rewards]
    if len(set(names)) != len(names):
        raise ValueError(f"reward names must differ: {names}")
    scored = df.withColumns({r.name: r.column(df) for r in rewards})
    total = F.lit(0.0)
    for r in rewards:
        total = total + F.lit(r.weight) * F.col(r.name)
    return scored.withColumn(out, total)
