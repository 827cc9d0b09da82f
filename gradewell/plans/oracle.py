"""DuckDB SQL twins of the query catalogue (the correctness oracle).

Each statement rebuilds its inputs from the driver views with the same rules
as ``fixtures.py`` and computes the result with plain SQL (window ``lead``
instead of the two-step lookup, ``row_number`` instead of the parallel row
index, per-row ``CASE`` instead of shared column functions). Patterns, weights
and limits are written out here; only the fixed long texts (prompts, tags,
word lists, example rows) come from ``constants``, and the completion
templates from ``fixtures``.
"""

from __future__ import annotations

from .. import constants as K
from . import fixtures as X

# White space and digits as Python's str methods see them.
SPACES = [*range(9, 14), 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
PY_SPACE = "[" + "".join(rf"\x{{{c:x}}}" for c in SPACES) + "]"
PY_DIGIT = r"\p{Nd}"
NUMBER_AT_END = r"(?:####" + PY_SPACE + r"*)?(-?\p{Nd}+(?:\.\p{Nd}+)?)" + PY_SPACE + "*$"
PY_FLOAT = (
    r"^[+-]?([0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|([nN][aA][nN])|[iI][nN][fF]"
    r"|[iI][nN][fF][iI][nN][iI][tT][yY])$"
)
ANSWER_FORMAT = "(?i)(final answer|answer)" + PY_SPACE + r"*[:\-]"

GEN_KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_CHARS = " || ".join(f"chr({c})" for c in SPACES)


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def norm(x: str) -> str:
    stripped = strip(f"coalesce({x}, '')")
    return f"lower(regexp_replace({stripped}, {lit(PY_SPACE + '+')}, ' ', 'g'))"


def number(x: str) -> str:
    stripped = strip(f"coalesce({x}, '')")
    return f"nullif(regexp_extract({stripped}, {lit(NUMBER_AT_END)}, 1), '')"


def once(x: str, tag: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(tag)}, '')) = {len(tag)})"


def tagged(x: str, a: str, b: str) -> str:
    return strip(f"regexp_extract(coalesce({x}, ''), {lit('(?is)' + a + '(.*?)' + b)}, 1)")


def has(t: str, w: str) -> str:
    return f"(strpos({t}, {lit(w)}) > 0)"


def count_terms(t: str, terms) -> str:
    return "(" + " + ".join(f"CAST({has(t, w)} AS INTEGER)" for w in terms) + ")"


def any_of(t: str, terms) -> str:
    return "(" + " OR ".join(has(t, w) for w in terms) + ")"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def D(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def chatml(messages: list[tuple[str, str]], open_: bool = False) -> str:
    parts = []
    for role, content in messages:
        parts += [lit(f"<|im_start|>{role}\n"), content, lit("<|im_end|>\n")]
    if open_:
        parts.append(lit("<|im_start|>assistant\n"))
    return "(" + " || ".join(parts) + ")"


def upper_full(x: str) -> str:
    """Java / Python upper-casing: full case mapping (the data's only multi-char case is sharp s)."""
    return f"upper(replace({x}, 'ß', 'SS'))"


# ------------------------------------------------------------------ fixtures

PAIRS = """pairs AS (
  SELECT conv_id * 1000 + turn AS k, conv_id, turn, text AS prompt, next_text AS reference
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations) c
  WHERE role = 'user' AND next_role = 'assistant')"""

_pad_cases = " ".join(f"WHEN {v} THEN rpad(full_ref, {w}, '.')" for v, w in X.VARIANT_PAD.items())
VERIFIABLE = f"""{PAIRS},
vbase AS (
  SELECT k, conv_id, turn, CAST((conv_id * 3 + turn) % 10 AS INTEGER) AS variant, k % 97 AS n,
         reference || ' ' || CAST(CASE WHEN conv_id % 2 = 0 THEN k % 97 ELSE k % 97 + 1 END AS VARCHAR) AS full_ref
  FROM pairs),
vcomp AS (
  SELECT conv_id, turn, variant, CASE variant
    WHEN 0 THEN full_ref
    WHEN 1 THEN {upper_full("replace(full_ref, ' ', '  ')")}
    WHEN 2 THEN 'Final answer: ' || CAST(n AS VARCHAR)
    WHEN 3 THEN '#### ' || CAST(n AS VARCHAR)
    WHEN 4 THEN {lit(X.BOILERPLATE_COMPLETION)}
    WHEN 5 THEN ''
    {_pad_cases} END AS completion
  FROM vbase),
vref AS (
  SELECT conv_id, turn, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN '' ELSE full_ref END AS reference
  FROM vbase WHERE k % 19 <> 0),
vjoined AS (
  SELECT c.conv_id, c.turn, c.variant, coalesce(c.completion, '') AS txt, r.reference AS ref
  FROM vcomp c LEFT JOIN vref r ON r.conv_id = c.conv_id AND r.turn = c.turn),
vscored AS (
  SELECT conv_id, turn, variant,
    CAST(CASE WHEN greatest(1, length(txt) // 4) <= 256 THEN 0.2 WHEN greatest(1, length(txt) // 4) <= 512 THEN 0.1 ELSE -0.2 END AS DOUBLE)
    + CAST(CASE WHEN regexp_matches(txt, {lit(ANSWER_FORMAT)}) THEN 0.2 ELSE 0.0 END AS DOUBLE)
    + CAST(CASE WHEN ref <> '' AND {norm('txt')} = {norm('ref')} THEN 1.0 ELSE 0.0 END AS DOUBLE)
    + CAST(CASE WHEN ref <> '' AND {number('txt')} = {number('ref')} THEN 0.6 ELSE 0.0 END AS DOUBLE)
    - CAST(CASE WHEN strpos({norm('txt')}, 'as an ai') > 0 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS reward
  FROM vjoined)"""

CHATS = """chats AS (SELECT conv_id, turn, role, text FROM conversations)"""

RAW_EXAMPLES = """raw AS (
  SELECT doc_id, lang,
    CASE WHEN doc_id % 8 = 0 THEN text WHEN doc_id % 8 IN (5, 6) THEN '' WHEN doc_id % 8 = 7 THEN '   ' END AS prompt,
    CASE WHEN doc_id % 8 = 1 THEN text WHEN doc_id % 8 = 3 THEN 'What is the topic?' END AS question,
    CASE WHEN doc_id % 8 = 2 THEN 'Summarize the document.' WHEN doc_id % 8 = 6 THEN '' END AS instruction,
    CASE WHEN doc_id % 8 = 2 THEN text END AS input,
    CASE WHEN doc_id % 8 = 3 THEN text END AS context,
    CASE WHEN doc_id % 8 IN (5, 7) THEN text END AS text,
    CASE WHEN doc_id % 8 = 4 THEN [struct_pack(role := 'user', content := text), struct_pack(role := 'assistant', content := lang)]
         WHEN doc_id % 8 = 6 THEN []::STRUCT(role VARCHAR, content VARCHAR)[] END AS messages,
    CASE WHEN doc_id % 4 = 1 THEN '' END AS reference,
    CASE WHEN doc_id % 4 = 0 THEN source END AS answer,
    CASE WHEN doc_id % 4 = 3 THEN lang END AS chosen,
    CASE WHEN doc_id % 4 = 3 THEN 'n/a' END AS rejected
  FROM documents)"""

SENTENCES = f"""sentences AS (
  SELECT d.doc_id, d.text,
    CASE WHEN l.quality + 2 * l.toxic = 0 THEN {lit(K.LABEL_NEGATIVE[0])} WHEN l.quality + 2 * l.toxic = 1 THEN {lit(K.LABEL_NEUTRAL[0])} ELSE {lit(K.LABEL_POSITIVE[0])} END AS reasoning,
    CASE WHEN l.quality + 2 * l.toxic = 0 THEN 'negative' WHEN l.quality + 2 * l.toxic = 1 THEN 'neutral' ELSE 'positive' END AS sentiment,
    CASE WHEN l.quality + 2 * l.toxic = 0 THEN {D(K.LABEL_NEGATIVE[2])} WHEN l.quality + 2 * l.toxic = 1 THEN {D(K.LABEL_NEUTRAL[2])} ELSE {D(K.LABEL_POSITIVE[2])} END AS confidence,
    {lit(K.LABEL_SOURCE)} AS source
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

SFT_TEXT = chatml(
    [
        ("system", lit(K.SYSTEM_FINANCIAL_SFT)),
        ("user", f"{lit(K.NEWS_PREFIX)} || text"),
        (
            "assistant",
            f"'<REASONING>' || reasoning || '</REASONING>' || chr(10) || '<SENTIMENT>' || sentiment || '</SENTIMENT>' || chr(10) "
            f"|| '<CONFIDENCE>' || CAST(confidence AS VARCHAR) || '</CONFIDENCE>'",
        ),
    ]
)
RL_PROMPT = chatml([("system", lit(K.SYSTEM_FINANCIAL_RL)), ("user", f"{lit(K.NEWS_PREFIX)} || text")], open_=True)


def news_sql(k: str) -> str:
    return f"('Quarterly update for order ' || CAST({k} AS VARCHAR) || ': shipments and pricing reviewed.')"


_TEMPLATE_VALUES = ",\n    ".join(f"({i}, {lit(t)})" for i, t in enumerate(X.FINANCE_TEMPLATES))
ORDER_PROMPT = chatml([("system", lit(K.SYSTEM_FINANCIAL_RL)), ("user", f"{lit(K.NEWS_PREFIX)} || {news_sql('o_orderkey')}")], open_=True)

GENS = f"""templates AS (SELECT * FROM (VALUES
    {_TEMPLATE_VALUES}) t(template_id, completion)),
gens AS (
  SELECT {GEN_KEY_SQL}, l_orderkey AS prompt_id,
    CASE WHEN d.text IS NULL THEN t.completion
         ELSE replace(t.completion, '</REASONING>', ' ' || split_part(d.text, '.', 1) || '</REASONING>') END AS completion
  FROM lineitem JOIN templates t ON t.template_id = CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 20 AS INTEGER)
  LEFT JOIN documents d ON d.doc_id = l_partkey),
prompts AS (SELECT o_orderkey AS prompt_id, {ORDER_PROMPT} AS prompt FROM orders),
gp AS (SELECT g.*, p.prompt FROM gens g JOIN prompts p ON p.prompt_id = g.prompt_id)"""

_LOW_R = "lower(reasoning)"
COMPONENTS = f"""{GENS},
comp AS (
  SELECT {GEN_KEY_SQL}, prompt_id, completion,
    CAST(CASE WHEN {" AND ".join(once("completion", t) for pair in K.TAG_PAIRS for t in pair)} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS gate,
    {tagged("completion", K.REASONING_START, K.REASONING_END)} AS reasoning,
    lower({tagged("completion", K.SENTIMENT_START, K.SENTIMENT_END)}) AS sentiment,
    {tagged("completion", K.CONFIDENCE_START, K.CONFIDENCE_END)} AS confidence_text
  FROM gens),
scored AS (
  SELECT *,
    CASE WHEN regexp_matches(confidence_text, {lit(PY_FLOAT)})
         THEN TRY_CAST(regexp_replace(confidence_text, '^[+-]([nN][aA][nN])$', '\\1') AS DOUBLE) ELSE 0.0 END AS confidence,
    greatest(0.0, least(1.0,
        least({count_terms(_LOW_R, K.FINANCIAL_TERMS)} / 3.0, 1.0) * 0.4
      + least({count_terms(_LOW_R, K.CONNECTIVES)} / 2.0, 1.0) * 0.3
      + CASE WHEN {any_of(_LOW_R, K.QUALITY_POSITIVE_CUES)} AND {any_of(_LOW_R, K.QUALITY_NEGATIVE_CUES)} THEN 0.3
             WHEN {any_of(_LOW_R, K.QUALITY_POSITIVE_CUES)} OR {any_of(_LOW_R, K.QUALITY_NEGATIVE_CUES)} THEN 0.15 ELSE 0.0 END)) AS quality,
    greatest(0.0, least(1.0,
        CASE WHEN ({has(_LOW_R, 'growth')} AND {has(_LOW_R, 'decline')}) OR ({has(_LOW_R, 'profit')} AND {has(_LOW_R, 'loss')}) THEN 0.2 ELSE 0.5 END
      + CASE WHEN {any_of(_LOW_R, K.LOGIC_CONCLUSION_WORDS)} THEN 0.3 ELSE 0.0 END
      + CASE WHEN {any_of(_LOW_R, K.LOGIC_HEDGE_WORDS)} THEN 0.2 ELSE 0.0 END)) AS logic,
    greatest(0.0, least(1.0,
        least({count_terms(_LOW_R, K.CONTEXT_TERMS)} / 3.0, 1.0) * 0.6
      + CASE WHEN {any_of(_LOW_R, K.TIMING_TERMS)} THEN 0.4 WHEN {has(_LOW_R, K.FUTURE_TERM)} THEN 0.2 ELSE 0.0 END)) AS context,
    CASE WHEN ({any_of(_LOW_R, K.DIRECTION_POSITIVE_CUES)} AND {any_of(_LOW_R, K.DIRECTION_NEGATIVE_CUES)} AND sentiment = 'neutral')
           OR ({any_of(_LOW_R, K.DIRECTION_POSITIVE_CUES)} AND NOT {any_of(_LOW_R, K.DIRECTION_NEGATIVE_CUES)} AND sentiment = 'positive')
           OR ({any_of(_LOW_R, K.DIRECTION_NEGATIVE_CUES)} AND NOT {any_of(_LOW_R, K.DIRECTION_POSITIVE_CUES)} AND sentiment = 'negative')
         THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS direction
  FROM comp),
bundled AS (SELECT *, 0.5 * quality + 0.3 * logic + 0.2 * context AS bundle FROM scored)"""

TEACHER = f"""teacher AS (
  SELECT o_orderkey AS prompt_id,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 19 <> 0 THEN {news_sql('o_orderkey')} END AS text,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 7 AS DOUBLE) / 2.0 END AS a,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) / 2.0 END AS b,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) / 2.0 END AS c
  FROM orders WHERE o_orderkey % 11 <> 0),
tmax AS (SELECT *, greatest(a, b, c) AS m FROM teacher),
tprobs AS (
  SELECT prompt_id,
    CASE WHEN a IS NULL THEN NULL WHEN coalesce(text, '') = '' THEN 1.0 / 3.0 ELSE exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)) END AS p_negative,
    CASE WHEN a IS NULL THEN NULL WHEN coalesce(text, '') = '' THEN 1.0 / 3.0 ELSE exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)) END AS p_neutral,
    CASE WHEN a IS NULL THEN NULL WHEN coalesce(text, '') = '' THEN 1.0 / 3.0 ELSE exp(c - m) / (exp(a - m) + exp(b - m) + exp(c - m)) END AS p_positive
  FROM tmax)"""


def by_length(news: str, label: int) -> str:
    """Softmax share of a label under the stand-in model over a text's length;
    a third for a blank or null text."""
    n = f"length({news})"
    logits = [f"(CAST({n} % {m} AS DOUBLE) / 2.0)" for m in (7, 5, 3)]
    top = f"greatest({', '.join(logits)})"
    parts = [f"exp({x} - {top})" for x in logits]
    return f"CASE WHEN coalesce({news}, '') = '' THEN 1.0 / 3.0 ELSE {parts[label]} / ({' + '.join(parts)}) END"


_REWARD = """calibrated AS (
  SELECT *, CASE WHEN isnan(1.0 - (confidence - p_teacher) * (confidence - p_teacher)) THEN 0.0
                 ELSE greatest(0.0, 1.0 - (confidence - p_teacher) * (confidence - p_teacher)) END AS calibration
  FROM aligned),
fin AS (
  SELECT *, CASE WHEN gate = 0 THEN 0.0 ELSE gate * (0.35 * p_teacher + 0.25 * bundle + 0.2 * calibration + 0.15 * direction) END AS finance_reward
  FROM calibrated)"""

FINANCE = f"""{COMPONENTS},
{TEACHER},
aligned AS (
  SELECT s.*, coalesce(CASE s.sentiment WHEN 'negative' THEN t.p_negative WHEN 'neutral' THEN t.p_neutral WHEN 'positive' THEN t.p_positive END, 0.0) AS p_teacher
  FROM bundled s LEFT JOIN tprobs t ON t.prompt_id = s.prompt_id),
{_REWARD}"""

# prompt -> news -> model: news only in prompts that hold the prefix
FINANCE_MODEL = f"""{COMPONENTS},
orders_news AS (
  SELECT prompt_id, CASE WHEN prompt_id % 13 = 0 OR prompt_id % 19 = 0 THEN ''
    ELSE {strip(f"substr(prompt, strpos(prompt, {lit(K.NEWS_PREFIX)}) + {len(K.NEWS_PREFIX)})")} END AS news
  FROM prompts),
guessed AS (
  SELECT b.*, coalesce(n.news, '') AS news FROM bundled b LEFT JOIN orders_news n ON n.prompt_id = b.prompt_id),
aligned AS (
  SELECT *, coalesce(CASE sentiment WHEN 'negative' THEN {by_length('news', 0)} WHEN 'neutral' THEN {by_length('news', 1)}
                       WHEN 'positive' THEN {by_length('news', 2)} END, 0.0) AS p_teacher FROM guessed),
{_REWARD}"""

CHART_OUT = f"""co AS (
  SELECT doc_id,
    CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'charts/' || CAST(doc_id AS VARCHAR) || '.png' END AS image_path,
    CASE WHEN doc_id % 5 = 0 THEN 'https://example.org/' || CAST(doc_id AS VARCHAR) END AS original_image_url,
    'Which language is document ' || CAST(doc_id AS VARCHAR) || ' written in?' AS question,
    lang,
    CASE doc_id % 7
      WHEN 0 THEN 'User: Which language is document ' || CAST(doc_id AS VARCHAR) || ' written in?' || chr(10) || 'Assistant: ' || lang
      WHEN 1 THEN 'a Assistant: b Assistant: ' || upper(lang)
      WHEN 2 THEN text
      WHEN 3 THEN 'Assistant: ' || lang || '<|im_end|>'
      WHEN 4 THEN 'the value was ' || CAST(doc_id % 100 AS VARCHAR) || ' in the year of our lord two thousand'
      WHEN 5 THEN replace(text, chr(10), ' ')
      ELSE '' END AS raw_output,
    CASE WHEN doc_id % 19 = 0 THEN 'error' ELSE 'success' END AS processing_status,
    CASE WHEN doc_id % 19 = 0 THEN 'generation failed' END AS error_message
  FROM documents),
a1 AS (
  SELECT *, {strip("CASE WHEN strpos(raw_output, 'Assistant:') > 0 THEN string_split(raw_output, 'Assistant:')[-1] ELSE string_split(" + strip('raw_output') + ", chr(10))[-1] END")} AS a0
  FROM co),
a2 AS (SELECT *, {strip("replace(replace(a0, '<|end_of_text|>', ''), '<|im_end|>', '')")} AS a FROM a1),
a3 AS (SELECT *, string_split_regex(a, {lit(PY_SPACE + '+')}) AS words FROM a2),
answers AS (
  SELECT *, CASE WHEN len(words) > 10 THEN
      CASE WHEN regexp_matches(array_to_string(words[1:5], ' '), {lit('(^| )' + PY_DIGIT + '+( |$)')})
           THEN array_to_string(words[1:5], ' ') ELSE words[1] END
    ELSE a END AS model_answer
  FROM a3),
pos AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS dataset_index FROM answers),
numbered AS (
  SELECT row_number() OVER (ORDER BY dataset_index) - 1 AS sample_id, dataset_index, image_path, original_image_url, question, lang,
    CASE WHEN processing_status = 'error' THEN 'ERROR: ' || coalesce(error_message, '') ELSE model_answer END AS model_answer,
    processing_status
  FROM pos WHERE image_path IS NOT NULL)"""

TRAIN_LOG = """tlog AS (
  SELECT event_id AS step,
    CASE WHEN event_type <> 'error' THEN value END AS loss,
    CASE WHEN event_type = 'purchase' THEN value END AS reward,
    CASE WHEN event_type = 'view' THEN value END AS kl,
    CASE WHEN event_type = 'signup' THEN value END AS eval_loss
  FROM events)"""

VARIANTS = f"""base AS (SELECT doc_id, 'Summarize document ' || CAST(doc_id AS VARCHAR) AS prompt, text AS base_output FROM documents),
tuned AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {upper_full('text')} ELSE text END AS lora_output FROM documents WHERE doc_id % 17 <> 0),
cmp AS (SELECT b.doc_id, b.prompt, b.base_output, t.lora_output FROM base b JOIN tuned t ON t.doc_id = b.doc_id)"""


def _preview(x: str) -> str:
    f = f"replace(coalesce({x}, ''), chr(10), ' ')"
    return f"CASE WHEN length({f}) > {K.PREVIEW_CHARS} THEN substr({f}, 1, {K.PREVIEW_CHARS}) || {lit(K.PREVIEW_ELLIPSIS)} ELSE {f} END"


def _flat_chat() -> str:
    return strip(f"string_agg(role || ': ' || {strip('text')}, chr(10) ORDER BY turn)")


_SYN_ROWS = " UNION ALL ".join(
    f"SELECT CAST(NULL AS BIGINT) AS doc_id, {lit(t)} AS text, {lit(s)} AS sentiment, {D(c)} AS confidence, CAST(NULL AS VARCHAR) AS source"
    for t, _r, s, c in K.SYNTHETIC_EXAMPLES
)

_JSON_ROW = (
    "to_json(struct_pack(doc_id := doc_id, lang := lang, prompt := prompt, question := question, "
    "instruction := instruction, input := input, context := context, text := text, messages := messages, "
    "reference := reference, answer := answer, chosen := chosen, rejected := rejected))::VARCHAR"
)


def _prompt_sql() -> str:
    flat = strip(f"'user: ' || {strip('messages[1].content')} || chr(10) || 'assistant: ' || {strip('messages[2].content')}")
    instr, inp = strip("coalesce(instruction, '')"), strip("coalesce(input, '')")
    ctx, q = strip("coalesce(context, '')"), strip("coalesce(question, '')")
    return f"""coalesce(
      CASE WHEN prompt <> '' THEN prompt END,
      CASE WHEN question <> '' THEN question END,
      CASE WHEN instruction <> '' THEN instruction END,
      CASE WHEN text <> '' THEN text END,
      CASE WHEN input <> '' THEN input END,
      CASE WHEN context <> '' THEN context END,
      CASE WHEN len(messages) > 0 THEN {flat} END,
      CASE WHEN {instr} <> '' AND {inp} <> '' THEN {instr} || {lit(K.INSTRUCTION_INPUT_SEPARATOR)} || {inp} END,
      CASE WHEN {instr} <> '' THEN {instr} END,
      CASE WHEN {inp} <> '' THEN {inp} END,
      CASE WHEN {ctx} <> '' AND {q} <> '' THEN {ctx} || {lit(K.CONTEXT_QUESTION_SEPARATOR)} || {q} END,
      CASE WHEN {q} <> '' THEN {q} END,
      {_JSON_ROW})"""


def _finance_select(cols: str) -> str:
    return f"WITH {FINANCE}\nSELECT {cols} FROM fin"


ORACLE: dict[str, str] = {
    "q_verifiable_reward": f"WITH {VERIFIABLE}\nSELECT conv_id, turn, variant, {r6('reward')} AS reward FROM vscored",
    "q_reward_by_variant": f"""WITH {VERIFIABLE}
SELECT variant, count(*) AS n, {r6('avg(reward)')} AS mean_reward, {r6('min(reward)')} AS min_reward, {r6('max(reward)')} AS max_reward
FROM vscored GROUP BY variant""",
    "q_flatten_chat": f"WITH {CHATS}\nSELECT conv_id, {_flat_chat()} AS prompt FROM chats GROUP BY conv_id",
    "q_flatten_mixed_chat": f"""WITH lines AS (SELECT conv_id, turn, conv_id % 8 AS shape, role || ': ' || {strip('text')} AS message,
  role || ': ' || {strip("text || '  end'")} AS parts, text FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
each AS (SELECT conv_id, turn, shape, CASE shape WHEN 1 THEN parts WHEN 2 THEN text
  WHEN 3 THEN CASE WHEN turn % 2 = 1 THEN message ELSE text END
  WHEN 5 THEN CASE WHEN turn % 2 = 1 THEN 'user: None' ELSE 'None: ' END
  WHEN 7 THEN CASE WHEN turn % 3 = 0 THEN 'True' ELSE turn::VARCHAR END ELSE message END AS line FROM lines)
SELECT conv_id, CASE WHEN any_value(shape) NOT IN (4, 6) THEN {strip("string_agg(line, chr(10) ORDER BY turn)")} END AS prompt
FROM each GROUP BY conv_id""",
    "q_mixed_prompt_reference": f"""SELECT doc_id, CASE WHEN shape = 0 AND text <> '' THEN text
    WHEN shape = 1 THEN {strip(f"'user: ' || {strip('text')} || chr(10) || '7'")}
    WHEN shape = 2 THEN {strip("text || chr(10) || lang")} WHEN shape = 3 THEN '   '
    WHEN shape = 4 THEN text ELSE '{{"doc_id":' || doc_id || ',"other":{{"a":' || doc_id || ',"b":[1,"x"]}}}}' END AS prompt,
  CASE shape WHEN 1 THEN '1.5' WHEN 2 THEN source WHEN 3 THEN '' WHEN 4 THEN 'True' END AS reference
FROM (SELECT doc_id, doc_id % 6 AS shape, coalesce(text, '') AS text, lang, source FROM documents)""",
    "q_verifiable_reward_mixed": f"WITH {VERIFIABLE}\nSELECT conv_id, turn, variant, {r6('reward')} AS reward FROM vscored",
    "q_flatten_turns": f"WITH {CHATS}\nSELECT conv_id, {_flat_chat()} AS prompt FROM chats GROUP BY conv_id",
    "q_completion_text": f"WITH {CHATS}\nSELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS completion_text FROM chats GROUP BY conv_id",
    "q_prompt_reference": f"WITH {RAW_EXAMPLES}\nSELECT doc_id, {_prompt_sql()} AS prompt, coalesce(reference, answer, chosen) AS reference FROM raw",
    "q_label_sentences": f"WITH {SENTENCES}\nSELECT doc_id, text, reasoning, sentiment, {r6('confidence')} AS confidence, source FROM sentences",
    "q_assemble": f"""WITH {SENTENCES}
SELECT doc_id, text, sentiment, {r6('confidence')} AS confidence, source FROM sentences
UNION ALL SELECT doc_id, text, sentiment, {r6('confidence')} AS confidence, source FROM ({_SYN_ROWS}) s""",
    "q_format_sft": f"WITH {SENTENCES}\nSELECT doc_id, CAST(greatest(1, length({SFT_TEXT}) // 4) AS INTEGER) AS token_len, {SFT_TEXT} AS text FROM sentences",
    "q_format_rl": f"WITH {SENTENCES}\nSELECT doc_id, {RL_PROMPT} AS prompt, CAST(greatest(1, length({RL_PROMPT}) // 4) AS INTEGER) AS full_len, text AS gold_text FROM sentences",
    "q_token_filter": f"""WITH {SENTENCES}, sft AS (SELECT doc_id, CAST(greatest(1, length({SFT_TEXT}) // 4) AS INTEGER) AS token_len FROM sentences)
SELECT doc_id, token_len FROM sft WHERE token_len <= {K.MAX_PROMPT_TOKENS}""",
    "q_format_chart": """SELECT doc_id, 'charts/' || CAST(doc_id AS VARCHAR) || '.png' AS image, CAST(3 AS INTEGER) AS n_messages,
  'charts/' || CAST(doc_id AS VARCHAR) || '.png' AS user_image,
  'Which language is document ' || CAST(doc_id AS VARCHAR) || ' written in?' AS user_text,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS answer, 'system' AS first_role
FROM documents""",
    "q_shuffle_sample": f"""SELECT doc_id, lang FROM documents
ORDER BY md5('{K.DEFAULT_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {K.SAMPLE_ROWS}""",
    "q_cap": f"""WITH {SENTENCES}
SELECT doc_id, CAST(greatest(1, length({RL_PROMPT}) // 4) AS INTEGER) AS full_len FROM sentences ORDER BY doc_id LIMIT {K.MAX_REAL_EXAMPLES}""",
    "q_first_rows": """SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem
ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 20000""",
    "q_first_rows_ties": """WITH keyed AS (SELECT CASE WHEN l_linenumber > 1 THEN l_returnflag END AS l_returnflag FROM lineitem),
kept AS (SELECT l_returnflag FROM keyed ORDER BY l_returnflag NULLS FIRST LIMIT 30000)
SELECT l_returnflag, count(*) AS n FROM kept GROUP BY l_returnflag""",
    "q_schema_problems": """WITH d AS (SELECT doc_id, lang, n_chars, doc_id % 3 AS part FROM documents),
typed AS (
  SELECT CASE part WHEN 0 THEN 'old' WHEN 1 THEN 'new' ELSE 'mixed' END AS unit,
    CASE WHEN part = 2 AND doc_id % 7 = 0 THEN 'malformed' WHEN n_chars IS NULL THEN 'void'
         WHEN part = 1 AND doc_id % 5 = 0 THEN 'string' WHEN part = 2 THEN 'double' ELSE 'bigint' END AS type
  FROM d)
SELECT unit, 'malformed' AS problem, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS found, CAST(NULL AS VARCHAR) AS wanted,
  count(*) AS n FROM typed WHERE type = 'malformed' GROUP BY unit
UNION ALL SELECT unit, 'missing', 'lang', NULL, NULL, count(*) FROM typed WHERE unit = 'new' GROUP BY unit
UNION ALL SELECT unit, 'conflict', 'n_chars', 'string', 'double', count(*) FROM typed WHERE type = 'string' GROUP BY unit""",
    "q_stream_quarantine": """SELECT CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 <> 0 THEN doc_id END AS doc_id,
  CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 <> 0 THEN CAST(n_chars AS BIGINT) END AS n_chars,
  CASE WHEN doc_id % 10 = 0 THEN '{"doc_id":' || doc_id || ',"n_chars"'
       WHEN doc_id % 11 = 0 THEN '{"doc_id":' || doc_id || ',"n_chars":"many"}' END AS line
FROM documents""",
    "q_salted_join": """WITH keyed AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber <> 7 THEN l_orderkey END AS key FROM lineitem)
SELECT keyed.*, o_orderpriority FROM keyed LEFT JOIN orders ON key = o_orderkey""",
    "q_take_skip": """WITH idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index, count(*) OVER () AS n FROM documents)
SELECT doc_id, row_index, CASE WHEN row_index < floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split FROM idx""",
    "q_take_skip_repeated_keys": """WITH keyed AS (SELECT CASE WHEN doc_id % 9 <> 0 THEN lang END AS lang FROM documents),
idx AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS row_index, count(*) OVER () AS n FROM keyed),
parts AS (SELECT lang, row_index, CASE WHEN row_index < floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split FROM idx)
SELECT lang, split, count(*) AS n, count(DISTINCT row_index) AS numbers, min(row_index) AS first, max(row_index) AS last
FROM parts GROUP BY lang, split""",
    "q_take_skip_conversations": """WITH idx AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index, count(*) OVER () AS n
             FROM conversations)
SELECT conv_id, turn, row_index, CASE WHEN row_index < floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split FROM idx""",
    "q_three_way_split": """WITH idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index, count(*) OVER () AS n FROM documents)
SELECT doc_id AS id, row_index, CASE WHEN row_index < floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split FROM idx
UNION ALL SELECT item_id AS id, CAST(NULL AS BIGINT) AS row_index, 'test' AS split FROM benchmark""",
    "q_slice_split": """WITH idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index, count(*) OVER () AS n FROM documents)
SELECT doc_id, row_index, CASE WHEN row_index < round(80 * n / 100.0) THEN 'train' ELSE 'validation' END AS split FROM idx""",
    "q_components": f"WITH {COMPONENTS}\nSELECT {GEN_KEY_SQL}, reasoning, sentiment, confidence_text FROM comp",
    "q_format_gate": f"WITH {COMPONENTS}\nSELECT {GEN_KEY_SQL}, gate FROM comp",
    "q_news_from_prompt": f"""WITH {GENS}
SELECT {GEN_KEY_SQL}, CASE WHEN strpos(prompt, {lit(K.NEWS_PREFIX)}) > 0
  THEN {strip(f"substr(prompt, strpos(prompt, {lit(K.NEWS_PREFIX)}) + {len(K.NEWS_PREFIX)})")} ELSE '' END AS news FROM gp""",
    "q_prompt_completion": f"WITH {GENS}\nSELECT {GEN_KEY_SQL}, prompt_id, CAST(greatest(1, length(prompt) // 4) AS INTEGER) AS prompt_tokens FROM gp",
    "q_extract_number": f"WITH {VERIFIABLE}\nSELECT conv_id, turn, {number('txt')} AS completion_number, {number('ref')} AS reference_number FROM vjoined",
    "q_compare_variants_full": f"""WITH {VARIANTS},
fo AS (SELECT coalesce(b.doc_id, t.doc_id) AS doc_id, b.doc_id IS NOT NULL AS in_base, t.doc_id IS NOT NULL AS in_lora
       FROM base b FULL OUTER JOIN tuned t ON t.doc_id = b.doc_id)
SELECT doc_id, in_base, in_lora FROM fo""",
    "q_status_counts": f"WITH {CHART_OUT}\nSELECT processing_status, count(*) AS n FROM numbered GROUP BY processing_status",
    "q_last_checkpoints": f"WITH {TRAIN_LOG}\nSELECT step, eval_loss FROM tlog WHERE eval_loss IS NOT NULL ORDER BY step DESC LIMIT 3",
    "q_softmax": f"WITH {TEACHER}\nSELECT prompt_id, {r6('p_negative')} AS p_negative, {r6('p_neutral')} AS p_neutral, {r6('p_positive')} AS p_positive FROM tprobs",
    "q_score_teacher": f"""WITH {TEACHER}
SELECT prompt_id, {r6(by_length('text', 0))} AS p_negative, {r6(by_length('text', 1))} AS p_neutral, {r6(by_length('text', 2))} AS p_positive
FROM teacher""",
    "q_prediction_store": f"""WITH {TEACHER}
SELECT prompt_id, {r6(by_length('text', 0))} AS p_negative, {r6(by_length('text', 1))} AS p_neutral, {r6(by_length('text', 2))} AS p_positive
FROM teacher""",
    "q_prediction_store_runs": f"""WITH {TEACHER},
firsts AS (SELECT text, min(CASE WHEN prompt_id % 2 = 0 THEN 0 ELSE 1 END) AS run FROM teacher WHERE text <> '' GROUP BY text)
SELECT run::INTEGER AS run, count(*) AS n FROM firsts GROUP BY run""",
    "q_track_rewards": f"""WITH {FINANCE},
weeks AS (SELECT (l_orderkey * 600 // 604800) * 604800 AS week, l_linenumber, count(*) AS n, avg(finance_reward) AS mean,
  min(finance_reward) AS lo, max(finance_reward) AS hi, avg(CASE WHEN gate > 0 THEN 1.0 ELSE 0.0 END) AS passed FROM fin GROUP BY ALL)
SELECT week, l_linenumber, n, {r6('mean')} AS mean_reward, {r6('lo')} AS min_reward, {r6('hi')} AS max_reward, {r6('passed')} AS gate_rate,
  (sum(n) OVER (PARTITION BY l_linenumber))::BIGINT AS seen, 0::BIGINT AS late FROM weeks""",
    "q_finance_reward_model": f"""WITH {FINANCE_MODEL}
SELECT {GEN_KEY_SQL}, {r6('p_teacher')} AS p_teacher, {r6('finance_reward')} AS finance_reward FROM fin""",
    "q_teacher_alignment": _finance_select(f"{GEN_KEY_SQL}, sentiment, {r6('p_teacher')} AS p_teacher"),
    "q_reasoning": f"WITH {COMPONENTS}\nSELECT {GEN_KEY_SQL}, {r6('quality')} AS quality, {r6('logic')} AS logic, {r6('context')} AS context, {r6('bundle')} AS bundle FROM bundled",
    "q_calibration": _finance_select(f"{GEN_KEY_SQL}, {r6('calibration')} AS calibration"),
    "q_directional": f"WITH {COMPONENTS}\nSELECT {GEN_KEY_SQL}, direction FROM scored",
    "q_finance_reward": _finance_select(f"{GEN_KEY_SQL}, {r6('finance_reward')} AS finance_reward"),
    "q_total_reward": _finance_select(
        f"{GEN_KEY_SQL}, gate, {r6('finance_reward')} AS finance_reward, {r6('1.0 * gate + 1.0 * finance_reward')} AS total_reward"
    ),
    "q_group_advantage": f"""WITH {FINANCE},
st AS (SELECT prompt_id, count(*) AS n, avg(finance_reward) AS mu, stddev_samp(finance_reward) AS sd,
              min(finance_reward) AS lo, max(finance_reward) AS hi FROM fin GROUP BY prompt_id)
SELECT {GEN_KEY_SQL}, {r6('finance_reward')} AS finance_reward,
  {r6('CASE WHEN st.n <= 1 OR st.lo = st.hi THEN 0.0 ELSE (finance_reward - st.mu) / (st.sd + 0.0001) END')} AS advantage
FROM fin JOIN st USING (prompt_id)""",
    "q_best_of_group": f"""WITH {FINANCE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY finance_reward DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rk,
                  count(*) OVER (PARTITION BY prompt_id) AS n_generations FROM fin)
SELECT prompt_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, {r6('finance_reward')} AS finance_reward, n_generations
FROM ranked WHERE rk = 1""",
    "q_reward_summary": f"""WITH {FINANCE}
SELECT sentiment, count(*) AS n, {r6('avg(finance_reward)')} AS mean_reward, {r6('min(finance_reward)')} AS min_reward,
  {r6('max(finance_reward)')} AS max_reward, {r6('avg(gate)')} AS gate_rate, {r6('avg(quality)')} AS mean_quality,
  {r6('avg(logic)')} AS mean_logic, {r6('avg(context)')} AS mean_context, {r6('avg(calibration)')} AS mean_calibration,
  {r6('avg(direction)')} AS mean_direction, CAST(grouping(sentiment) AS INTEGER) AS is_total
FROM fin GROUP BY ROLLUP (sentiment)""",
    "q_reward_summary_cube": f"""WITH {FINANCE}
SELECT sentiment, gate, count(*) AS n, {r6('avg(finance_reward)')} AS mean_reward, {r6('min(finance_reward)')} AS min_reward,
  {r6('max(finance_reward)')} AS max_reward, {r6('avg(gate)')} AS gate_rate, {r6('avg(calibration)')} AS mean_calibration,
  CAST(grouping(sentiment, gate) AS INTEGER) AS is_total
FROM fin GROUP BY CUBE (sentiment, gate)""",
    "q_compare_variants": f"WITH {VARIANTS}\nSELECT doc_id, prompt, base_output, lora_output, base_output <> lora_output AS changed FROM cmp",
    "q_preview": f"WITH {VARIANTS}\nSELECT doc_id, {_preview('base_output')} AS base_output_preview, {_preview('lora_output')} AS lora_output_preview FROM cmp",
    "q_extract_answer": f"WITH {CHART_OUT}\nSELECT doc_id, model_answer FROM answers",
    "q_number_results": f"WITH {CHART_OUT}\nSELECT sample_id, dataset_index, image_path, question, model_answer, processing_status FROM numbered",
    "q_accuracy": f"""WITH {CHART_OUT}
SELECT count(*) AS n_samples, count(*) FILTER (WHERE processing_status = 'success') AS n_success,
  count(*) FILTER (WHERE processing_status = 'error') AS n_error,
  count(*) FILTER (WHERE processing_status = 'success' AND {norm('lang')} = {norm('model_answer')}) AS n_correct,
  CASE WHEN count(*) > 0 THEN {r6("count(*) FILTER (WHERE processing_status = 'success' AND " + norm('lang') + " = " + norm('model_answer') + ") / count(*)")} END AS accuracy
FROM numbered""",
    "q_training_curve": f"WITH {TRAIN_LOG}\nSELECT step, loss, reward, kl FROM tlog WHERE step IS NOT NULL AND loss IS NOT NULL",
    "q_best_checkpoint": f"""WITH {TRAIN_LOG},
ev AS (SELECT * FROM tlog WHERE eval_loss IS NOT NULL AND NOT isnan(eval_loss)),
best AS (SELECT step, eval_loss FROM ev ORDER BY eval_loss, step LIMIT 1)
SELECT best.step AS best_step, best.eval_loss AS best_eval_loss, (SELECT count(*) FROM ev) AS n_evaluations,
  (SELECT max(step) FROM ev) AS last_eval_step FROM best""",
    "q_verifiable_reward_chat": f"WITH {VERIFIABLE}\nSELECT conv_id, turn, variant, {r6('reward')} AS reward FROM vscored",
    "q_stream_rewards": f"WITH {VERIFIABLE}\nSELECT conv_id, turn, variant, {r6('reward')} AS reward FROM vscored",
    "q_stream_normalise": f"WITH {RAW_EXAMPLES}\nSELECT doc_id, {_prompt_sql()} AS prompt, coalesce(reference, answer, chosen) AS reference FROM raw",
    "q_flatten_chat_shapes": f"""SELECT doc_id, 'user: ' || chr(10) || 'user:' AS unnamed,
  {strip("'human: ' || " + strip('text') + " || chr(10) || 'user: ' || " + strip('lang'))} AS named,
  {strip("text || chr(10) || chr(10) || lang")} AS strings,
  {strip("'user: ' || " + strip('text') + " || chr(10) || lang || ': '")} AS maps,
  {strip("'user: ' || " + strip("text || ' ' || lang"))} AS typed, 'user:' AS other
FROM documents""",
    "q_render_chat": f"""SELECT doc_id, '<|im_start|>system' || chr(10) || {lit(K.CHART_SYSTEM_MESSAGE)} || '<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || 'Which language is document ' || CAST(doc_id AS VARCHAR) || ' written in?<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END || '<|im_end|>' || chr(10) AS text
FROM documents""",
    "q_read_examples": f"WITH {SENTENCES}\nSELECT doc_id, text, reasoning, sentiment, {r6('confidence')} AS confidence FROM sentences",
    "q_load_splits": """SELECT doc_id, text AS prompt, lang AS reference, CASE WHEN doc_id % 10 < 6 THEN 'train_sft' ELSE 'validation' END AS split
FROM documents WHERE doc_id % 10 < 6 OR doc_id % 10 = 8""",
    "q_load_splits_by_column": """SELECT doc_id, text AS prompt, CAST(NULL AS VARCHAR) AS reference,
  CASE WHEN doc_id % 7 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "q_read_prompts": """SELECT CAST(0 AS BIGINT) AS prompt_id, 'first prompt' AS prompt
UNION ALL SELECT row_number() OVER (ORDER BY doc_id) AS prompt_id, 'Summarize document ' || CAST(doc_id AS VARCHAR) AS prompt
FROM documents WHERE doc_id % 5 <> 0""",
    "q_resolve_images": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN CAST(strlen(html) AS BIGINT) END AS image_size FROM pages",
    "q_write_comparison_csv": f"WITH {VARIANTS}\nSELECT prompt, nullif(base_output, '') AS base_output, nullif(lora_output, '') AS lora_output FROM cmp",
    "q_write_results_json": f"""WITH {CHART_OUT}
SELECT sample_id, dataset_index, image_path, original_image_url, question, lang AS ground_truth, model_answer, processing_status FROM numbered""",
    "q_write_summary": f"""WITH {CHART_OUT},
texts AS (
  SELECT {lit(K.SUMMARY_TITLE)} || chr(10) || repeat('=', 50) || chr(10) || chr(10) || 'Model: base-model' || chr(10) || 'Adapter: adapter' || chr(10)
    || 'Total samples processed: ' || CAST(count(*) AS VARCHAR) || chr(10) || 'Output directory: results' || chr(10) AS t FROM numbered
  UNION ALL
  SELECT 'SAMPLE ' || CASE WHEN sample_id < 9 THEN '0' ELSE '' END || CAST(sample_id + 1 AS VARCHAR) || chr(10) || repeat('-', 30) || chr(10)
    || 'Image: ' || image_path || chr(10) || 'Question: ' || question || chr(10) || 'Ground Truth: [' || chr(39) || lang || chr(39) || ']' || chr(10)
    || 'Model Answer: ' || model_answer || chr(10) || 'Status: ' || processing_status || chr(10) AS t FROM numbered),
lines AS (SELECT unnest(string_split(t, chr(10))) AS line FROM texts)
SELECT line, count(*) AS n FROM lines GROUP BY line""",
    "q_write_summary_file": f"""WITH {CHART_OUT},
texts AS (
  SELECT CAST(-1 AS BIGINT) AS k, {lit(K.SUMMARY_TITLE)} || chr(10) || repeat('=', 50) || chr(10) || chr(10) || 'Model: base-model' || chr(10) || 'Adapter: adapter' || chr(10)
    || 'Total samples processed: ' || CAST(count(*) AS VARCHAR) || chr(10) || 'Output directory: results' || chr(10) AS t FROM numbered
  UNION ALL
  SELECT sample_id AS k, 'SAMPLE ' || CASE WHEN sample_id < 9 THEN '0' ELSE '' END || CAST(sample_id + 1 AS VARCHAR) || chr(10) || repeat('-', 30) || chr(10)
    || 'Image: ' || image_path || chr(10) || 'Question: ' || question || chr(10) || 'Ground Truth: [' || chr(39) || lang || chr(39) || ']' || chr(10)
    || 'Model Answer: ' || model_answer || chr(10) || 'Status: ' || processing_status || chr(10) AS t FROM numbered),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts)
SELECT row_number() OVER (ORDER BY k, i) - 1 AS place, line FROM lines""",
}
