"""Fixed values the results depend on.

FIXED VALUES: every string and number in this module must stay exactly as
written, in this order, because reward scores, rendered training rows and
split choices are defined by them. They are kept together here so that no
other module hides a literal that changes a result.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES - tagged completion contract
# ---------------------------------------------------------------------------
REASONING_START = "<REASONING>"
REASONING_END = "</REASONING>"
SENTIMENT_START = "<SENTIMENT>"
SENTIMENT_END = "</SENTIMENT>"
CONFIDENCE_START = "<CONFIDENCE>"
CONFIDENCE_END = "</CONFIDENCE>"

TAG_PAIRS = (
    (REASONING_START, REASONING_END),
    (SENTIMENT_START, SENTIMENT_END),
    (CONFIDENCE_START, CONFIDENCE_END),
)

# ---------------------------------------------------------------------------
# FIXED VALUES - financial prompts
# ---------------------------------------------------------------------------
NEWS_PREFIX = "Analyze the sentiment of this financial news:\n"

SYSTEM_FINANCIAL_SFT = (
    "You are a financial analyst. Analyze sentiment with clear, balanced reasoning.\n"
    "OUTPUT CONTRACT (exactly this structure):\n"
    "<REASONING> 2–3 concise sentences with both positives and negatives; use financial terms and connectives (because/however/therefore). </REASONING>\n"
    "<SENTIMENT> one of: positive | negative | neutral </SENTIMENT>\n"
    "<CONFIDENCE> a decimal between 0.1 and 1.0 </CONFIDENCE>\n"
    "Do not add any other sections or tags.\n"
    "\n"
    "Example:\n"
    "<REASONING> Revenue growth is strong but margins compressed due to higher input costs; guidance is cautious, suggesting near-term volatility. Therefore, outlook is balanced with upside from new products. </REASONING>\n"
    "<SENTIMENT> neutral </SENTIMENT>\n"
    "<CONFIDENCE> 0.72 </CONFIDENCE>"
)

SYSTEM_FINANCIAL_RL = (
    "Follow the exact contract. Keep the reasoning compact and balanced.\n"
    "<REASONING> ... </REASONING>\n"
    "<SENTIMENT> positive|negative|neutral </SENTIMENT>\n"
    "<CONFIDENCE> 0.1–1.0 </CONFIDENCE>"
)

# ---------------------------------------------------------------------------
# FIXED VALUES - labelled sentences: label -> (reasoning, sentiment, confidence)
# label 0 and 1 are listed; any other label is positive.
# ---------------------------------------------------------------------------
LABEL_NEGATIVE = (
    "Text implies risks or deteriorating performance; signals likely weigh on valuation.",
    "negative",
    0.75,
)
LABEL_NEUTRAL = (
    "Information is balanced; positives and negatives offset each other, implying a wait-and-see stance.",
    "neutral",
    0.60,
)
LABEL_POSITIVE = (
    "Text implies improving fundamentals or favorable momentum; sentiment is constructive.",
    "positive",
    0.75,
)
LABEL_SOURCE = "phrasebank"

# ---------------------------------------------------------------------------
# FIXED VALUES - the three built-in synthetic examples (text, reasoning, sentiment, confidence)
# ---------------------------------------------------------------------------
SYNTHETIC_EXAMPLES = (
    (
        "Tech company reports 25% revenue growth but 8% profit decline due to R&D investment",
        "Revenue growth is strong, reflecting demand and expansion. Profit dipped due to R&D, which is a strategic cost with long-term upside. Near-term margins compress, but growth story remains intact.",
        "positive",
        0.75,
    ),
    (
        "Bank announces 3% dividend increase while facing regulatory scrutiny over compliance issues",
        "Dividend increase signals capital strength and shareholder focus. However, regulatory scrutiny introduces material risk, including fines or constraints; this offsets the positive signal.",
        "negative",
        0.80,
    ),
    (
        "Manufacturing firm reports stable earnings but warns of supply chain disruptions ahead",
        "Current results are stable, showing operational control. The forward warning raises uncertainty, with potential cost and delivery impacts. Overall, signals are mixed.",
        "neutral",
        0.65,
    ),
)

# ---------------------------------------------------------------------------
# FIXED VALUES - reasoning lexicons (substring match on lower-cased reasoning)
# ---------------------------------------------------------------------------
FINANCIAL_TERMS = ("revenue", "profit", "margin", "guidance", "debt", "cash", "capex", "dividend")
CONNECTIVES = ("because", "however", "although", "while", "despite", "therefore", "thus")
CONTEXT_TERMS = ("market", "sector", "industry", "trend", "environment", "macro", "near-term", "long-term")
QUALITY_POSITIVE_CUES = ("growth", "increase", "improve", "strong", "up")
QUALITY_NEGATIVE_CUES = ("decline", "decrease", "worse", "weak", "down")
LOGIC_CONCLUSION_WORDS = ("therefore", "thus")
LOGIC_HEDGE_WORDS = ("mixed", "uncertain", "cautious")
TIMING_TERMS = ("short-term", "long-term", "near-term")
FUTURE_TERM = "future"
# Scores of the reasoning rules: terms that count in full, weights, bonuses.
QUALITY_TERMS_FULL, QUALITY_TERMS_WEIGHT = 3.0, 0.4
QUALITY_LINKS_FULL, QUALITY_LINKS_WEIGHT = 2.0, 0.3
QUALITY_BOTH_CUES, QUALITY_ONE_CUE = 0.3, 0.15
LOGIC_CONTRADICTIONS = (("growth", "decline"), ("profit", "loss"))
LOGIC_BASE, LOGIC_CONTRADICTED = 0.5, 0.2
LOGIC_CONCLUSION, LOGIC_HEDGE = 0.3, 0.2
CONTEXT_TERMS_FULL, CONTEXT_TERMS_WEIGHT = 3.0, 0.6
CONTEXT_HORIZON, CONTEXT_FUTURE = 0.4, 0.2
BUNDLE_WEIGHTS = {"quality": 0.5, "logic": 0.3, "context": 0.2}
FINANCE_WEIGHTS = {"sentiment": 0.35, "reasoning": 0.25, "calibration": 0.20, "direction": 0.15}
DIRECTION_POSITIVE_CUES = ("increase", "growth", "improve", "up", "higher")
DIRECTION_NEGATIVE_CUES = ("decrease", "decline", "worse", "down", "lower")

TEACHER_LABELS = ("negative", "neutral", "positive")
TEACHER_MAX_CHARS = 1024

# ---------------------------------------------------------------------------
# FIXED VALUES - generic prompt / reference field precedence
# ---------------------------------------------------------------------------
PROMPT_FIELDS = ("prompt", "question", "query", "instruction", "text", "input", "context", "ctx", "document", "source")
CHAT_FIELDS = ("messages", "conversations", "dialog", "chat")
REFERENCE_FIELDS = ("reference", "response", "answer", "output", "label", "target", "gold", "completion", "chosen")
INSTRUCTION_INPUT_SEPARATOR = "\n\nInput: "
CONTEXT_QUESTION_SEPARATOR = "\n\nQuestion: "

# ---------------------------------------------------------------------------
# FIXED VALUES - verifiable reward
# ---------------------------------------------------------------------------
ANSWER_FORMAT_PATTERN = "(final answer|answer)"  # followed by optional whitespace and ':' or '-'
BOILERPLATE_PHRASE = "as an ai"
LENGTH_BANDS = ((256, 0.2), (512, 0.1))  # estimated tokens <= limit -> bonus
LENGTH_PENALTY = -0.2
FORMAT_BONUS = 0.2
EXACT_BONUS = 1.0
NUMBER_BONUS = 0.6
BOILERPLATE_PENALTY = 0.3
CHARS_PER_TOKEN = 4

# ---------------------------------------------------------------------------
# FIXED VALUES - split preferences
# ---------------------------------------------------------------------------
PREFERRED_TRAIN_SPLITS = ("train_sft", "train", "train_gen", "train_prefs", "train_all")
PREFERRED_EVAL_SPLITS = ("test_sft", "validation", "valid", "test", "test_gen", "test_prefs")

# ---------------------------------------------------------------------------
# FIXED VALUES - base-vs-tuned comparison
# ---------------------------------------------------------------------------
DEFAULT_COMPARISON_PROMPTS = (
    "Explain GRPO in two sentences.",
    "List three safe ways to speed up PyTorch inference on Windows.",
    "You are given: 12 apples, you eat 5 and buy 4 more. How many now?",
    "Write a very short email subject for a job application follow-up.",
    "What's one surprising fact about the James Webb Space Telescope?",
)
PREVIEW_CHARS = 160
PREVIEW_ELLIPSIS = "…"
PREVIEW_ROWS = 5

# ---------------------------------------------------------------------------
# FIXED VALUES - chart question answering
# ---------------------------------------------------------------------------
CHART_SYSTEM_MESSAGE = (
    """
    You are a Vision Language Model specialized in interpreting visual data from chart images.
    Your task is to analyze the provided chart image and respond to queries with concise answers, usually a single word, number, or short phrase.
    The charts include a variety of types (e.g., line charts, bar charts) and contain colors, labels, and text.
    Focus on delivering accurate, succinct answers based on the visual information. Avoid additional explanation unless absolutely necessary.
    """
)
ASSISTANT_MARKER = "Assistant:"
END_TOKENS = ("<|end_of_text|>", "<|im_end|>")
ANSWER_MAX_WORDS = 10
ANSWER_DIGIT_WINDOW = 5
ERROR_PREFIX = "ERROR: "
SUMMARY_TITLE = "FINETUNED MODEL TEST RESULTS"  # default; the caller names its model

# ---------------------------------------------------------------------------
# FIXED VALUES - sampling defaults
# ---------------------------------------------------------------------------
DEFAULT_SEED = 42
SAMPLE_ROWS = 100
MAX_REAL_EXAMPLES = 200
MIN_TOTAL_EXAMPLES = 20
MAX_PROMPT_TOKENS = 1024
TRAIN_FRACTION = 0.8
VALIDATION_FRACTION = 0.2

# FIXED VALUES - layout of the evaluation summary
SUMMARY_RULE = "=" * 50
SUMMARY_HEADER = ("Model: ", "Adapter: ", "Total samples processed: ", "Output directory: ")
SAMPLE_HEADER = "SAMPLE %02d\n"
SAMPLE_RULE = "-" * 30
SAMPLE_FIELDS = ("Image: ", "Question: ", "Ground Truth: ", "Model Answer: ", "Status: ")
