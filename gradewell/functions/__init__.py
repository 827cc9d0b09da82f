"""Column -> Column building blocks (all JVM-side expressions)."""

from .chat import CHATML, ChatTemplate, completion_text, flatten_chat, render_chat, render_messages, token_length
from .numeric import calibration, parse_python_float, round6, softmax
from .text import (
    extract_answer,
    extract_number,
    extract_tagged,
    news_from_prompt,
    normalize_text,
    preview,
    py_strip,
)
