"""Text that models produce or read: JSON dug out of answers, instructions and hidden characters found and removed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that try to change what a model was told.
INJECTION = (r"ignore (?:all |any )?(?:previous|prior|above) instructions", r"disregard (?:the|your) (?:rules|instructions)", r"you are now (?:a|an|in)\b", r"system prompt", r"</?(?:system|assistant|user)>")
HIDDEN = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]"


def json_of(answer: Column, shape: str) -> Column:
    """The JSON object of a model's answer: from a fenced block or from the first brace to the last, with trailing commas
    and comments mended; null if nothing parses."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\{.*\}|\[.*\])", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    mended = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s*//.*$", ""), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(mended).isNotNull(), F.from_json(mended, shape))


def injection_signs(text: Column) -> Column:
    """Patterns of INJECTION that the text matches."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in INJECTION]), lambda x: x.isNotNull())


def sanitize(text: Column) -> Column:
    """Hidden characters out, markup of roles escaped."""
    return F.regexp_replace(F.regexp_replace(text, HIDDEN, ""), r"<(/?(?:system|assistant|user))>", "&lt;$1&gt;")
