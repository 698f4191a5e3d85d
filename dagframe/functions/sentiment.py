"""A lexicon scorer in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default lexicon.
POSITIVE = ("good", "great", "excellent", "love", "happy", "best", "wonderful", "nice", "amazing", "fine")
NEGATIVE = ("bad", "terrible", "awful", "hate", "sad", "worst", "horrible", "trash", "pathetic", "idiot", "worthless", "disgusting", "stupid")


def score(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """Positive less negative words, whole and in any case; null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: F.regexp_count(low, F.lit(f"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"))
    return (count(positive) - count(negative)).cast("double")


def label(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """``positive(Prob:p,Score:s)`` or ``negative(...)``; a score of zero is positive."""
    s = score(text, positive, negative)
    return F.format_string("%s(Prob:%.4f,Score:%.1f)", F.when(s >= 0, "positive").otherwise("negative"), 1 / (1 + F.exp(-s)), s)
