"""Text expressions: tokens and weighted term hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
PLAIN_WORD = r"\d+\p{L}*|\p{L}+"
WORD = rf"\d+[\p{{L}}&&[^{CJK}]]*|[\p{{L}}&&[^{CJK}]]+|[{CJK}]+"


def tokens(text: Column) -> Column:
    """Lowercase words, split where a letter is followed by a digit and at every other sign.

    Runs of Chinese characters become overlapping pairs (a single character stays as it is).
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def pairs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1)))
        return F.when(w.rlike(f"^[{CJK}]{{2,}}$"), F.transform(at, lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))

    plain = F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD), F.lit(0))
    has_cjk = text.rlike(f"[{CJK}]")
    return F.when(has_cjk, F.flatten(F.transform(words, pairs))).otherwise(plain)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether lowercase ``text`` contains one of the terms."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t.lower()))
    return hit


def weighted_hits(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms contained in ``text``, each counted once."""
    low = F.lower(text)
    total = F.lit(0.0)
    for term, w in weights.items():
        total = total + F.when(F.contains(low, F.lit(term.lower())), float(w)).otherwise(0.0)
    return total
