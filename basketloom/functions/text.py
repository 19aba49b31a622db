"""Product-text cleaning and tokenisation as Spark expressions (Unicode-aware, no UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units after a number, and words before one, that a cleaned name loses.
UNITS = [
    "ct", "count", "mg", "mcg", "oz", r"fl\s*oz", "fl", "gallon", "inch", "in", "pack", "pk", "ml", "liter", "lit", "lít", "l", "lb", "lbs",
    "iu", r"i\.u\.?", "loads", "watt", "cups", "cup", "sticks", "g", "kg", "gr", "grs", "cm", "mm",
]
SIZE_WORDS = ["size", "cỡ"]
# The stopword list.
STOPWORDS = ["và", "cho", "với", "của", "từ", "trong", "một", "những", "các", "bằng", "trên", "vừa", "không", "chứa", "có", "&"]


def measurement_pattern() -> str:
    return rf"\b\d+(?:[.,]\d+)?\s*(?:{'|'.join(UNITS)})\b|\b(?:{'|'.join(SIZE_WORDS)})\s*\d+\b"


def stopword_patterns(words: list[str]) -> tuple[str | None, str | None]:
    """Alternations of the ordinary words and of the special ones, longest first; None where there is none."""
    ordered = sorted({w.strip().lower() for w in words if w.strip()}, key=lambda w: (-len(w), w))
    plain = [re.escape(w) for w in ordered if re.match(r"\w", w) and re.search(r"\w$", w)]
    special = [re.escape(w) for w in ordered if not (re.match(r"\w", w) and re.search(r"\w$", w))]
    return (rf"\b({'|'.join(plain)})\b" if plain else None, f"({'|'.join(special)})" if special else None)


def clean_text(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower case; measurements, special and ordinary stopwords deleted; other signs and white space become one blank."""
    plain, special = stopword_patterns(STOPWORDS if stopwords is None else stopwords)
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, "(?iU)" + measurement_pattern(), "")
    if special:
        out = F.regexp_replace(out, "(?iU)" + special, "")
    if plain:
        out = F.regexp_replace(out, "(?iU)" + plain, "")
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Words of two characters at least."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def ngrams(words: Column, longest: int = 1) -> Column:
    """All n-grams of 1 to ``longest`` words, joined by blanks, repeats kept."""
    out = words
    for n in range(2, longest + 1):
        out = F.concat(out, _joined(words, n))
    return out


def _joined(words: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    grams = F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.expr("cast(array() as array<string>)"))


def name_tokens(name: Column) -> Column:
    """Distinct white-space separated lower-case tokens (the overlap study's own tokeniser)."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(name)), r"(?U)\s+"), lambda t: t != ""))
