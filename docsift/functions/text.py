"""Text rules as column expressions: cleaning, line predicates, entities, counts. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?[0-9][0-9 \-.]{8,15}[0-9]"
URL = r"(?i)https?://\S+|www\.\S+"
NUMBER = r"\b[0-9]+(\.[0-9]+)?\b"
MAX_CHARS = 200_000
MIN_WORDS = 15


def normalize(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def slug(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def lines(t: Column) -> Column:
    return F.split(t, "\n", -1)


def full_lines(t: Column) -> Column:
    return F.filter(lines(t), lambda x: F.trim(x) != "")


def words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\S+"))


def email(t: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(t, EMAIL, 0), F.lit("")))


def phone(t: Column) -> Column:
    """Digits of the first number of 10 to 13 digits."""
    digits = F.transform(F.regexp_extract_all(t, F.lit(PHONE), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.try_element_at(F.filter(digits, lambda x: F.length(x).between(10, 13)), F.lit(1))


def contact_score(mail: Column, number: Column) -> Column:
    return F.when(mail.isNotNull() & number.isNotNull(), 100).when(mail.isNotNull() | number.isNotNull(), 50).otherwise(0)


def length_score(n: Column) -> Column:
    tiers = ((120, 20), (200, 40), (350, 75), (900, 100), (1400, 85))
    out = F.when(n > 2000, 50).otherwise(60)
    for below, score in reversed(tiers):
        out = F.when(n < below, score).otherwise(out)
    return out


def tier(score: Column, high: float = 0.70, low: float = 0.45) -> Column:
    return F.when(score >= high, "Shortlisted").when(score >= low, "Manual Review").otherwise("Rejected")


def match_any(t: Column, lexicon: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds any of the words as a substring."""
    return F.exists(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.contains(t, w))


def count_any(t: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.contains(t, w)))
