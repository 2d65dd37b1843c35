"""Masks, redaction and tokens of log messages as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a template hides, in this order. Java and RE2 agree on these patterns.
MASKS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"https?://[^\s]+", "<URL>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<IP>"),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z?", "<TIME>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9]+(\.[0-9]+)?\b", "<NUM>"),
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD = r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()


def _may_hold(text: Column, pattern: str) -> Column:
    """A cheap test that every text with a match of one of the patterns above passes."""
    if "@" in pattern:
        return text.contains("@")
    if "://" in pattern:
        return text.contains("://")
    if "0x" in pattern:
        return text.contains("0x")
    if pattern == MASKS[0][0]:
        return text.rlike("[0-9a-fA-F]{8}-")
    if pattern == IPV4:
        return text.rlike(r"[0-9]\.[0-9]")
    return text.rlike("[0-9]{3}" if pattern != MASKS[-1][0] else "[0-9]")


def _replaced(text: Column, pairs: tuple) -> Column:
    """Each pattern replaced where it may be. The text goes through an array, so that each step names it once."""

    def step(pattern: str, name: str) -> Callable[[Column], Column]:
        return lambda t: F.when(_may_hold(t, pattern), F.regexp_replace(t, pattern, name)).otherwise(t)

    one = F.array(text)
    for pair in pairs:
        one = F.transform(one, step(*pair))
    return F.element_at(one, 1)


def template(message: Column) -> Column:
    """A message with its variable parts masked and white space collapsed."""
    return F.trim(F.regexp_replace(_replaced(message, MASKS), r"\s+", " "))


def found(text: Column, pattern: str) -> Column:
    """All matches; null for a null text."""
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(_may_hold(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def redacted(text: Column) -> Column:
    """E-mail addresses, social security and phone numbers and card numbers replaced by their kind."""
    return _replaced(text, ((EMAIL, "[EMAIL]"), (SSN, "[SSN]"), (CARD, "[CARD]"), (PHONE, "[PHONE]")))


def partly_masked(value: Column, keep: int = 4) -> Column:
    """All but the last `keep` characters as *."""
    n = F.length(value)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - keep), F.right(value, F.lit(keep))))


def salted_id(value: Column, salt: str, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 1, length)


def masked_ip(ip: Column) -> Column:
    """An IPv4 address as its /24 network; other text unchanged."""
    return F.regexp_replace(ip, r"^([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\.[0-9]{1,3}$", "$1.0")


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters or digits without stop words, each once, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))


def all_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def highlighted(text: Column, terms: list[str]) -> Column:
    import re

    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in terms) + ")", "<mark>$1</mark>")
