"""Text expressions: cleaning, term matching, polarity, phrase counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fx

# A word character is any letter, digit or underscore, in any script.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]+"


def compact_text(text: Column) -> Column:
    """Collapse white space to single blanks and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def headline_and_body(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts joined by a blank."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def distinct_words(text: Column) -> Column:
    """The distinct words of a text, as they are spelled."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1)))


def cased_words(text: Column) -> Column:
    """Structs of ``word`` as spelled, ``low`` in lower case, and ``lowered``: whether the
    lower-cased text holds ``low`` as a word.

    Lower-casing depends on what stands around a letter for two letters only
    (the dotted I, which gains a mark, and sigma): texts that hold them give
    the words of the lower-cased text besides, without a ``word``.
    """
    odd = text.rlike("[\u0130\u03a3]")

    def spelled(lowered: bool) -> Column:
        return F.transform(
            distinct_words(text),
            lambda w: F.struct(w.alias("word"), F.lower(w).alias("low"), F.lit(lowered).alias("lowered")),
        )

    low = F.transform(
        distinct_words(F.lower(text)),
        lambda w: F.struct(
            F.lit(None).cast("string").alias("word"), w.alias("low"), F.lit(True).alias("lowered")
        ),
    )
    return F.when(odd, F.concat(spelled(False), low)).otherwise(spelled(True))


def whole_term(term: Column) -> Column:
    """Pattern of a term that no word character may touch on either side."""
    return F.concat(F.lit(rf"(?<!{WORD})\Q"), term, F.lit(rf"\E(?!{WORD})"))


def _quoted(term: str) -> str:
    return r"\s+".join(rf"\Q{part}\E" for part in term.split(" "))


def has_term(low: Column, term: str) -> Column:
    """Whether lower-cased text holds ``term`` as whole words.

    The substring test is cheap and settles almost every text; the pattern only
    runs where the term's first word occurs at all.
    """
    pattern = rf"(?<!{WORD}){_quoted(term.lower())}(?!{WORD})"
    return low.contains(term.lower().split(" ")[0]) & low.rlike(pattern)


def match_terms(text: Column, terms: Sequence[str]) -> Column:
    """Terms found as whole words, case-insensitive, in dictionary order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(has_term(low, t), F.lit(t)) for t in terms]))


def _occurrences(low: Column, term: str) -> Column:
    """Non-overlapping substring occurrences of ``term``."""
    cut = (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(len(term))
    return F.when(low.contains(term), cut.cast("int")).otherwise(F.lit(0))


def _total(cols: Sequence[Column]) -> Column:
    out = F.lit(0)
    for col in cols:
        out = out + col
    return out


def lexicon_counts(
    text: Column,
    positive: Sequence[str] = fx.LEXICON_POSITIVE,
    negative: Sequence[str] = fx.LEXICON_NEGATIVE,
) -> tuple[Column, Column]:
    """Substring occurrences of positive and negative terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        _total([_occurrences(low, t) for t in positive]),
        _total([_occurrences(low, t) for t in negative]),
    )


def polarity(positive: Column, negative: Column) -> Column:
    """(p - n) / (p + n), 0 where neither occurs."""
    both = positive + negative
    return F.when(both > 0, (positive - negative) / both).otherwise(F.lit(0.0))


def lexicon_score(
    text: Column,
    positive: Sequence[str] = fx.LEXICON_POSITIVE,
    negative: Sequence[str] = fx.LEXICON_NEGATIVE,
) -> Column:
    """Polarity in [-1, 1] from substring counts ('execute' counts for 'cut')."""
    return polarity(*lexicon_counts(text, positive, negative))


def score_label(score: Column) -> Column:
    return (
        F.when(score > 0.05, F.lit("positive"))
        .when(score < -0.05, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def terms_present(low: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as substrings."""
    return _total([low.contains(t).cast("int") for t in terms])


def tanh_sentiment(
    title: Column,
    content: Column,
    positive: Sequence[str] = fx.ANNUAL_POSITIVE,
    negative: Sequence[str] = fx.ANNUAL_NEGATIVE,
    ai: Sequence[str] = fx.ANNUAL_AI,
) -> tuple[Column, Column]:
    """Squashed sentiment of an article and its AI term hits."""
    low = compact_text(F.lower(headline_and_body(title, content)))
    hits = terms_present(low, ai)
    raw = terms_present(low, positive) - terms_present(low, negative) + F.lit(0.35) * hits
    return F.round(F.tanh(raw / 4.5), 6), hits


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """Total matches of all patterns, case-insensitive, Unicode word rules."""
    return _total(
        [
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?iU){p}"))
            for p in patterns
        ]
    )


def parse_ts(raw: Column) -> Column:
    """ISO 8601 or RFC 822 text to a UTC timestamp; null where neither parses.

    Text without an offset is taken as UTC (the session time zone).
    """
    text = F.trim(raw)
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(no_weekday, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(no_weekday, F.lit("d MMM yyyy HH:mm:ss Z")),
    )


def parse_compact_ts(raw: Column) -> Column:
    """``yyyyMMddHHmmss`` where the text is 14 digits, else as ``parse_ts``."""
    return F.when(
        raw.rlike(r"^\d{14}$"), F.try_to_timestamp(raw, F.lit("yyyyMMddHHmmss"))
    ).otherwise(parse_ts(raw))
