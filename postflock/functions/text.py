"""Text expressions. Every function takes and returns a Column, so it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Character classes of the text rules, spelled out so that they are the full
# Unicode word and space classes rather than the ASCII ones Java uses by default.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
MAX_POST_CHARS = 280


def clean_text(text: Column) -> Column:
    """Trim white space, trim double quotes, fold runs of white space to one blank."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.regexp_replace(F.btrim(trimmed, F.lit('"')), f"{SPACE}+", " ")


def raw_tags(text: Column) -> Column:
    """Tags as written, in order, with repeats; empty array for a NULL text."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(f"#({WORD}+)"), 1), F.array().cast("array<string>")
    )


def tags(text: Column) -> Column:
    """Lower-cased tags in order, with repeats."""
    return F.transform(raw_tags(text), F.lower)


def tag_set(text: Column) -> Column:
    """Lower-cased tags, each once."""
    return F.array_distinct(tags(text))


def normalise_tag(tag: Column) -> Column:
    return F.lower(tag)


def has_tag(tag_array: Column, tag: Column | str) -> Column:
    return F.array_contains(tag_array, tag)


def add_tag(tag_array: Column, tag: Column) -> Column:
    """The array with the tag in it once."""
    return F.array_distinct(F.array_append(tag_array, tag))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}{{2,}}"), 0)


def preview(text: Column, length: int = 100) -> Column:
    """First characters with dots always added."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def short_preview(text: Column, length: int = 50) -> Column:
    """First characters, with dots only where something was cut off."""
    return F.when(F.length(text) > length, preview(text, length)).otherwise(text)


def capitalise(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 2)))


def synthetic_email(username: Column) -> Column:
    return F.concat(username, F.lit("@example.com"))


def sign_label(score: Column) -> Column:
    return _label(score, 0.0)


def polarity_label(score: Column) -> Column:
    return _label(score, 0.3)


def mood_label(score: Column) -> Column:
    return _label(score, 0.1)


def _label(score: Column, threshold: float) -> Column:
    return (
        F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")
    )


def safe_double(text: Column) -> Column:
    """Number in the text, 0.0 where there is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))
