"""Text functions of forum pages, all JVM-side expressions.

Null input gives null unless a default is named. Whitespace means Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "Unknown"
# Footer of an article, the label before its sender, and the marks of a push and a boo.
FOOTER = "\n--\n"
SENDER = "來自:"
PUSH, BOO = "推", "噓"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_tag(title: Column) -> Column:
    """The first bracket group of a title; 'Unknown' for none, an empty group or a null title."""
    found = F.regexp_extract(F.coalesce(title, F.lit("")), r"\[([^\]]+)\]", 1)
    return F.when(found == "", UNKNOWN).otherwise(found)


def last_sender_ip(footer: Column) -> Column:
    """The address of the last sender line; 'Unknown' if there is none."""
    hits = F.regexp_extract_all(F.coalesce(footer, F.lit("")), F.lit(SENDER + r"\s*(\d{1,3}(?:\.\d{1,3}){3})"), F.lit(1))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(UNKNOWN))


def last_sender_country(footer: Column) -> Column:
    """What stands in parentheses on the last sender line that has them; 'Unknown' if none has."""
    hits = F.regexp_extract_all(F.coalesce(footer, F.lit("")), F.lit(SENDER + r"[^\n]*?\(([^\n]+)\)"), F.lit(1))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(UNKNOWN))


def cut_at_last(text: Column, marker: str = FOOTER) -> Column:
    """Text before the last marker, stripped; the whole text where the marker is missing."""
    size = F.length(F.substring_index(text, marker, -1))
    kept = F.when(F.contains(text, F.lit(marker)), F.substring(text, F.lit(1), F.length(text) - size - len(marker))).otherwise(text)
    return strip(kept)


def push_score(mark: Column) -> Column:
    """1 for a push, -1 for a boo, 0 for anything else and for null."""
    clean = strip(mark)
    return F.when(clean == PUSH, 1).when(clean == BOO, -1).otherwise(0)


def drop_first(text: Column) -> Column:
    """Without the first character (the colon before a comment); a blank after it stays."""
    return F.substring(strip(text), F.lit(2), F.length(text))


def wrapped_label(text: Column, after: int = 4, longer_than: int = 3) -> Column:
    """A line break after ``after`` characters in labels longer than ``longer_than``."""
    return F.when(F.length(text) > longer_than, F.concat(F.substring(text, 1, after), F.lit("\n"), F.substring(text, F.lit(after + 1), F.length(text)))).otherwise(text)


def absolute_url(host: str, path: Column) -> Column:
    return F.concat(F.lit(host), path)


def titled(title: Column, body: Column, sign: str = "？") -> Column:
    """A heading, a sign and what stands under it, as scraped pieces are put together; null if either is missing."""
    return F.concat(title, F.lit(sign), body)


def with_map(text: Column, pairs: Column) -> Column:
    """A text with a map after it as JSON; null if either is missing."""
    return F.concat(text, F.to_json(pairs))


def without_last_newline(text: Column) -> Column:
    """One trailing newline less."""
    return F.regexp_replace(text, r"\n\z", "")


def single_quoted(text: Column) -> Column:
    """Escaped double quotes of model output as single quotes."""
    return F.replace(text, F.lit('\\"'), F.lit("'"))


def plain_tokens(text: Column) -> Column:
    """Default segmenter: runs of letters and digits, case kept; pluggable by passing another array column."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Default token count: every ideograph, run of other letters, run of digits and other sign is one."""
    pattern = r"[\x{4e00}-\x{9fff}]|[\p{L}&&[^\x{4e00}-\x{9fff}]]+|\p{N}+|[^\s\p{L}\p{N}]"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def rounded(value: Column, digits: int = 3) -> Column:
    """Number as text with fixed decimals."""
    return F.format_string(f"%.{digits}f", value)
