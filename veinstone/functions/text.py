"""Column functions on texts, keywords and measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, by which words are told apart.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F "
#: What keywords may be made of; other characters are removed from words.
KEPT = r"A-Za-z0-9/\-"
NOTHING = "\x01"


def ascii_text(text: Column) -> Column:
    """Each character that isn't ASCII, and each question mark, becomes a space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]|\?", " ")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def cleaned_words(text: Column) -> Column:
    """The words of a text, in their places, case kept; ``NOTHING`` stands for each character that keywords don't have.

    Words end at white space, question marks and whatever isn't ASCII. One pass over the text and one split instead of
    a regular expression for every word; a word of other characters alone keeps its place.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x00-\x7F&&[^{KEPT}{SPACE}?]]", NOTHING)
    return F.array_remove(F.split(marked, rf"[{SPACE}?\x80-\x{{10FFFF}}]+"), "")


def cleaned_word(word: Column) -> Column:
    """A word of ``cleaned_words`` without what stands for other characters."""
    return F.replace(word, F.lit(NOTHING), F.lit(""))


def is_case_sensitive(keyword: Column) -> Column:
    """Keywords that are compared without upper-casing the word: the parts of ``IT``."""
    return keyword.isin("IT", "I", "T", "")


def normalized(score: Column, most: Column) -> Column:
    return score * 100 / most


def xml_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def sql_escape(text: Column) -> Column:
    """Single quotes doubled, as in SQL literals."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def html_text(html: Column) -> Column:
    """Text of HTML: script, style and comments go, tags leave nothing behind, the five XML entities and no-break spaces are resolved."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def sic_code(text: Column) -> Column:
    """The first number in a text, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("int"), F.lit(0))


def rating(per_second: Column) -> Column:
    """Bands of records per second."""
    return F.when(per_second > 1000, "excellent").when(per_second > 500, "very good").when(per_second > 100, "good").when(per_second > 50, "fair").otherwise("needs work")


def control_colour(share: Column) -> Column:
    return F.when(F.coalesce(share, F.lit(0.0)) >= 50, "green").otherwise("red")
