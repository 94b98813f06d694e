"""Scalar expressions over text; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_WORDS = ("table", "column", "row", "csv", "spreadsheet")
_opens = "[0-9A-Z(\\[]"
#: White space after the end of a sentence and before what may open the next.
BOUNDARY = f"(?<=[!?]|(?<!\\p{{Lu}})\\.)\\s+(?={_opens})"
SLIDE_WORDS = ("slide", "deck", "presentation", "pptx", "powerpoint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, inside of lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.trim(text, F.lit(" \t\r\n\f"))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def token_len(text: Column) -> Column:
    """The estimate used without a tokenizer: a quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def terms(text: Column) -> Column:
    """Lower-cased runs of anything but white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def clip(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def mentions(question: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased question contains one of the words anywhere, inside other words too."""
    found = F.lit(False)
    for word in words:
        found = found | F.lower(question).contains(word)
    return found


def sentences(text: Column) -> Column:
    """The sentences of each paragraph; where that gives at most one, the non-blank lines with their line ends.

    A sentence ends at ``.``, ``!`` or ``?`` before white space and a capital, digit or opening bracket, but not at a full
    stop after a capital. Paragraphs are parted by blank lines.
    """
    whole = normalise_newlines(text)
    paragraphs = F.filter(F.split(whole, "\n\n"), lambda p: ~is_blank(p))
    spans = F.flatten(F.transform(paragraphs, lambda p: F.split(p, BOUNDARY)))
    lines = F.split(whole, "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x)), lambda x: ~is_blank(x))
    return F.when(F.size(spans) > 1, spans).otherwise(kept)


def citation_coverage(answer: Column) -> Column:
    """The share of an answer's sentences that carry a mark such as [3]; null without sentences."""
    parts = F.filter(F.split(answer, r"(?<=[!.?])\s+"), lambda s: ~is_blank(s))
    cited = F.size(F.filter(parts, lambda s: s.rlike(r"\[[0-9]+\]")))
    return F.when(F.size(parts) > 0, cited / F.size(parts))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, a few entities are resolved, white space is one blank."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))
