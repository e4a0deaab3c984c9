"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract: what counts as white space, a token, a name, a block tag, a heading.
SPACE = r"[ \t\n\r\f\x0B]+"
TOKEN = "[A-Za-z0-9_]+"
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
BLOCK_TAG = r"<(?:div|dl|dt|dd|span|table|tr|td)[ >/]"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
#: Block tags per 1000 characters above which a page counts as a dump of markup.
MAX_DENSITY = 5.0


def norm_space(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """Maximal runs of identifier characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def front_matter(text: Column) -> Column:
    """The leading ``---`` block, or an empty string."""
    # A fixed value of the contract, as are the patterns of titles and links below.
    return F.regexp_extract(text, r"\A---\r?\n(?s:.*?)\r?\n---\r?\n", 0)


def body_of(text: Column) -> Column:
    return F.substr(text, F.length(front_matter(text)) + 1)


def title_of(text: Column) -> Column:
    """``title:`` of the front matter without quotes; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(front_matter(text), r"(?m)^title:\s*(.+?)\s*$", 1), "^[\"']+|[\"']+$", "")


def html_density(html: Column) -> Column:
    """Block tags per 1000 characters."""
    return F.regexp_count(html, F.lit(BLOCK_TAG)) * 1000 / F.greatest(F.length(html), F.lit(1))


def is_prose(html: Column) -> Column:
    return html_density(html) <= MAX_DENSITY


def heading_level(line: Column) -> Column:
    """1 to 6 for an ATX heading, else 0."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


def link_target(cell: Column) -> Column:
    """``{% link X %}`` becomes X."""
    return F.regexp_replace(cell, r"\{%\s*link\s+(.+?)\s*%\}", "$1")


def name_key(name: Column) -> Column:
    """The form in which names are looked up when scoring."""
    return F.lower(F.trim(name))


def norm_default(value: Column) -> Column:
    """A default as it is compared: without quoting, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(value), "^[`\"' \\t]+|[`\"' \\t]+$", "")))


def stratum_of(path: Column) -> Column:
    """Which part of a documentation tree a page belongs to."""
    return F.when(F.split_part(path, F.lit("/"), F.lit(1)).isin("core_extensions", "extensions"), "extension").otherwise("narrative")


def bucket_of(stratum: Column, has_signal: Column) -> Column:
    return F.when(stratum == "reference", stratum).otherwise(F.concat_ws("-", stratum, F.when(has_signal, "signal").otherwise("distractor")))


def grounded(evidence: Column, document: Column) -> Column:
    """Whether the quoted span occurs in the document, white space aside."""
    return F.contains(norm_space(document), norm_space(evidence))


def error_group(message: Column) -> Column:
    """An error without its retry epilogue, unwrapped from a JSON envelope if it is whole."""
    short = F.regexp_replace(message, r"\s*\[gave up after .*?\]\s*$", "")
    envelope = F.regexp_extract(short, r"(?s)(\{.*\})\s*$", 1)
    return F.coalesce(F.get_json_object(F.when(envelope != "", envelope), "$.error.message"), short)
