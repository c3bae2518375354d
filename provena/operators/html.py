"""Main text of raw HTML pages with regular expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.text import col

# Elements whose whole content is not text of the page, and the entities that are decoded (ampersand last).
DROPPED = ("script", "style", "nav", "head", "header", "footer", "aside", "noscript")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
COMMENT = r"(?s)<!--.*?-->"
TAG = r"(?s)<[^>]*>"


def dropped_element(name: str) -> str:
    return rf"(?is)<{name}(\s[^>]*)?>.*?</{name}\s*>"


def main_text(html: str | Column) -> Column:
    """Drop comments and page furniture, turn tags into line breaks, decode entities, drop blank lines."""
    t = F.regexp_replace(col(html), COMMENT, "")
    for name in DROPPED:
        t = F.regexp_replace(t, dropped_element(name), "")
    t = F.regexp_replace(t, TAG, "\n")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(t, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")
