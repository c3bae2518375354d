"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Unicode-aware whitespace trimming removes, as one regex class.
WS = (
    r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Fixed value: index terms are runs of two or more letters, digits or underscores.
TERM_CLASS = r"[\p{L}\p{N}_]"
TERM = TERM_CLASS + "{2,}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is computed once per row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: str | Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def whole_json(c: str | Column) -> Column:
    """The text as one JSON value (variant), null where it is none or where anything but white space follows the value.

    Spark's parser stops after the first value. So the text is read as the first of two elements of a list; the second is a
    mark that the text cannot hold, its own hash.
    """
    text = col(c)
    mark = F.md5(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit('\n,"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(listed, "$[1]", "string") == mark, F.try_variant_get(listed, "$[0]", "variant"))


def collapse_spaces(c: str | Column) -> Column:
    return F.regexp_replace(strip(c), rf"{WS}+", " ")


def words(c: str | Column) -> Column:
    return F.filter(F.split(strip(c), rf"{WS}+"), lambda w: w != F.lit(""))


def word_count(c: str | Column) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, rf"{WS}+")))


def terms(c: str | Column) -> Column:
    """Lower-cased index terms in text order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({TERM})"), F.lit(1))


def term_counts(c: str | Column) -> Column:
    """``array<struct<term, tf>>`` of one text, computed inside the row.

    The sorted terms are cut where the value changes, so no shuffle is needed to count them.
    """
    def starts(a: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(a)),
            lambda i: (i == 1) | (F.element_at(a, i) != F.element_at(a, F.greatest(i - 1, F.lit(1)))),
        )

    def runs(a: Column) -> Column:
        return bind(
            starts(a),
            lambda at: F.zip_with(
                at,
                F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(a) + 1)),
                lambda s, e: F.struct(F.element_at(a, s).alias("term"), (e - s).alias("tf")),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return bind(F.sort_array(terms(c)), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(empty))


def canonical_newlines(c: str | Column) -> Column:
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_sha256(c: str | Column) -> Column:
    """Hash of text that ignores only how lines end."""
    return F.sha2(canonical_newlines(c), 256)


def found_phrases(c: str | Column, phrases: Sequence[str]) -> Column:
    """The given phrases that occur in the lower-cased text, in the given order."""
    low = F.lower(col(c))
    hits = F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])
    return F.array_compact(hits)


def any_phrase(c: str | Column, phrases: Sequence[str]) -> Column:
    low = F.lower(col(c))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def entity_codes(c: str | Column, keywords: Mapping[str, str]) -> Column:
    """Codes whose keyword occurs anywhere in the text (substring, any case)."""
    low = F.lower(col(c))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(code)) for code, k in keywords.items()]))


def match_form(c: str | Column) -> Column:
    """Lower case, everything but ASCII letters, digits and spaces blanked, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), rf"[^a-z0-9]", " "), " +", " "))


def hash_bucket(c: str | Column, buckets: int) -> Column:
    """A bucket number any engine with md5 can recompute."""
    return F.pmod(F.conv(F.substring(F.md5(col(c)), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
