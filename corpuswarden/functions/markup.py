"""Markup checks: balance of tags per document, and the exact well-formedness test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions.rows import each_struct

# Elements that are written without a closing tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_OPEN = r"<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*[^/>]|\s*)>"
_CLOSE = r"</([a-zA-Z][a-zA-Z0-9]*)\s*>"


def strip_invisible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    out = html
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script.*?</script>", r"(?is)<style.*?</style>"):
        out = F.regexp_replace(out, pattern, "")
    return out


def markup_balance(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Tags whose opening and closing counts differ, per document."""
    plain = strip_invisible(F.col(html))
    signed = lambda pattern, n: F.transform(
        F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lower(t).alias("tag"), F.lit(n).alias("n"))
    )
    tags = each_struct(df, keep, F.concat(signed(_OPEN, 1), signed(_CLOSE, -1)), "tag").where(~F.col("tag").isin(*VOID))
    return tags.groupBy(*keep, "tag").agg(F.sum("n").alias("surplus")).where(F.col("surplus") != 0)


# Fixed patterns: a tag with quoted attributes or none, and a reference.
TAG = r"""</?[A-Za-z_][A-Za-z0-9_:.-]*(?:\s+[A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?>"""
REFERENCE = r"&[a-zA-Z#0-9]+;"
#: Between the names of a stack of open elements, and before the first.
MARK = ">"


def _probe(html: Column) -> Column:
    return F.regexp_replace(strip_invisible(html), r"(?i)<!doctype[^>]*>", "")


def text_between(html: Column) -> Column:
    """What is neither a tag nor a reference."""
    return F.regexp_replace(F.regexp_replace(_probe(html), TAG, ""), REFERENCE, "")


def open_elements(html: Column) -> Column:
    """Names of the elements left open, outermost first, each after and before ``>``; empty if a
    closing tag did not name the last open one.

    A fold over the tags of the whole text in order with a stack of names."""

    def step(stack: Column, tag: Column) -> Column:
        name = F.regexp_extract(tag, r"^</?([A-Za-z0-9_:.-]+)", 1)
        closing, alone = F.startswith(tag, F.lit("</")), F.endswith(tag, F.lit("/>")) | F.lower(name).isin(*VOID)
        last = F.concat(F.lit(MARK), name, F.lit(MARK))
        return (
            F.when(stack == "", stack)
            .when(closing & F.endswith(stack, last), F.left(stack, F.char_length(stack) - F.char_length(name) - 1))
            .when(closing, F.lit(""))
            .when(alone, stack)
            .otherwise(F.concat(stack, name, F.lit(MARK)))
        )

    return F.aggregate(F.regexp_extract_all(_probe(html), F.lit(TAG), F.lit(0)), F.lit(MARK), step)


def markup_state(html: Column) -> Column:
    """malformed, ok or skipped; a text without any markup is skipped.

    Every closing tag must name the last element still open, and none may be left
    open. Names keep their case. What scripts, styles, comments and the document type hold is left
    out, void elements and references by name or number are taken as html has
    them; any other ``<`` or ``&`` is malformed, such as attributes without quotes."""
    return (
        F.when(~F.contains(html, F.lit("<")) & ~F.contains(html, F.lit("&")), "skipped")
        .when(text_between(html).rlike("[<&]") | (open_elements(html) != MARK), "malformed")
        .otherwise("ok")
    )
