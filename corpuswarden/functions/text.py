"""Text column expressions: line splitting, normalizing, digests, slugs, percents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators of str.splitlines() go beyond those of a text file
# (\\n, \\r, \\r\\n); in mode "newline_count" the tail after the last \\n always counts.
LINE_BREAKS = {"splitlines": r"\r\n|[\r\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"}
SUMMARY_MAX = 100
NOT_BLANK = r"(?U)\S"


def split_lines(text: Column, mode: str) -> Column:
    """Array of lines of ``text`` under one of the three line definitions."""
    if mode == "newline_count":
        return F.split(text, "\n")
    if mode == "file":
        body = unify_newlines(text)
        body = F.when(body.endswith("\n"), F.left(body, F.char_length(body) - 1)).otherwise(body)
        pieces = F.split(body, "\n")
    else:
        pieces = F.split(F.regexp_replace(text, f"({LINE_BREAKS[mode]})\\z", ""), LINE_BREAKS[mode])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(pieces)


def unify_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def rstrip_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)[\p{Zs}\t\x0B\f]+$", "")


def normalize_text(
    text: Column, drop_prefix: str | None = None, blank_line_fragments: bool = False
) -> Column:
    """Text without cosmetics: one newline form, no trailing blanks, no stamp
    lines, no line numbers in ``#L<n>`` fragments."""
    out = rstrip_lines(unify_newlines(text))
    if drop_prefix:
        out = F.array_join(
            F.filter(F.split(out, "\n"), lambda line: ~line.startswith(drop_prefix)), "\n"
        )
    if blank_line_fragments:
        out = F.regexp_replace(out, r"#L\d+", "#L")
    return out


def content_digest(text: Column) -> Column:
    """SHA-256 in hex; null stays null."""
    return F.sha2(text, 256)


def short_digest(*parts: Column) -> Column:
    """First 12 hex digits of the MD5 over the parts joined by newlines.

    A missing part counts as empty, it does not vanish."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.md5(F.concat_ws("\n", *filled)), 1, 12)


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def blank_out(text: Column, pattern: str) -> Column:
    """Text with every match replaced by as many newlines as it holds, so that
    line numbers stay what they are."""
    breaks = lambda m: F.repeat(F.lit("\n"), F.char_length(m) - F.char_length(F.replace(m, F.lit("\n"), F.lit(""))))
    kept = F.split(text, pattern)
    cut = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(kept, cut, lambda k, c: F.concat(k, F.coalesce(breaks(c), F.lit("")))), "")


# Comments, and fences, where either marker closes the other.
COMMENT = r"(?s)<!--.*?-->"
FENCED = r"(?ms)^[ \t]*(?:```|~~~)[^\n]*(?:\z|\n.*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z))"


def lintable(text: Column) -> Column:
    """Text without fenced blocks, comments and inline code, line numbers kept."""
    return strip_inline_code(blank_out(blank_out(unify_newlines(text), FENCED), COMMENT))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_inline_code(text: Column) -> Column:
    return F.regexp_replace(text, r"`[^`\n]*`", "")


def anchor_for(path: Column) -> Column:
    """Anchor id of a path: only letters, digits, ``_`` and ``-`` stay."""
    return F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}_-]", "")


def heading_slug(heading: Column) -> Column:
    """Anchor slug of a heading before repeats are numbered."""
    unlinked = F.regexp_replace(
        heading, r'\[(!\[[^\]]*\]\([^)\s]*\)|[^\]]*)\]\([^)\s]+(?:\s+"[^"]*")?\)', "$1"
    )
    plain = F.lower(F.trim(F.replace(unlinked, F.lit("`"), F.lit(""))))
    return F.replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\- ]", ""), F.lit(" "), F.lit("-"))


def first_sentence(text: Column) -> Column:
    """Summary of a text: its first non-empty line, cut at the first sentence end."""
    lines = F.split(unify_newlines(text), "\n")
    line = F.coalesce(strip(F.get(F.filter(lines, lambda x: x.rlike(NOT_BLANK)), F.lit(0))), F.lit(""))
    dot = F.instr(line, ". ")
    semi = F.instr(line, "; ")
    # instr is 1-based, so a marker at the very start (index 0) reads 1
    cut = F.when(dot > 1, F.substring(line, F.lit(1), dot)).when(
        semi > 1, F.substring(line, F.lit(1), semi)
    ).otherwise(line)
    return F.when(
        F.char_length(cut) > SUMMARY_MAX,
        F.concat(F.rtrim(F.substring(cut, 1, SUMMARY_MAX - 1)), F.lit("…")),
    ).otherwise(cut)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to the even neighbour, null on an empty base."""
    ratio = F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.bround(ratio, 0).cast("long")


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("—")).otherwise(F.concat(value.cast("string"), F.lit("%")))


def requirement_name(requirement: Column) -> Column:
    """Bare distribution name of a requirement string, null if there is none."""
    bare = F.regexp_extract(requirement, r"^\s*([A-Za-z0-9_.\-]+)", 1)
    return F.nullif(F.replace(F.lower(bare), F.lit("_"), F.lit("-")), F.lit(""))


def days_between(later: Column, earlier: Column) -> Column:
    """Age in fractional days."""
    return (
        F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    ) / F.lit(86_400_000_000.0)
