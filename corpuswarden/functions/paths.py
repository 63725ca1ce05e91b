"""Path, url and glob expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPED = ".."  # marker segment of a path that climbed above its root


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a shell glob. ``*`` also crosses ``/``, as in fnmatch."""
    out, rest = [], pattern
    while rest:
        # a closing bracket right after the opening one is a member, not the end
        bracket = re.match(r"\[(!?+)(\][^\]]*|[^\]]+)\]", rest)
        if bracket:
            negate, chars = bracket.groups()
            chars = re.sub(r"[\\\[\]^&]", r"\\\g<0>", chars)
            out.append(f"[{'^' if negate else ''}{chars}]")
            rest = rest[bracket.end():]
            continue
        char, rest = rest[0], rest[1:]
        out.append({"*": ".*", "?": "."}.get(char) or re.escape(char))
    return "^(?s:" + "".join(out) + ")$"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash, empty if there is none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def with_folders(path: Column) -> Column:
    """The path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def fold_path(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments folded, null once it climbs above the root."""

    # what is folded so far is one string, each segment behind a slash; null stays null
    def step(acc: Column, seg: Column) -> Column:
        above = F.left(acc, F.char_length(acc) - F.char_length(base_name(acc)) - 1)
        return F.when((seg == "") | (seg == "."), acc).when(seg == ESCAPED, F.when(acc != "", above)).otherwise(F.concat(acc, F.lit("/"), seg))

    return F.substring(F.aggregate(F.split(path, "/"), F.lit(""), step), 2, 2**31 - 1)


def flat_key(path: Column) -> Column:
    """Path as one flat key: drive colon, separators and underscores become ``-``."""
    return F.regexp_replace(path, r"[:\\/_]", "-")


def repo_slug(url: Column, host: str) -> Column:
    """``owner/name`` of a remote url on ``host`` in either form, null otherwise."""
    pattern = re.escape(host) + r"[:/]([^/]+/[^/]+?)(?:\.git)?$"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def index_name(name: Column) -> Column:
    """Package-index form of a name: runs of ``-``, ``_`` and ``.`` become one dash."""
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    """Path of a url without the leading slash, the query and the fragment."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
