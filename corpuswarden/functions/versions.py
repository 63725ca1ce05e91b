"""Version texts as integer arrays; Spark compares arrays element by element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = r"^\d{1,18}([.]\d{1,18}){1,3}$"


def version_parts(version: Column) -> Column:
    """``array<bigint>`` of a dotted version, null if it is not one."""
    return F.when(version.rlike(_STRICT), F.split(version, "[.]").cast("array<bigint>"))


def read_version(text: Column, variable: str = "__version__") -> Column:
    """Three-part version assigned to ``variable`` at a line start."""
    found = F.regexp_extract(text, rf"""(?m)^{variable}\s*=\s*['"](\d+[.]\d+[.]\d+)['"]""", 1)
    return F.nullif(found, F.lit(""))


def bump_patch(version: Column) -> Column:
    parts = version_parts(version)
    return F.concat_ws(
        ".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), (F.get(parts, F.lit(2)) + 1).cast("string")
    )


def is_lower(version: Column, floor: Column) -> Column:
    """Numeric comparison; false when either side cannot be read."""
    return F.coalesce(version_parts(version) < version_parts(floor), F.lit(False))
