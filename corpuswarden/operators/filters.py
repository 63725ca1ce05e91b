"""Row filters, budgets, rules and classifications. Most need no shuffle at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.ordered import top_k


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def public_filter(
    df: DataFrame,
    name: str,
    kind: str | None = None,
    private_prefix: str = "_",
    generated_prefixes: tuple[str, ...] = ("Ui_",),
    accessor_kinds: tuple[str, ...] = ("setter", "deleter"),
) -> DataFrame:
    """Public names: not private, not generated, not an accessor of another member."""
    hidden = [F.startswith(F.col(name), F.lit(p)) for p in (private_prefix, *generated_prefixes)]
    if kind:
        hidden.append(F.coalesce(F.col(kind).isin(*accessor_kinds), F.lit(False)))
    return df.where(~any_of(hidden))


def boundary_class(target: Column, base_dir: Column) -> Column:
    """Scope of a link target seen from ``base_dir``: external, anchor, empty, escapes or inside."""
    path = F.trim(F.substring_index(target, "#", 1))
    return (
        F.when(target.rlike(r"^(https?://|mailto:)"), "external")
        .when(target.startswith("#"), "anchor")
        .when(path == "", "empty")
        .when(path.startswith("/") | resolve_target(target, base_dir).isNull(), "escapes")
        .otherwise("inside")
    )


def resolve_target(target: Column, base_dir: Column) -> Column:
    """Folded path of a relative target, null if it climbs above the root."""
    return paths.fold_path(F.concat_ws("/", base_dir, F.trim(F.substring_index(target, "#", 1))))


def boundary_filter(links: DataFrame, target: str, base_dir: str) -> DataFrame:
    """Links that stay in scope, with their resolved path."""
    return (
        links.withColumn("scope", boundary_class(F.col(target), F.col(base_dir)))
        .where(F.col("scope") == "inside")
        .withColumn("resolved", resolve_target(F.col(target), F.col(base_dir)))
    )


def is_exempt(
    path: Column,
    names: tuple[str, ...] = (),
    name_parts: tuple[str, ...] = (),
    segments: tuple[str, ...] = (),
) -> Column:
    """Exempt by lower-cased file name, by a substring of it, or by a directory segment."""
    name = F.lower(paths.base_name(path))
    checks = []
    if names:
        checks.append(name.isin(*names))
    checks += [F.contains(name, F.lit(p)) for p in name_parts]
    if segments:
        checks.append(F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in segments])))
    return any_of(checks)


def exempt_filter(df: DataFrame, path: str, generated: DataFrame | None = None, repo: str = "repo", **rules) -> DataFrame:
    """Rows that are not exempt, nor listed in ``generated(repo, path)``."""
    out = df.where(~is_exempt(F.col(path), **rules))
    if generated is not None:
        out = out.join(generated.select(repo, path).distinct(), [repo, path], "left_anti")
    return out


def allowlist_filter(df: DataFrame, allow: DataFrame, path: str, function: str) -> DataFrame:
    """Findings not suppressed by an exact (path, function) key nor by (path, ``*``)."""
    listed = allow.select(F.col("path").alias("_path"), F.col("function").alias("_fn")).distinct()
    cond = (F.col(path) == F.col("_path")) & ((F.col("_fn") == "*") | (F.col("_fn") == F.col(function)))
    return df.join(listed, cond, "left_anti")


def glob_hit(name: Column, path: Column, patterns: list[str]) -> Column:
    """Does any glob match the base name or the whole relative path?"""
    either = "|".join(f"(?:{paths.glob_to_regex(p)})" for p in patterns)
    return name.rlike(either) | path.rlike(either)


def glob_match(df: DataFrame, path: str, excludes: list[str]) -> DataFrame:
    """Rows that no exclude pattern hits. The patterns are part of the plan, not a join."""
    if not excludes:
        return df
    return df.where(~glob_hit(paths.base_name(F.col(path)), F.col(path), excludes))


def size_budget(
    df: DataFrame,
    size: Column,
    advisory: Column,
    hard: Column,
    near_cap: float = 0.9,
    near_empty: int = 20,
) -> DataFrame:
    """Size against an advisory and a hard cap that may depend on the row.

    FAIL above the hard cap; WARN above the advisory cap, near the hard cap or
    for a next-to-empty row; over = bytes above the cap that was broken."""
    out = df.withColumn("size", size.cast("long")).withColumn("_a", advisory).withColumn("_h", hard)
    return (
        out.withColumn(
            "status",
            F.when(F.col("size") > F.col("_h"), "FAIL")
            .when(F.col("size") > F.col("_a"), "WARN")
            .when(F.col("size") > F.col("_h") * near_cap, "WARN")
            .when(F.col("size") < near_empty, "WARN")
            .otherwise("OK"),
        )
        .withColumn(
            "over",
            F.when(F.col("size") > F.col("_h"), F.col("size") - F.col("_h"))
            .when(F.col("size") > F.col("_a"), F.col("size") - F.col("_a"))
            .otherwise(0)
            .cast("long"),
        )
        .drop("_a", "_h")
    )


def entry_budget(lines: DataFrame, keys: list[str], cap: int, entry: Column | None = None) -> DataFrame:
    """Per document: entries over the character cap, and the longest entry."""
    rows = lines if entry is None else lines.where(entry)
    chars = F.char_length("line")
    return rows.groupBy(*keys).agg(
        F.count_if(chars > cap).alias("n_over"), F.max(chars).cast("long").alias("longest")
    )


def field_rules(df: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule is a condition that must not hold.

    A rule that cannot be decided (null) is broken: unreadable fields are findings."""
    checks = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.coalesce(bad, F.lit(True)).alias("bad")) for n, bad in rules.items()]
    )
    broken = F.filter(checks, lambda x: x["bad"])
    return df.select(*keep, F.inline(broken)).drop("bad")


def marker_scan(df: DataFrame, text: str, keep: list[str], marker: str) -> DataFrame:
    """Rows whose text has ``marker`` (a regex) at a line start, with the first such line."""
    line = F.regexp_extract(text, f"(?m)^({marker}[^\\n]*)", 1)
    return df.where(F.col(text).rlike(f"(?m)^{marker}")).select(*keep, line.alias("first_line"))


CONFLICT_MARKER = "<<<<<<< "


def conflict_marker_scan(df: DataFrame, text: str, keep: list[str], marker: str = CONFLICT_MARKER) -> DataFrame:
    """Texts with an unresolved merge in any of the given versions."""
    return marker_scan(df, text, keep, marker)


def forbidden_heading(
    df: DataFrame, text: str, keep: list[str], heading: str = r"##\s*\[Unreleased\]"
) -> DataFrame:
    """Documents with a banned heading at a line start, in any case."""
    return df.where(F.col(text).rlike(f"(?mi)^{heading}")).select(*keep)


def recent_changes(
    df: DataFrame,
    group: str,
    path: str,
    ts: str,
    minutes: int,
    as_of: Column,
    generated: str = r"^API_(INDEX|REGISTRY|CHANGES)\.(md|json)$",
    k: int = 8,
) -> DataFrame:
    """Files changed within the last minutes, newest first: the first k per group and
    how many more there are. Of a rename only the new name counts."""
    recent = (
        df.withColumn(path, F.regexp_replace(path, r"^.* -> ", ""))
        .where(~F.col(path).rlike(generated))
        .where(F.col(ts) > as_of - F.make_dt_interval(mins=F.lit(minutes)))
    )
    totals = recent.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    first = top_k(recent, [group], [F.col(ts).desc(), F.col(path)], k)
    return first.join(totals, group).withColumn("rest", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def log_verdict(
    lines: DataFrame,
    keys: list[str],
    noise: str,
    error: str,
    transient: str | None = None,
    passed: str | None = None,
) -> DataFrame:
    """Verdict of each job's log: ok, retry or failed, with the first telling line.

    Progress lines are dropped first. Any error line fails the job, unless a
    transient cause appears too, which means retry. With ``passed`` a job that
    shows no such line has failed although nothing complains."""
    kept = lines.withColumn("_kept", ~F.col("line").rlike(noise))
    hit = F.col("_kept") & F.col("line").rlike(error)
    soft = F.col("_kept") & F.col("line").rlike(transient) if transient else F.lit(False)
    good = F.col("line").rlike(passed) if passed else F.lit(True)
    per_job = kept.groupBy(*keys).agg(
        F.bool_or(hit).alias("_err"),
        F.bool_or(soft).alias("_soft"),
        F.count_if(good).alias("n_passed"),
        F.min_by(F.when(hit, F.col("line")), F.when(hit, F.col("line_no"))).alias("_first"),
    )
    return per_job.select(
        *keys,
        F.when(F.col("_err") & F.col("_soft"), "retry")
        .when(F.col("_err") | (F.col("n_passed") < 1), "failed")
        .otherwise("ok")
        .alias("verdict"),
        "n_passed",
        F.when(F.col("_err"), F.col("_first"))
        .when(F.col("n_passed") < 1, F.lit("no passing line"))
        .alias("first_hit"),
    )


def element_property_violations(
    df: DataFrame,
    props: str,
    cap: int,
    orientation: tuple[str, str] = ("orientation", "Vertical"),
    size_type: tuple[str, str] = ("sizeType", "Fixed"),
    number: str = "height",
) -> DataFrame:
    """Elements whose two enum properties end as given and whose number is above the cap.

    An unreadable number is skipped, a missing property is not a match."""
    p = F.col(props)
    value = F.try_element_at(p, F.lit(number)).try_cast("int")
    return df.where(
        F.try_element_at(p, F.lit(orientation[0])).endswith(orientation[1])
        & F.try_element_at(p, F.lit(size_type[0])).endswith(size_type[1])
        & (value > cap)
    ).withColumn("value", value)


# The three naming patterns for handlers that are in force.
HANDLER_PATTERNS = {
    "widget": r"^[a-z]+\d{3}(_init)?$",
    "audit": r"^(tb|b|chk|cmb|list|s|d|i|w)\d+$",
    "domain": r"^(tb|b|chk|cmb|s|list|txt)\d",
}


def name_class(name: Column, patterns: dict[str, str], other: str = "other") -> Column:
    """First pattern in order that the name matches."""
    out = None
    for label, pattern in patterns.items():
        out = F.when(name.rlike(pattern), label) if out is None else out.when(name.rlike(pattern), label)
    return out.otherwise(other)


def name_stem(name: Column, suffix: str = "_init") -> Column:
    return F.regexp_replace(name, f"{suffix}$", "")


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """Ordered classification: label of the first rule that holds."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.lit(default) if out is None else out.otherwise(default)


# The sentences of a summary that nothing else provides.
DOMAIN_SENTENCE = ("Workspace repo aligned with the ", " domain.")
NO_SUMMARY = "Workspace repository."


def entity_summary(name: Column, description: Column, readme_line: Column, domain: Column) -> Column:
    """Description, else the first readme line unless it only repeats the name, else
    a sentence about the domain, else a constant."""
    blank_to_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    readme = F.trim(F.regexp_replace(F.trim(readme_line), "^#+", ""))
    return F.coalesce(
        blank_to_null(description),
        F.when((readme != "") & (F.lower(readme) != F.lower(name)), readme),
        F.concat(F.lit(DOMAIN_SENTENCE[0]), blank_to_null(domain), F.lit(DOMAIN_SENTENCE[1])),
        F.lit(NO_SUMMARY),
    )
