"""Scans: files, lines, catalogs, tables in text, elements, links, receipts, calls.

A scan explodes one row into its parts inside that row's own task. No scan
shuffles, apart from those that say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswarden.functions import paths
from corpuswarden.functions.ordered import running_last, running_sum
from corpuswarden.functions.rows import each, each_numbered, each_struct
from corpuswarden.functions.text import NOT_BLANK, requirement_name, split_lines, unify_newlines
from corpuswarden.session import materialize

SYMBOL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("qualname", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("deprecated", T.BooleanType()),
    ]
)
CLASS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("bases", T.ArrayType(T.StringType())),
        T.StructField("members", T.ArrayType(SYMBOL)),
    ]
)
MODULE = T.StructType(
    [
        T.StructField("relpath", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("functions", T.ArrayType(SYMBOL)),
        T.StructField("classes", T.ArrayType(CLASS)),
    ]
)
CATALOG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("source_root", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("modules", T.ArrayType(MODULE)),
    ]
)


def read_corpus(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below ``root`` as (path, content, length, modificationTime).

    Files that vanish or cannot be read are left out, they do not end the run."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def corpus_scan(
    files: DataFrame,
    path: str,
    suffixes: list[str] | None = None,
    prune_segments: list[str] | None = None,
    skip_names: list[str] | None = None,
) -> DataFrame:
    """Keep files by suffix, without those below a pruned directory or of a skipped name.

    A directory is pruned when a whole segment equals it, not a part of one."""
    out = df = files
    if suffixes:
        keep = F.lit(False)
        for suffix in suffixes:
            keep = keep | F.col(path).endswith(suffix)
        out = df.where(keep)
    if prune_segments:
        parts = F.split(path, "/")
        dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        out = out.where(~F.arrays_overlap(dirs, F.array(*[F.lit(p) for p in prune_segments])))
    if skip_names:
        out = out.where(~paths.base_name(F.col(path)).isin(*skip_names))
    return out


def line_scan(df: DataFrame, text: str, keep: list[str], mode: str) -> DataFrame:
    """One row per line: ``keep`` columns, line_no (from 1), line, nonempty."""
    lines = each_numbered(df, keep, split_lines(F.col(text), mode), "line_no", "line")
    return lines.withColumn("nonempty", F.col("line").rlike(NOT_BLANK))


def line_count(text: Column, mode: str) -> Column:
    """Number of lines; those of a text file are counted by their ends, not taken apart."""
    if mode != "file":
        return F.size(split_lines(text, mode)).cast("long")
    body = unify_newlines(text)
    ends = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit("")))
    tail = F.when(text.endswith("\n") | text.endswith("\r") | (text == ""), 0).otherwise(1)
    return F.when(text.isNotNull(), ends + tail).cast("long")


def registry_scan(df: DataFrame, payload: str) -> DataFrame:
    """Nested catalog JSON to flat symbol rows; missing keys take their defaults.

    Classes come out as one row of kind ``class`` beside one row per member."""
    parsed = df.select(F.from_json(payload, CATALOG).alias("c"))
    catalog = each(parsed, [F.coalesce("c.name", F.lit("")).alias("package")], F.col("c.modules"), "m")
    module = F.coalesce("m.relpath", F.lit(""))
    empty_symbols = F.array().cast(T.ArrayType(SYMBOL))
    functions = F.transform(
        F.coalesce("m.functions", empty_symbols),
        lambda s: F.struct(F.lit("").alias("owner"), *_symbol_fields(s, "function")),
    )
    classes = F.coalesce("m.classes", F.array().cast(T.ArrayType(CLASS)))
    class_rows = F.transform(
        classes,
        lambda c: F.struct(
            F.lit("").alias("owner"),
            F.coalesce(c["name"], F.lit("")).alias("name"),
            F.coalesce(c["name"], F.lit("")).alias("qualname"),
            F.lit("class").alias("kind"),
            F.lit("(class)").alias("signature"),
            F.coalesce(c["summary"], F.lit("")).alias("summary"),
            F.coalesce(c["line"], F.lit(0)).alias("line"),
            F.lit(False).alias("deprecated"),
        ),
    )
    members = F.flatten(
        F.transform(
            classes,
            lambda c: F.transform(
                F.coalesce(c["members"], empty_symbols),
                lambda s: F.struct(
                    F.coalesce(c["name"], F.lit("")).alias("owner"), *_symbol_fields(s, "method")
                ),
            ),
        )
    )
    return each_struct(
        catalog, ["package", module.alias("module")], F.concat(functions, class_rows, members), "owner"
    )


def _symbol_fields(s: Column, kind: str) -> list[Column]:
    return [
        F.coalesce(s["name"], F.lit("")).alias("name"),
        F.coalesce(s["qualname"], s["name"], F.lit("")).alias("qualname"),
        F.coalesce(s["kind"], F.lit(kind)).alias("kind"),
        F.coalesce(s["signature"], F.lit("")).alias("signature"),
        F.coalesce(s["summary"], F.lit("")).alias("summary"),
        F.coalesce(s["line"], F.lit(0)).alias("line"),
        F.coalesce(s["deprecated"], F.lit(False)).alias("deprecated"),
    ]


def flat_signatures(symbols: DataFrame) -> DataFrame:
    """``module::qualname`` keys with their signatures."""
    return symbols.select(F.concat_ws("::", "module", "qualname").alias("key"), "signature")


def pipe_table_scan(
    lines: DataFrame,
    keys: list[str],
    delimiter: str = "|",
    section: str | None = None,
    heading: str = r"^##\s+(.+?)\s*$",
) -> DataFrame:
    """Delimited rows inside text as arrays of trimmed cells.

    With ``section`` only rows below that heading count; any other heading
    closes it, and finding the section carries state from line to line."""
    if section is not None:
        title = F.nullif(F.regexp_extract("line", heading, 1), F.lit(""))
        lines = running_last(lines, keys, "line_no", title, "_section").where(
            F.col("_section") == section
        ).drop("_section")
    rows = lines.where(F.contains("line", F.lit(delimiter)))
    body = F.regexp_replace(F.trim("line"), r"^\||\|$", "") if delimiter == "|" else F.col("line")
    cells = F.transform(F.split(body, r"\Q" + delimiter + r"\E"), lambda c: F.trim(c))
    is_rule = F.col("line").rlike(r"^[\s|:\-]+$")
    return rows.where(~is_rule).select(*keys, "line_no", cells.alias("cells"))


def element_scan(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row per opening tag in order of appearance."""
    tags = F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return each_numbered(df, keep, tags, "seq", "tag").withColumn("tag", F.lower("tag"))


def named_elements(
    spark: SparkSession, path: str, row_tag: str, props: list[str]
) -> DataFrame:
    """Elements of an XML file set that carry a name, with the listed properties as a map."""
    schema = T.StructType(
        [
            T.StructField("_name", T.StringType()),
            T.StructField("_class", T.StringType()),
            T.StructField(
                "property",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("_name", T.StringType()),
                            T.StructField("string", T.StringType()),
                            T.StructField("number", T.StringType()),
                            T.StructField("bool", T.StringType()),
                            T.StructField("enum", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    )
    wanted = F.filter(
        F.coalesce("property", F.array().cast(schema["property"].dataType)),
        lambda p: p["_name"].isin(*props),
    )
    pairs = F.transform(
        wanted,
        lambda p: F.struct(p["_name"], F.coalesce(p["string"], p["number"], p["bool"], p["enum"])),
    )
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .schema(schema)
        .load(path)
        .where(F.col("_name").isNotNull())
        .select(
            F.col("_name").alias("name"),
            F.col("_class").alias("class"),
            F.map_from_entries(pairs).alias("props"),
        )
    )


# Link targets in markup pages and in markdown text.
HREF = r'href="([^"]*)"'
MARKDOWN_LINK = r'\[(?:!\[[^\]]*\]\([^)\s]*\)|[^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'


def link_scan(df: DataFrame, text: str, keep: list[str], pattern: str) -> DataFrame:
    """Link targets in order, with the fragment after the first ``#`` split off."""
    targets = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    fragment = F.regexp_extract("target", r"^[^#]*#(?s:(.*))$", 1)
    return each_numbered(df, keep, targets, "seq", "target").select(
        *keep, "seq", "target", F.substring_index("target", "#", 1).alias("target_path"), fragment.alias("fragment")
    )


def requirement_names(df: DataFrame, owner: str, requirement: str, wanted: list[str]) -> DataFrame:
    """Wanted distribution names per owner, each once."""
    return (
        df.select(owner, requirement_name(F.col(requirement)).alias("name"))
        .where(F.col("name").isin(*[w.lower() for w in wanted]))
        .distinct()
    )


def baseline_resolve(
    entities: DataFrame, snapshots: DataFrame, key: str, ts: str, value: str, cut: Column
) -> DataFrame:
    """Baseline of each entity: the last snapshot at or before the cut, else the
    first one after it, else none; the label says which."""
    released = F.col(ts) <= cut
    picked = snapshots.groupBy(key).agg(
        F.max_by(F.when(released, F.col(value)), F.when(released, F.struct(ts, value))).alias("_rel"),
        F.min_by(F.when(~released, F.col(value)), F.when(~released, F.struct(ts, value))).alias("_ref"),
    )
    return entities.select(key).join(picked, key, "left").select(
        key,
        F.coalesce("_rel", "_ref").alias("baseline"),
        F.when(F.col("_rel").isNotNull(), "released")
        .when(F.col("_ref").isNotNull(), "refresh")
        .otherwise("none")
        .alias("label"),
    )


def receipt_map_scan(df: DataFrame, key: str, payload: str) -> DataFrame:
    """JSON object of check to ISO time as rows; unreadable objects give none and
    entries with an unreadable time are dropped."""
    entries = F.map_entries(F.from_json(payload, T.MapType(T.StringType(), T.StringType())))
    return (
        each(df, [key], entries, "_e")
        .select(key, F.col("_e.key").alias("check"), F.try_to_timestamp(F.col("_e.value")).alias("ts"))
        .where(F.col("ts").isNotNull())
    )


def receipt_map_fold(receipts: DataFrame, key: str, check: str, ts: str) -> DataFrame:
    """Latest time per check as one sorted JSON object per key.

    The object holds one entry per distinct check name, never one per receipt."""
    iso = F.date_format(F.max(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    latest = receipts.groupBy(key, check).agg(iso.alias("_t"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(check).alias("key"), F.col("_t").alias("value"))))
    return latest.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias("payload"))


def definition_scan(lines: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Definitions at a line start: name (group 1) and line."""
    return (
        lines.select(*keys, "line_no", F.regexp_extract("line", pattern, 1).alias("name"))
        .where(F.col("name") != "")
    )


# Fixed patterns: a reference to lines of a source file in a document, and what a
# source line may hold. Strings and comments are blanked before calls are looked for.
LINE_REFERENCE = r"\[([^\]]*)\]\(([^)#?]+\.py)#L(\d+)(?:-L(\d+))?\)"
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
IMPORT = r"^\s*import\s+([^#;]+)"
IMPORT_FROM = r"^\s*from\s+([\w.]+)\s+import\s+\(?([^#;)]+)"
IMPORTED = r"^([\w.]+)(?:\s+as\s+(\w+))?$"
CALL = r"(?<![\w.])(?:(\w+)\s*\.\s*)?(\w+)\s*\("
KEYWORD = r"(?<![\w.])(\w+)\s*=\s*([^=,()\s][^,()]*)"
DEFINITION = r"^\s*(?:async\s+)?def\s+(\w+)"


def _number(digits: Column) -> Column:
    """A line number; of more than 18 digits, 10**18, which no text reaches."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(F.char_length(bare) > 18, F.lit(10**18)).otherwise(F.concat(F.lit("0"), F.substring(bare, 1, 18)).cast("long"))


def line_reference_scan(lines: DataFrame, doc: str) -> DataFrame:
    """References to lines of source files out of document lines: ``doc``, ``line_no``, ``offset``
    (characters, from 1), ``reference``, ``target`` (folded below the document's own
    folder), ``start``, ``end``.

    Addresses of other hosts, absolute paths and paths that climb above the root
    are no references into the corpus."""
    # what a generator takes apart is a column below it: its own expressions are interpreted row by row
    found = lines.where(F.contains("line", F.lit(".py#L"))).select(doc, "line_no", "line", F.regexp_extract_all("line", F.lit(LINE_REFERENCE), F.lit(0)).alias("_found"))
    start = F.struct(F.array().cast("array<struct<reference:string,offset:int>>").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, text: Column) -> Column:
        # the first place at or after the end of the one before; an earlier one would be a match itself
        at = F.position(text, F.col("line"), acc["at"])
        hit = F.array(F.struct(text.alias("reference"), at.alias("offset")))
        return F.struct(F.concat(acc["out"], hit).alias("out"), (at + F.char_length(text)).alias("at"))

    single = F.array(F.struct(F.element_at("_found", 1).alias("reference"), F.position(F.element_at("_found", 1), F.col("line")).alias("offset")))
    hits = F.when(F.size("_found") == 1, single).otherwise(F.aggregate("_found", start, step, lambda acc: acc["out"]))
    placed = each_struct(found, [doc, "line_no"], hits, "reference")
    # by its pattern a reference has one "](" that ends the label, one "#", and only "-" between its numbers
    raw = F.substring_index(F.substr("reference", F.instr("reference", "](") + 2), "#", 1)
    span = F.translate(F.substring_index("reference", "#", -1), "L)", "")
    own = F.left(doc, F.char_length(doc) - F.char_length(paths.base_name(F.col(doc))))
    here = placed.where(~raw.startswith("http://") & ~raw.startswith("https://") & ~raw.startswith("/")).withColumn("_path", F.concat(own, raw))
    # in the generator a path is folded once: as a column it would be folded anew in each filter that asks for it
    rows = each_struct(here, [doc, "line_no", "offset", "reference"], F.array(F.struct(paths.fold_path(F.col("_path")).alias("target"))), "target")
    return rows.select(
        doc,
        "line_no",
        F.col("offset").cast("long").alias("offset"),
        "reference",
        "target",
        _number(F.substring_index(span, "-", 1)).alias("start"),
        F.when(F.contains(span, F.lit("-")), _number(F.substring_index(span, "-", -1))).alias("end"),
    )


def logical_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Source lines as ``code`` (strings and comments blanked) with facts of the statement that they
    belong to, which goes on while a bracket is open: the number ``first`` of its first
    line, its ``indent``, the function it ``defines`` and the module whose names it ``takes``.

    Lines without code are left out."""
    code = F.regexp_replace(F.regexp_replace("line", QUOTED, "''"), "#.*$", "")
    rows = lines.select(*keys, "line_no", code.alias("code")).where(F.trim("code") != "")
    opened = F.char_length(F.regexp_replace("code", r"[^(\[{]", "")) - F.char_length(F.regexp_replace("code", r"[^)\]}]", ""))
    deep = running_sum(rows.withColumn("_d", opened), keys, "line_no", F.col("_d"), "_after")
    word = lambda pattern: F.nullif(F.regexp_extract("code", pattern, 1), F.lit(""))
    facts = F.struct(F.col("line_no").alias("first"), _indent().alias("indent"), word(DEFINITION).alias("defines"), word(IMPORT_FROM).alias("takes"))
    told = running_last(deep, keys, "line_no", F.when(F.col("_after") - F.col("_d") <= 0, facts), "_b")
    return told.select(*keys, "line_no", "code", "_b.*").where("first IS NOT NULL")


def _indent() -> Column:
    return F.char_length(F.regexp_extract(F.regexp_replace("code", "\t", "        "), "^( *)", 1))


def import_scan(code: DataFrame, keys: list[str], module: str) -> DataFrame:
    """Names that a file gives a module or its functions: ``alias`` and ``function``, null for the module."""
    named = lambda i: F.regexp_extract(F.trim("_e"), IMPORTED, i)
    alias = F.when(named(2) != "", named(2)).otherwise(named(1))
    parts = each(code, [*keys], F.split("code", ";"), "code")
    plain = each(parts.where(F.col("code").rlike(IMPORT)), keys, F.split(F.regexp_extract("code", IMPORT, 1), ","), "_e")
    whole = plain.where(named(1) == module).select(*keys, alias.alias("alias"), F.lit(None).cast("string").alias("function"))
    # on its first line the names follow the word import, on further ones they stand alone
    names = F.when(F.col("line_no") == F.col("first"), F.regexp_extract("code", IMPORT_FROM, 2)).otherwise(F.regexp_replace("code", "[()]|;.*$", ""))
    taken = each(code.where(F.col("takes") == module), keys, F.split(names, ","), "_e")
    return whole.unionByName(taken.where(named(1) != "").select(*keys, alias.alias("alias"), named(1).alias("function"))).distinct()


def call_scan(code: DataFrame, keys: list[str]) -> DataFrame:
    """Calls: ``line_no``, ``first``, ``indent`` (that of a body where the statement defines a function),
    ``label`` as written, ``head`` (what stands before the point, or the name) and
    ``member`` (the name after the point, else null)."""
    body = F.regexp_replace("code", DEFINITION + r"\s*", "")
    inside = (F.col("indent") + F.col("defines").isNotNull().cast("int")).alias("indent")
    calls = each(code, [*keys, "line_no", "first", inside], F.regexp_extract_all(body, F.lit(CALL), F.lit(0)), "_e")
    head, name = (F.regexp_extract("_e", CALL, i) for i in (1, 2))
    return calls.select(
        *keys, "line_no", "first", "indent",
        F.when(head != "", F.concat(head, F.lit("."), name)).otherwise(name).alias("label"),
        F.when(head != "", head).otherwise(name).alias("head"),
        F.when(head != "", name).alias("member"),
    )


def keyword_scan(code: DataFrame, keys: list[str]) -> DataFrame:
    """Keyword arguments of each statement: ``first``, ``keyword``, ``value``."""
    found = each(code, [*keys, "first"], F.regexp_extract_all("code", F.lit(KEYWORD), F.lit(0)), "_e")
    return found.select(*keys, "first", F.regexp_extract("_e", KEYWORD, 1).alias("keyword"), F.trim(F.regexp_extract("_e", KEYWORD, 2)).alias("value"))


def alias_hits(
    aliases: DataFrame, calls: DataFrame, file: str, alias: str, keyword_needed: list[str] | None = None
) -> DataFrame:
    """Calls that go through an import alias of a flagged function of the same file.

    ``aliases(file, alias, function)`` and ``calls(file, alias, ...)`` meet in an
    equi-join. A function listed in ``keyword_needed`` counts only where the
    call carries its keyword (``has_keyword``)."""
    facts = aliases.select(file, alias, "function").distinct()
    hits = calls.join(facts, [file, alias])
    if keyword_needed:
        hits = hits.where(~F.col("function").isin(*keyword_needed) | F.col("has_keyword"))
    return hits


def aliased_call_scan(
    lines: DataFrame, keys: list[str], module: str, always: list[str], unless: dict[str, tuple[str, list[str]]] | None = None
) -> DataFrame:
    """Calls of a module's functions in source lines, by whatever name the file imports them:
    ``line_no``, ``label``, ``function``, ``scope`` (the innermost enclosing definition, null at top).

    Those of ``always`` count wherever they are called; of ``unless`` (function to
    keyword and values) only if the statement gives that keyword another value.
    Imports, calls, keywords and scopes are rows of their own that meet in
    equi-joins; a statement may go over several lines."""
    unless = unless or {}
    # read five times below: imports, calls, keywords, definitions and bounds of scopes
    code, _ = materialize(logical_lines(lines, keys), "source-lines")
    known = import_scan(code, keys, module).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("alias").alias("_alias"), F.col("function").alias("_function"))
    calls = call_scan(code, keys)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    # a member needs the module's own name, a plain name that of a function
    hits = calls.join(known, [*same, F.col("head") == F.col("_alias"), F.col("member").isNull() == F.col("_function").isNotNull()])
    hits = hits.select(*calls.columns, F.coalesce("_function", "member").alias("function")).where(F.col("function").isin(*always, *unless))
    if unless:
        wanted = F.lit(False)
        for function, (keyword, values) in unless.items():
            wanted = wanted | ((F.col("function") == function) & (F.col("_keyword") == keyword) & ~F.col("_value").isin(*values))
        given = keyword_scan(code, keys).where(F.col("keyword").isin(*{k for k, _ in unless.values()})).distinct()
        given = given.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("first").alias("_first"), F.col("keyword").alias("_keyword"), F.col("value").alias("_value"))
        opted = hits.where(F.col("function").isin(*unless)).join(given, [*same, F.col("first") == F.col("_first"), wanted], "left_semi")
        hits = hits.where(F.col("function").isin(*always)).unionByName(opted)
    return innermost_scope(code, hits, keys).select(*keys, "line_no", "label", "function", "scope")


def innermost_scope(code: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``hits`` with the name of the innermost definition around them as ``scope``, null at top.

    A definition spans the statements after it up to the next one that is not
    indented more: nested intervals. For each indent that a file defines something
    at, the last statement not indented more decides: if it is a definition of just
    that indent, it spans the hit. The deepest one that does is the scope."""
    starts = code.where("line_no = first").select(*keys, "first", "indent", F.col("defines").alias("_name"))
    levels = starts.where("_name IS NOT NULL").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("indent").alias("_level")).distinct()
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    spans = F.struct(F.when(F.col("indent") == F.col("_level"), F.col("_name")).alias("name"))
    bound = starts.join(levels, [*same, F.col("indent") <= F.col("_level")]).select(*keys, "_level", (F.col("first") * 2).alias("_seq"), spans.alias("_span"))
    asked = hits.select(*keys, "first", "indent").distinct()
    asked = asked.join(levels, [*same, F.col("indent") > F.col("_level")]).select(*keys, "_level", (F.col("first") * 2 + 1).alias("_seq"))
    both = bound.unionByName(asked, allowMissingColumns=True)
    # a statement and a hit in it have different numbers, so that these are unique
    told = running_last(both, [*keys, "_level"], "_seq", F.col("_span"), "_in").where("_seq % 2 = 1 AND _in.name IS NOT NULL")
    best = told.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.floor(F.col("_seq") / 2).alias("_first")).agg(F.max_by("_in.name", "_level").alias("scope"))
    return hits.join(best, [*same, F.col("first") == F.col("_first")], "left").drop("_first", *[f"_{k}" for k in keys])
