"""Compiler diagnostics as column expressions: parse, format, normalise, classify."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Message layouts, kinds in order of precedence, prefixes and paths to remove.
STRUCTURED = r"^([^\s:]+\.c(?:pp)?):(\d+):(\d+):\s*(error|warning|note):\s*(.+)"
LOCATION = r"([^\s:]+\.c(?:pp)?):(\d+):(\d+):"
LINE_COLUMN = r":(\d+):(\d+):"
KINDS = {
    "syntax": r"(?i)syntax error|expected .* before|unexpected token",
    "undefined": r"(?i)undefined reference|implicit declaration|undeclared",
    "type": r"(?i)incompatible types|invalid conversion|type mismatch",
    "redefinition": r"(?i)redefinition|redeclared|multiple definition",
    "warning": r"(?i)\bwarning:",
    "error": r"(?i)\berror:",
}
PREFIXES = ("Compilation Failed:", "Compilation Failed :", "Error:", "Error :")
PREFIXES_STRICT = ("Compilation failed:", *PREFIXES)
TEMPORARY = r"/tmp/[\w\-]+/|tmp[\w\-]+/"
PATHS = r"/(?:[^\s:]*/)?([^\s:/]+)/*|[\w/.\-]*/([\w.\-]+\.[ch]pp?)|/{2,}"
PATHS_STRICT = r"(?:[\w.\-]*/)+([^\s:/]+)/*|/{2,}"
NOTHING = "No error message provided"
MAX_ERRORS = 50


def parse_line(line: Column) -> Column:
    """struct(file, line, column, type, message, raw), or null if the line is no diagnostic."""
    part = lambda i: F.regexp_extract(line, STRUCTURED, i)
    lower = F.lower(line)
    null = F.lit(None)
    whole = F.struct(
        part(1).alias("file"),
        part(2).cast("int").alias("line"),
        part(3).cast("int").alias("column"),
        part(4).alias("type"),
        strip(part(5)).alias("message"),
        line.alias("raw"),
    )
    loose = F.struct(
        null.cast("string").alias("file"),
        null.cast("int").alias("line"),
        null.cast("int").alias("column"),
        F.when(lower.contains("error"), "error").otherwise("warning").alias("type"),
        strip(line).alias("message"),
        line.alias("raw"),
    )
    return F.when(line.rlike(STRUCTURED), whole).when(lower.rlike("error|warning"), loose)


def parse(message: Column) -> Column:
    """All diagnostics of a message, in order."""
    return F.filter(F.transform(F.split(strip(message), "\n", -1), parse_line), lambda x: x.isNotNull())


def format_one(d: Column, number: Column) -> Column:
    where = F.when(
        d["file"].isNotNull() & (d["file"] != "") & (d["line"] != 0),
        F.format_string("**%s:%d:%d**", d["file"], d["line"], d["column"]),
    )
    kind = F.when(d["type"] != "", F.concat(F.lit("["), F.upper(d["type"]), F.lit("]")))
    return F.concat_ws(" ", F.concat(F.lit("\n"), number.cast("string"), F.lit(". ")), where, kind, d["message"])


def format_for_prompt(message: Column, source: Column | None = None, max_errors: int = MAX_ERRORS) -> Column:
    """The first ``max_errors`` diagnostics, numbered; without any the normalised message."""
    found = F.slice(parse(message), 1, max_errors)
    listed = F.concat(F.array(F.lit("## Compilation Errors:")), F.transform(found, lambda d, i: format_one(d, i + 1)))
    plain = F.array(F.lit("## Compilation Error:"), normalize(message))
    out = F.array_join(F.when(F.size(found) > 0, listed).otherwise(plain), "\n")
    if source is None:
        return out
    tail = F.concat(F.lit("\n\n## Source Code:\n```c\n"), strip(source), F.lit("\n```"))
    return F.concat(out, F.when(source != "", tail).otherwise(""))


def locations(message: Column) -> Column:
    """array(struct(file, line, col)) of every place named in a message."""
    part = lambda i: F.regexp_extract_all(message, F.lit(LOCATION), F.lit(i))
    return F.transform(
        F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")),
        lambda x: F.struct(x["a"].alias("file"), x["b"].cast("int").alias("line"), x["c"].cast("int").alias("col")),
    )


def remove_prefix(message: Column, strict: bool = True) -> Column:
    out = message
    for prefix in reversed(PREFIXES_STRICT if strict else PREFIXES):
        out = F.when(message.startswith(prefix), strip(F.substring(message, F.lit(len(prefix) + 1), F.length(message)))).otherwise(out)
    return out


def simplify_paths(message: Column, strict: bool = True) -> Column:
    """Temporary folders go, and paths become file names; the compatible form keeps a relative .c path's folder."""
    bare = F.regexp_replace(message, TEMPORARY, "")
    return F.regexp_replace(bare, PATHS_STRICT, "$1") if strict else F.regexp_replace(bare, PATHS, "$1$2")


def remove_line_numbers(message: Column) -> Column:
    return F.regexp_replace(message, LINE_COLUMN, ":")


def clean_whitespace(message: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(message, " +", " "), r"\n\s*\n\s*\n+", "\n\n"))


def line_key(line: Column) -> Column:
    """Lines are duplicates if they differ in numbers and outer white space only."""
    return strip(F.regexp_replace(line, r"\d+", "N"))


def remove_duplicate_lines(message: Column) -> Column:
    """Of duplicate lines the first stays; blank lines all stay. Lines are sorted by key and place, so no line is sought among all."""

    def first_ones(rows: Column) -> Column:
        kept = F.filter(rows, lambda r, i: (r["k"] == "") | (i == 0) | (F.get(rows, i - 1)["k"] != r["k"]))
        back = F.array_sort(F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
        return F.array_join(F.transform(back, lambda r: r["x"]), "\n")

    rows = F.transform(F.split(message, "\n", -1), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i"), x.alias("x")))
    return let(F.array_sort(rows), first_ones)


def kind_of(line: Column) -> Column:
    """The first kind whose pattern is found, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def categorize_line(line: Column) -> Column:

    def named(kind: Column) -> Column:
        return F.when(kind.isNotNull() & ~F.lower(line).contains(kind), F.concat(F.lit("["), F.upper(kind), F.lit("] "), line)).otherwise(line)

    return let(kind_of(line), named)


def add_categories(message: Column) -> Column:
    return F.array_join(F.transform(F.split(message, "\n", -1), lambda x: F.when(x.rlike(r"\S"), categorize_line(x)).otherwise(x)), "\n")


def normalize(message: Column, line_numbers: bool = True, paths: bool = True, categories: bool = True, strict: bool = True) -> Column:
    """Prefix, paths, line numbers, white space, duplicates, categories, in this order."""
    out = remove_prefix(message, strict)
    out = simplify_paths(out, strict) if paths else out
    out = out if line_numbers else remove_line_numbers(out)
    out = remove_duplicate_lines(clean_whitespace(out))
    out = strip(add_categories(out) if categories else out)
    return F.when(message.isNull() | ~message.rlike(r"\S"), NOTHING).otherwise(out)
