"""Operators on ordered lines: segmentation under headers, first and last of a key, distinct lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import asm
from ..functions.diagnostics import line_key
from ..functions.text import numbered_lines
from ..storage import stored


def ordered_list(order: Column | str, value: Column | str) -> Column:
    """Aggregate: the values in ascending order of ``order``."""
    order = F.col(order) if isinstance(order, str) else order
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def ordered_concat(order: Column | str, value: Column | str, separator: str) -> Column:
    return F.array_join(ordered_list(order, value), separator)


def segments(rows: DataFrame, is_header: Column, order: str, *keys: str, within: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Rows with ``segment``: the number of the last header at or above; rows above the first header go.

    ``within``: further columns, aggregates over the rows at or above; ``where`` chooses among the rows by what
    they were before.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    made = {"segment": F.sum(is_header.cast("int")).over(frame)} | {n: c.over(frame) for n, c in (within or {}).items()}
    if where is None:
        return rows.withColumns(made).where("segment > 0")
    return rows.withColumns({"__here": where} | made).where("__here and segment > 0").drop("__here")


def functions_of_lines(rows: DataFrame, key: str = "program_id", order: str = "ln", line: str = "line", strict: bool = True) -> DataFrame:
    """(key, segment, name, address, instructions) of a line relation; a header alone has an empty list."""
    x = F.col(line)
    head = asm.is_header(x, strict)
    cut = segments(rows.select(key, order, line), head, order, key)
    found = F.when(~asm.is_header(x, strict), asm.instruction(x, strict))
    return cut.groupBy(key, "segment").agg(
        F.max(F.when(head, asm.header_name(x, strict))).alias("name"),
        F.max(F.when(head, asm.header_address(x, strict))).alias("address"),
        F.filter(ordered_list(order, found), lambda i: i.isNotNull()).alias("instructions"),
    )


def extract_functions(listings: DataFrame, key: str = "program_id", text: str = "text", strict: bool = True) -> DataFrame:
    return functions_of_lines(numbered_lines(listings, text, key), key, strict=strict)


def formatted_listing(functions: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, formatted): each program's functions between markers."""
    one = asm.format_function(F.col("name"), F.col("address"), F.col("instructions"))
    return functions.groupBy(key).agg(ordered_concat(F.col("segment"), one, "\n").alias("formatted"))


def rendered_lines(rows: DataFrame, key: str = "program_id", order: str = "ln", line: str = "line", strict: bool = True) -> DataFrame:
    """(key, kind, ln, value): what each line adds to the raw, cleaned and formatted rendering of its program's listing.

    The values of a kind in order, each with a line end, are the file of that rendering; a value may hold line
    ends. No listing is held whole. A program's lines differ in ``order``; one without a function, or without
    a line to keep, has an empty value there.
    """
    x = F.col("line")
    said = rows.select(key, F.col(order).alias("ln"), F.col(line).alias("line"))
    said = said.select(key, "ln", "line", asm.clean_line(x, strict).alias("clean"), asm.header_name(x, strict).alias("name"), asm.header_address(x, strict).alias("address"))
    said = stored(said, "said")
    first = F.min(F.when(F.col("name").isNotNull(), F.col("ln"))).alias("first")
    ends = stored(said.groupBy(key).agg(first, F.max("ln").alias("last"), F.count("clean").alias("kept")), "ends")
    at_end = F.col("ln") == F.col("last")
    end = "<END_FUNC>\n\n"
    head = F.concat(F.lit("<FUNC> "), "name", F.lit(" at "), "address")
    inside = F.when(F.col("ln") >= F.col("first"), F.when(F.col("name").isNull(), F.col("clean")).when(F.col("ln") > F.col("first"), F.concat(F.lit(end + "\n"), head)).otherwise(head))
    formatted = F.when(at_end, F.when(F.col("first").isNull(), "").otherwise(F.concat_ws("\n", inside, F.lit(end)))).otherwise(inside)
    cleaned = F.when(at_end & (F.col("kept") == 0), "").otherwise(F.col("clean"))
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in (("raw", x), ("cleaned", cleaned), ("formatted", formatted))))
    made = said.join(ends, key).select(key, "ln", F.inline(kinds))
    return made.where(F.col("value").isNotNull()).select(key, "kind", "ln", "value")


def first_wins(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return _edge(rows, F.min_by, order, keys)


def last_wins(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    return _edge(rows, F.max_by, order, keys)


def _edge(rows: DataFrame, pick, order: str, keys: tuple[str, ...]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(pick(F.struct(*others), order).alias("row"))
    return chosen.select(*keys, "row.*").select(*rows.columns)


def distinct_lines(rows: DataFrame, order: str = "ln", line: str = "line", *keys: str) -> DataFrame:
    """Of lines that differ in numbers only the first of each group stays; blank lines all stay."""
    marked = rows.withColumn("__k", line_key(F.col(line)))
    first = F.row_number().over(Window.partitionBy(*keys, "__k").orderBy(order))
    blank = marked.where("__k = ''")
    return marked.where("__k <> ''").withColumn("__n", first).where("__n = 1").drop("__n").unionByName(blank).drop("__k")
