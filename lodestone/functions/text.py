"""Text primitives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, and the white space around a text.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
STRIP = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def lines(x: Column) -> Column:
    """Lines at any line end; a last line end begins no further line."""
    cut = F.split(F.regexp_replace(x, LINE_ENDS, "\n"), "\n", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def kept_lines(x: Column) -> Column:
    """Lines with their newline."""
    return F.regexp_extract_all(x, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))


def numbered_lines(df, text: str, *keys: str):
    """A row (keys, ln, line) for each line; ``ln`` counts from 0."""
    return df.select(*keys, F.posexplode(lines(F.col(text))).alias("ln", "line"))


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{Alnum}]", "_")


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def relative_to(path: Column, top: str) -> Column:
    return F.regexp_replace(path, "^" + quoted(top.rstrip("/")) + "/", "")


def quoted(x: str) -> str:
    """A regular expression that matches ``x``."""
    return r"\Q" + x.replace(r"\E", r"\E\\E\Q") + r"\E"


def hex_number(x: Column) -> Column:
    return F.conv(x, 16, 10).cast("decimal(20,0)")


def first_response_text(body: Column) -> Column:
    """The first assistant message's first output text of a response document."""
    kind = "struct<output:array<struct<type:string,role:string,content:array<struct<type:string,text:string>>>>>"
    said = F.filter(F.from_json(body, kind)["output"], lambda o: (o["type"] == "message") & (o["role"] == "assistant"))
    parts = F.filter(F.flatten(F.transform(said, lambda o: F.coalesce(o["content"], F.array()))), lambda c: c["type"] == "output_text")
    return F.coalesce(F.get(parts, F.lit(0))["text"], F.lit(""))


def strip_code_fence(x: Column) -> Column:
    """Without a fence at the very start and end; fences inside stay."""
    opened = F.regexp_replace(strip(x), r"^```[a-zA-Z0-9]*\s*", "")
    return strip(F.regexp_replace(opened, r"```$", ""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]
