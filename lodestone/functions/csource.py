"""C sources as column expressions: masking, function extraction, headers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import kept_lines

#: Literals and comments, function heads, words that are no function names, header lines.
LITERALS = r"""(?sm)//.*?$|/\*.*?\*/|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""
HEAD = r"\b([A-Za-z_][A-Za-z0-9_]*)[ \t\n\x0b\f\r]*\([^;{)]*\)[ \t\n\x0b\f\r]*\{"
BLANKS = " \t\n\x0b\f\r"
KEYWORDS = (
    "break", "case", "continue", "default", "do", "else", "enum", "for", "goto", "if", "return", "sizeof", "struct", "switch", "typedef", "union", "while",
)
HEADER_LINE = r"^\s*(?:#include|typedef|struct|enum)"
LOOK_BACK = 3
_HEAD = re.compile(HEAD)


def mask(code: Column) -> Column:
    """Comments, strings and characters as blanks; every offset stays."""
    gaps = F.split(code, LITERALS, -1)
    blanks = F.transform(F.regexp_extract_all(code, F.lit(LITERALS), F.lit(0)), lambda x: F.repeat(F.lit(" "), F.length(x)))
    return F.array_join(F.zip_with(gaps, blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


def _closing(masked: str) -> dict[int, int]:
    """Where each opening brace that closes does so."""
    out, stack = {}, []
    for brace in re.finditer("[{}]", masked):
        if brace[0] == "{":
            stack.append(brace.start())
        elif stack:
            out[stack.pop()] = brace.start()
    return out


def _begin(code: str, at: int) -> int:
    """Where the signature begins: its line, and up to three lines above that end no statement and are not blank."""
    begin = code.rfind("\n", 0, at) + 1
    for _ in range(LOOK_BACK):
        above = code.rfind("\n", 0, max(begin - 1, 0)) + 1
        line = code[above : max(begin - 1, 0)].strip(BLANKS)
        if not begin or not line or line[-1] in ";}":
            break
        begin = above
    return begin


def _functions_of(code: str, masked: str) -> list[dict]:
    closing, found = _closing(masked), {}
    for head in _HEAD.finditer(masked):
        close = closing.get(head.end() - 1)
        if head[1] not in KEYWORDS and close is not None and head[1] not in found:
            begin = _begin(code, head.start())
            found[head[1]] = {"name": head[1], "code": code[begin : close + 1], "at": begin}
    return list(found.values())


def _batch(code: pd.Series, masked: pd.Series) -> pd.Series:
    found = [_functions_of(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(code, masked, strict=True)]
    return pd.Series(found, dtype=object)


def functions(code: Column) -> Column:
    """array(struct(name, code, at)) of the functions of a source, the first of each name, in order.

    Heads are sought with comments and literals masked; control words are no names, and a function
    whose braces never close is left out. Braces are paired by a stack, which built-in functions have only
    as arrays that are copied at every step, so this one step is a batch function; it is linear in the text.
    """
    made = F.pandas_udf(_batch, "array<struct<name:string,code:string,at:int>>")
    return made(code, mask(code))


def header_part(code: Column) -> Column:
    """The lines that begin with an include or a type; only those lines move, bodies stay."""
    return F.array_join(F.filter(kept_lines(code), lambda x: x.rlike(HEADER_LINE)), "")


def source_part(code: Column) -> Column:
    return F.array_join(F.filter(kept_lines(code), lambda x: ~x.rlike(HEADER_LINE)), "")
