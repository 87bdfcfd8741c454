"""Disassembly listings as column expressions.

``strict`` reads the tab-separated layout and keeps template names and mnemonics such as ``add`` whole;
the compatible patterns take any white space and so lose mnemonics made of hexadecimal letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, strip

#: Layouts of header and instruction lines.
HEADER = r"^\s*([0-9a-fA-F]+)\s+<([^>]+)>:"
HEADER_STRICT = r"^\s*([0-9a-fA-F]+)\s+<(.+)>:\s*$"
INSTRUCTION = r"^\s*([0-9a-fA-F]+):\s+([0-9a-fA-F\s]+)\s+(.+)$"
INSTRUCTION_STRICT = r"^\s*([0-9a-fA-F]+):\t([0-9a-fA-F ]+)\t(.+)$"
COMMENT = r"#.*$"
WHITE = " \t\n\x0b\f\r"


def _header(strict: bool) -> str:
    return HEADER_STRICT if strict else HEADER


def is_header(line: Column, strict: bool = True) -> Column:
    return line.rlike(_header(strict))


def header_address(line: Column, strict: bool = True) -> Column:
    return F.nullif(F.regexp_extract(line, _header(strict), 1), F.lit(""))


def header_name(line: Column, strict: bool = True) -> Column:
    return F.nullif(F.regexp_extract(line, _header(strict), 2), F.lit(""))


def strip_comment(x: Column) -> Column:
    return strip(F.regexp_replace(x, COMMENT, ""))


def instruction(line: Column, strict: bool = True) -> Column:
    """The instruction without its comment; null if the line holds none."""
    return said(F.regexp_extract(line, INSTRUCTION_STRICT if strict else INSTRUCTION, 3))


def said(found: Column) -> Column:
    """``strip_comment`` of an instruction's part of a line, null for none; it has no line ends, so plain functions will do."""
    return F.nullif(F.btrim(F.substring_index(found, "#", 1), F.lit(WHITE)), F.lit(""))


def line_error(line: Column, strict: bool = True) -> Column:
    """Why a line that begins like an instruction or a header is none, or null."""
    begun = line.rlike(r"^\s*[0-9a-fA-F]+:") & ~line.rlike(INSTRUCTION_STRICT if strict else INSTRUCTION) & ~line.rlike(r"^\s*[0-9a-fA-F]+:\t[0-9a-fA-F ]+$")
    return F.when(begun, "damaged instruction").when(line.rlike(r"^[0-9a-fA-F]+\s+<") & ~is_header(line, strict), "damaged header")


def clean_line(line: Column, strict: bool = True) -> Column:
    head = F.concat(header_address(line, strict), F.lit(" <"), header_name(line, strict), F.lit(">:"))
    return F.when(is_header(line, strict), head).otherwise(instruction(line, strict))


def clean_assembly(text: Column, strict: bool = True) -> Column:
    """Headers and instructions only, one a line."""
    return F.array_join(F.filter(F.transform(lines(text), lambda x: clean_line(x, strict)), lambda x: x.isNotNull()), "\n")


def format_function(name: Column, address: Column, instructions: Column) -> Column:
    head = F.concat(F.lit("<FUNC> "), name, F.lit(" at "), address)
    return F.array_join(F.concat(F.array(head), instructions, F.array(F.lit("<END_FUNC>\n"), F.lit(""))), "\n")
