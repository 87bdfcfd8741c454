"""Prompts as column expressions; the leading texts are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n\n"


def _section(title: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{NL}{title}:\n"), body)).otherwise("")


def initial(lead: str, code: Column, summary: Column, neighbours: Column, graph: Column, language: Column) -> Column:
    head = F.concat(F.lit(f"{lead}{NL}```Language:"), language, F.lit("\nSummary:"), summary, F.lit("\n"), code, F.lit("\n```"))
    return F.concat(head, _section("Caller and Callee Summary", neighbours), _section("Function SOG", graph))


def repair(lead: str, code: Column, errors: Column, summary: Column, neighbours: Column, graph: Column, language: Column) -> Column:
    head = F.concat(F.lit(f"{lead}{NL}```c\nLanguage:"), language, F.lit("\nSummary:"), summary, F.lit("\nCode:"), code, F.lit("\n```"))
    asked = F.concat(F.lit(f"{NL}Compilation Errors:\n"), errors, F.lit(f"{NL}Please provide the corrected C code."))
    return F.concat(head, asked, _section("Caller and Callee Summary", neighbours), _section("Function SOG", graph))


def summary(lead: str, asm: Column, code: Column) -> Column:
    """The code section, then the instructions, each only if there is one; ``asm`` is an array."""
    fenced = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit(f"{NL}Ghidra Code:\n```c\n"), code, F.lit("\n```"))).otherwise("")
    listed = F.array_join(F.coalesce(asm, F.array().cast("array<string>")), "\n")
    return F.concat(F.lit(lead), fenced, _section("Assembly Instructions", listed))
