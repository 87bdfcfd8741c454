"""From executables to repaired program texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import csource
from ..operators import enrich, graph, listing
from ..sources import files
from ..sources.external import Generator, decompile, disassemble
from ..storage import stored
from . import repair


def records(binaries: DataFrame, decompiler, disassembler=disassemble) -> tuple[DataFrame, DataFrame]:
    """(function records, call edges) of binaries (program_id, content); programs whose parts fail have fewer records.

    What the tools say is stored, so each is called once for a binary and kind, whatever is computed from it.
    Where several files of a binary have a function of one name, the first by file name and place counts.
    """
    binaries = stored(binaries.select("program_id", "content"), "binaries")
    listed = stored(disassembler(binaries), "listings").where("status").select("program_id", "text")
    asm = listing.extract_functions(listed)
    code = stored(decompile(binaries, decompiler, "code"), "decompiled").where("status")
    parts = code.select("program_id", "stem", F.posexplode(csource.functions(F.col("text"))).alias("place", "f"))
    named = parts.select("program_id", F.col("f.name").alias("name"), F.col("f.code").alias("code"), F.struct("stem", "place").alias("at"))
    decompiled = listing.first_wins(named, "at", "program_id", "name").drop("at")
    cfg = stored(decompile(binaries, decompiler, "cfg"), "documents").where("status")
    cfg = cfg.select("program_id", F.col("stem").alias("name"), F.col("text").alias("document"))
    dots = stored(decompile(binaries, decompiler, "calls"), "graphs").where("status and stem = 'call_graph'")
    lines = dots.select("program_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    edges = stored(graph.edges_of_dot(lines), "calls")
    order = graph.topological_order(edges)
    return enrich.function_records(order, cfg, asm, decompiled, edges), edges


def run(spark: SparkSession, folder: str, out: str, decompiler, generator: Generator, compiler=None, disassembler=disassemble, **more) -> DataFrame:
    """One record for each executable below a folder, written with its final text to ``out``.

    Executables are disassembled and decompiled, their functions enriched and repaired, and joined again to
    whole programs. An executable whose tools fail, or whose functions have no control-flow document, is left out.
    """
    functions, edges = records(files.executables(spark, folder), decompiler, disassembler)
    enriched = stored(repair.enrich_functions(functions, generator, compiler, **more), "enriched")
    programs = stored(repair.combine_programs(enriched, edges, generator, compiler, **more), "combined")
    files.write_program(programs, out)
    return programs
