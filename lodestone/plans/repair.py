"""The bounded generate, compile and repair loop, and the two programs built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics, prompts
from ..operators import enrich, graph
from ..sources.external import Compiler, Generator, generate
from ..storage import stored

MAX_ITERATIONS = 3
SYSTEM_PROMPT, REPAIR_PROMPT, SUMMARY_PROMPT = "Rewrite this function.", "Repair this code.", "Summarise this code."


def _compiled(rows: DataFrame, compiler, object_only: bool, is_cpp: bool) -> DataFrame:
    schema = rows.select("*", F.lit(True).alias("status"), F.lit("").alias("message")).schema

    def run(frames):
        for frame in frames:
            found = [compiler.compile(c, is_cpp, object_only, "O0") for c in frame["code"]]
            yield frame.assign(status=[f[0] for f in found], message=[f[1] for f in found])

    return rows.mapInPandas(run, schema)


def attempts(
    tasks: DataFrame,
    generator: Generator,
    compiler=None,
    keys: tuple[str, ...] = ("program_id", "f_name"),
    max_iterations: int = MAX_ITERATIONS,
    object_only: bool = True,
    language: str = "c",
    lead: str = SYSTEM_PROMPT,
    repair_lead: str = REPAIR_PROMPT,
) -> DataFrame:
    """(keys, attempt, prompt, code, status, message), a row for each attempt.

    ``tasks``: keys, c_code, summary, neighbours, graph. Attempt 0 answers the first prompt; each of up to
    ``max_iterations`` more repairs the last code with its diagnostics; a task ends when its code compiles.
    One pass a round over the tasks still open; each pass is stored, so no call is made again.
    """
    compiler = compiler or Compiler()
    words = F.lit(language)
    first = prompts.initial(lead, F.col("c_code"), F.col("summary"), F.col("neighbours"), F.col("graph"), words)
    kept = [*keys, "summary", "neighbours", "graph"]
    asked = tasks.select(*kept, F.lit(0).alias("attempt"), first.alias("prompt"))
    out = None
    for n in range(max_iterations + 1):
        done = stored(_compiled(generate(asked, generator, result="code"), compiler, object_only, language == "cpp"), "attempts")
        rows = done.select(*keys, "attempt", "prompt", "code", "status", "message")
        out = rows if out is None else out.unionByName(rows)
        left = done.where("not status")
        if n == max_iterations or left.isEmpty():
            break
        errors = diagnostics.format_for_prompt(F.col("message"))
        again = prompts.repair(repair_lead, F.col("code"), errors, F.col("summary"), F.col("neighbours"), F.col("graph"), words)
        asked = left.select(*kept, F.lit(n + 1).alias("attempt"), again.alias("prompt"))
    return out


def outcome(rows: DataFrame, keys: tuple[str, ...] = ("program_id", "f_name")) -> DataFrame:
    """(keys, optimization_status, optimized_code): the last attempt's."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("status", "code"), "attempt").alias("last"))
    return last.select(*keys, F.col("last.status").alias("optimization_status"), F.col("last.code").alias("optimized_code"))


def enrich_functions(records: DataFrame, generator: Generator, compiler=None, summary_lead: str = SUMMARY_PROMPT, **more) -> DataFrame:
    """Function records with a summary and repaired code; main keeps its code and is never sent to repair."""
    asked = records.withColumn("prompt", prompts.summary(summary_lead, F.col("asm"), F.col("ghidra_code")))
    full = stored(generate(asked, generator, result="function_summary").drop("prompt"), "summaries")
    tasks = full.where("f_name <> 'main'").select(
        "program_id", "f_name", F.col("ghidra_code").alias("c_code"), F.col("function_summary").alias("summary"), F.lit("").alias("neighbours"), F.col("sog_dot").alias("graph")
    )
    done = outcome(attempts(tasks, generator, compiler, **more))
    main = full.where("f_name = 'main'").select("program_id", "f_name", F.lit(True).alias("optimization_status"), F.col("ghidra_code").alias("optimized_code"))
    return full.join(done.unionByName(main), ["program_id", "f_name"])


def combine_programs(functions: DataFrame, edges: DataFrame, generator: Generator, compiler=None, summary_lead: str = SUMMARY_PROMPT, **more) -> DataFrame:
    """One record a program: its functions, summaries and the repaired whole, linked rather than compiled only."""
    none = F.array().cast("array<string>")
    code = enrich.program_code(functions)
    asked = code.withColumn("prompt", prompts.summary(summary_lead, none, F.col("code")))
    told = generate(asked, generator, result="program_summary").drop("prompt")
    told = stored(told.join(graph.context_summary(edges), "program_id", "left").withColumn("context", F.coalesce("context", F.lit(""))), "programs")
    tasks = told.select("program_id", F.col("code").alias("c_code"), F.col("program_summary").alias("summary"), F.col("context").alias("neighbours"), F.lit("").alias("graph"))
    keys = ("program_id",)
    done = outcome(attempts(tasks, generator, compiler, keys=keys, object_only=False, **more), keys)
    calls = graph.callees(edges).groupBy("program_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "callees"))).alias("callgraph"))
    return (
        told.select("program_id", "program_summary", F.col("context").alias("context_summary"))
        .join(enrich.nested(functions), "program_id")
        .join(calls, "program_id", "left")
        .join(done, "program_id")
        .withColumnRenamed("program_id", "executable_name")
    )
