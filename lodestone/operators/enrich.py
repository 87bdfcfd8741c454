"""Function records and whole programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import csource
from . import graph
from .listing import last_wins, ordered_concat


def function_records(
    order: DataFrame, cfg: DataFrame, asm: DataFrame, decompiled: DataFrame, edges: DataFrame, key: str = "program_id"
) -> DataFrame:
    """(key, pos, f_name, asm, ghidra_code, sog_dot, callers, callees) of ordered functions that have a CFG document.

    ``order``: key, node, pos; ``cfg``: key, name, document; ``asm``: key, name, segment, instructions;
    ``decompiled``: key, name, code. A missing listing is an empty list, missing code an empty text.
    """
    documents = cfg.select(key, F.col("name").alias("f_name"), F.col("document").alias("sog_dot"))
    kept = order.select(key, "pos", F.col("node").alias("f_name")).join(documents, [key, "f_name"])
    listing = last_wins(asm.select(key, "name", "segment", "instructions"), "segment", key, "name")
    listing = listing.select(key, F.col("name").alias("f_name"), F.col("instructions").alias("asm"))
    code = decompiled.select(key, F.col("name").alias("f_name"), F.col("code").alias("ghidra_code"))
    to = graph.callers(edges, key).withColumnRenamed("dst", "f_name")
    of = graph.callees(edges, key).select(key, F.col("src").alias("f_name"), "callees")
    out = kept
    for side in (listing, code, to, of):
        out = out.join(side, [key, "f_name"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        key,
        "pos",
        "f_name",
        F.coalesce("asm", none).alias("asm"),
        F.coalesce("ghidra_code", F.lit("")).alias("ghidra_code"),
        "sog_dot",
        F.coalesce("callers", none).alias("callers"),
        F.coalesce("callees", none).alias("callees"),
    )


def program_code(functions: DataFrame, key: str = "program_id", name: str = "f_name", code: str = "optimized_code", order: str = "pos") -> DataFrame:
    """(key, code): distinct header blocks, an empty line, then the functions' sources with main last.

    Header blocks are compared as wholes and each stands where it is first seen. Main's is added if it is new.
    """
    parts = functions.select(
        key,
        (F.col(name) == "main").alias("main"),
        order,
        csource.header_part(F.col(code)).alias("header"),
        csource.source_part(F.col(code)).alias("source"),
    )
    seen = F.row_number().over(Window.partitionBy(key, "header").orderBy("main", order))
    place = F.struct("main", order)
    body = parts.withColumn("seen", seen).groupBy(key).agg(
        ordered_concat(place, F.when(F.col("seen") == 1, F.concat("header", F.lit("\n"))).otherwise(""), "").alias("headers"),
        ordered_concat(place, F.concat("source", F.lit("\n")), "").alias("sources"),
    )
    return body.select(key, F.concat("headers", F.lit("\n"), "sources").alias("code"))


def nested(functions: DataFrame, key: str = "program_id", order: str = "pos") -> DataFrame:
    """(key, functions): the records of each program as one ordered list."""
    others: list[Column] = [F.col(c) for c in functions.columns if c not in (key, order)]
    rows = F.array_sort(F.collect_list(F.struct(order, F.struct(*others).alias("f"))), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))
    return functions.groupBy(key).agg(F.transform(rows, lambda x: x["f"]).alias("functions"))
