"""Control-flow relations: blocks of functions, instructions of blocks, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dealt, stored
from . import intervals


def flatten_operands(operands: Column) -> Column:
    """The objects of all operands as one list of strings."""
    return F.transform(F.flatten(operands), lambda x: x.cast("string"))


def blocks_of_functions(functions: DataFrame, blocks: DataFrame, program: str = "program_id") -> DataFrame:
    """Blocks whose closed interval meets the function's: all columns of both and ``block``, B0, B1, ... by start.

    ``functions``: program, name, lo, hi; ``blocks``: program, start, end (numbers). A block that meets two
    functions stands in both; functions without blocks, and blocks of none, have no row.
    """
    joined, n = intervals.counted_overlaps(functions, blocks, ("lo", "hi"), ("start", "end"), program)
    joined = dealt(joined, n, program, "name")
    number = F.row_number().over(Window.partitionBy(program, "name").orderBy("start", "end")) - 1
    return joined.withColumn("block", F.concat(F.lit("B"), number.cast("string")))


def instructions_in_blocks(instructions: DataFrame, blocks: DataFrame, program: str = "program_id") -> DataFrame:
    """Instructions with the start of the block that holds their address; those in no block go.

    Blocks of a program do not overlap. Instructions of one program are dealt to many tasks by address.
    """
    spans = blocks.select(program, F.col("start").alias("block_start"), F.col("end").alias("__end"))
    return intervals.holders(instructions, spans, "address", ("block_start", "__end"), program).select(*instructions.columns, "block_start")


def edges_of_blocks(function_blocks: DataFrame, destinations: DataFrame, program: str = "program_id") -> DataFrame:
    """(program, name, src, dst, type): flows between blocks of one function; flows that leave it or lead nowhere go.

    ``destinations``: program, src_start, dst_start, type.
    """
    return flows_of_functions(function_blocks, destinations, program).select(program, "name", "src", "dst", "type")


def flows_of_functions(function_blocks: DataFrame, destinations: DataFrame, program: str = "program_id", rows: int = 0) -> DataFrame:
    """``edges_of_blocks`` with where both ends start: (program, name, src, src_start, dst, dst_start, type).

    ``rows``: how many blocks there are, where that is known, so that many are dealt to more tasks.
    """
    at, to = [program, "src_start"], [program, "name", "dst_start"]
    b = function_blocks.select(program, "name", F.col("start").alias("src_start"), F.col("block").alias("src"))
    t = function_blocks.select(program, "name", F.col("start").alias("dst_start"), F.col("block").alias("dst"))
    known = destinations.where(F.col("dst_start").isNotNull())
    left = dealt(b, rows, *at).join(dealt(known, rows, *at), at)
    return dealt(left, rows, *to).join(dealt(t, rows, *to), to).select(program, "name", "src", "src_start", "dst", "dst_start", "type")


def _arrows() -> Column:
    """The edges among a function's ``held`` blocks, that begin at ``starts``, in order. Where several begin at one address, each is an end."""
    none, starts = F.array().cast("array<struct<to:bigint,type:string>>"), F.col("starts")
    said = lambda b, f, to: F.struct(b["id"].alias("src"), to.alias("dst"), f["type"].alias("type"))
    from_block = lambda each: F.flatten(F.transform("held", lambda b: F.flatten(F.transform(F.coalesce(b["flows"], none), lambda f: each(b, f)))))
    one = from_block(lambda b, f: F.transform(F.filter(F.array(F.array_position(starts, f["to"])), lambda i: i > 0), lambda i: said(b, f, F.concat(F.lit("B"), (i - 1).cast("string")))))
    every = from_block(lambda b, f: F.transform(F.filter("held", lambda t: t["start"] == f["to"]), lambda t: said(b, f, t["id"])))
    made = F.when(F.size(F.array_distinct(starts)) == F.size(starts), one).otherwise(every)
    return F.sort_array(made)


def _address(x: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(x)), 8, "0")


def listed_instructions(said: Column) -> Column:
    """Aggregate: a block's instructions by address, from (address, mnemonic, proto, ops)."""
    shown = lambda i: F.struct(_address(i["address"]).alias("address"), i["mnemonic"].alias("mnemonic"), i["proto"].alias("proto"), i["ops"].alias("ops"))
    return F.transform(F.sort_array(F.collect_list(said)), shown)


def _shown(listed: DataFrame, *others: str | Column) -> DataFrame:
    """``others``, ``blocks`` and ``edges`` of documents, from each function's ``held`` blocks by start: (start, ..., instructions, flows)."""
    number = F.transform("held", lambda b, i: F.struct(F.concat(F.lit("B"), i.cast("string")).alias("id"), b["start"].alias("start"), b["instructions"].alias("instructions"), b["flows"].alias("flows")))
    shown = F.transform("held", lambda b: F.struct(b["id"].alias("id"), _address(b["start"]).alias("start"), b["instructions"].alias("instructions")))
    starts = F.transform("held", lambda b: b["start"].cast("long"))  # a column, so that it is not made again for each flow
    return listed.withColumns({"held": number, "starts": starts}).select(*others, shown.alias("blocks"), _arrows().alias("edges"))


def documents_of_blocks(listed: DataFrame, program: str = "program_id") -> DataFrame:
    """``cfg_documents`` of functions that have their blocks: (program, name, lo, held), ``held`` as ``_shown`` takes it."""
    return _shown(listed, program, F.col("name").alias("function_name"), _address("lo").alias("entry"))


def cfg_documents(functions: DataFrame, blocks: DataFrame, instructions: DataFrame, destinations: DataFrame, program: str = "program_id") -> DataFrame:
    """(program, function_name, entry, blocks, edges): one nested document a function, functions without blocks too."""
    lines = instructions_in_blocks(instructions, blocks, program)
    per_block = lines.groupBy(program, F.col("block_start").alias("start")).agg(listed_instructions(F.struct("address", "mnemonic", "proto", "ops")).alias("instructions"))
    # what a block holds goes along when it meets its functions; then a function's blocks meet once
    flows = destinations.where(F.col("dst_start").isNotNull()).groupBy(program, F.col("src_start").alias("start"))
    flows = flows.agg(F.collect_list(F.struct(F.col("dst_start").cast("long").alias("to"), "type")).alias("flows"))
    held = blocks.select(program, "start", "end").join(per_block, [program, "start"], "left").join(flows, [program, "start"], "left")
    held = stored(held, "held")  # read for its levels, then joined; few blocks of many functions are broadcast
    # where blocks are broadcast, functions dealt before the join need no shuffle of all they meet after it
    parts = int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = functions.select(program, "name", "lo", "hi").repartition(parts, program, "name")
    owned = intervals.overlaps(dealt, held, ("lo", "hi"), ("start", "end"), program)
    none = F.array().cast("array<struct<address:string,mnemonic:string,proto:string,ops:array<string>>>")
    content = F.coalesce("instructions", none).alias("instructions")
    listed = owned.groupBy(program, "name").agg(F.array_sort(F.collect_list(F.struct("start", "end", content, "flows"))).alias("held"))
    listed = _shown(listed, program, "name")
    out = functions.select(program, "name", _address("lo").alias("entry")).join(listed, [program, "name"], "left")
    return out.select(
        program,
        F.col("name").alias("function_name"),
        "entry",
        F.coalesce("blocks", F.array().cast(listed.schema["blocks"].dataType)).alias("blocks"),
        F.coalesce("edges", F.array().cast(listed.schema["edges"].dataType)).alias("edges"),
    )
