"""Call graphs: edges, neighbours, degrees, topological order, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, removed, shared_folder, stored
from .listing import ordered_concat, ordered_list


def edges_of_dot(lines: DataFrame, line: str = "line") -> DataFrame:
    """Edges (all other columns, src, dst) of DOT lines that hold an arrow."""
    x = F.col(line)
    parts = F.split(F.regexp_replace(x, r"[{};]", ""), "->", -1)
    rest = [c for c in lines.columns if c != line]
    return lines.where(x.contains("->")).select(*rest, F.trim(F.get(parts, F.lit(0))).alias("src"), F.trim(F.get(parts, F.lit(1))).alias("dst"))


def dot_error(line: Column) -> Column:
    """Why a DOT line with an arrow is no edge of two names, or null."""
    parts = F.transform(F.split(F.regexp_replace(line, r"[{};]", ""), "->", -1), lambda x: F.trim(x))
    bad = (F.size(parts) != 2) | F.exists(parts, lambda x: x == "")
    return F.when(line.contains("->") & bad, "an arrow without two ends")


def callees(edges: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, src, callees, first_ln): repeated calls stay, in file order."""
    return edges.groupBy(key, "src").agg(ordered_list("ln", "dst").alias("callees"), F.min("ln").alias("first_ln"))


def callers(edges: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, dst, callers): distinct callers by the line on which they first call anything."""
    first = edges.groupBy(key, "src").agg(F.min("ln").alias("first_ln"))
    pairs = edges.select(key, "src", "dst").distinct().join(first, [key, "src"])
    return pairs.groupBy(key, "dst").agg(ordered_list("first_ln", "src").alias("callers"))


def in_degree(edges: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, node, degree) of every node, callers without callers too; repeated edges count."""
    ends = edges.select(key, F.col("src").alias("node"), F.lit(0).alias("n")).union(edges.select(key, "dst", F.lit(1)))
    return ends.groupBy(key, "node").agg(F.sum("n").alias("degree"))


#: Programs of up to so many calls are ordered in one task each; rows of a level that one task ranks.
SMALL_CALLS, RANK_ROWS = 1 << 20, 1 << 20


def topological_order(edges: DataFrame, key: str = "program_id", small: int = SMALL_CALLS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(key, node, level, pos): callers before callees in first-in first-out order, for all programs at once.

    A node comes after its last caller; nodes of one level are ordered by that caller's place and the
    line of the last call, then by name. Nodes on a cycle, and those that only such nodes lead to, have no
    place. ``edges`` has (key, ln, src, dst); a null line counts as the first.

    Programs of up to ``small`` calls are ordered in a task each, however long their chains are. Larger ones
    go level by level over all tasks; both ways give the same rows.
    """
    edges = edges.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col("ln").cast("long"), F.lit(-(2**63))).alias("ln"), "src", "dst")
    edges = stored(edges, "calls")
    large = edges.groupBy(key).count().where(F.col("count") > small).select(key)
    kind = edges.schema[key].dataType.simpleString()
    if large.isEmpty():
        return edges.groupBy(key).applyInPandas(_in_order(key), f"{key} {kind}, node string, level int, pos long")
    large = F.broadcast(large)  # few: each has more than ``small`` calls; a shuffle by key would bring each into one task
    rest = edges.join(large, key, "left_anti").groupBy(key).applyInPandas(_in_order(key), f"{key} {kind}, node string, level int, pos long")
    return rest.unionByName(_by_levels(edges.join(large, key, "left_semi"), key, rank_rows))


def _in_order(key: str):
    """The order of one program's calls by a queue of nodes without further callers."""

    def run(calls: pd.DataFrame) -> pd.DataFrame:
        calls = calls.sort_values(["ln", "dst"], kind="stable")
        left = calls["dst"].value_counts().to_dict()
        of = calls.groupby("src", sort=False)["dst"].agg(list).to_dict()
        first = calls.groupby("src")["ln"].min()
        queue = [(n, 0) for _, n in sorted((at, n) for n, at in first.items() if n not in left)]
        for node, level in queue:  # grows while it is read
            for to in of.get(node, ()):
                left[to] -= 1
                if not left[to]:
                    queue.append((to, level + 1))
        nodes, levels = [n for n, _ in queue], [n for _, n in queue]
        whose = [calls[key].iloc[0]] * len(queue)
        return pd.DataFrame({key: pd.Series(whose, dtype=object), "node": pd.Series(nodes, dtype=object), "level": levels, "pos": range(1, len(queue) + 1)})

    return run


def _by_levels(edges: DataFrame, key: str, rank_rows: int) -> DataFrame:
    """The order of large programs, a pass a level.

    A pass joins the nodes that were placed last with their calls and writes what has arrived at the nodes
    they call; a node whose arrivals of all passes are its in-degree is placed next. Written are one row for
    each call at most, the placed nodes, and the calls that are left whenever half of them are done.
    """
    spark = edges.sparkSession
    placed, arrivals = shared_folder(spark, "order"), shared_folder(spark, "arrivals")
    kind = edges.schema[key].dataType.simpleString()
    place = f"{key} {kind}, node string, level int, pos long"
    came = f"{key} {kind}, node string, many long, last struct<pos:long,ln:long>, degree long"
    table = lambda schema, *paths: spark.read.schema(schema).parquet(*paths)
    degree = edges.groupBy(key, "dst").agg(F.count("*").alias("degree"))
    calls = stored(edges.join(degree, [key, "dst"]), "calls")
    start = edges.groupBy(key, F.col("src").alias("node")).agg(F.min("ln").alias("ln")).join(degree.withColumnRenamed("dst", "node"), [key, "node"], "left_anti")
    ready, many = start.select(key, "node", F.struct(F.lit(0).cast("long").alias("pos"), "ln").alias("last")), calls.count()
    n, left, done, since = 0, many, 0, 0
    while True:
        before = table(place, f"{placed}/{n - 1}") if n else None
        _ranked(ready, key, n, 1 + many // rank_rows, before).write.parquet(f"{placed}/{n}")
        now = table(place, f"{placed}/{n}")
        reached = now.select(key, F.col("node").alias("src"), "pos").join(calls, [key, "src"]).groupBy(key, F.col("dst").alias("node"))
        reached.agg(F.count("*").alias("many"), F.max(F.struct("pos", "ln")).alias("last"), F.max("degree").alias("degree")).write.parquet(f"{arrivals}/{n}")
        arrived = table(came, f"{arrivals}/{n}")
        many, used = arrived.agg(F.count("*"), F.coalesce(F.sum("many"), F.lit(0))).first()
        if not many:
            break
        total = arrived
        if n:
            earlier = table(came, *(f"{arrivals}/{i}" for i in range(n))).join(arrived.select(key, "node"), [key, "node"])
            total = arrived.unionByName(earlier).groupBy(key, "node").agg(F.sum("many").alias("many"), F.max("last").alias("last"), F.max("degree").alias("degree"))
        ready = total.where(F.col("many") == F.col("degree")).select(key, "node", "last")
        n, done = n + 1, done + used
        if 2 * done > left:
            over = table(place, *(f"{placed}/{i}" for i in range(since, n))).select(key, F.col("node").alias("src"))
            fewer = stored(calls.join(over, [key, "src"], "left_anti"), "calls")
            dropped(calls)
            calls, left, done, since = fewer, left - done, 0, n
    dropped(calls)
    removed(spark, arrivals)
    return table(place, *(f"{placed}/{i}" for i in range(n + 1)))


def _ranked(rows: DataFrame, key: str, level: int, parts: int, before: DataFrame | None) -> DataFrame:
    """(key, node, level, pos): rows by their ``last`` caller, numbered in each program behind those placed ``before``.

    Rows are range-partitioned and sorted; a row's number is its place in its partition, the program's rows
    in partitions before it, and the last number given. Only sizes of partitions meet in a window.
    """
    order = [key, "last.pos", "last.ln", "node"]
    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.repartition(1)
    at = stored(dealt.sortWithinPartitions(*order).select(key, "node", F.monotonically_increasing_id().alias("at")), "ranks")
    part = F.shiftright("at", 33).alias("part")
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(key, part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = sizes.select(key, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    out = at.withColumn("part", part).join(F.broadcast(sizes), [key, "part"])
    if before is None:
        out = out.withColumn("base", F.lit(0))
    else:
        out = out.join(F.broadcast(before.groupBy(key).agg(F.max("pos").alias("base"))), key)
    return out.select(key, "node", F.lit(level).alias("level"), (F.col("base") + F.col("offset") + F.col("at") - F.col("first") + 1).cast("long").alias("pos"))


def context_summary(edges: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, context): one line a caller, in file order."""
    each = callees(edges, key)
    said = F.when(F.size("callees") > 0, F.array_join("callees", ", ")).otherwise("no functions")
    return each.groupBy(key).agg(ordered_concat(F.col("first_ln"), F.concat("src", F.lit(" calls "), said, F.lit("\n")), "").alias("context"))


#: The texts of DOT files.
CALLS_HEAD, CALL_LINE, DOT_END = "digraph CallGraph {\n", "{%s} -> {%s};\n", "}\n"
BLOCKS_HEAD = 'digraph G {\nlabelloc="t";\nlabel="Function: %s\nEntry: %s";\n'
BLOCK_LINE, FLOW_LINE = '"%s" [label="%s\\nend=%s\\nsize=%d\\nmnemonic=%s"];\n', '"%s" -> "%s";\n'


def dot_of_edges(edges: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, dot): the call graph as DOT text."""
    line = F.format_string(CALL_LINE, "src", "dst")
    body = ordered_concat(F.col("ln"), line, "")
    return edges.groupBy(key).agg(F.concat(F.lit(CALLS_HEAD), body, F.lit(DOT_END)).alias("dot"))


def block_dot(nodes: DataFrame, edges: DataFrame, key: str = "function_name") -> DataFrame:
    """(key, dot) with labelled nodes. ``nodes``: key, entry, start, end, size, mnemonic; ``edges``: key, src, dst.

    A missing size counts as 0, a missing mnemonic as empty.
    """
    label = F.format_string(
        BLOCK_LINE,
        "start", "start", "end", F.coalesce("size", F.lit(0)), F.coalesce("mnemonic", F.lit("")),
    )
    drawn = nodes.groupBy(key).agg(F.max("entry").alias("entry"), ordered_concat(F.col("start"), label, "").alias("nodes"))
    arrow = F.format_string(FLOW_LINE, "src", "dst")
    lines = edges.groupBy(key).agg(ordered_concat(F.struct("src", "dst"), arrow, "").alias("arrows"))
    head = F.format_string(BLOCKS_HEAD, key, "entry")
    return drawn.join(lines, key, "left").select(key, F.concat(head, "nodes", F.coalesce("arrows", F.lit("")), F.lit(DOT_END)).alias("dot"))
