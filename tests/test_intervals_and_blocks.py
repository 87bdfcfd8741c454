"""Interval joins against all pairs, orders by levels against a queue, and blocks of a listing by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocks, cfg, graph, intervals


def spans(rnd, n, names):
    """Intervals from single numbers to half of everything, negative ones and empty ones among them."""
    rows = []
    for i in range(n):
        lo = rnd.randrange(-(1 << rnd.choice([4, 10, 40])), 1 << rnd.choice([4, 10, 40]))
        rows.append((rnd.choice("pqr"), f"{names}{i}", lo, lo + rnd.choice([-1, 0, 1, 15, 16, 17, 127, 128, 5000, 1 << 35])))
    return rows


def test_interval_joins(spark):
    rnd = random.Random(8)
    left, right = spans(rnd, 150, "f") + [("p", "null", None, 5), (None, "no key", 0, 5)], spans(rnd, 150, "b")
    one = spark.createDataFrame(left, "program_id string, name string, lo long, hi long")
    two = spark.createDataFrame(right, "program_id string, block string, start long, end long")
    want = sorted((n, m) for p, n, a, b in left for q, m, c, d in right if a is not None and p == q and a <= b and c <= d and a <= d and c <= b)
    assert sorted((r.name, r.block) for r in intervals.overlaps(one, two, ("lo", "hi"), ("start", "end")).collect()) == want
    assert len(want) > 250
    got = intervals.holders(one.select("program_id", "name", "lo"), two, "lo", ("start", "end"))
    assert sorted((r.name, r.block) for r in got.collect()) == sorted((n, m) for p, n, a, _ in left for q, m, c, d in right if a is not None and p == q and c <= a <= d)
    none = two.limit(0)
    assert intervals.overlaps(one, none, ("lo", "hi"), ("start", "end")).count() == 0 and intervals.holders(one.select("program_id", "lo"), none, "lo", ("start", "end")).count() == 0


def test_intervals_are_dealt_by_address(spark):
    """Instructions of one program meet their blocks over many keys, without a window, and rows grow with the result."""
    n = 20_000
    code = spark.range(n).select(F.lit("p").alias("program_id"), (F.col("id") * 4).alias("address"), F.lit("nop").alias("mnemonic"))
    found = spark.range(n // 10).select(F.lit("p").alias("program_id"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 39).alias("end"))
    got = cfg.instructions_in_blocks(code, found)
    assert got.where("block_start = address - address % 40").count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "__bucket" in plan


def queue_order(rows):
    out = []
    for p in sorted({r[0] for r in rows}):
        calls = sorted((r[1:] for r in rows if r[0] == p), key=lambda r: (r[0], r[2]))
        left = {d: sum(c[2] == d for c in calls) for _, _, d in calls}
        first = {}
        for ln, src, _ in calls:
            first.setdefault(src, ln)
        queue = [(n, 0) for _, n in sorted((at, n) for n, at in first.items() if n not in left)]
        for node, level in queue:
            for _, src, dst in calls:
                if src == node:
                    left[dst] -= 1
                    if not left[dst]:
                        queue.append((dst, level + 1))
        out += [(p, n, level, i) for i, (n, level) in enumerate(queue, 1)]
    return sorted(out)


@pytest.mark.parametrize(("small", "rank_rows"), [(1 << 20, 1 << 20), (0, 5), (40, 1 << 20)])
def test_orders_by_levels_and_in_one_task(spark, small, rank_rows):
    """Programs above and below the size, rings and repeated calls among them; partitions of a few rows each."""
    rnd = random.Random(3)
    rows = []
    for p, n in (("a", 60), ("b", 30), ("c", 45)):
        for i in range(n):
            x, y = rnd.randint(0, 8), rnd.randint(0, 8)
            x, y = (min(x, y), max(x, y) + 1) if rnd.random() < 0.97 else (y, x)
            rows.append((p, i, f"n{x}", f"n{y}"))
    edges = spark.createDataFrame([*rows, (None, 1, "x", "y")], "program_id string, ln int, src string, dst string")
    got = graph.topological_order(edges, small=small, rank_rows=rank_rows)
    assert sorted(map(tuple, got.collect())) == queue_order(rows)


def test_a_chain_of_a_thousand_levels(spark):
    edges = spark.range(1000).select(F.lit("p").alias("program_id"), F.col("id").alias("ln"), F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    got = graph.topological_order(edges).agg(F.max("level"), F.max("pos"), F.count("*")).first()
    assert tuple(got) == (1000, 1001, 1001)


#: A function with a guard that ends in a call that never returns, one that jumps out of itself, and a stub.
LISTING = """prog:     file format elf64-x86-64

Disassembly of section .plt.sec:

0000000000001060 <__stack_chk_fail@plt>:
    1060:\tf3 0f 1e fa          \tendbr64
    1064:\tf2 ff 25 5d 2f 00 00 \tbnd jmp QWORD PTR [rip+0x2f5d]        # 3fc8 <x>
    106b:\t0f 1f 44 00 00       \tnop    DWORD PTR [rax+rax*1+0x0]

0000000000001169 <max>:
    1169:\t55                   \tpush   rbp
    116a:\t39 45 fc             \tcmp    DWORD PTR [rbp-0x4],eax
    116d:\t7e 02                \tjle    1171 <max+0x8>
    116f:\teb 03                \tjmp    1174 <max+0xb>
    1171:\t8b 45 f8             \tmov    eax,DWORD PTR [rbp-0x8]
    1174:\t5d                   \tpop    rbp
    1175:\tc3                   \tret

0000000000001498 <main>:
    1498:\te8 cc fc ff ff       \tcall   1169 <max>
    149d:\te8 cc fc ff ff       \tcall   1169 <max>
    14a2:\tff d0                \tcall   rax
    14a3:\t90                   \tmov    eax, 0x10
    14a4:\t74 05                \tje     14ab <main+0x13>
    14a6:\te8 b5 fb ff ff       \tcall   1060 <__stack_chk_fail@plt>
    14ab:\te8 00 00 00 00       \tcall   9000 <far>
    14b0:\tff e0                \tnotrack jmp rax
"""


def test_blocks_of_a_listing(spark):
    from lodestone.functions.text import numbered_lines

    rows = numbered_lines(spark.createDataFrame([("p", LISTING)], "program_id string, text string"), "text", "program_id")
    functions, found, code, flows = blocks.of_lines(rows)
    docs = {r.function_name: r for r in cfg.cfg_documents(functions, found, code, flows).collect()}
    shape = {n: [(b["id"], b["start"], [i["mnemonic"] for i in b["instructions"]]) for b in d.blocks] for n, d in docs.items()}
    assert shape["max"] == [("B0", "00001169", ["push", "cmp", "jle"]), ("B1", "0000116f", ["jmp"]), ("B2", "00001171", ["mov"]), ("B3", "00001174", ["pop", "ret"])]
    assert shape["main"] == [("B0", "00001498", ["call", "call", "call", "mov", "je"]), ("B1", "000014a6", ["call"]), ("B2", "000014ab", ["call", "jmp"])]
    arrows = {n: {(e["src"], e["dst"], e["type"]) for e in d.edges} for n, d in docs.items()}
    assert arrows["max"] == {("B0", "B2", "CONDITIONAL_JUMP"), ("B0", "B1", "FALL_THROUGH"), ("B1", "B3", "UNCONDITIONAL_JUMP"), ("B2", "B3", "FALL_THROUGH")}
    assert arrows["main"] == {("B0", "B2", "CONDITIONAL_JUMP"), ("B0", "B1", "FALL_THROUGH")}  # the guard's call never returns
    assert [i["ops"] for i in docs["max"].blocks[0]["instructions"]] == [["rbp"], ["DWORD PTR [rbp-0x4]", "eax"], ["1171 <max+0x8>"]]
    assert docs["main"].blocks[0]["instructions"][3]["ops"] == ["eax", "0x10"]
    calls = blocks.call_edges(code).orderBy("ln").collect()
    assert [(r.src, r.dst) for r in calls] == [("main", "max"), ("main", "__stack_chk_fail@plt"), ("main", "far")]
    assert blocks.of_lines(rows.limit(0))[1].count() == 0
