"""Operators on small relations, among them the call graph of a small compiled program."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import cfg, enrich, graph, listing
from lodestone.plans import repair
from lodestone.sources import files
from lodestone.sources.external import Compiler, StubCompiler, StubGenerator, available, clean_output, compile_all, compile_matrix, create_generator, disassemble

CALLS = "_init>__gmon_start__ _start>__libc_start_main knapsack>max knapsack>__stack_chk_fail main>knapsack main>printf main>__stack_chk_fail"


def edges(spark, calls):
    rows = [("p", i, *c.split(">")) for i, c in enumerate(calls.split())]
    return spark.createDataFrame(rows, "program_id string, ln int, src string, dst string")


def order(spark, calls):
    return [r.node for r in graph.topological_order(edges(spark, calls)).orderBy("pos").collect()]


def kahn(calls):
    pairs = [c.split(">") for c in calls.split()]
    nodes = list(dict.fromkeys(x for x, _ in pairs)) + [y for _, y in pairs]
    left = {n: sum(y == n for _, y in pairs) for n in nodes}
    queue, out = [n for n in dict.fromkeys(x for x, _ in pairs) if not left[n]], []
    while queue:
        out.append(now := queue.pop(0))
        for x, y in pairs:
            if x == now:
                left[y] -= 1
                if not left[y]:
                    queue.append(y)
    return out


@pytest.mark.parametrize("calls", [CALLS, CALLS + " max>knapsack", "main>m m>m m>merge", "a>b a>c a>b", "a>b c>b b>d"])
def test_topological_order(spark, calls):
    assert order(spark, calls) == kahn(calls)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=9))
def test_topological_order_of_any_graph(spark, pairs):
    calls = " ".join(f"n{a}>n{b}" for a, b in pairs)
    assert order(spark, calls) == kahn(calls)


def test_neighbours(spark):
    e = edges(spark, CALLS)
    callers = {r.dst: r.callers for r in graph.callers(e).collect()}
    callees = {r.src: r.callees for r in graph.callees(e).collect()}
    assert callers["__stack_chk_fail"] == ["knapsack", "main"]
    assert callees["main"] == ["knapsack", "printf", "__stack_chk_fail"] and "printf" not in callees
    assert {r.node: r.degree for r in graph.in_degree(e).collect()}["__stack_chk_fail"] == 2
    assert "main calls knapsack, printf, __stack_chk_fail\n" in graph.context_summary(e).first().context
    back = graph.edges_of_dot(graph.dot_of_edges(e).select("program_id", F.posexplode(F.split("dot", "\n")).alias("ln", "line")))
    assert [(r.src, r.dst) for r in back.orderBy("ln").collect()] == [(r.src, r.dst) for r in e.orderBy("ln").collect()]


def test_functions_of_a_listing(spark):
    raw = " 1:\t90 \tlost\n0001 <f>:\n 1:\t90 \tnop\n 2:\tc3 \tret\n0002 <g>:\n0003 <h>:\n 3:\tc3 \tret\n"
    rows = listing.extract_functions(spark.createDataFrame([("p", raw)], "program_id string, text string")).orderBy("segment").collect()
    assert [(r.name, r.instructions) for r in rows] == [("f", ["nop", "ret"]), ("g", []), ("h", ["ret"])]


def test_first_last_and_distinct(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in listing.first_wins(rows, "o", "k").collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in listing.last_wins(rows, "o", "k").collect()} == {("a", "y"), ("b", "z")}
    lines = spark.createDataFrame([(0, "a.c:1: x"), (1, "a.c:9: x"), (2, ""), (3, "")], "ln int, line string")
    once = listing.distinct_lines(lines)
    assert [r.ln for r in once.orderBy("ln").collect()] == [0, 2, 3]
    assert listing.distinct_lines(once).count() == 3


def program(spark):
    f = spark.createDataFrame([("p", "f", 0, 19), ("p", "g", 20, 29), ("p", "ext", 90, 90)], "program_id string, name string, lo long, hi long")
    b = spark.createDataFrame([("p", 0, 9), ("p", 10, 19), ("p", 20, 29)], "program_id string, start long, end long")
    i = spark.createDataFrame([("p", 0, "push", "", ["a"]), ("p", 12, "ret", "", []), ("p", 25, "nop", "", []), ("p", 50, "x", "", [])], "program_id string, address long, mnemonic string, proto string, ops array<string>")
    d = spark.createDataFrame([("p", 0, 10, "FALL_THROUGH"), ("p", 10, 20, "CALL"), ("p", 20, None, "RET")], "program_id string, src_start long, dst_start long, type string")
    return f, b, i, d


def test_blocks(spark):
    f, b, _, d = program(spark)
    owned = cfg.blocks_of_functions(f, b)
    assert {(r.name, r.block, r.start) for r in owned.collect()} == {("f", "B0", 0), ("f", "B1", 10), ("g", "B0", 20)}
    assert [(r.name, r.src, r.dst) for r in cfg.edges_of_blocks(owned, d).collect()] == [("f", "B0", "B1")]


def test_cfg_documents(spark, tmp_path):
    f, b, i, d = program(spark)
    assert {(r.address, r.block_start) for r in cfg.instructions_in_blocks(i, b).collect()} == {(0, 0), (12, 10), (25, 20)}
    docs = cfg.cfg_documents(f, b, i, d)
    found = {r.function_name: r for r in docs.collect()}
    assert [x["id"] for x in found["f"].blocks] == ["B0", "B1"] and found["ext"].blocks == [] and found["f"].entry == "00000000"
    assert found["f"].blocks[1]["instructions"][0]["mnemonic"] == "ret"
    for r in docs.select("function_name", F.to_json(F.struct(*[c for c in docs.columns if c != "program_id"])).alias("j")).collect():
        (tmp_path / f"_{r.function_name}.json").write_text(r.j)
    back = files.cfg_documents(spark, str(tmp_path), "p")
    assert {r.stem for r in back.collect()} == {"_f", "_g", "_ext"}
    assert back.select(F.explode("parsed.blocks")).count() == 3


def test_records_and_programs(spark):
    e = edges(spark, "main>f main>g f>g")
    topo = graph.topological_order(e)
    docs = spark.createDataFrame([("p", "main", "{}"), ("p", "f", "{}")], "program_id string, name string, document string")
    asm = spark.createDataFrame([("p", "f", 1, ["old"]), ("p", "f", 2, ["new"])], "program_id string, name string, segment int, instructions array<string>")
    code = spark.createDataFrame([("p", "main", "#include <a>\nint main() {}"), ("p", "f", "#include <a>\nint f;")], "program_id string, name string, code string")
    records = enrich.function_records(topo, docs, asm, code, e)
    rows = {r.f_name: r for r in records.collect()}
    assert set(rows) == {"main", "f"} and rows["f"].asm == ["new"] and rows["main"].asm == [] and rows["f"].callers == ["main"]
    whole = enrich.program_code(records.withColumnRenamed("ghidra_code", "optimized_code")).first().code
    assert whole == "#include <a>\n\n\nint f;\nint main() {}\n"

    seen = StubGenerator(lambda p: "int f;" if "Compilation Errors" in p else "int f")
    judge = StubCompiler(lambda c: (c.endswith(";"), "a.c:1:1: error: expected ';' before x"))
    full = repair.enrich_functions(records, seen, judge)
    done = {r.f_name: r for r in full.collect()}
    assert done["main"].optimized_code == "#include <a>\nint main() {}" and done["f"].optimized_code == "int f;"
    final = repair.combine_programs(full, e, seen, judge).first()
    assert final.optimization_status and final.callgraph["main"] == ["f", "g"] and len(final.functions) == 2


def test_attempts_end(spark):
    tasks = spark.createDataFrame([("p", "f", "c", "s", "", "")], "program_id string, f_name string, c_code string, summary string, neighbours string, graph string")
    never = repair.attempts(tasks, StubGenerator(lambda p: "x"), StubCompiler(lambda c: (False, "no")))
    assert sorted(r.attempt for r in never.collect()) == [0, 1, 2, 3]
    assert repair.outcome(never).first().optimization_status is False


def test_compilers(spark):
    if not available("gcc")["gcc"] or not Compiler().compile("int main(void) { return 0; }")[0]:
        pytest.skip("no compiler here")
    rows = spark.createDataFrame([("/s/a.c", "int main(){return 0;}", False), ("/s/b.c", "int main({", False)], "path string, code string, is_cpp boolean")
    got = {(r.path, r.opt_level): r for r in compile_all(compile_matrix(rows, ("O0", "O2")), Compiler()).collect()}
    assert got["/s/a.c", "O2"].status and not got["/s/b.c", "O0"].status and got["/s/b.c", "O0"].message.startswith("Compilation failed: ")
    bad = spark.createDataFrame([("x", bytearray(b"no binary"))], "program_id string, content binary")
    assert disassemble(bad).first().status is False


def test_generators():
    with pytest.raises(ValueError):
        create_generator("nobody")
    assert create_generator("OpenAI", "m", "k").url.endswith("/v1/chat/completions")
    silent = create_generator("ollama", "m", base_url="http://127.0.0.1:9")
    assert silent.generate("x") == ""
    assert clean_output("```c\nint x;\n```") == "int x;" and clean_output("a ``` b") == "a ``` b"


def test_sources(spark, tmp_path):
    for name in ("a.c", "b.cpp", "c.txt", "prog"):
        (tmp_path / name).write_text("x")
    assert {(r.path.rsplit("/", 1)[1], r.is_cpp) for r in files.sources(spark, str(tmp_path)).collect()} == {("a.c", False), ("b.cpp", True)}
    assert [r.program_id for r in files.executables(spark, str(tmp_path)).collect()] == ["prog"]


def test_streaming(spark, tmp_path):
    from lodestone.streaming import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.asm").write_text("0001 <f>:\n 1:\tc3 \tret\n")
    rows = arrivals.arriving_listings(spark, str(tmp_path / "in"))
    arrivals.functions_sink(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got.program_id, got.name, got.instructions) == ("p", "f", ["ret"])


LISTING = """
0000000000001000 <main>:
    1000:\t55                   \tpush   rbp
    1001:\tc3                   \tret

0000000000001010 <max>:
    1010:\t55                   \tpush   rbp
"""
C_CODE = "int max(int a)\n{\n  return a;\n}\n\nint main(void)\n{\n  return max(1);\n}\n"


def made(content, what):
    if content != b"good":
        return {}
    cfg_text = '{"function_name": "%s", "entry": "00001000", "blocks": [], "edges": []}'
    return {"code": {"binary": C_CODE}, "cfg": {n: cfg_text % n for n in ("main", "max")}, "calls": {"call_graph": "digraph g {\nmain -> max;\n}"}}[what]


def listed(binaries):
    return binaries.select("program_id", (F.col("content") == b"good").alias("status"), F.lit(LISTING).alias("text"))


def test_from_executables_to_program_texts(spark, tmp_path):
    """The whole way with stub tools; an executable whose tools fail is left out."""
    from lodestone.plans import programs
    from lodestone.sources.external import StubDecompiler

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "prog").write_bytes(b"good")
    (tmp_path / "in" / "broken").write_bytes(b"bad")
    (tmp_path / "in" / "notes.txt").write_bytes(b"good")
    answer = StubGenerator(lambda p: "int max(int a)\n{\n  return a + 0;\n}\n" if "max(1)" not in p else C_CODE)
    got = programs.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), StubDecompiler(made), answer, StubCompiler(), listed).collect()
    assert [r.executable_name for r in got] == ["prog"] and [f["f_name"] for f in got[0].functions] == ["main", "max"]
    assert got[0].functions[0]["asm"] == ["push   rbp", "ret"] and got[0].callgraph == {"main": ["max"]} and got[0].optimization_status
    texts = spark.read.text(str(tmp_path / "out" / "final_program_code"), wholetext=True).collect()
    assert [(r.value.strip(), r.executable_name) for r in texts] == [(got[0].optimized_code.strip(), "prog")]
    back = spark.read.json(str(tmp_path / "out" / "enriched_data")).collect()
    assert [r.executable_name for r in back] == ["prog"] and len(back[0].functions) == 2


def test_directories_of_binaries_and_sources(spark, tmp_path):
    from lodestone.sources.external import compile_directory, disassemble_directory, outcome_counts

    (tmp_path / "prog").write_bytes(b"good")
    (tmp_path / "a.c").write_text("int main(){}")
    (tmp_path / "b.cpp").write_text("bad")
    where = disassemble_directory(spark, str(tmp_path), str(tmp_path / "out"), cleaned=False, disassembler=listed)
    assert sorted(where) == ["formatted", "raw"]
    assert "<FUNC> main at " in spark.read.text(where["formatted"], wholetext=True).first().value
    (tmp_path / "prog").write_bytes(b"bad")
    assert disassemble_directory(spark, str(tmp_path), str(tmp_path / "none"), disassembler=listed) == {}
    compiler = StubCompiler(lambda code: (code != "bad", "Compilation failed: x"))
    done = compile_directory(spark, str(tmp_path), compiler, ("O0", "O2"))
    assert {(r.path.rsplit("/", 1)[1], r.opt_level, r.status, r.output_path) for r in done.collect()} == {
        ("a.c", "O0", True, "out/a_O0"), ("a.c", "O2", True, "out/a_O2"), ("b.cpp", "O0", False, "out/b_O0"), ("b.cpp", "O2", False, "out/b_O2")
    }
    assert {tuple(r) for r in outcome_counts(done).collect()} == {("O0", 2, 1, 1), ("O2", 2, 1, 1)}


def test_tools_on_the_path(spark, tmp_path, monkeypatch):
    """A compiler, a disassembler and a decompiler that are scripts: processes, failures and outputs as they come."""
    import os

    from lodestone.sources.external import Decompiler, decompile

    for name, text in {
        "gcc": 'grep -q bad "$1" && { echo "$1:1: error: bad" >&2; exit 1; }\nexit 0',
        "objdump": "echo listing of \"$@\"",
        "decomp": 'grep -q good "$1" || { echo no binary >&2; exit 1; }\necho "int f() { }" > "$2/f.c"',
    }.items():
        (tmp_path / name).write_text(f"#!/bin/sh\n{text}\n")
        (tmp_path / name).chmod(0o755)
    compiler = Compiler(c=str(tmp_path / "gcc"))
    assert compiler.compile("int x;") == (True, "Compilation successful")
    ok, message = compiler.compile("bad")
    assert not ok and message.startswith("Compilation failed: ") and "error: bad" in message
    assert not Compiler(c=str(tmp_path / "nowhere")).compile("x")[0]
    binaries = spark.createDataFrame([("p", bytearray(b"good")), ("q", bytearray(b"none"))], "program_id string, content binary")
    got = {r.program_id: r for r in disassemble(binaries, tool=str(tmp_path / "objdump")).collect()}
    assert got["p"].status and got["p"].text.startswith("listing of -d -M intel -C ")
    found = {r.program_id: r for r in decompile(binaries, Decompiler((str(tmp_path / "decomp"), "{binary}", "{out}"))).collect()}
    assert (found["p"].status, found["p"].stem, found["p"].text.strip()) == (True, "f", "int f() { }")
    assert not found["q"].status and "no binary" in found["q"].text
    assert not decompile(binaries, Decompiler((os.path.join(str(tmp_path), "nowhere"),))).where("status").count()


def test_logs_and_parameters(spark, tmp_path):
    from lodestone import logs

    log = logs.logger("lodestone-test", str(tmp_path))
    assert logs.logger("lodestone-test", str(tmp_path)) is log and len(log.handlers) == 2
    log.debug("whole")
    (file,) = tmp_path.glob("lodestone-test_????????_??????.log")
    assert "whole" in file.read_text()
    at = spark.sql("select timestamp '2024-03-05 06:07:08' as t").select(logs.stamp(F.col("t")).alias("s")).first().s
    assert at == "20240305_060708"
    (tmp_path / "p.json").write_text('{"a": 1}')
    assert logs.parameters(str(tmp_path / "p.json"), {"a": 0, "b": 2}) == {"a": 1, "b": 2}


def test_large_programs_stay_dealt(spark, monkeypatch):
    """No step of the order by levels brings a whole program into one task."""
    import re

    plans = []
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    stored, ranked = graph.stored, graph._ranked
    monkeypatch.setattr(graph, "stored", lambda df, what: note(df) or stored(df, what))
    monkeypatch.setattr(graph, "_ranked", lambda *a: (lambda df: note(df) or df)(ranked(*a)))
    monkeypatch.setattr(graph, "_by_levels", lambda edges, *a, f=graph._by_levels: note(edges) or f(edges, *a))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.range(40).selectExpr("'w' as program_id", "id as ln", "concat('n', id % 4) as src", "concat('m', id) as dst")
        assert graph.topological_order(edges, small=3, rank_rows=5).count() == 44
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    bare = r"hashpartitioning\(program_id#\d+, \d+\), ENSURE_REQUIREMENTS"
    rows = [x for p in plans for x in re.findall(rf"Exchange {bare}[^\n]*\n[^\n]*", p)]
    assert plans and not [x for x in rows if "Aggregate" not in x]


def test_documents_meet_blocks_once(spark):
    """Blocks are numbered and joined with their flows inside a function; two that begin at one address are both ends."""
    functions = spark.createDataFrame([("w", "f", 0, 99)], "program_id string, name string, lo long, hi long")
    found = spark.createDataFrame([("w", 0, 9), ("w", 10, 14), ("w", 10, 19)], "program_id string, start long, end long")
    code = spark.createDataFrame([("w", 3, "nop", "nop", ["a"])], "program_id string, address long, mnemonic string, proto string, ops array<string>")
    flows = spark.createDataFrame([("w", 0, 10, "X"), ("w", 10, 0, "Y"), ("w", 0, 77, "Z"), ("w", 0, None, "N")], "program_id string, src_start long, dst_start long, type string")
    made = cfg.cfg_documents(functions, found, code, flows)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    row = made.collect()[0]
    assert [(b.id, b.start, len(b.instructions)) for b in row.blocks] == [("B0", "00000000", 1), ("B1", "0000000a", 0), ("B2", "0000000a", 0)]
    assert [tuple(e) for e in row.edges] == [("B0", "B1", "X"), ("B0", "B2", "X"), ("B1", "B0", "Y"), ("B2", "B0", "Y")]
