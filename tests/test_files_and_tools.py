"""Files that sinks write, damaged inputs, and tools that are called once."""

import os

from pyspark.sql import functions as F

from lodestone.functions import asm
from lodestone.operators import graph
from lodestone.plans import programs
from lodestone.sources import files
from lodestone.sources.external import Compiler, StubCompiler, StubDecompiler, compile_directory, delivered
from tests.test_operators import LISTING, made


def test_compiled_files(spark, tmp_path):
    """A file at every level, one that may be run, and none left aside; a folder that cannot be made is a failure."""
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("int main(){}")
    (tmp_path / "src" / "b.cpp").write_text("bad")
    compiler = StubCompiler(lambda code: (code != "bad", "Compilation failed: x"), lambda code, level: f"{level} {code}".encode())
    for _ in range(2):
        done = compile_directory(spark, str(tmp_path / "src"), compiler, ("O0", "O2"), out=str(tmp_path / "out")).collect()
    assert {(os.path.basename(r.output_path), r.status) for r in done} == {("a_O0", True), ("a_O2", True), ("b_O0", False), ("b_O2", False)}
    assert sorted(os.listdir(tmp_path / "out")) == ["a_O0", "a_O2"] and (tmp_path / "out" / "a_O2").read_text() == "O2 int main(){}"
    assert os.access(tmp_path / "out" / "a_O0", os.X_OK)
    blocked = compile_directory(spark, str(tmp_path / "src"), compiler, ("O0",), out=str(tmp_path / "out" / "a_O0")).where("path like '%a.c'").first()
    assert not blocked.status and blocked.message.startswith("Compilation error: ")


def test_a_compiler_keeps_its_output(tmp_path):
    (tmp_path / "gcc").write_text('#!/bin/sh\nwhile [ "$1" != -o ]; do shift; done\necho made > "$2"\n')
    (tmp_path / "gcc").chmod(0o755)
    assert Compiler(c=str(tmp_path / "gcc")).build("int x;") == (True, "Compilation successful", b"made\n")
    delivered(b"1", str(tmp_path / "x" / "f"))
    delivered(b"2", f"file://{tmp_path}/x/f")
    assert os.listdir(tmp_path / "x") == ["f"] and (tmp_path / "x" / "f").read_bytes() == b"2"


def test_damaged_files_are_rows(spark, tmp_path):
    good = '{"function_name": "f", "entry": "0", "blocks": [], "edges": []}'
    (tmp_path / "_good.json").write_text(good)
    (tmp_path / "cut.json").write_text(good[:20])
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfe")
    (tmp_path / "list.json").write_text("[1, 2]")
    (tmp_path / "empty.json").write_text("")
    rows = files.cfg_documents(spark, str(tmp_path), "p")
    assert {r.stem: r.error is None for r in rows.collect()} == {"_good": True, "cut": False, "bytes": False, "list": False, "empty": False}
    kept = files.isolated(rows, str(tmp_path / "bad"))
    assert [(r.stem, r.parsed.function_name) for r in kept.collect()] == [("_good", "f")] and "error" not in kept.columns
    assert spark.read.json(str(tmp_path / "bad")).count() == 4


def test_damaged_lines(spark):
    dots = spark.createDataFrame([("{a} -> {b};",), ("{a} -> ;",), ("a -> b -> c",), ("}",)], "line string")
    assert [r.e is None for r in dots.select(graph.dot_error(F.col("line")).alias("e")).collect()] == [True, False, False, True]
    lines = ["  1000:\t55  \tpush   rbp", "  1000:\t00 00 00 ", "  1000: 55 push", "0010 <f>:", "0010 <f", "Disassembly of section .text:", ""]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(asm.line_error(F.col("line")).alias("e")).collect()
    assert [r.e for r in got] == [None, None, "damaged instruction", None, "damaged header", None, None]


def test_tools_are_called_once(spark, tmp_path):
    """Each tool sees each binary once for each kind, whatever is computed from its answers."""
    log = str(tmp_path / "calls")

    def noted(content, what):
        with open(log, "a") as f:
            f.write(f"{what}\n")
        return made(content, what)

    def listed(binaries):
        def run(frames):
            import pandas as pd

            for frame in frames:
                with open(log, "a") as f:
                    f.write("listing\n" * len(frame))
                yield pd.DataFrame({"program_id": frame["program_id"], "status": True, "text": LISTING})

        return binaries.select("program_id").mapInPandas(run, "program_id string, status boolean, text string")

    binaries = spark.createDataFrame([("p", bytearray(b"good")), ("q", bytearray(b"good"))], "program_id string, content binary")
    records, edges = programs.records(binaries, StubDecompiler(noted), listed)
    assert records.count() == 4 and edges.count() == 2 and records.where("f_name = 'main'").count() == 2
    with open(log) as f:
        assert sorted(f.read().split()) == ["calls"] * 2 + ["cfg"] * 2 + ["code"] * 2 + ["listing"] * 2


def test_the_first_code_of_a_name(spark):
    twice = StubDecompiler(lambda content, what: {"code": {"a": "int main(void)\n{\n  return 2;\n}\n", "b": "int main(void)\n{\n  return 1;\n}\n"}}.get(what) or made(b"good", what))
    listed = lambda df: df.select("program_id", F.lit(True).alias("status"), F.lit(LISTING).alias("text"))
    records, _ = programs.records(spark.createDataFrame([("p", bytearray(b"good"))], "program_id string, content binary"), twice, listed)
    assert "return 2" in records.where("f_name = 'main'").first().ghidra_code


def test_control_flow_files(spark, tmp_path):
    row = spark.createDataFrame([("p", "f", "0", [], [("B0", "B1", "FALL_THROUGH")])], f"program_id string, {files.CFG}")
    files.write_cfg(row, str(tmp_path / "cfg"))
    back = spark.read.schema(f"{files.CFG}, program_id STRING").json(str(tmp_path / "cfg")).first()
    assert (back.program_id, back.function_name, back.blocks, back.edges[0].type) == ("p", "f", [], "FALL_THROUGH")
