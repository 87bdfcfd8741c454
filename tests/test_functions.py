"""Expressions against hand-derived cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import asm, csource, diagnostics, names, prompts, text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("line", "strict", "compatible"),
    [
        ("  401130:\t48 83 ec 08          \tsub    rsp,0x8", "sub    rsp,0x8", "sub    rsp,0x8"),
        ("  401144:\t48 83 c4 08          \tadd    rsp,0x8", "add    rsp,0x8", "rsp,0x8"),
        ("  40114a:\tff c8                \tdec    eax", "dec    eax", "eax"),
        ("  401136:\t00 00 00 ", None, "00"),
        ("  401148:\tc3                   \tret", "ret", "ret"),
        ("  401150:\t48 8d 05\tlea    rax,[rip+0xeac]        # 2004 <x>", "lea    rax,[rip+0xeac]", "lea    rax,[rip+0xeac]"),
        ("Disassembly of section .text:", None, None),
        ("", None, None),
    ],
)
def test_instruction(spark, line, strict, compatible):
    assert one(spark, line, lambda x: asm.instruction(x)) == strict
    assert one(spark, line, lambda x: asm.instruction(x, False)) == compatible


def test_headers(spark):
    plain, template, spaced = "0000000000001149 <main>:", "0000000000001200 <std::vector<int>::f()>:", "0000000000001200 <int foo<int>(int)>:"
    assert one(spark, plain, asm.header_name) == "main"
    assert one(spark, plain, asm.header_address) == "0000000000001149"
    assert one(spark, template, asm.header_name) == "std::vector<int>::f()"
    assert one(spark, template, lambda x: asm.header_name(x, False)) == "std::vector<int"
    assert one(spark, spaced, lambda x: asm.is_header(x, False)) is False
    assert one(spark, spaced, asm.header_name) == "int foo<int>(int)"


def test_clean_and_format(spark):
    listing = "junk\n\n0001 <f>:\n 1:\tc3 \tret # x\n\n0002 <g>:\n"
    assert one(spark, listing, asm.clean_assembly) == "0001 <f>:\nret\n0002 <g>:"
    got = spark.range(1).select(asm.format_function(F.lit("f"), F.lit("1"), F.array(F.lit("ret")))).first()[0]
    assert got == "<FUNC> f at 1\nret\n<END_FUNC>\n\n"


@pytest.mark.parametrize(
    ("name", "runtime"),
    [("_init", True), ("x@plt", True), ("frame_dummy_2", True), ("register_tm_clones", True), ("main", False), ("FUN_0010", False)],
)
def test_runtime_names(spark, name, runtime):
    assert one(spark, name, names.is_runtime_name) is runtime


def test_real_functions(spark):
    rows = spark.createDataFrame([("main", False, None), ("max", False, False), ("printf", False, True), ("t", True, False), ("FUN_1", False, False)], "n string, t boolean, e boolean")
    kept = rows.where(names.is_real_function(F.col("n"), F.col("t"), F.col("e")))
    assert [r.n for r in kept.collect()] == ["main", "max"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Compilation failed: /tmp/x/original.c: In function 'f':", None),
        ("/tmp/x/original.c:3:5: error: expected ';' before 'y'", ("/tmp/x/original.c", 3, 5, "error", "expected ';' before 'y'")),
        ("a.cpp:7:2: note: declared here", ("a.cpp", 7, 2, "note", "declared here")),
        ("a.c:1:10: fatal error: foo.h: No such file", (None, None, None, "error", "a.c:1:10: fatal error: foo.h: No such file")),
        ("x.h:4:1: warning: odd", (None, None, None, "warning", "x.h:4:1: warning: odd")),
        ("x.o: undefined reference to 'g'", None),
        ("collect2: error: ld returned 1 exit status", (None, None, None, "error", "collect2: error: ld returned 1 exit status")),
    ],
)
def test_parse_line(spark, line, want):
    got = one(spark, line, diagnostics.parse_line)
    assert (got and (got["file"], got["line"], got["column"], got["type"], got["message"])) == want


def test_format_for_prompt(spark):
    got = one(spark, "/tmp/x/original.c:3:5: error: bad\ncollect2: error: ld", diagnostics.format_for_prompt)
    assert got == "## Compilation Errors:\n\n1.  **/tmp/x/original.c:3:5** [ERROR] bad\n\n2.  [ERROR] collect2: error: ld"
    many = "\n".join(f"a.c:{i}:1: error: e" for i in range(1, 52))
    assert one(spark, many, lambda x: F.size(F.split(diagnostics.format_for_prompt(x), "\n\n"))) == 51
    assert one(spark, "nothing here", diagnostics.format_for_prompt) == "## Compilation Error:\nnothing here"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("expected ';' before 'y'", "[SYNTAX] expected ';' before 'y'"),
        ("'q' undeclared", "[UNDEFINED] 'q' undeclared"),
        ("undefined reference to g", "undefined reference to g"),
        ("invalid conversion from a to b", "[TYPE] invalid conversion from a to b"),
        ("incompatible types", "incompatible types"),
        ("'f' redeclared", "[REDEFINITION] 'f' redeclared"),
        ("error: foo", "error: foo"),
    ],
)
def test_categories(spark, line, want):
    assert one(spark, line, diagnostics.add_categories) == want


@pytest.mark.parametrize(
    ("message", "strict", "compatible"),
    [
        ("/tmp/ab1/original.c:3", "original.c:3", "original.c:3"),
        ("/usr/include/stdio.h:5", "stdio.h:5", "stdio.h:5"),
        ("src/a.cpp:1", "a.cpp:1", "a.cpp:1"),
        ("src/a.c:1", "a.c:1", "srca.c:1"),
    ],
)
def test_paths(spark, message, strict, compatible):
    assert one(spark, message, diagnostics.simplify_paths) == strict
    assert one(spark, message, lambda x: diagnostics.simplify_paths(x, False)) == compatible


def test_normalize(spark):
    assert one(spark, " \n", diagnostics.normalize) == one(spark, None, diagnostics.normalize) == "No error message provided"
    assert one(spark, "a.c:1:2: error: x\na.c:9:9: error: x\n\nb", diagnostics.remove_duplicate_lines) == "a.c:1:2: error: x\n\nb"
    assert one(spark, "x.c:1:2: e", diagnostics.remove_line_numbers) == "x.c: e"
    places = one(spark, "a.c:1:2: x b.cpp:3:4: y", diagnostics.locations)
    assert [tuple(p) for p in places] == [("a.c", 1, 2), ("b.cpp", 3, 4)]


def functions(spark, code):
    return {f["name"]: f["code"] for f in one(spark, code, csource.functions)}


def test_functions(spark):
    code = "#define N 1;\n\nstatic\nint f(int a)\n{\n  char *s = \"}\"; /* { */\n  if (a) { return 1; }\n}\n// about g\nvoid g(void) { f(2); }\nint g(int x) { return x; }\nint open() { {\n"
    got = functions(spark, code)
    assert list(got) == ["f", "g"]
    assert got["f"].startswith("static\nint f(int a)") and got["f"].endswith("}\n}")
    assert got["g"] == "// about g\nvoid g(void) { f(2); }"
    assert functions(spark, "int h(int (*p)(int)) { return 0; }") == {}
    assert functions(spark, "") == {}


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab\"'/*\\\n{} ", max_size=40))
def test_mask_keeps_offsets(spark, code):
    assert len(one(spark, code, csource.mask)) == len(code)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["#include <a>", "  struct s x;", "int a;", "", "#define X", "typedef int t;"]), max_size=8))
def test_header_and_source_are_all_lines(spark, lines):
    code = "".join(x + "\n" for x in lines)
    head, body = one(spark, code, csource.header_part), one(spark, code, csource.source_part)
    assert sorted((head + body).splitlines()) == sorted(code.splitlines())


@pytest.mark.parametrize(
    ("said", "want"),
    [(" ```c\nint x;\n``` ", "int x;"), ("int x;", "int x;"), ("a ```c\nb\n``` c", "a ```c\nb\n``` c"), ("", "")],
)
def test_code_fence(spark, said, want):
    assert one(spark, said, text.strip_code_fence) == want


def test_paths_of_files(spark):
    assert one(spark, "/a/b.tar.gz", text.stem) == "b.tar"
    assert one(spark, "/a/.foo", text.suffix) == ""
    assert one(spark, "/a/b/c.c", lambda x: text.relative_to(x, "/a")) == "b/c.c"
    assert one(spark, "00101169", text.hex_number) == 1053033
    assert one(spark, "a\r\nb\n", text.lines) == ["a", "b"]


def test_prompts(spark):
    e, c = F.lit(""), F.lit("c")
    short = spark.range(1).select(prompts.initial("L", F.lit("code"), F.lit("s"), e, e, c)).first()[0]
    assert short == "L\n\n```Language:c\nSummary:s\ncode\n```"
    full = spark.range(1).select(prompts.initial("L", F.lit("code"), F.lit("s"), F.lit("n"), F.lit("g"), c)).first()[0]
    assert full == short + "\n\nCaller and Callee Summary:\nn\n\nFunction SOG:\ng"


def test_response_pick(spark):
    body = '{"output":[{"type":"x"},{"type":"message","role":"assistant","content":[{"type":"output_text","text":"hi"}]}]}'
    assert one(spark, body, text.first_response_text) == "hi"
    assert one(spark, "not json", text.first_response_text) == ""


def test_long_literals_and_comments(spark):
    code = 'int f() { char *s = "' + "x\\\\" * 300_000 + '"; /*' + "y*" * 500_000 + "*/ char c = '" + "z" * 100_000 + "'; }"
    masked = one(spark, code, csource.mask)
    assert len(masked) == len(code) and masked.split() == ["int", "f()", "{", "char", "*s", "=", ";", "char", "c", "=", ";", "}"]


def test_many_functions_in_linear_time(spark):
    import time

    code = "".join(f"int f{i % 900}(int a)\n{{\n  if (a) {{ return {i}; }}\n  return a;\n}}\n\n" for i in range(1000))
    one(spark, code[:200], csource.functions)
    began = time.time()
    found = one(spark, code, csource.functions)
    assert time.time() - began < 6 and [f["name"] for f in found] == [f"f{i}" for i in range(900)]
    assert found[5]["code"].startswith("int f5(int a)") and found[5]["code"].endswith("return a;\n}")


@pytest.mark.parametrize("n", [1000, 4000, 16000])
def test_functions_and_lines_of_any_number(spark, n):
    """Time follows the text: what took seconds for a thousand must not take minutes for sixteen thousand."""
    import time

    code = "".join(f"/* {{ */ static int\nf{i}(int a)\n{{\n  if (a) {{ return \"}}\"[0]; }}\n}}\n\n" for i in range(n))
    message = "\n".join(f"a{'x' * (i % 97)}.c:{i}: error {i}" for i in range(n))
    one(spark, code[:200], csource.functions)
    began = time.time()
    found = one(spark, code, csource.functions)
    assert len(found) == n and found[-1]["name"] == f"f{n - 1}" and found[-1]["code"].startswith("/* { */ static int\n")
    assert len(one(spark, message, diagnostics.remove_duplicate_lines).split("\n")) == 97
    assert time.time() - began < 4 + n / 1000


def test_many_diagnostic_lines(spark):
    message = "\n".join(f"a.c:{i}: error: thing {'x' * (i % 50)}" for i in range(1000))
    assert len(one(spark, message, diagnostics.remove_duplicate_lines).split("\n")) == 50
