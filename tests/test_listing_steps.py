"""Listings at size: how often their steps run, and how much of them a task holds."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions.text import numbered_lines
from lodestone.operators import blocks, cfg
from tests.test_intervals_and_blocks import LISTING


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(spark, programs=1):
    listings = spark.range(programs).select(F.concat(F.lit("p"), "id").alias("program_id"), F.lit(LISTING).alias("text"))
    return numbered_lines(listings, "text", "program_id")


def test_flows_come_from_stored_blocks(spark):
    """flows read the blocks once stored, and have both ends without asking for the blocks of functions again."""
    functions, found, _, flows = blocks.of_lines(lines_of(spark))
    assert "Window" not in plan(flows) and "Window" not in plan(found)
    owned = cfg.blocks_of_functions(functions, found)
    got = cfg.flows_of_functions(owned, flows).where("name = 'max'").collect()
    assert {(r.src, r.src_start, r.dst, r.dst_start) for r in got} == {("B0", 0x1169, "B2", 0x1171), ("B0", 0x1169, "B1", 0x116F), ("B1", 0x116F, "B3", 0x1174), ("B2", 0x1171, "B3", 0x1174)}


def test_lines_are_read_once(spark):
    """a function's name comes with its number, in one window without a join."""
    text = plan(blocks.instructions_of_lines(lines_of(spark)))
    assert text.count("RunningWindowFunction") + text.count("Window [") <= 2 and "Join" not in text


@pytest.mark.parametrize("rows", [10, 1 << 19])
def test_what_a_task_holds_does_not_grow(spark, monkeypatch, rows):
    """F8: lines, calls and functions are dealt to more tasks where there are more, with the same rows."""
    monkeypatch.setattr(storage, "TASK_ROWS", rows)
    code = blocks.instructions_of_lines(lines_of(spark, 30))
    calls = blocks.call_edges(code)
    got = calls.groupBy("program_id").agg(F.sort_array(F.collect_set(F.concat_ws(">", "src", "dst"))).alias("calls")).collect()
    assert len(got) == 30 and all(r.calls == ["main>__stack_chk_fail@plt", "main>far", "main>max"] for r in got)
    parts = code.rdd.getNumPartitions()
    assert parts > 30 if rows == 10 else parts <= 4


def test_a_task_holds_few_rows(spark):
    """F8: two million rows are sixteen tasks' work, more than there are cores here."""
    assert storage.dealt(spark.range(10), 1 << 21, "id").rdd.getNumPartitions() == 16


def test_blocks_without_texts(spark):
    """blocks, flows and functions are the same when no instruction's text is stored."""
    whole, slim = blocks.of_lines(lines_of(spark)), blocks.of_lines(lines_of(spark), texts=False)
    assert set(whole[2].columns) - set(slim[2].columns) == {"proto", "ops"}
    for a, b in zip(whole, slim, strict=True):
        got = [sorted(map(str, x.select(*b.columns).collect())) for x in (a, b)]
        assert got[0] and got[0] == got[1]


def test_words_of_instructions(spark):
    """Prefixes, tabs, comments, operands and targets are told as the patterns say."""
    said = ["rep stos QWORD PTR es:[rdi],rax", "lock", "bnd\tjmp\t1170 <f+0x4>  # x", "call 0x1200 <a::b<c>", "jmpq *%rax", "add  eax , , 1", "je 10 <g+1>", "loop 20", "jmp 123456789abcdef01 <h>"]
    text = "0000 <f>:\n" + "\n".join(f" \t{0x1160 + i:x}:\t48 89 e5 9 \t{s}" for i, s in enumerate(said)) + "\n 1170:\t00 00 \n"
    rows = numbered_lines(spark.createDataFrame([("p", text), (None, text)], "program_id string, text string"), "text", "program_id")
    got = [(r.address, r.size, r.mnemonic, r.ops, r.target, r.label) for r in blocks.instructions_of_lines(rows).orderBy("ln").collect()]
    assert [g[:2] for g in got] == [(0x1160 + i, 3) for i in range(len(said))]
    assert [g[2:] for g in got] == [
        ("stos", ["QWORD PTR es:[rdi]", "rax"], None, None), ("lock", [], None, None), ("jmp", ["1170 <f+0x4>"], 0x1170, "f"), ("call", ["0x1200 <a::b<c>"], 0x1200, "a::b<c"),
        ("jmpq", ["*%rax"], None, None), ("add", ["eax", "1"], None, None), ("je", ["10 <g+1>"], None, None), ("loop", ["20"], 0x20, None), ("jmp", ["123456789abcdef01 <h>"], None, "h"),
    ]


@pytest.mark.parametrize("rows", [7, 1 << 19])
def test_renderings_without_whole_listings(spark, tmp_path, monkeypatch, rows):
    """files of several tasks, in order, have the digests of whole renderings; odd listings among them."""
    import hashlib

    from lodestone.operators import listing
    from lodestone.sources import files
    from lodestone.sources.external import renderings

    monkeypatch.setattr(files, "TASK_ROWS", rows)
    texts = {"p": LISTING.rstrip("\n"), "a=b c": LISTING + "\n0000 <last>:\n\nend", "none": "no function\n", "early": "  1060:\tf3 0f \tnop\n\n0010 <f>:", "blank": "x"}
    binaries = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()], "program_id string, content binary")
    listed = binaries.select("program_id", F.lit(True).alias("status"), F.col("content").cast("string").alias("text"))
    want = {(r.program_id, k): hashlib.sha256(r[k].rstrip("\n").encode() if k == "raw" else r[k].encode()).hexdigest() for r in renderings(binaries, lambda _: listed).collect() for k in ("raw", "cleaned", "formatted")}
    folder = f"file://{tmp_path}/out"
    files.write_rendered(listing.rendered_lines(numbered_lines(listed, "text", "program_id")), folder)
    assert {(r.program_id, r.kind): r.digest for r in files.rendered_digests(spark, folder).collect()} == want
    written = [f for _, _, names in os.walk(tmp_path / "out") for f in names if f.startswith("part-")]
    assert len(written) > 20 if rows == 7 else len(written) == 15


def keyed(documents):
    return sorted((r.program_id, r.function_name, r.entry, str(r.blocks), str(r.edges)) for r in documents.collect())


@pytest.mark.parametrize("rows", [10, 1 << 19])
def test_documents_of_lines(spark, monkeypatch, rows):
    """documents made where a function's instructions meet are those of the interval joins, dealt to more tasks where there are more."""
    monkeypatch.setattr(storage, "TASK_ROWS", rows)
    made = blocks.documents_of_lines(lines_of(spark, 12))
    assert keyed(made) == keyed(cfg.cfg_documents(*blocks.of_lines(lines_of(spark, 12)))) and made.count() == 36
    parts = made.rdd.getNumPartitions()
    assert parts > 12 if rows == 10 else parts <= 4


def test_documents_keep_little_on_disk(spark):
    """whole instructions are shuffled once after they are stored, and of all that was stored only they are left."""
    storage.stored(spark.range(1), "first")
    folder = os.path.dirname(storage.shared_folder(spark, "next")).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    made = blocks.documents_of_lines(lines_of(spark))
    made.write.format("noop").mode("overwrite").save()
    assert sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before) == ["aimed", "instructions"]
    text = plan(made).split("== Initial Plan ==")[-1]
    assert text.count("Exchange") == 1 and "Join" not in text


def test_documents_of_odd_listings(spark):
    """functions of one name, addresses that repeat or are too long for a number, jumps into other functions and into nothing."""
    said = [
        "0010 <f>:", "  10:\t90 \tnop", "  11:\t75 00 \tjne    20 <g>", "  13:\t90 \tnop", "  13:\t91 \txchg   eax,ecx", "", "0020 <g>:", "  20:\t90 \tnop", "  21:\teb 00 \tjmp    13 <f+0x3>",
        "  23:\teb 00 \tjmp    99 <h>", "0030 <f>:", "  30:\t74 00 \tje     32 <f+0x2>", "  32:\tc3 \tret", "0040 <empty>:", "0050 <far>:", "  123456789abcdef01:\tc3 \tret",
    ]
    got = blocks.documents_of_lines(numbered_lines(spark.createDataFrame([("p", "\n".join(said)), (None, said[0])], "program_id string, text string"), "text", "program_id"))
    shape = sorted((r.function_name, r.entry, [(b["start"], [i["proto"] for i in b["instructions"]]) for b in r.blocks], [(e["src"], e["dst"], e["type"]) for e in r.edges]) for r in got.collect() if r.entry)
    assert shape == [
        ("f", "00000010", [("00000010", ["nop", "jne    20 <g>"]), ("00000013", ["nop", "xchg   eax,ecx"])], [("B0", "B1", "FALL_THROUGH")]),
        ("f", "00000030", [("00000030", ["je     32 <f+0x2>"]), ("00000032", ["ret"])], [("B0", "B1", "CONDITIONAL_JUMP"), ("B0", "B1", "FALL_THROUGH")]),
        ("g", "00000020", [("00000020", ["nop", "jmp    13 <f+0x3>"]), ("00000023", ["jmp    99 <h>"])], []),
    ]
    assert [(r.function_name, r.blocks, r.edges) for r in got.collect() if not r.entry] == [("far", [], [])]
