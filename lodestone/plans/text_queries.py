"""Queries on listings, C sources and diagnostics; their texts are built from table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import asm, csource, diagnostics, text
from ..operators import enrich, listing
from .registry import Tables, query

# listings: every fourth line of an order is a header, an instruction, one with a comment, or neither


def _listing_lines(t: Tables) -> DataFrame:
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    at = F.lower(F.hex(key))
    kind = (key + n) % 4
    line = (
        F.when(kind == 0, F.format_string("%s <fn_%d>:", F.lpad(at, 16, "0"), "l_partkey"))
        .when(kind == 1, F.format_string("  %s:\t48 83 ec 08          \tsub    rsp,0x%d", at, n))
        .when(kind == 2, F.format_string("  %s:\t48 83 c4 08          \tadd    rsp,0x%d        # part %d", at, n, "l_partkey"))
        .otherwise(F.lit("Disassembly of section .text:"))
    )
    return t.lineitem.select(key.alias("program_id"), n.alias("ln"), "l_partkey", line.alias("line"))


_LINES = """l AS (SELECT l_orderkey AS program_id, l_linenumber AS ln, l_partkey, (l_orderkey + l_linenumber) % 4 AS kind, lower(to_hex(l_orderkey)) AS addr FROM lineitem)"""


@query(f"WITH {_LINES} SELECT program_id, ln, lpad(addr, 16, '0') AS address, 'fn_' || l_partkey AS name FROM l WHERE kind = 0")
def asm_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address and name of header lines."""
    rows, x = _listing_lines(Tables(spark, sf_dir)), F.col("line")
    return rows.where(asm.is_header(x)).select("program_id", "ln", asm.header_address(x).alias("address"), asm.header_name(x).alias("name"))


@query(f"""WITH {_LINES} SELECT program_id, ln, CASE kind WHEN 1 THEN 'sub' ELSE 'add' END || '    rsp,0x' || ln AS strict,
    CASE kind WHEN 1 THEN 'sub    rsp,0x' ELSE 'rsp,0x' END || ln AS compatible FROM l WHERE kind IN (1, 2)""")
def asm_instruction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions without comments; the compatible reading loses mnemonics of hexadecimal letters."""
    x = F.col("line")
    rows = _listing_lines(Tables(spark, sf_dir)).select("program_id", "ln", asm.instruction(x).alias("strict"), asm.instruction(x, False).alias("compatible"))
    return rows.where("strict is not null")


@query("SELECT o_orderkey, o_orderpriority AS stripped FROM orders")
def asm_comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and outer white space go."""
    made = F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("  \t# "), F.col("o_orderstatus"), F.lit(" # more"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", asm.strip_comment(made).alias("stripped"))


@query(f"""WITH {_LINES}, c AS (SELECT *, CASE kind WHEN 0 THEN lpad(addr, 16, '0') || ' <fn_' || l_partkey || '>:' WHEN 1 THEN 'sub    rsp,0x' || ln
    WHEN 2 THEN 'add    rsp,0x' || ln END AS line FROM l) SELECT program_id, coalesce(string_agg(line, chr(10) ORDER BY ln, l_partkey), '') AS cleaned FROM c GROUP BY 1""")
def clean_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole listings reduced to headers and instructions."""
    whole = _listing_lines(Tables(spark, sf_dir)).groupBy("program_id").agg(listing.ordered_concat(F.struct("ln", "l_partkey"), "line", "\n").alias("text"))
    return whole.select("program_id", asm.clean_assembly(F.col("text")).alias("cleaned"))


_EVENTS = """e AS (SELECT user_id AS program_id, event_id, ts, event_type FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY program_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM e),
    f AS (SELECT program_id, segment, max(CASE WHEN event_type = 'signup' THEN 'f' || event_id END) AS name,
        max(CASE WHEN event_type = 'signup' THEN lower(to_hex(event_id)) END) AS address,
        coalesce(string_agg(CASE WHEN event_type <> 'signup' THEN event_type || '_' || event_id END, '{sep}' ORDER BY ts, event_id), '') AS instructions
        FROM s WHERE segment > 0 GROUP BY 1, 2)"""


def _event_functions(t: Tables) -> DataFrame:
    at = F.lower(F.hex("event_id"))
    name = F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "signup", F.concat(at, F.lit(" <f"), name, F.lit(">:"))).otherwise(
        F.concat(F.lit(" "), at, F.lit(":\t90 \t"), F.col("event_type"), F.lit("_"), name)
    )
    rows = t.events.select(F.col("user_id").alias("program_id"), F.struct("ts", "event_id").alias("ln"), line.alias("line"))
    return listing.functions_of_lines(rows)


@query(f"WITH {_EVENTS.format(sep=';')} SELECT program_id, CAST(segment AS BIGINT) AS segment, name, address, instructions FROM f")
def asm_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines gathered under the header above them."""
    return _event_functions(Tables(spark, sf_dir)).withColumn("instructions", F.array_join("instructions", ";"))


@query(f"""WITH {_EVENTS.format(sep=';')} SELECT program_id, string_agg('<FUNC> ' || name || ' at ' || address || chr(10)
    || CASE WHEN instructions = '' THEN '' ELSE replace(instructions, ';', chr(10)) || chr(10) END || '<END_FUNC>' || chr(10) || chr(10), chr(10) ORDER BY segment) AS formatted FROM f GROUP BY 1""")
def asm_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions between markers."""
    return listing.formatted_listing(_event_functions(Tables(spark, sf_dir)))


# C sources


def _part_source() -> Column:
    return F.format_string('int f%d(int a) { /* %s { */ char *s = "%s}";\n return \'x\'; } // end', "p_partkey", "p_name", "p_brand")


@query("""SELECT p_partkey, 'int f' || p_partkey || '(int a) { ' || repeat(' ', length(p_name) + 8) || ' char *s = ' || repeat(' ', length(p_brand) + 3) || ';' || chr(10)
    || ' return    ; }       ' AS masked FROM part""")
def mask_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and literals blanked, offsets kept."""
    return Tables(spark, sf_dir).part.select("p_partkey", csource.mask(_part_source()).alias("masked"))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand, p_size FROM part)
    SELECT k, 'first' || k AS name, '// ' || p_brand || chr(10) || 'static' || chr(10) || 'int first' || k || '(int a, int b) {' || chr(10) || '  if (a) { return b; } else { return a; }' || chr(10) || '}' AS code FROM p
    UNION ALL SELECT k, 'second', 'void second(void) { char c = ''{''; first(1, 2); }' FROM p
    UNION ALL SELECT k, 'third', 'int third() { return 3; }' FROM p WHERE p_size % 2 = 0""")
def c_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a source: look-back, masked braces, control words, repeated names, unclosed bodies."""
    third = F.when(F.col("p_size") % 2 == 0, "int third() { return 3; }\nint third() { return 4; }\n").otherwise("int third() { { return 3; }\n")
    head = F.format_string("#define N 3;\n// %s\nstatic\nint first%d(int a, int b) {\n  if (a) { return b; } else { return a; }\n}\n", "p_brand", "p_partkey")
    code = F.concat(head, F.lit("void second(void) { char c = '{'; first(1, 2); }\n"), third)
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("k"), F.explode(csource.functions(code)).alias("f")).select("k", "f.name", "f.code")


@query("SELECT s_suppkey, 'go' || s_suppkey AS name FROM supplier")
def c_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control words before a brace are no functions."""
    code = F.format_string("int go%d(int n) { while (n) { n--; } for (;n;) { } switch (n) { } do { } while (n); if (n) { } return n; }", "s_suppkey")
    return Tables(spark, sf_dir).supplier.select("s_suppkey", F.explode(csource.functions(code)).alias("f")).select("s_suppkey", "f.name")


@query("""SELECT s_suppkey, '#include <a.h>' || chr(10) || '  struct s' || s_suppkey || ' x;' || chr(10) || 'enum e;' AS header,
    'int a;' || chr(10) || '#define ' || s_name || chr(10) || 'int b;' || chr(10) AS source FROM supplier""")
def split_header_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines apart from the rest."""
    code = F.format_string("#include <a.h>\nint a;\n  struct s%d x;\n#define %s\nint b;\nenum e;", "s_suppkey", "s_name")
    return Tables(spark, sf_dir).supplier.select("s_suppkey", csource.header_part(code).alias("header"), csource.source_part(code).alias("source"))


@query("""WITH f AS (SELECT s_nationkey AS program_id, s_suppkey AS pos, CASE WHEN s_suppkey % 7 = 3 THEN 'main' ELSE s_name END AS name,
        '#include <h' || s_suppkey % 3 || '.h>' || chr(10) AS header, 'int f' || s_suppkey || ';' || chr(10) AS source FROM supplier),
    g AS (SELECT *, row_number() OVER (PARTITION BY program_id, header ORDER BY name = 'main', pos) AS n FROM f)
    SELECT CAST(program_id AS VARCHAR) AS program_id, coalesce(string_agg(header || chr(10), '' ORDER BY name = 'main', pos) FILTER (WHERE n = 1), '') || chr(10)
        || string_agg(source || chr(10), '' ORDER BY name = 'main', pos) AS code FROM g GROUP BY program_id""")
def program_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct headers, then sources with main last."""
    key = F.col("s_suppkey")
    rows = Tables(spark, sf_dir).supplier.select(
        F.col("s_nationkey").cast("string").alias("program_id"), key.alias("pos"), F.when(key % 7 == 3, "main").otherwise(F.col("s_name")).alias("f_name"),
        F.format_string("#include <h%d.h>\nint f%d;\n", key % 3, key).alias("optimized_code"),
    )
    return enrich.program_code(rows)


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'x ```c' || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || '``` y' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS code FROM conversations""")
def strip_code_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences at the very ends go, fences inside stay."""
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    fenced = F.concat(F.lit("\n```c\n"), body, F.lit("\n```\n "))
    made = F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, body).otherwise(F.concat(F.lit("x ```c\n"), body, F.lit("\n``` y")))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", text.strip_code_fence(made).alias("code"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE '' END AS answer FROM conversations")
def nested_response_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assistant text of a response document."""
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    message = lambda kind, role, x: F.struct(F.lit(kind).alias("type"), role.alias("role"), F.array(part("reasoning", F.lit("no")), part("output_text", x)).alias("content"))
    said = F.array(message("reasoning", F.lit("assistant"), F.lit("no")), message("message", F.col("role"), F.col("text")))
    body = F.to_json(F.struct(said.alias("output")))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", text.first_response_text(body).alias("answer"))


# diagnostics: a message of an order has a line of its lineitems each, of four kinds


def _messages(t: Tables) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    kind = (F.col("l_orderkey") + n) % 4
    line = (
        F.when(kind == 0, F.format_string("/tmp/x/f%d.c:%d:%d: error: expected ';' before 'y'", part, n, part % 80))
        .when(kind == 1, F.format_string("f%d.cpp:%d:%d: note: declared here", part, n, part % 80))
        .when(kind == 2, F.format_string("h%d.h:%d:1: Warning: odd", part, n))
        .otherwise(F.format_string("x%d.o: undefined reference to 'g'", part))
    )
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), line.alias("line"))
    return rows.groupBy("l_orderkey").agg(listing.ordered_concat("o", "line", "\n").alias("message"))


_MESSAGES = """m AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, (l_orderkey + l_linenumber) % 4 AS kind FROM lineitem),
    d AS (SELECT k, n, p, kind, row_number() OVER (PARTITION BY k ORDER BY n, p) AS ord,
        CASE kind WHEN 0 THEN '/tmp/x/f' || p || '.c' WHEN 1 THEN 'f' || p || '.cpp' END AS file, CASE WHEN kind < 2 THEN n END AS line, CASE WHEN kind < 2 THEN p % 80 END AS col,
        CASE kind WHEN 0 THEN 'error' WHEN 1 THEN 'note' ELSE 'warning' END AS type,
        CASE kind WHEN 0 THEN 'expected '';'' before ''y''' WHEN 1 THEN 'declared here' ELSE 'h' || p || '.h:' || n || ':1: Warning: odd' END AS message FROM m WHERE kind < 3)"""


@query(f'WITH {_MESSAGES} SELECT k AS l_orderkey, CAST(ord - 1 AS INTEGER) AS ord, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", type, message FROM d')
def diag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of messages: structured, by their words, or none."""
    found = F.posexplode(diagnostics.parse(F.col("message"))).alias("ord", "d")
    return _messages(Tables(spark, sf_dir)).select("l_orderkey", found).select("l_orderkey", "ord", "d.file", "d.line", "d.column", "d.type", "d.message")


@query("""WITH l AS (SELECT o_custkey % 50 AS k, o_orderkey + 1 AS o, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders)
    SELECT k, CAST(count(*) AS INTEGER) AS n_shown, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS shown FROM l WHERE n <= 50 GROUP BY k""")
def diag_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty diagnostics of a message."""
    line = F.format_string("a.c:%d:1: error: e", F.col("o_orderkey") + 1)
    whole = Tables(spark, sf_dir).orders.groupBy((F.col("o_custkey") % 50).alias("k")).agg(listing.ordered_concat("o_orderkey", line, "\n").alias("message"))
    said = F.regexp_extract_all(diagnostics.format_for_prompt(F.col("message")), F.lit(r"a\.c:(\d+):1"), F.lit(1))
    return whole.select("k", said.alias("found")).select("k", F.size("found").alias("n_shown"), F.array_join("found", ",").alias("shown"))


@query(f"WITH {_MESSAGES} SELECT k AS l_orderkey, CAST(count(*) AS INTEGER) AS n, string_agg(file || '@' || line || '@' || col, ' ' ORDER BY ord) AS places FROM d WHERE kind < 2 GROUP BY k")
def diag_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that a message names."""
    rows = _messages(Tables(spark, sf_dir)).select("l_orderkey", diagnostics.locations(F.col("message")).alias("p")).where(F.size("p") > 0)
    one = F.transform("p", lambda x: F.concat_ws("@", x["file"], x["line"].cast("string"), x["col"].cast("string")))
    return rows.select("l_orderkey", F.size("p").alias("n"), F.array_join(one, " ").alias("places"))


@query(f"""WITH {_MESSAGES} SELECT k AS l_orderkey, '## Compilation Errors:' || chr(10) || string_agg(chr(10) || ord || '. '
    || CASE WHEN kind < 2 THEN ' **' || file || ':' || line || ':' || col || '**' ELSE '' END || ' [' || upper(type) || '] ' || message, chr(10) ORDER BY ord) AS shown FROM d GROUP BY k""")
def diag_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered diagnostics for a prompt; messages without any are left to diag_normalize."""
    rows = _messages(Tables(spark, sf_dir)).where(F.size(diagnostics.parse(F.col("message"))) > 0)
    return rows.select("l_orderkey", diagnostics.format_for_prompt(F.col("message")).alias("shown"))


@query("""WITH l AS (SELECT o_orderkey AS k, ['expected '';'' before ''y''', '''q'' undeclared', 'undefined reference to g', 'invalid conversion from a', 'incompatible types',
        '''f'' redeclared', 'error: foo', 'nothing'][o_orderkey % 8 + 1] AS line FROM orders)
    SELECT k, CASE k % 8 WHEN 0 THEN '[SYNTAX] ' WHEN 1 THEN '[UNDEFINED] ' WHEN 3 THEN '[TYPE] ' WHEN 5 THEN '[REDEFINITION] ' ELSE '' END || line AS line,
        CASE k % 8 WHEN 0 THEN 'syntax' WHEN 1 THEN 'undefined' WHEN 2 THEN 'undefined' WHEN 3 THEN 'type' WHEN 4 THEN 'type' WHEN 5 THEN 'redefinition' WHEN 6 THEN 'error' END AS kind FROM l""")
def diag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of lines, and their tags where the word is not said already."""
    said = ("expected ';' before 'y'", "'q' undeclared", "undefined reference to g", "invalid conversion from a", "incompatible types", "'f' redeclared", "error: foo", "nothing")
    key = F.col("o_orderkey")
    line = F.element_at(F.array(*(F.lit(x) for x in said)), (key % 8 + 1).cast("int"))
    return Tables(spark, sf_dir).orders.select(key.alias("k"), diagnostics.add_categories(line).alias("line"), diagnostics.kind_of(line).alias("kind"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
    k AS (SELECT *, regexp_replace(regexp_replace(line, '\\d+', 'N', 'g'), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS key FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, ln) AS n FROM k)
    SELECT doc_id, CAST(ln - 1 AS INTEGER) AS ln, line FROM n WHERE key = '' OR n = 1""")
def diag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents of which only the first of each group that differs in numbers only stays."""
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    kept = listing.distinct_lines(rows.withColumn("at", F.struct("doc_id", "ln")), "at")
    return kept.select("doc_id", "ln", "line")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'No error message provided' ELSE
    'original.c:' || o_orderkey || ':2: error: x' || chr(10) || chr(10) || '[SYNTAX] expected y before z' || CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE chr(10) || 'a b' END END AS strict
    FROM orders""")
def diag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message without prefix, folders, repeated lines and white space, with kinds."""
    key = F.col("o_orderkey")
    lines = F.format_string("Compilation failed: /tmp/a1/original.c:%d:2: error: x\n  \n\n\nexpected   y before z\nexpected y before z", key)
    made = F.when(key % 5 == 0, F.lit(" \n ")).when(key % 5 == 1, lines).otherwise(F.concat(lines, F.lit("\na  b\n")))
    return Tables(spark, sf_dir).orders.select(key.alias("k"), diagnostics.normalize(made).alias("strict"))


@query("""SELECT p_partkey, 'e ' || 'f' || p_partkey || '.c:3 stdio.h:5 a.cpp:1 a.c:2' AS strict, 'e ' || 'f' || p_partkey || '.c:3 stdio.h:5 a.cpp:1 srca.c:2' AS compatible FROM part""")
def diag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths reduced to file names."""
    made = F.format_string("e /tmp/ab%d/f%d.c:3 /usr/include/stdio.h:5 src/a.cpp:1 src/a.c:2", "p_size", "p_partkey")
    rows = Tables(spark, sf_dir).part
    return rows.select("p_partkey", diagnostics.simplify_paths(made).alias("strict"), diagnostics.simplify_paths(made, False).alias("compatible"))


@query("SELECT p_partkey, 'f' || p_partkey || '.c: error: x; g.c: odd' AS line FROM part")
def diag_strip_lineno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column references go."""
    made = F.format_string("f%d.c:%d:7: error: x; g.c:1:2: odd", "p_partkey", "p_size")
    return Tables(spark, sf_dir).part.select("p_partkey", diagnostics.remove_line_numbers(made).alias("line"))


@query("SELECT p_partkey, p_name || ' x' || chr(10) || chr(10) || 'y z' AS said FROM part")
def diag_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blanks and of blank lines shrink."""
    made = F.concat(F.lit("\n  "), F.col("p_name"), F.lit("    x\n \n\n\ny  z \n"))
    return Tables(spark, sf_dir).part.select("p_partkey", diagnostics.clean_whitespace(made).alias("said"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE 'Note: ' || p_name END AS strict, CASE p_partkey % 3 WHEN 0 THEN 'Compilation failed: ' || p_name WHEN 1 THEN p_name ELSE 'Note: ' || p_name END AS compatible FROM part")
def diag_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known prefixes go; the compatible form overlooks the compiler driver's own."""
    key = F.col("p_partkey") % 3
    made = F.concat(F.when(key == 0, "Compilation failed: ").when(key == 1, "Error : ").otherwise("Note: "), F.col("p_name"))
    rows = Tables(spark, sf_dir).part
    return rows.select("p_partkey", diagnostics.remove_prefix(made).alias("strict"), diagnostics.remove_prefix(made, False).alias("compatible"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DECIMAL(20, 0)) AS number FROM lineitem")
def hex_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal addresses as numbers."""
    at = F.lpad(F.lower(F.hex("l_partkey")), 8, "0")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", text.hex_number(at).alias("number"))
