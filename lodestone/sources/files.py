"""File sources and sinks."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, stem, suffix
from ..storage import TASK_ROWS, stored

#: Suffixes of sources in listing order; all but the first are C++.
SOURCE_SUFFIXES = (".c", ".cpp", ".cc", ".cxx", ".c++")
CFG = (
    "function_name STRING, entry STRING, blocks ARRAY<STRUCT<id:STRING,start:STRING,"
    "instructions:ARRAY<STRUCT<address:STRING,mnemonic:STRING,proto:STRING,ops:ARRAY<STRING>>>>>,"
    "edges ARRAY<STRUCT<src:STRING,dst:STRING,type:STRING>>"
)

CORRUPT = "_corrupt_record"


def _files(spark: SparkSession, folder: str, pattern: str, recursive: bool, content: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder)
    return found.select("path", "content") if content else found.select("path")


def executables(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(program_id, path, content) of the files without a suffix."""
    found = _files(spark, folder, "*", recursive, True)
    return found.where(suffix(F.col("path")) == "").select(stem(F.col("path")).alias("program_id"), "path", "content")


def is_source(path):
    return suffix(path).isin(*SOURCE_SUFFIXES)


def is_cpp(path, always: bool = False):
    return F.lit(True) if always else suffix(path).isin(*SOURCE_SUFFIXES[1:])


def by_suffix(paths: DataFrame, path: str = "path") -> DataFrame:
    """Source paths with the rank of their suffix in the listing order."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SOURCE_SUFFIXES)), suffix(F.col(path)))
    return paths.withColumn("suffix_rank", rank.cast("int")).where("suffix_rank > 0")


def sources(spark: SparkSession, folder: str, recursive: bool = True, always_cpp: bool = False) -> DataFrame:
    """(path, code, is_cpp, suffix_rank) of C and C++ sources."""
    found = _files(spark, folder, "*.c*", recursive, True)
    return by_suffix(found).select("path", F.col("content").cast("string").alias("code"), is_cpp(F.col("path"), always_cpp).alias("is_cpp"), "suffix_rank")


def texts(spark: SparkSession, paths) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cfg_documents(spark: SparkSession, folder: str, program_id: str | None = None) -> DataFrame:
    """(program_id, stem, document, parsed, error) of the JSON files below a folder, names that begin with ``_`` too.

    A file that cannot be read, is no UTF-8, or holds no document of this layout is a row with why, and the
    others stay; ``isolated`` takes such rows out.

    Spark's listings hide such names, so they are listed and read by their full names, a task for some
    files each. Of files with one stem the last by path counts. Folders that only Spark can list
    (no local or pyarrow file system) are read through Spark, hidden names excepted.
    """
    from pyarrow import fs

    url = folder if urlparse(folder).scheme else f"file://{os.path.abspath(folder)}"
    where, top = fs.FileSystem.from_uri(url)
    found = [i.path for i in where.get_file_info(fs.FileSelector(top, recursive=True)) if i.path.endswith(".json")]
    names = spark.createDataFrame([(p,) for p in sorted(found)], "path string").repartition(max(1, min(len(found), 200)))
    root = f"{urlparse(url).scheme}://{urlparse(url).netloc}"

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for path in frame["path"]:
                try:
                    there, name = fs.FileSystem.from_uri(root + path)
                    with there.open_input_stream(unquote(name)) as f:
                        rows.append((path, f.read().decode(), None))
                except (OSError, ValueError) as e:  # one file's failure is its row
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "document", "error"], dtype=object)

    read = names.mapInPandas(run, "path string, document string, error string")
    last = read.groupBy(stem(F.col("path")).alias("stem")).agg(F.max_by(F.struct("document", "error"), "path").alias("x"))
    rows = last.select(F.lit(program_id).alias("program_id"), "stem", "x.document", "x.error")
    return rows.select("program_id", "stem", "document", parsed_cfg(F.col("document")).alias("parsed"), F.coalesce("error", cfg_error(F.col("document"))).alias("error"))


def parsed_cfg(document: Column) -> Column:
    """A control-flow document's text as a struct, null where ``cfg_error`` says why."""
    return F.when(cfg_error(document).isNull(), F.from_json(document, CFG))


def cfg_error(document: Column) -> Column:
    """Why a text is no control-flow document, or null."""
    read = F.from_json(document, f"{CFG}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    return (
        F.when(document.isNull(), "no text").when(read[CORRUPT].isNotNull() | read.isNull(), "no JSON document of this layout")
        .when(read["function_name"].isNull(), "no function name").when(read["blocks"].isNull(), "no blocks")
    )


def isolated(rows: DataFrame, bad: str, error: str | Column = "error") -> DataFrame:
    """The rows without an error, without that column; the others are added to the JSON files of the folder ``bad``.

    ``error`` is a column or its name. Rows are stored first, so what made them is not asked again.
    """
    marked = rows if isinstance(error, str) else rows.withColumn("error", error)
    name = error if isinstance(error, str) else "error"
    kept = stored(marked, "rows")
    kept.where(F.col(name).isNotNull()).write.mode("append").json(bad)
    return kept.where(F.col(name).isNull()).drop(name)


def dot_lines(spark: SparkSession, path: str, program_id: str | None = None) -> DataFrame:
    """(program_id, ln, line) of a DOT file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.lit(program_id).alias("program_id"), F.posexplode(F.split("value", "\n")).alias("ln", "line"))


def write_program(program: DataFrame, folder: str) -> None:
    """Final text, in a folder for each program, and the whole nested record of each."""
    named = program.select("executable_name", F.col("optimized_code").alias("value"))
    named.write.mode("overwrite").partitionBy("executable_name").text(f"{folder}/final_program_code")
    program.write.mode("overwrite").json(f"{folder}/enriched_data")


def write_cfg(documents: DataFrame, folder: str) -> None:
    documents.write.mode("overwrite").partitionBy("program_id").json(folder)


def write_listings(listings: DataFrame, folder: str, raw: bool = True, cleaned: bool = True, formatted: bool = True) -> dict[str, str]:
    """Up to three renderings of listings (program_id, raw, cleaned, formatted); where each was written."""
    out = {}
    for name, wanted in (("raw", raw), ("cleaned", cleaned), ("formatted", formatted)):
        if wanted:
            out[name] = f"{folder}/{name}"
            listings.select("program_id", F.col(name).alias("value")).write.mode("overwrite").partitionBy("program_id").text(out[name])
    return out


def write_rendered(rendered: DataFrame, folder: str) -> None:
    """Rows (program_id, kind, ln, value) as text files below kind and program, which in the order of their names are the rendering.

    Rows are sorted over all tasks: a long listing is a file of each of several tasks, and none holds it whole.
    """
    rows = stored(rendered, "rendered")
    order = ["kind", "program_id", "ln"]
    sorted_rows = rows.repartitionByRange(max(1, -(-rows.count() // TASK_ROWS)), *order).sortWithinPartitions(*order)
    sorted_rows.select("kind", "program_id", "value").write.mode("overwrite").partitionBy("kind", "program_id").text(folder)


def rendered_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(program_id, kind, digest): SHA-256 of each rendering that ``write_rendered`` wrote, without its last line end.

    A listing's files are read one after the other, a megabyte at a time. The folder must be one that pyarrow opens.
    """
    found = spark.read.format("binaryFile").load(folder).select(F.col("program_id").cast("string").alias("program_id"), "kind", "path")
    # a task's number leads a file's name: longer ones are later
    paths = F.transform(F.array_sort(F.collect_list(F.struct(F.length(file_name(F.col("path"))).alias("n"), "path"))), lambda p: p["path"])
    listings = stored(found.groupBy("program_id", "kind").agg(paths.alias("paths")), "paths")

    def run(batches):
        import hashlib
        import re

        import pandas as pd
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        for frame in batches:
            made = []
            for paths in frame["paths"]:
                digest, held = hashlib.sha256(), b""
                for path in paths:
                    with where.open_input_stream(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)) as f:
                        while piece := f.read(1 << 20):
                            digest.update(held)
                            held = piece
                digest.update(held.removesuffix(b"\n"))
                made.append(digest.hexdigest())
            yield pd.DataFrame({"program_id": frame["program_id"], "kind": frame["kind"], "digest": made})

    return listings.repartition(max(1, min(listings.count(), 1000))).mapInPandas(run, "program_id string, kind string, digest string")


def file_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(stem, path): the last path of each stem."""
    return paths.groupBy(stem(F.col(path)).alias("stem")).agg(F.max(path).alias("path"))


