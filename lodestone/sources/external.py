"""External processes and text generators behind batch functions.

Every process or network call is made once for each row inside a partition, its outcome is a column, and
failures are rows, not exceptions. Generators and compilers are passed in, so that tests and offline runs
use deterministic ones.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Seconds until a call counts as failed, and the compiler's levels.
TOOL_TIMEOUT, COMPILE_TIMEOUT, DISASSEMBLE_TIMEOUT, GENERATE_TIMEOUT = 10, 60, 60, 600
DECOMPILE_TIMEOUT, EXTRACT_TIMEOUT = 120, 180
LEVELS = ("O0", "O1", "O2", "O3")
#: What is said of a process's end.
SUCCESSFUL, FAILED, TIMED_OUT, COMPILE_ERROR = "Compilation successful", "Compilation failed: ", "Compilation timed out", "Compilation error: "
DISASSEMBLY_ERROR = "Disassembly error: "


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass
class StubGenerator:
    """Deterministic and offline: a function of the prompt."""

    answer: Callable[[str], str] = lambda prompt: ""

    def generate(self, prompt: str) -> str:
        return self.answer(prompt)


@dataclass
class HttpGenerator:
    """Posts a JSON request; a failed call gives an empty text, or raises if ``strict``."""

    url: str
    request: Callable[[str], dict]
    pick: Callable[[dict], str]
    headers: dict[str, str] = field(default_factory=dict)
    strict: bool = False
    retries: int = 0

    def generate(self, prompt: str) -> str:
        for attempt in range(self.retries + 1):
            try:
                body = json.dumps(self.request(prompt)).encode()
                call = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
                with urllib.request.urlopen(call, timeout=GENERATE_TIMEOUT) as reply:
                    text = self.pick(json.load(reply))
                if text or attempt == self.retries:
                    return clean_output(text)
            except Exception:
                if self.strict:
                    raise
                if attempt == self.retries:
                    return ""
        return ""


def clean_output(text: str) -> str:
    """Without outer white space and without a code fence at the very ends."""
    text = text.strip()
    if text.startswith("```"):
        head, _, rest = text.partition("\n")
        text = rest if head[3:].strip().isalnum() or head == "```" else text[3:]
    return text.removesuffix("```").strip()


def _message_text(reply: dict) -> str:
    for item in reply.get("output", []):
        if (item.get("type"), item.get("role")) == ("message", "assistant"):
            for part in item.get("content") or []:
                if part.get("type") == "output_text":
                    return part.get("text", "")
    return ""


def _responses(model: str | None, key: str | None, url: str | None, temperature: float, limit: int | None) -> Generator:
    ask = lambda p: {"model": model, "input": p, "temperature": temperature} | ({"max_output_tokens": limit} if limit else {})
    return HttpGenerator(f"{(url or 'http://localhost:8000').rstrip('/')}/v1/responses", ask, _message_text, {"Authorization": f"Bearer {key}"} if key else {})


def _chat(model: str | None, key: str | None, url: str | None, temperature: float, limit: int | None) -> Generator:
    ask = lambda p: {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": p}]} | ({"max_tokens": limit} if limit else {})
    key = key or os.environ.get("OPENAI_API_KEY")
    pick = lambda r: r["choices"][0]["message"]["content"] or ""
    return HttpGenerator(f"{(url or 'https://api.openai.com').rstrip('/')}/v1/chat/completions", ask, pick, {"Authorization": f"Bearer {key}"}, strict=True)


def _parts(model: str | None, key: str | None, url: str | None, temperature: float, limit: int | None) -> Generator:
    settings = {"temperature": temperature} | ({"maxOutputTokens": limit} if limit else {})
    ask = lambda p: {"contents": [{"parts": [{"text": p}]}], "generationConfig": settings}

    def pick(reply: dict) -> str:
        found = reply.get("candidates") or [{}]
        return "\n".join(x["text"] for x in found[0].get("content", {}).get("parts", []) if x.get("text"))

    top = (url or "https://generativelanguage.googleapis.com").rstrip("/")
    return HttpGenerator(f"{top}/v1beta/models/{model}:generateContent", ask, pick, {"x-goog-api-key": key or ""}, retries=1)


def _local(model: str | None, key: str | None, url: str | None, temperature: float, limit: int | None) -> Generator:
    options = {"temperature": temperature} | ({"num_predict": limit} if limit else {})
    ask = lambda p: {"model": model, "prompt": p, "stream": False, "options": options}
    return HttpGenerator(f"{(url or 'http://localhost:11434').rstrip('/')}/api/generate", ask, lambda r: r.get("response", ""))


PROVIDERS: dict[str, Callable[..., Generator]] = {"openai": _chat, "gemini": _parts, "vllm": _responses, "ollama": _local}


def create_generator(
    provider: str,
    model_name: str | None = None,
    api_key: str | None = None,
    base_url: str | None = None,
    temperature: float = 0.7,
    max_tokens: int | None = None,
) -> Generator:
    """A generator by provider name, in any case; an unknown one is a ValueError."""
    try:
        make = PROVIDERS[provider.lower()]
    except KeyError:
        raise ValueError(f"unknown provider {provider!r}; known are {', '.join(sorted(PROVIDERS))}") from None
    return make(model_name, api_key, base_url, temperature, max_tokens)


@dataclass
class Compiler:
    """gcc or g++ on a source text; success or the message, never an exception."""

    c: str = "gcc"
    cpp: str = "g++"
    extra_flags: tuple[str, ...] = ()
    include_dirs: tuple[str, ...] = ()
    library_dirs: tuple[str, ...] = ()
    libraries: tuple[str, ...] = ()

    def command(self, source: str, output: str, is_cpp: bool, object_only: bool, level: str) -> list[str]:
        out = [self.cpp if is_cpp else self.c, *["-c"] * object_only, source, "-o", output, f"-{level}", "-w"]
        for flag, values in (("-I", self.include_dirs), ("-L", self.library_dirs), ("-l", self.libraries)):
            for value in values:
                out += [flag, value]
        return [*out, *self.extra_flags]

    def build(self, code: str, is_cpp: bool = False, object_only: bool = False, level: str = "O0") -> tuple[bool, str, bytes | None]:
        """Success, message and the compiled file's content, if the compiler wrote any."""
        with tempfile.TemporaryDirectory() as folder:
            source, output = os.path.join(folder, "original.cpp" if is_cpp else "original.c"), os.path.join(folder, "out")
            with open(source, "w") as f:
                f.write(code)
            try:
                done = subprocess.run(self.command(source, output, is_cpp, object_only, level), capture_output=True, text=True, timeout=COMPILE_TIMEOUT)
                if done.returncode:
                    return False, f"{FAILED}{done.stderr}", None
                if not os.path.exists(output):
                    return True, SUCCESSFUL, None
                with open(output, "rb") as f:
                    return True, SUCCESSFUL, f.read()
            except subprocess.TimeoutExpired:
                return False, TIMED_OUT, None
            except OSError as e:
                return False, f"{COMPILE_ERROR}{e}", None

    def compile(self, code: str, is_cpp: bool = False, object_only: bool = False, level: str = "O0") -> tuple[bool, str]:
        return self.build(code, is_cpp, object_only, level)[:2]


@dataclass
class StubCompiler:
    """Deterministic: a function of the source text."""

    verdict: Callable[[str], tuple[bool, str]] = lambda code: (True, "")
    binary: Callable[[str, str], bytes | None] = lambda code, level: None

    def build(self, code: str, is_cpp: bool = False, object_only: bool = False, level: str = "O0") -> tuple[bool, str, bytes | None]:
        ok, message = self.verdict(code)
        return ok, message, self.binary(code, level) if ok else None

    def compile(self, code: str, is_cpp: bool = False, object_only: bool = False, level: str = "O0") -> tuple[bool, str]:
        return self.verdict(code)


def available(*tools: str) -> dict[str, bool]:
    """Which tools answer to --version."""

    def answers(tool: str) -> bool:
        try:
            return shutil.which(tool) is not None and subprocess.run([tool, "--version"], capture_output=True, timeout=TOOL_TIMEOUT).returncode == 0
        except (OSError, subprocess.TimeoutExpired):
            return False

    return {tool: answers(tool) for tool in tools}


def disassemble(binaries: DataFrame, intel: bool = True, demangle: bool = True, tool: str = "objdump") -> DataFrame:
    """(program_id, status, text): the listing of each binary (program_id, content), or why there is none."""

    def one(content: bytes) -> tuple[bool, str]:
        with tempfile.NamedTemporaryFile() as f:
            f.write(content)
            f.flush()
            command = [tool, "-d", *["-M", "intel"] * intel, *["-C"] * demangle, f.name]
            try:
                done = subprocess.run(command, capture_output=True, text=True, timeout=DISASSEMBLE_TIMEOUT)
            except (OSError, subprocess.TimeoutExpired) as e:
                return False, f"{DISASSEMBLY_ERROR}{e}"
        return (True, done.stdout) if done.returncode == 0 else (False, done.stderr)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(bytes(x)) for x in frame["content"]]
            yield pd.DataFrame({"program_id": frame["program_id"], "status": [f[0] for f in found], "text": [f[1] for f in found]})

    return binaries.select("program_id", "content").mapInPandas(run, "program_id string, status boolean, text string")


def compile_matrix(sources: DataFrame, levels: tuple[str, ...] = LEVELS, path: str = "path", folder: str = "out") -> DataFrame:
    """Every source at every level with its output path: four literal rows, no shuffle."""
    from ..functions.text import stem

    level = F.explode(F.array(*(F.lit(x) for x in levels)))
    return sources.select("*", level.alias("opt_level")).withColumn("output_path", F.concat_ws("/", F.lit(folder), F.concat_ws("_", stem(F.col(path)), "opt_level")))


def compile_all(sources: DataFrame, compiler=None, object_only: bool = False) -> DataFrame:
    """``sources`` (path, code, is_cpp, and opt_level if there are several) with ``status`` and ``message``.

    With a column ``output_path`` each compiled file is written there, aside first and then renamed, so that
    a task that runs again, or twice, leaves one whole file; a file that cannot be written is a failure. The
    result is stored: nothing is compiled again for what is computed from it.
    """
    compiler = compiler or Compiler()
    if "opt_level" not in sources.columns:
        sources = sources.withColumn("opt_level", F.lit(LEVELS[0]))
    if "output_path" not in sources.columns:
        sources = sources.withColumn("output_path", F.lit(None).cast("string"))
    rows = sources.select("path", "code", "is_cpp", "opt_level", "output_path")

    def one(row) -> tuple[bool, str]:
        ok, message, content = compiler.build(row.code, row.is_cpp, object_only, row.opt_level)
        if ok and content is not None and isinstance(row.output_path, str):
            try:
                delivered(content, row.output_path)
            except OSError as e:
                return False, f"{COMPILE_ERROR}{e}"
        return ok, message

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(r) for r in frame.itertuples()]
            yield frame[["path", "opt_level"]].assign(status=[f[0] for f in found], message=[f[1] for f in found])

    return stored(rows.mapInPandas(run, "path string, opt_level string, status boolean, message string"), "compiled")


def delivered(content: bytes, path: str) -> None:
    """Write a file that anybody may run: under another name first, which a rename then makes the file, old or new."""
    url = path if urlparse(path).scheme else f"file://{os.path.abspath(path)}"
    where, name = fs.FileSystem.from_uri(url)
    where.create_dir(os.path.dirname(name), recursive=True)
    aside = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(aside) as f:
        f.write(content)
    if isinstance(where, fs.LocalFileSystem):
        os.chmod(aside, 0o777)
    where.move(aside, name)


def compile_directory(
    spark: SparkSession, folder: str, compiler=None, levels: tuple[str, ...] = LEVELS[:1], recursive: bool = True, always_cpp: bool = False, object_only: bool = False, out: str = "out"
) -> DataFrame:
    """(path, opt_level, output_path, status, message) of every C and C++ source below a folder at every level.

    Compiled files are written to ``output_path``, so ``out`` must be a folder that all executors share.
    """
    from . import files

    found = compile_matrix(files.sources(spark, folder, recursive, always_cpp), levels, folder=out)
    return found.select("path", "opt_level", "output_path").join(compile_all(found, compiler, object_only), ["path", "opt_level"])


def outcome_counts(compiled: DataFrame) -> DataFrame:
    """(opt_level, total, succeeded, failed) of compiled sources."""
    return compiled.groupBy("opt_level").agg(F.count("*").alias("total"), F.count_if("status").alias("succeeded"), F.count_if(~F.col("status")).alias("failed"))


def renderings(binaries: DataFrame, disassembler=disassemble, strict: bool = True) -> DataFrame:
    """(program_id, raw, cleaned, formatted) of the binaries that could be disassembled."""
    from ..functions import asm
    from ..operators import listing

    raw = stored(disassembler(binaries).where("status").select("program_id", F.col("text").alias("raw")), "listings")
    formatted = listing.formatted_listing(listing.extract_functions(raw, text="raw", strict=strict))
    cleaned = raw.select("program_id", "raw", asm.clean_assembly(F.col("raw"), strict).alias("cleaned"))
    return cleaned.join(formatted, "program_id", "left").withColumn("formatted", F.coalesce("formatted", F.lit("")))


def disassemble_directory(spark: SparkSession, folder: str, out: str, recursive: bool = True, raw: bool = True, cleaned: bool = True, formatted: bool = True, disassembler=disassemble) -> dict[str, str]:
    """Write up to three renderings of the files without a suffix below a folder; where each was written, nothing without any listing."""
    from . import files

    found = stored(renderings(files.executables(spark, folder, recursive), disassembler), "renderings")
    return {} if found.isEmpty() else files.write_listings(found, out, raw, cleaned, formatted)


@dataclass
class Decompiler:
    """An external tool that writes files about a binary; ``{binary}``, ``{out}`` and ``{what}`` in the command are filled in.

    ``what`` is code (files .c), cfg (.json) or calls (.dot). A call that fails, or writes nothing, is a
    status and a message.
    """

    command: tuple[str, ...]
    suffixes: dict[str, str] = field(default_factory=lambda: {"code": ".c", "cfg": ".json", "calls": ".dot"})

    def extract(self, content: bytes, what: str) -> tuple[bool, dict[str, str]]:
        with tempfile.TemporaryDirectory() as folder:
            binary, out = os.path.join(folder, "binary"), os.path.join(folder, "out")
            os.mkdir(out)
            with open(binary, "wb") as f:
                f.write(content)
            command = [x.format(binary=binary, out=out, what=what) for x in self.command]
            try:
                done = subprocess.run(command, capture_output=True, text=True, timeout=DECOMPILE_TIMEOUT if what == "code" else EXTRACT_TIMEOUT)
            except (OSError, subprocess.SubprocessError) as e:
                return False, {"": str(e)}
            made = {}
            for name in sorted(os.listdir(out)):
                if name.endswith(self.suffixes[what]):
                    with open(os.path.join(out, name), errors="replace") as f:
                        made[name[: -len(self.suffixes[what])]] = f.read()
        return (True, made) if done.returncode == 0 and made else (False, {"": done.stderr})


@dataclass
class StubDecompiler:
    """Deterministic: files as a function of the content."""

    files: Callable[[bytes, str], dict[str, str]] = lambda content, what: {}

    def extract(self, content: bytes, what: str) -> tuple[bool, dict[str, str]]:
        made = self.files(content, what)
        return bool(made), made or {"": "nothing made"}


def decompile(binaries: DataFrame, decompiler, what: str = "code") -> DataFrame:
    """(program_id, status, stem, text): a row for each file that a decompiler makes of a binary, or one with why there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for program, content in zip(frame["program_id"], frame["content"], strict=True):
                try:
                    ok, made = decompiler.extract(bytes(content), what)
                except Exception as e:  # one binary's failure is its row
                    ok, made = False, {"": str(e)}
                rows += [(program, ok, stem, text) for stem, text in made.items()]
            yield pd.DataFrame(rows, columns=["program_id", "status", "stem", "text"])

    return binaries.select("program_id", "content").mapInPandas(run, "program_id string, status boolean, stem string, text string")


def generate(prompts: DataFrame, generator: Generator, prompt: str = "prompt", result: str = "generated") -> DataFrame:
    """Every row with the generator's text; one call a row."""
    schema = prompts.select("*", F.lit("").alias(result)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{result: [generator.generate(p) for p in frame[prompt]]})

    return prompts.mapInPandas(run, schema)
