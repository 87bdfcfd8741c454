"""Array kernels shared by the operators: whole Arrow text columns become byte and word arrays.

Everything here works on UTF-8 bytes held in numpy arrays, so a batch of documents is tokenised and
hashed without a Python object per word. Batches are cut into pieces of about ``PIECE_BYTES`` so a
worker's memory does not depend on the batch; one document is never cut.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..storage import dropped, shared_folder, stored, swept  # noqa: F401  (the operators take them from here)

PIECE_BYTES = 1 << 20

_U = np.uint64
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {_BASE: np.ones(1, dtype=np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII digits and lower-case letters and of every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words are runs of lower-case ASCII letters and of every non-ASCII byte.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True


def powers(n: int, of: int = _BASE) -> np.ndarray:
    """At least ``n`` powers of an odd number, the hash base if none is given, modulo 2**64."""
    table = _powers.get(of)
    if table is None or len(table) < n:
        factor = np.full(max(n, 64), of, dtype=np.uint64)
        factor[0] = 1
        table = _powers[of] = np.multiply.accumulate(factor)
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every bit of its input."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; a null has no bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        raise TypeError(f"{name} is {column.type}, not a string column")
    _, offsets, data = column.buffers()
    n = len(column)
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(n, dtype=bool)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if null.any() and (np.diff(o)[null] != 0).any():
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
        return text_column(pa.RecordBatch.from_arrays([column], [name]), name)[:2] + (null,)
    return buf, o, null


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a range of documents: hashes, byte spans and the documents' word ranges."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True):
        base = offsets[0]
        raw = buf[base : offsets[-1]]
        self.bounds = offsets - base
        self.bytes = LOWER[raw] if lower else raw
        n = len(raw)
        inside = is_word[self.bytes]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        before[self.bounds] = False
        self.start = np.flatnonzero(inside & ~before[:n])
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = inside
        after[self.bounds] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.length = self.end - self.start
        #: Words of document i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.start, self.bounds, side="left")
        packed = self.bytes[inside]
        if len(self.start):
            at = np.cumsum(self.length) - self.length
            place = np.arange(len(packed)) - np.repeat(at, self.length)
            table = powers(int(self.length.max()))
            summed = np.add.reduceat(_BYTE_VALUE[packed] * table[place], at)
            self.hash = mix(summed + self.length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """For each word its document's place in the range."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def hash_word(word: str, lower: bool = True) -> int:
    """The hash that ``Words`` gives to one word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    every = np.ones(256, dtype=bool)
    return int(Words(raw, np.array([0, len(raw)]), every, lower).hash[0])


_gram_factor = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; entry i covers words i .. i + n - 1."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = h[: len(h) - n + 1] * _gram_factor[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * _gram_factor[k]
    return mix(out + _U(n))


class RollingHash:
    """Hashes of any spans of one byte array, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        self.back = powers(len(data) + 1, pow(_BASE, -1, 1 << 64))
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data] * powers(len(data))[: len(data)], out=self.prefix[1:])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length; entry i begins at i."""
        n = len(self.prefix) - length
        out = self.prefix[length:] - self.prefix[:n]
        out *= self.back[:n]
        out += np.uint64(length)
        return mix(out)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(np.uint64))


def release() -> None:
    """Give freed memory back to the system: a worker keeps running, and its executor's other tasks need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more columns behind it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a batch on its way to a Python worker, unless the session sets its own limit.
BATCH_BYTES = 1 << 24
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that functions pickled by reference can be imported there."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(os.path.dirname(here))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder in (os.path.dirname(here), here):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scatter(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(part, bytes of each array's items of that part): many small records travel as one row a part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1 if len(part) else []
    arrays = [a[order] for a in arrays]
    for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
        if hi > lo:
            yield int(part[lo]), *(a[lo:hi].tobytes() for a in arrays)


def gathered(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """The arrays that ``scatter`` packed into the rows of a binary column, one after another."""
    got = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist() if x]
    return np.concatenate(got) if got else np.zeros(0, dtype=dtype)


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed: small numbers in wide integers cost little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """A part for each hash, from its high bits."""
    return ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
