"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers start a new token at a space that follows a character other than white space, so a text
falls into chunks (such a space and what follows up to the next one) that can be encoded one by one. Each
block of documents encodes its distinct chunks once. Over the bytes of those chunks, laid end to end, two
packed bitsets mark where tokens of either side end. Their AND has the shared cuts, running popcounts (rank)
turn a cut's byte into a place among the tokens of each side, and the tokens between two cuts are a group.
Links are all pairs inside a group; they are kept as distinct id pairs with how often they occur, so a
group that repeats a token is not written out.

How many documents hold a pair is a corpus-wide count: blocks send each of their distinct pairs once, with
the number of their documents, and ask for the totals the same way; a Spark join answers, and the block's
documents add up what their chunks link.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import pack, read, release, ship, stored, unpack

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a block, or one longer document; links of a slice that are written out at once.
BLOCK_BYTES, SLICE_LINKS = 4 << 20, 1 << 20
#: Chunks that are given to the libraries as one text.
ENCODE_CHUNKS = 1 << 9
#: Bytes of group texts that leave a task at once, or one longer document's.
OUT_BYTES = 1 << 22
MARK = "▁"
_SPACED = re.compile(r"\s ")


def split(text: str) -> list[str]:
    """The chunks of a space and a text, each without its leading space."""
    words = text.split(" ")
    if not _SPACED.search(" " + text):
        return words
    out, held = [], [words[0]]
    for w in words[1:]:
        if not held[-1] or held[-1][-1].isspace():
            held.append(w)
        else:
            out.append(" ".join(held))
            held = [w]
    return [*out, " ".join(held)]


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their entries."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        symbols = byte_of_symbol()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode() for i in range(self.b.vocab_size()) for piece in [self.b.id_to_piece(i)]
        ]
        inner = (piece.lstrip(MARK) for i in range(self.b.vocab_size()) for piece in [self.b.id_to_piece(i)])
        if any(MARK in x for x in inner) or self.b.encode(" a") == self.b.encode("a"):
            raise ValueError("pieces of this model may cross whitespace markers, or its white space is normalised")
        self.length_a, self.length_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        names = lambda side, ends: np.array([[f"{i}{e}" for e in ends] for i in range(len(side))], dtype=object)
        #: An id's text within its side of a group, and as the last of it; of B also as the last of a chunk.
        self.name_a, self.name_b = names(self.bytes_a, ",|"), names(self.bytes_b, ",;\n")

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """(number of each chunk among those whose tokens have its bytes, or -1, and for A and B all ids and how many a chunk has).

        Chunks that end in no white space are encoded many at a time, as one text, and cut where they end.
        """
        odd = np.array([not c or c[-1].isspace() for c in chunks], dtype=bool)
        order = np.argsort(odd, kind="stable")
        plain, found, same = len(chunks) - int(odd.sum()), [], np.zeros(len(chunks), dtype=bool)
        for i in range(0, plain, ENCODE_CHUNKS):
            where = order[i : i + ENCODE_CHUNKS].tolist() if i + ENCODE_CHUNKS <= plain else order[i:plain].tolist()
            got = self._together([chunks[k] for k in where])
            for k, part in zip([where] if got else [[k] for k in where], [got] if got else (self._alone(chunks[k]) for k in where), strict=True):
                same[k] = part is not None
                found += [part] * (part is not None)
        for k in order[plain:].tolist():
            part = self._alone(chunks[k])
            same[k] = part is not None
            found += [part] * (part is not None)
        number = np.full(len(chunks), -1, dtype=np.int64)
        number[order[same[order]]] = np.arange(int(same.sum()))
        none = (np.zeros(0, np.int64),) * 4
        return number, *(np.concatenate(x) for x in zip(none, *found, strict=True))

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of A, how many a chunk has, and the same of B; nothing if their bytes are not the chunks'."""
        text = " ".join(chunks)
        raw = b" " + text.encode()
        end = np.cumsum([len(c.encode()) + 1 for c in chunks])
        out = []
        for ids, entries, length in ((self.ids_a(text), self.bytes_a, self.length_a), (self.b.encode(text), self.bytes_b, self.length_b)):
            if b"".join([entries[i] for i in ids]) != raw:
                return None
            flat = np.array(ids, dtype=np.int64)
            to = np.searchsorted(np.cumsum(length[flat]), end) + 1  # a chunk's end is a token's
            out += [flat, np.diff(to, prepend=0)]
        return tuple(out)

    def _alone(self, chunk: str) -> tuple[np.ndarray, ...] | None:
        a, b = self.ids_a(chunk), self.b.encode(chunk) or [self.b.piece_to_id(MARK)]  # a last marker alone; the library adds none to an empty string
        if not b"".join([self.bytes_a[i] for i in a]) == b" " + chunk.encode() == b"".join([self.bytes_b[i] for i in b]):
            return None
        return np.array(a, dtype=np.int64), np.array([len(a)]), np.array(b, dtype=np.int64), np.array([len(b)])

    def ids_a(self, text: str) -> list[int]:
        return self.a.encode(" " + text, add_special_tokens=False).ids


def bitset(places: np.ndarray, size: int) -> np.ndarray:
    """A packed bitset of ``size`` bits with these set."""
    flags = np.zeros(-(-size // 64) * 64, dtype=bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def rank(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place."""
    word, rest = places >> 6, (places & 63).astype(np.uint64)
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - rest)
    return before[word] + np.bitwise_count(bits[word] & mask)


def select(bits: np.ndarray) -> np.ndarray:
    """The places of all set bits, in order."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., n[0] of them, then those of start[1], and so on."""
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - at, n)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster here than numpy's hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Chunks:
    """The alignment of distinct chunks, by chunk: numbers of tokens, groups and links, the groups' text, linked id pairs."""

    def __init__(self, tokens: Tokenizers, chunks: list[str]):
        #: A chunk's number among those whose tokens have its bytes, or -1.
        self.number, a, self.n_a, b, self.n_b = tokens.encode(chunks)
        self._groups(tokens, a, b)
        self._pairs(a, b)

    def _groups(self, tokens: Tokenizers, a: np.ndarray, b: np.ndarray) -> None:
        last_a, last_b = np.cumsum(tokens.length_a[a]) - 1, np.cumsum(tokens.length_b[b]) - 1
        size = int(last_a[-1]) + 1 if len(a) else 0
        bits_a, bits_b = bitset(last_a, size), bitset(last_b, size)
        cuts = select(bits_a & bits_b)
        to_a, to_b = rank(bits_a, cuts), rank(bits_b, cuts)
        self.many_a, self.many_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        ends = rank(bits_a & bits_b, last_a[np.cumsum(self.n_a) - 1]) if len(a) else np.zeros(0, np.int64)  # a chunk's end is a cut
        self.n_groups = np.diff(ends, prepend=0)
        self.chunk_of_group = np.repeat(np.arange(len(ends)), self.n_groups)
        self.n_links = np.add.reduceat(self.many_a * self.many_b, ends - self.n_groups) if len(ends) else ends
        kind_a, kind_b = np.zeros(len(a), dtype=np.int8), np.zeros(len(b), dtype=np.int8)
        kind_a[to_a - 1], kind_b[to_b - 1] = 1, 1
        kind_b[to_b[ends - 1] - 1] = 2
        place = np.concatenate([np.repeat(2 * np.arange(len(cuts)), self.many_a), np.repeat(2 * np.arange(len(cuts)) + 1, self.many_b)])
        said = np.concatenate([tokens.name_a[a, kind_a], tokens.name_b[b, kind_b]])[np.argsort(place, kind="stable")]
        self.groups = "".join(said.tolist()).split("\n")[:-1]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Distinct linked pairs and, for each chunk, which of them it holds how often."""
        group = np.arange(len(self.many_a))

        def counted(ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            code, times = np.unique(np.repeat(group, many) << 32 | ids, return_counts=True)
            n = np.bincount(code >> 32, minlength=len(group))
            return code & 0xFFFFFFFF, times, n, np.cumsum(n) - n

        id_a, times_a, n_a, at_a = counted(a, self.many_a)
        id_b, times_b, n_b, at_b = counted(b, self.many_b)
        links = np.cumsum(n_a * n_b)
        found, lo = [], 0
        while lo < len(group):  # slices of groups, or one larger group in slices of its A ids
            hi = max(lo + 1, int(np.searchsorted(links, (links[lo - 1] if lo else 0) + SLICE_LINKS, side="right")))
            left = np.arange(at_a[lo], at_a[hi - 1] + n_a[hi - 1])
            step = max(1, SLICE_LINKS // max(1, int(n_b[lo]))) if hi == lo + 1 else len(left)
            for i in range(0, len(left), step):
                some = left[i : i + step]
                of = np.repeat(group[lo:hi], n_a[lo:hi])[i : i + step]
                right, some, of = ragged(at_b[of], n_b[of]), np.repeat(some, n_b[of]), np.repeat(of, n_b[of])
                found.append((self.chunk_of_group[of], id_a[some] << 32 | id_b[right], times_a[some] * times_b[right]))
            lo = hi
        chunk, pair, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        del found
        self.pairs, local = np.unique(pair, return_inverse=True)
        code, back = np.unique(chunk * max(1, len(self.pairs)) + local, return_inverse=True)
        self.times = np.bincount(back, weights=times, minlength=len(code)).astype(np.int64)
        self.pair = code % max(1, len(self.pairs))
        n = np.bincount(code // max(1, len(self.pairs)), minlength=len(self.n_a))
        self.n_pairs, self.first_pair = n, np.cumsum(n) - n

    def documents_of_pairs(self, sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each distinct pair how many documents, given as sequences of chunks, hold it."""
        out = np.zeros(len(self.pairs), dtype=np.int64)
        code = distinct(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(self.n_a)) + sequence)
        doc, chunk = code // max(1, len(self.n_a)), code % max(1, len(self.n_a))
        links, lo = np.cumsum(self.n_pairs[chunk]), 0
        while lo < len(doc):  # whole documents, of about a slice's links together
            hi = int(np.searchsorted(links, (links[lo - 1] if lo else 0) + SLICE_LINKS, side="right"))
            hi = int(np.searchsorted(doc, doc[min(max(hi, lo + 1), len(doc)) - 1], side="right"))
            some = chunk[lo:hi]
            held = self.pair[ragged(self.first_pair[some], self.n_pairs[some])]
            held = distinct(np.repeat(doc[lo:hi], self.n_pairs[some]) * len(self.pairs) + held) % len(self.pairs)
            out += np.bincount(held, minlength=len(self.pairs))
            lo = hi
        return out


def _encoded(tokens: Tokenizers, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(a block's parts as bytes, its distinct pairs, how many of its documents hold each)."""
    names: dict[str, int] = {}
    rows = []
    for text in texts:
        words = split(text) if text else []
        for w in words:
            if w not in names:
                names[w] = len(names)
        rows.append(np.array([names[w] for w in words], dtype=np.int64))
    made = Chunks(tokens, list(names))
    rows = [made.number[r] for r in rows]
    rows = [r if len(r) and r.min() >= 0 else r[:0] for r in rows]
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    sequence = np.concatenate([*rows, np.zeros(0, np.int64)])
    numbers = (lengths, sequence, made.n_a, made.n_b, made.n_groups, made.n_pairs, made.pair)
    parts = [pack(x.astype(np.uint32)) for x in numbers] + [pack(x.astype(np.uint64)) for x in (made.n_links, made.times)]
    parts.append(pack(np.frombuffer("\n".join(made.groups).encode(), dtype=np.uint8)))
    return parts, made.pairs, made.documents_of_pairs(sequence, lengths)


def blocks(docs: DataFrame, file_a: str, file_b: str, key: str, text: str) -> DataFrame:
    """(block, keys, parts, pairs, documents): documents encoded and aligned, ``BLOCK_BYTES`` of text a row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number, task = None, 0, TaskContext.get().partitionId()

        def made(keys: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
            parts, pairs, n = _encoded(tokens, texts)
            row = (f"{task}-{number}", pa.concat_arrays(keys), parts, pairs, n)
            types = (pa.string(), pa.list_(keys[0].type), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "keys", "parts", "pairs", "documents"])

        keys, texts, size = [], [], 0
        for batch in batches:
            tokens = tokens or Tokenizers(file_a, file_b)
            got, lo = batch.column(1).to_pylist(), 0
            for i, x in enumerate(got):
                texts.append(x or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or i == len(got) - 1:
                    keys.append(batch.column(0).slice(lo, i + 1 - lo))
                    lo = i + 1
                if size >= BLOCK_BYTES:
                    yield made(keys, texts)
                    keys, texts, size, number = [], [], 0, number + 1
                    release()
        if texts:
            yield made(keys, texts)
        release()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"block string, keys array<{kind}>, parts array<binary>, pairs array<long>, documents array<long>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of answered blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = batch.column(0)[i].values
            parts = batch.column(1)[i].as_py()
            lengths, sequence, n_a, n_b, n_groups, n_pairs, pair = (unpack(x, np.uint32).astype(np.int64) for x in parts[:7])
            n_links, times = (unpack(x, np.uint64).astype(np.int64) for x in parts[7:9])
            groups = np.array(unpack(parts[9], np.uint8).tobytes().decode().split("\n"), dtype=object)
            asked, said = (np.zeros(0, np.int64) if batch.column(c)[i].values is None else batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
            said = said[np.argsort(asked)]  # a block asks for each pair once and keeps them sorted
            count = np.abs(said)[pair] if len(pair) else pair
            best = said[pair] < 0 if len(pair) else pair
            first = np.cumsum(n_pairs) - n_pairs
            by_chunk = lambda x: np.add.reduceat(x, first) if len(first) else x
            of_chunk = np.stack([n_a, n_b, n_groups, n_links, by_chunk(times * best), by_chunk(times * count)], axis=1)
            begin = np.cumsum(lengths) - lengths
            sums = np.zeros((len(lengths), 6), dtype=np.int64)
            some = np.flatnonzero(lengths)
            if len(some):
                sums[some] = np.add.reduceat(of_chunk[sequence], begin[some], axis=0)
            size = np.array([len(x) + 1 for x in groups.tolist()], dtype=np.int64)
            total = np.zeros(len(lengths), dtype=np.int64)
            if len(some):
                total[some] = np.add.reduceat(size[sequence], begin[some])
            cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(total) // OUT_BYTES)) + 1, [len(lengths)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                told = [";".join(groups[sequence[b : b + n]].tolist()) for b, n in zip(begin[lo:hi].tolist(), lengths[lo:hi].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), *(pa.array(sums[lo:hi, c]) for c in range(6)), pa.array(told, pa.string())], names=_OUT)
            del groups, of_chunk, sequence
            release()


_OUT = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def align(docs: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row for each row of ``docs``.

    A is a byte-level tokenizer's file, B a SentencePiece model that adds a leading space; A encodes the text
    with that space. ``groups`` has the ids of each group, ``a1,a2|b1;a3|b2,b3``. A pair of ids counts once
    for each row that links it; ``count_sum`` adds the pair's count for every link, and ``n_best`` has the
    links whose pair has the highest count of its A id, ties included.

    A null or empty text, and one whose tokens do not have its bytes, has no tokens: zeros and an empty
    string. Null keys and rows that share a key are rows like others, and repeated rows count as often as
    they occur. Extra columns are not read. An empty table gives an empty result. A block is at least a
    document: a task holds about a hundred bytes for each byte of its longest text.
    """
    ship(docs.sparkSession)
    made = stored(blocks(docs, file_a, file_b, key, text), "aligned")
    held = made.select("block", F.inline(F.arrays_zip("pairs", "documents"))).toDF("block", "pair", "documents")
    counts = stored(held.groupBy("pair").agg(F.sum("documents").alias("count")), "pairs")
    # as many rows as A has entries
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    marked = counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(highest), "a")
    marked = marked.select("pair", F.when(F.col("count") == F.col("highest"), -F.col("count")).otherwise(F.col("count")).alias("said"))
    asked = made.select("block", F.explode("pairs").alias("pair")).join(marked, "pair")
    told = asked.groupBy("block").agg(F.collect_list("pair").alias("asked"), F.collect_list("said").alias("said"))
    answered = made.select("block", "keys", "parts").join(told, "block", "left").select("keys", "parts", "asked", "said")
    kind = docs.schema[key].dataType.simpleString()
    out = answered.mapInArrow(_summed, f"key {kind}, {', '.join(f'{c} long' for c in _OUT[1:7])}, groups string")
    return out.withColumnRenamed("key", key)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of its alignment and the digest of its groups."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = align(docs, public_tokenizers.path(FILE_A), public_tokenizers.path(FILE_B))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return made.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {"op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {}
