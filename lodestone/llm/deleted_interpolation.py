"""Language-model scoring by deleted interpolation.

P(w | h) mixes the maximum-likelihood estimates c(h w) / c(h) and c(w) / N with 1 / (V + 1). The weights
depend on the bucket of the context's frequency and are learned by expectation-maximisation: a tenth of
the training documents is deleted from the counts, and the weights maximise its likelihood under the
counts that are left. Scores then use the counts of all training documents.

Counts are not broadcast. Documents are taken in blocks; a block asks for each of its distinct words and
pairs once, in sorted, delta-coded arrays, one row for each part of the hash space, and sends its own
counts along. The task of a part adds up and answers every block in the order of its question. A block's
tokens, as numbers into its distinct words, go along and meet its answers again by block. What is moved is one entry for each distinct pair
of a block, and a very common word is one entry a block. The number of parts follows the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import SPACED, Words, _gram_factor, hash_word, mix, pack, pack_sorted, part_of, partitions, pieces, read, release, ship, stored, swept, text_column, unpack, unpack_sorted

BLOCK_BYTES = 3 << 20
#: Bytes of texts for each part of the hash space, and of a row with some of a block's tokens.
PART_BYTES, PAYLOAD_BYTES = 8 << 20, 1 << 18
#: Parts whose results are written to one file.
PARTS_A_FILE = 8
END, START = hash_word("\x00end"), hash_word("\x00start")
HELD, DEV, TRAIN = 0, 1, 2
BUCKETS = 24
STEP = 0.25
#: Bits of a pair's hash, whatever the input: among 10**12 different pairs about one in 10**5 shares its hash.
PAIR_BITS = 56


def pair_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of every token with the one before it, or with a start; ``first`` has the documents' first tokens."""
    before = np.concatenate([[np.uint64(START)], h[:-1]]) if len(h) else h
    before[first] = START
    return mix(before * _gram_factor[0] + h * _gram_factor[1] + np.uint64(2)) >> np.uint64(64 - PAIR_BITS)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of lower-cased words with an end for each document, tokens of each document)."""
    hashes, counts = [], []
    for lo, hi in pieces(offsets):
        w = Words(buf, offsets[lo : hi + 1], SPACED)
        hashes.append(np.insert(w.hash, w.first[1:], np.uint64(END)))
        counts.append(w.counts + 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


_ASKED = "part int, block string, kind int, n int, seq int, answers int, hashes binary, counts binary"
_ANSWER = "block string, kind int, n int, seq int, answers int, total binary, deleted binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])


def _ask(parts: int):
    """Blocks' questions to the parts, and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            kinds = np.where(fold == 0, HELD, np.where(fold == 1, DEV, TRAIN))
            for kind in (HELD, DEV, TRAIN):
                own = batch.filter(pa.array(kinds == kind))
                _, offsets, _ = text_column(own, "text")
                for lo, hi in pieces(offsets, BLOCK_BYTES):
                    number += 1
                    yield from _question(own.slice(lo, hi - lo), kind, parts, number)
                    release()

    return run


def _question(rows: pa.RecordBatch, kind: int, parts: int, number: int) -> Iterator[pa.RecordBatch]:
    h, counts = tokens(*text_column(rows, "text")[:2])
    words, word, many = np.unique(h, return_inverse=True, return_counts=True)
    common = np.argsort(-many, kind="stable")  # common words get small numbers
    name = np.empty(len(words), dtype=np.uint32)
    name[common] = np.arange(len(words), dtype=np.uint32)
    keys = pa.RecordBatch.from_arrays([rows.column(0)], names=["key"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, keys.schema) as out:
        out.write_batch(keys)
    head = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
    payload = b"".join(len(x).to_bytes(8, "little") + x for x in (head, pack(counts.astype(np.uint32)), pack(words[common]), pack(name[word])))
    block = f"{TaskContext.get().partitionId()}-{number}-{hashlib.blake2b(payload, digest_size=8).hexdigest()}"
    pairs, pair_counts = np.unique(pair_hashes(h, np.cumsum(counts) - counts), return_counts=True)
    del word, name, h
    made = []
    for n, hashes, times, top in ((1, words, many, 64), (2, pairs, pair_counts, PAIR_BITS)):
        cut = np.searchsorted(part_of(hashes << np.uint64(64 - top), parts), np.arange(parts + 1))
        for part in np.flatnonzero(np.diff(cut)).tolist():
            some = slice(cut[part], cut[part + 1])
            made.append((part, block, kind, n, part, None, pack_sorted(hashes[some]), pack(times[some].astype(np.uint32))))
    yield _batch(made, _ASKED)
    there = int(hashlib.blake2b(block.encode(), digest_size=4).hexdigest(), 16) % parts
    yield _batch([(there, block, kind, 0, i, len(made), payload[at : at + PAYLOAD_BYTES], None) for i, at in enumerate(range(0, len(payload), PAYLOAD_BYTES))], _ASKED)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a part's hashes to every block that asked, over the part's words a row of sums, and tokens as they came."""
    asked: dict[int, list[pa.RecordBatch]] = {1: [], 2: []}
    for batch in batches:
        kind_of_row = batch.column(2).to_numpy()
        for n in (0, 1, 2):
            some = batch.filter(pa.array(kind_of_row == n))
            if some.num_rows and n:
                asked[n].append(some)
            elif some.num_rows:
                yield pa.RecordBatch.from_arrays([*some.columns[:6], pa.nulls(some.num_rows, pa.binary())], names=[f.split()[0] for f in _ANSWER.split(", ")])
    for n, held in asked.items():
        if not held:
            continue
        rows = [(b, i) for b in held for i in range(b.num_rows)]
        every = [unpack_sorted(b.column(5)[i].as_py()) for b, i in rows]
        distinct = np.concatenate(every)
        del every
        distinct.sort()
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
        total, deleted = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        for b, i in rows:  # a block asks for a hash once
            kind = b.column(1)[i].as_py()
            if kind != HELD:
                at, counts = np.searchsorted(distinct, unpack_sorted(b.column(5)[i].as_py())), unpack(b.column(6)[i].as_py(), np.uint32)
                total[at] += counts
                if kind == DEV:
                    deleted[at] += counts
        for b, i in rows:
            block, kind, _, seq, _ = (b.column(c)[i].as_py() for c in range(5))
            at = np.searchsorted(distinct, unpack_sorted(b.column(5)[i].as_py()))
            yield _batch([(block, kind, n, seq, None, pack(total[at]), pack(deleted[at]) if kind == DEV else None)], _ANSWER)
        if n == 1:
            sums = np.array([(total > 0).sum(), total.sum(), (total > deleted).sum(), deleted.sum()], dtype=np.int64)
            yield _batch([(None, -1, -1, 0, None, sums.tobytes(), None)], _ANSWER)
        del distinct, total, deleted, rows
        held.clear()
        release()


def _blocks(answers: DataFrame, parts: int) -> DataFrame:
    """Every block's tokens and answers, in one partition."""
    return answers.where("n >= 0").repartition(parts, "block")


class Block:
    """A block's keys, tokens, distinct words and pairs, and the counts that were answered, in the order of sorted hashes."""

    def __init__(self, rows: list[dict]):
        data, self.kind = b"".join(r["total"] for r in rows if r["n"] == 0), rows[0]["kind"]
        given = [r for r in rows if r["n"]]
        if rows[0]["n"] or len(given) != rows[0]["answers"]:
            raise RuntimeError("a block lacks tokens or answers")
        fields, at = [], 0
        for _ in range(4):
            size = int.from_bytes(data[at : at + 8], "little")
            fields.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        self.keys = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(fields[0])).read_all().column(0).combine_chunks()
        self.counts = unpack(fields[1], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        words, name = unpack(fields[2], np.uint64), unpack(fields[3], np.uint32)
        order = np.argsort(words)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.word = words[order], place[name]
        self.pair = np.unique(pair_hashes(words[name], self.first), return_inverse=True)[1].astype(np.int32)
        self.total, self.deleted = ([np.concatenate([unpack(r[c], np.int64) for r in given if r["n"] == n and r[c]] or [np.zeros(0, np.int64)]) for n in (1, 2)] for c in ("total", "deleted"))


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of a partition, which are about as many bytes as a part's, one after another."""
    rows: dict[str, list[tuple]] = {}
    for batch in batches:
        block, n, seq = (batch.column(i).to_pylist() for i in (0, 2, 3))
        for i, name in enumerate(block):
            rows.setdefault(name, []).append((n[i], seq[i], batch.slice(i, 1)))
    for name in list(rows):
        yield Block([r for _, _, piece in sorted(rows.pop(name), key=lambda x: x[:2]) for r in piece.to_pylist()])
        release()


def _context(t: Block, words: np.ndarray) -> np.ndarray:
    """How often each token's context was counted; a document's start as often as its end."""
    count = words[t.word]
    out = np.concatenate([[0], count[:-1]])
    out[t.first] = words[np.searchsorted(t.words, np.uint64(END))]
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 if unseen, then by powers of two."""
    return np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log(np.maximum(p, 1e-300)) / STEP), -1).astype(np.int64)


def _evidence(kept: int):
    """(bucket, pair level, word level, tokens) of deleted documents under the counts without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _each_block(batches):
            words, pairs = t.total[0] - t.deleted[0], t.total[1] - t.deleted[1]
            context = _context(t, words)
            pair = pairs[t.pair] / np.maximum(context, 1)
            code = (bucket_of(context) << 40) | ((_level(pair) + 1) << 20) | (_level(words[t.word] / max(kept, 1)) + 1)
            some, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n, pa.int64())], names=["code", "tokens"])

    return run


def learn_weights(bucket: np.ndarray, pair: np.ndarray, word: np.ndarray, tokens: np.ndarray, unseen: float, rounds: int = 40) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation; without evidence those of the whole."""

    def fit(use: np.ndarray) -> np.ndarray:
        p = np.stack([pair[use], word[use], np.full(use.sum(), unseen)], axis=1)
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * weight
            share /= share.sum(axis=1, keepdims=True)
            weight = (share * tokens[use, None]).sum(axis=0)
            weight = np.maximum(weight / weight.sum(), 1e-6)
            weight /= weight.sum()
        return weight

    whole = fit(np.ones(len(bucket), dtype=bool)) if len(bucket) else np.array([0.0, 0.9, 0.1])
    return np.array([fit(bucket == b) if tokens[bucket == b].sum() >= 100 else whole for b in range(BUCKETS)])


def _score(weights: np.ndarray, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _each_block(batches):
            words, pairs = t.total
            count, context = words[t.word], _context(t, words)
            w = weights[bucket_of(context)]
            p = w[:, 0] * pairs[t.pair] / np.maximum(context, 1) + w[:, 1] * count / max(n, 1) + w[:, 2] / (v + 1)
            base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    t.keys,
                    pa.array(np.full(len(t.keys), t.kind == HELD)),
                    pa.array(t.counts, pa.int64()),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), t.first), pa.int64()),
                    pa.array(np.full(len(t.keys), n), pa.int64()),
                    pa.array(np.add.reduceat(base, t.first), pa.float64()),
                    pa.array(np.add.reduceat(np.log10(p), t.first), pa.float64()),
                ],
                names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del t, words, pairs, count, context, w, p, base

    return run


def train(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray, int, int]:
    """(blocks with their answers, weights of (pair, word, uniform) by bucket, training tokens, distinct ones)."""
    spark = docs.sparkSession
    ship(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(10)), F.lit(9)).cast("int")
    rows = docs.select(F.col(key).alias("key"), fold.alias("fold"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // PART_BYTES))
    asked = rows.mapInArrow(_ask(parts), _ASKED).repartition(parts, "part").drop("part")
    answers = stored(asked.mapInArrow(_answer, _ANSWER).coalesce(-(-parts // PARTS_A_FILE)), "counts")
    del asked
    swept(spark)
    sums = np.array([np.frombuffer(r[0], np.int64) for r in answers.where("n = -1").select("total").collect()], dtype=np.int64).reshape(-1, 4).sum(axis=0)
    v, n, kept_v, deleted = (int(x) for x in sums)
    evidence = _blocks(answers.where(F.col("kind") == DEV), parts).mapInArrow(_evidence(n - deleted), "code long, tokens long")
    seen = evidence.groupBy("code").agg(F.sum("tokens")).collect()  # at most buckets times levels squared
    code = np.array([r[0] for r in seen], dtype=np.int64)
    tokens_seen = np.array([r[1] for r in seen], dtype=np.float64)
    back = lambda level: np.where(level > 0, np.exp(-(level - 1) * STEP), 0.0)
    weights = learn_weights(code >> 40, back((code >> 20) & 0xFFFFF), back(code & 0xFFFFF), tokens_seen, 1 / (kept_v + 1))
    return _blocks(answers, parts), weights, n, v


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Documents whose crc32(key as text) mod 10 is 0 are held out; all others train, and those with
    remainder 1 are deleted when the weights are learned. Tokens are lower-cased (A-Z) words without
    ASCII white space and one end. A null text counts as empty and has its end only; a row with a null
    key trains. Repeated rows count as often as they occur. Extra columns are not read. An empty table
    gives an empty result. A block is at least a document: a task holds about a hundred bytes for each
    byte of its longest text.
    """
    blocks, weights, n, v = train(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    out = blocks.mapInArrow(_score(weights, n, v), f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its score under the interpolated model and under smoothed word counts."""
    return score(read(spark, sf_dir, "documents"))


QUERIES = {"op6_interpolation": op6_interpolation}
ORACLE_SQL: dict[str, str] = {}
