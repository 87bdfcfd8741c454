"""Quality classifier: an interpolated modified Kneser-Ney trigram model trained on trusted text.

Half of the trusted documents train, chosen by a hash of their keys, and the others set the thresholds, so each
has one use. Callers may ask for fewer (``train_documents``); the query and the pipeline do not. N-grams are
counted, discounted and interpolated in shards by hash, so the model may be of any size; this goes part
by part of their hashes, and texts are scored in passes, so the disk holds the shuffles of one part or pass at a time.
A trigram lives in the shard of its last pair, beside that pair's own counts; blocks of texts send sorted arrays of their
distinct n-grams there. A shard asks the others for sums over its trigrams' contexts, and words are joined by hash.

The interpolated probability is kept as one number for each n-gram: what the log probability of a text
gains when that n-gram occurs in it, as a prediction and as a context. A text's score is the sum over its
n-grams, so it is added up shard by shard. The model is dealt into shards by n-gram hash, one for ``SHARD_BYTES``
of the texts to be scored, so neither a shard nor what it is asked grows with the input. A block of
documents asks each shard once for every distinct n-gram that a fixed-size bitmap of the model lets through,
with the documents that hold it; where shard and questions meet, gains are joined by n-gram and summed by
document, and the sums of a block's shards meet again.

A document is kept unless its perplexity is over its language's threshold: a quantile over all trusted
documents of that language that did not train, widened by ``MARGIN`` and, as a mean over n tokens varies more the smaller n,
by exp(``SLACK`` / sqrt(n)). Languages without trusted documents get the quantile over all of them.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import BITMAP, in_bitmap, local_bitmap
from .kernel import SPACED, Words, _gram_factor, dropped, fresh, grams, hash_word, mix, pack, pack_sorted, part_of, pieces, read, release, ship, signed, stored, swept, text_column, unpack, unpack_sorted

TRAIN_DOCUMENTS = 2500
TRAIN_CHARS = 20_000
BLOCK_BYTES = 3 << 20
#: Bytes of texts for each shard of the model, the fewest shards, n-grams in a row of the model, bytes of a bitmap's row.
SHARD_BYTES, SHARDS, ROW_GRAMS, SLICE = 16 << 20, 16, 1 << 18, 4096
#: Texts are scored in so many passes at most, each over as many bytes at least.
PASSES, PASS_BYTES = 6, 32 << 20
#: N-grams are counted and joined in so many parts at most, one for so many bytes of trusted texts.
PARTS, PART_BYTES = 4, 8 << 20
#: Bytes of trusted texts for each shard in which n-grams are counted.
FIT_BYTES = 4 << 20
#: Questions leave out so many bits of a hash: of 10**9 n-grams in a model one in 10**7 others is taken for one of them.
DROPPED_BITS = 8
QUANTILE = 0.99
MARGIN = 1.15
SLACK = 5.0
END = hash_word("\x00end")
_MODEL = "slice int, grams binary, gains binary"


def with_ends(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with an end token behind every document, and each token's document."""
    n = len(w.first) - 1
    return np.insert(w.hash, w.first[1:], np.uint64(END)), np.repeat(np.arange(n), w.counts + 1)


def _inside(document: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams lie in one document."""
    return document[: len(document) - n + 1] == document[n - 1 :]


def trigrams(pairs: np.ndarray) -> np.ndarray:
    """Hash of every three consecutive words from the hashes of the two pairs in them."""
    return joined(pairs[:-1], pairs[1:])


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A trigram's hash from those of its first and last two words."""
    return mix(first * _gram_factor[0] + second * _gram_factor[1] + np.uint64(3))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What modified Kneser-Ney takes from counts of one, two and more, from the numbers of n-grams counted one to four times."""
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
        d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    else:
        d1 = d2 = d3 = 0.5
    return [min(max(x, 0.1), i - 0.1 + 0.1 * (i > 1)) for i, x in ((1, d1), (2, d2), (3, d3))]


_SHARDED = "shard int, kind int, x binary, y binary, z binary, n binary, g long, p double, total double, off double"
#: Kinds of rows of a shard: trigrams and bigrams that texts hold, questions for contexts, answers, a shard's own contexts, words.
TRIGRAMS, BIGRAMS, ASKED, ANSWER, OWN, WORD = range(6)


def _shard_row(shard: int, kind: int, *binary: bytes | None, g: int | None = None) -> tuple:
    return (shard, kind, *binary, *[None] * (4 - len(binary)), g, None, None, None)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted, and the sum of each array over every key's places."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _off(n: np.ndarray, d: list[float]) -> np.ndarray:
    """What counts are discounted by."""
    return np.minimum(np.array(d)[np.minimum(n, 3) - 1], 0.999 * n)


def _counted(shards: int, lo: int, hi: int):
    """Rows of a block's distinct trigrams (last pair, first pair, count) and bigrams (hash, first word, last word) whose
    last pair or hash is in one of the shards ``lo`` to ``hi``, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch)
            for start, end in pieces(offsets, 4 * BLOCK_BYTES):
                h, document = with_ends(Words(buf, offsets[start : end + 1], SPACED, lower=False))
                pair = grams(h, 2)
                shard = part_of(pair, shards)
                here = (lo <= shard) & (shard < hi)
                at = np.flatnonzero(here & _inside(document, 2)) if len(pair) else np.zeros(0, np.int64)
                g, first = np.unique(pair[at], return_index=True)
                two = g, h[at[first]], h[at[first] + 1]
                at = np.flatnonzero(here[1:] & _inside(document, 3)) if len(pair) > 1 else np.zeros(0, np.int64)
                _, first, times = np.unique(joined(pair[at], pair[at + 1]), return_index=True, return_counts=True)
                at = at[first]
                order = np.argsort(pair[at + 1])
                at = at[order]
                three = pair[at + 1], pair[at], times[order].astype(np.uint32)
                del h, document, pair, shard, here, at, first, order
                made = []
                cut = lambda g: np.searchsorted(part_of(g, shards), np.arange(lo, hi + 1)).tolist()
                for kind, (x, y, z) in ((TRIGRAMS, three), (BIGRAMS, two)):
                    ends = cut(x)
                    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        if a < b:
                            made.append(_shard_row(lo + i, kind, pack_sorted(x[a:b]), y[a:b].tobytes(), pack(z[a:b]) if kind == TRIGRAMS else z[a:b].tobytes()))
                if made:
                    yield _rows(made, _SHARDED)
                release()

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """Each shard of a partition with its rows by kind: (shard, {kind: [(x, y, z, n)]})."""
    held: dict[int, dict[int, list]] = {}
    for batch in batches:
        for i, (shard, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            held.setdefault(shard, collections.defaultdict(list))[kind].append(tuple(batch.column(c)[i].as_py() for c in range(2, 6)))
    for shard in list(held):
        yield shard, held.pop(shard)
        release()


def _many(rows: list, column: int, read_) -> np.ndarray:
    return np.concatenate([read_(r[column]) for r in rows] or [np.zeros(0, np.uint64)])


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _u32(data: bytes) -> np.ndarray:
    return unpack(data, np.uint32).astype(np.int64)


def _f64(data: bytes) -> np.ndarray:
    return unpack(data, np.uint64).view(np.float64)


_KINDS = ", ".join(f"k{i} long" for i in (1, 2, 3, 4))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's distinct trigrams and their counts, and its bigrams with the number of different words before them; those
    only at a start count once. First pairs and words are places in a sorted array of the distinct ones. Each row has how
    many of its counts are one to four."""
    for shard, rows in _by_shard(batches):
        b, a, n = _many(rows[TRIGRAMS], 0, unpack_sorted), _many(rows[TRIGRAMS], 1, _u64), _many(rows[TRIGRAMS], 2, _u32)
        _, first, place = np.unique(joined(a, b), return_index=True, return_inverse=True)
        n = np.bincount(place, n, minlength=len(first)).astype(np.int64)
        order = np.argsort(b[first])
        a, b, n = a[first][order], b[first][order], n[order]
        g, first = np.unique(_many(rows[BIGRAMS], 0, unpack_sorted), return_index=True)
        one, two = (_many(rows[BIGRAMS], c, _u64)[first] for c in (1, 2))
        longer, times = np.unique(b, return_counts=True)
        before = np.ones(len(g), dtype=np.int64)
        before[np.searchsorted(g, longer)] = times
        made = []
        if len(b):
            first, place = np.unique(a, return_inverse=True)
            made.append((*_shard_row(shard, TRIGRAMS, pack_sorted(b), pack_sorted(first), pack(place.astype(np.uint32)), pack(n.astype(np.uint32))), *np.bincount(n[n < 5], minlength=5)[1:].tolist()))
        if len(g):
            word, place = np.unique(np.append(one, two), return_inverse=True)
            made.append((*_shard_row(shard, BIGRAMS, pack_sorted(g), pack_sorted(word), pack(place.astype(np.uint32)), pack(before.astype(np.uint32))), *np.bincount(before[before < 5], minlength=5)[1:].tolist()))
        yield _rows(made, f"{_SHARDED}, {_KINDS}")


def _kinds(rows: DataFrame, kind: int) -> collections.Counter:
    """How many n-grams of a kind have a count of one to four."""
    row = rows.where(F.col("kind") == kind).agg(*(F.sum(f"k{i}") for i in (1, 2, 3, 4))).first()
    return collections.Counter({i + 1: n or 0 for i, n in enumerate(row)})


def _of_kinds(kinds: collections.Counter) -> list[float]:
    return discounts(*(kinds[i] for i in (1, 2, 3, 4)))


def _words(d: list[float]):
    """(g, n, total, off) of each word of a row of bigrams: those it ends, and counts and discounts of those it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, z, n in zip(*(batch.column(c) for c in (3, 4, 5)), strict=True):
                g, n = unpack_sorted(y.as_py()), _u32(n.as_py())
                one, two = np.split(_u32(z.as_py()), 2)
                sums = [np.bincount(at, w, minlength=len(g)) for at, w in ((two, None), (one, n), (one, _off(n, d)))]
                yield pa.RecordBatch.from_arrays([pa.array(signed(g)), *(pa.array(s.astype(np.int64)) for s in sums[:2]), pa.array(sums[2])], names=["g", "n", "total", "off"])
        release()

    return run


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, g) of every distinct word of a row of bigrams."""
    for batch in batches:
        for shard, y in zip(batch.column(0), batch.column(3), strict=True):
            g = unpack_sorted(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), shard.as_py(), np.int32)), pa.array(signed(g))], names=["shard", "g"])
    release()


def _contexts(shards: int, d: list[float]):
    """A row of trigrams asks each shard for its contexts there, sorted, with their counts and discounts here; ``n`` names the asker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, y, z, n in zip(*(batch.column(c) for c in (0, 3, 4, 5)), strict=True):
                a, place, n = unpack_sorted(y.as_py()), _u32(z.as_py()), _u32(n.as_py())
                total, off = np.bincount(place, n), np.bincount(place, _off(n, d))
                cut = np.searchsorted(part_of(a, shards), np.arange(shards + 1)).tolist()
                who = shard.as_py().to_bytes(4, "little")
                made = [_shard_row(i, ASKED, pack_sorted(a[lo:hi]), pack(total[lo:hi].astype(np.uint32)), pack(off[lo:hi].view(np.uint64)), who) for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if lo < hi]
                yield _rows(made, _SHARDED)
        release()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts summed over all askers: to each the discounts of those it asked for, in their order, and to the shard all sums."""
    for shard, rows in _by_shard(batches):
        every = [unpack_sorted(r[0]) for r in rows[ASKED]]
        a, total, off = _sums(np.concatenate(every), _many(rows[ASKED], 1, _u32), _many(rows[ASKED], 2, _f64))
        here = shard.to_bytes(4, "little")
        for asked, r in zip(every, rows[ASKED], strict=True):
            yield _rows([_shard_row(int.from_bytes(r[3], "little"), ANSWER, pack(off[np.searchsorted(a, asked)].astype(np.float32).view(np.uint32)), None, None, here)], _SHARDED)
        yield _rows([_shard_row(shard, OWN, pack_sorted(a), pack(total.astype(np.uint32)), pack(off.view(np.uint64)))], _SHARDED)


def _gains(shards: int, d2: list[float], d3: list[float]):
    """(range, grams, gains) of a shard's trigrams and bigrams, from their counts and what was answered about contexts and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], collections.defaultdict(list)
        for batch in batches:
            kind = batch.column(1).to_numpy()
            held.append(batch.filter(pa.array(kind != WORD)))
            word = batch.filter(pa.array(kind == WORD))
            shard = word.column(0).to_numpy()
            for i in np.unique(shard).tolist():
                words[i].append(tuple(word.column(c).fill_null(0).to_numpy(zero_copy_only=False)[shard == i] for c in (6, 7, 8, 9)))
        for shard, rows in _by_shard(iter(held)):
            word, p, total, off = (np.concatenate(c) for c in zip(*words.pop(shard), strict=True))
            order = np.argsort(word.view(np.uint64))
            word, p, total, off = word.view(np.uint64)[order], p[order], total[order], off[order]
            (two,) = rows[BIGRAMS]
            g, n = unpack_sorted(two[0]), _u32(two[3])
            first, last = np.split(np.searchsorted(word, unpack_sorted(two[1]))[_u32(two[2])], 2)
            lower = off[first] / total[first] * p[last]
            p = (n - _off(n, d2)) / total[first] + lower
            gain = np.log(p / lower)
            for own, t, o in (r[:3] for r in rows[OWN]):  # a pair with an end is followed by nothing
                gain[np.searchsorted(g, unpack_sorted(own))] += np.log(_f64(o) / _u32(t))
            h = g
            if rows[TRIGRAMS]:
                (three,) = rows[TRIGRAMS]
                b, contexts, place, n = unpack_sorted(three[0]), unpack_sorted(three[1]), _u32(three[2]), _u32(three[3])
                # answers of the shards in their order are those for all contexts in theirs
                answers = sorted(rows[ANSWER], key=lambda r: int.from_bytes(r[3], "little"))
                left = np.concatenate([unpack(r[0], np.uint32).view(np.float32) for r in answers]).astype(np.float64)
                if len(contexts) != len(left):
                    raise RuntimeError("a shard lacks answers")
                h = np.append(g, joined(contexts[place], b))
                gain = np.append(gain, np.log1p((n - _off(n, d3)) / left[place] / p[np.searchsorted(g, b)]))
            yield _ranges(h, gain, shards)

    return run


def _ranges(h: np.ndarray, gain: np.ndarray, ranges: int) -> pa.RecordBatch:
    """N-grams cut into ranges of their hashes: sorted, without the dropped bits and compressed."""
    order = np.argsort(h)
    h, gain = h[order], gain[order].astype(np.float32).view(np.uint32)
    cut = np.searchsorted(part_of(h, ranges), np.arange(ranges + 1)).tolist()
    h = h >> np.uint64(DROPPED_BITS)
    return _rows([(i, pack_sorted(h[lo:hi]), pack(gain[lo:hi])) for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if lo < hi], _MODEL)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(-1, grams, gains): rows of up to ``ROW_GRAMS`` n-grams of a range, sorted: the closer they are, the less they take."""
    held = collections.defaultdict(list)
    for batch in batches:
        for where, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[where].append(row)
    for where in list(held):
        rows = held.pop(where)
        h, gain = np.concatenate([unpack_sorted(g) for g, _ in rows]), np.concatenate([unpack(x, np.uint32) for _, x in rows])
        order = np.argsort(h)
        for at in range(0, len(h), ROW_GRAMS):
            some = order[at : at + ROW_GRAMS]
            yield _rows([(-1, pack_sorted(h[some]), pack(gain[some]))], _MODEL)
        release()


def _packed(ranges: int):
    """(range, grams, gains) of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _ranges(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), ranges)
        release()

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's bitmap of the model's n-grams, in slices from 0 on."""
    bits = np.zeros(BITMAP // 8, dtype=np.uint8)
    for batch in batches:
        for row in batch.column(0):
            bits |= local_bitmap(unpack_sorted(row.as_py()) << np.uint64(DROPPED_BITS))
    held = np.flatnonzero(bits.reshape(-1, SLICE).any(axis=1)).tolist()
    if held:
        yield _rows([(i, bits[i * SLICE : (i + 1) * SLICE].tobytes(), None) for i in held], _MODEL)
    release()


def fit(trusted: DataFrame, text: str = "text") -> DataFrame:
    """(slice, grams, gains) of every n-gram seen in the whole texts given: rows of n-grams have slice -1, those of their
    bitmap follow from 0 on, and one of slice -2 has the log probability of an unseen word. Empty without texts."""
    spark = trusted.sparkSession
    ship(spark)

    def kept(df: DataFrame, what: str, *over: DataFrame) -> DataFrame:
        """Stored, whereupon its shuffles and the tables ``over`` go: the disk holds one step's at a time."""
        out = stored(df, what)
        dropped(*over)
        swept(spark)
        return out

    texts = kept(trusted.select(F.col(text).alias("text")), "trusted")
    many, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not many:
        return texts.select(F.lit(0).alias("slice"), F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("gains")).where("false")
    parts = min(PARTS, 1 + (size or 0) // PART_BYTES)
    each = max(1, -(-(size or 0) // (parts * FIT_BYTES)))  # shards of a part
    shards = parts * each
    counted = []
    for i in range(parts):
        rows = texts.mapInArrow(_counted(shards, i * each, (i + 1) * each), _SHARDED)
        counted.append(kept(rows.repartition(each, "shard").mapInArrow(_distinct, f"{_SHARDED}, {_KINDS}"), "trigrams", *([texts] if i == parts - 1 else [])))
        del rows
    every = reduce(DataFrame.union, counted)
    d2, d3 = (_of_kinds(_kinds(every, kind)) for kind in (BIGRAMS, TRIGRAMS))
    # a text has an end, and what has no word before it counts once
    ends = spark.range(1).select(F.lit(int(signed(np.array([END], np.uint64))[0])).alias("g"), *(F.lit(0).cast(t).alias(n) for n, t in (("n", "long"), ("total", "long"), ("off", "double"))))
    bigrams = every.where(F.col("kind") == BIGRAMS).drop(*(f"k{i}" for i in (1, 2, 3, 4)))
    one = bigrams.mapInArrow(_words(d2), "g long, n long, total long, off double").union(ends).groupBy("g").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n"), F.sum("total").alias("total"), F.sum("off").alias("off"))
    one = kept(one, "words")
    d1 = _of_kinds(collections.Counter({r["n"]: r["rows"] for r in one.where("n < 5").groupBy("n").agg(F.count("*").alias("rows")).collect()}))
    off = F.least(F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2]), 0.999 * F.col("n"))
    size, total, left = one.agg(F.count("*"), F.sum("n"), F.sum(off)).first()
    floor = left / total / (size + 1)
    words = one.select("g", ((F.col("n") - off) / total + floor).alias("p"), F.col("total").cast("double").alias("total"), "off")
    trigrams_ = every.where(F.col("kind") == TRIGRAMS).drop(*(f"k{i}" for i in (1, 2, 3, 4)))
    contexts = kept(trigrams_.mapInArrow(_contexts(shards, d3), _SHARDED).repartition(shards, "shard").mapInArrow(_answered, _SHARDED), "contexts")
    packed = []
    empty = [F.lit(None).cast("binary").alias(c) for c in "xyzn"]
    for i, part in enumerate(counted):
        part = part.drop(*(f"k{i}" for i in (1, 2, 3, 4)))
        asked = part.where(F.col("kind") == BIGRAMS).mapInArrow(_needed, "shard int, g long")
        known = asked.join(words, "g").select("shard", F.lit(WORD).alias("kind"), *empty, "g", "p", "total", "off")
        rows = part.union(contexts.where(F.col("shard").between(i * each, (i + 1) * each - 1))).union(known)
        packed.append(kept(rows.repartition(each, "shard").mapInArrow(_gains(shards, d2, d3), _MODEL), "trigrams", counted[i]))
        del rows, known, asked
    gain = F.log(F.col("p") / floor) + F.when(F.col("total") > 0, F.log(F.col("off") / F.col("total"))).otherwise(0.0)
    packed.append(kept(words.select("g", gain.alias("gain")).mapInArrow(_packed(shards), _MODEL), "packed", one, contexts))
    packed = kept(reduce(DataFrame.union, packed).repartition(shards, "slice").mapInArrow(_merged, _MODEL), "model", *packed)
    bits = packed.select("grams").mapInArrow(_bits, _MODEL).groupBy("slice").agg(F.bitmap_or_agg("grams").alias("grams")).select("slice", "grams", F.lit(None).cast("binary").alias("gains"))
    unseen = spark.range(1).select(F.lit(-2).alias("slice"), F.lit(None).cast("binary").alias("grams"), F.lit(np.array([np.log(floor)]).tobytes()).alias("gains"))
    return packed.union(kept(bits.union(unseen), "bitmap"))


_ROW = "shard int, block string, docs int, grams binary, held binary, gains binary"
_SUMS = "block string, docs int, ids binary, sums binary"


def _holders(g: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The distinct n-grams of a sorted array, and which documents hold each of them how often: a document is the step from
    the n-gram's last one, as frequent n-grams are in most documents."""
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    pair = new.copy()
    pair[1:] |= who[1:] != who[:-1]
    at = np.flatnonzero(pair)
    step = who[at].astype(np.uint32)
    step[1:] -= np.where(new[at[1:]], 0, who[at[:-1]]).astype(np.uint32)
    times = np.diff(np.flatnonzero(new[at]), append=len(at))
    often = np.diff(at, append=len(g))
    return g[new], b"".join(len(z).to_bytes(8, "little") + z for z in (pack(x.astype(np.uint32)) for x in (times, step, often)))


def _held(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, who, often) as ``_holders`` packed them: documents of each n-gram, which ones, occurrences in each."""
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + size], np.uint32).astype(np.int64))
        at += 8 + size
    times, step, often = out
    summed = np.cumsum(step)
    first = np.cumsum(times) - times
    return times, summed - np.repeat(summed[first] - step[first], times), often


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])


def _ask(shards: int, known):
    """Blocks' questions: a shard's n-grams with the documents that hold them; and a row with the block's ids and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offsets, _ = text_column(batch)
            for lo, hi in pieces(offsets, BLOCK_BYTES):
                asked, owner, tokens = [], [], []
                for a, b in pieces(offsets[lo : hi + 1]):
                    h, document = with_ends(Words(buf, offsets[lo + a : lo + b + 1], SPACED, lower=False))
                    tokens.append(np.bincount(document, minlength=b - a))
                    pairs = grams(h, 2)
                    maybe = None
                    for n, g in ((1, h), (2, pairs), (3, trigrams(pairs))):
                        if len(g):
                            # the model has an n-gram only with both shorter ones in it
                            maybe = in_bitmap(known.value, g) & (True if maybe is None else maybe[:-1] & maybe[1:])
                            use = np.flatnonzero(maybe & _inside(document, n))
                            asked.append(g[use])
                            owner.append(a + document[use])
                g, who, count = np.concatenate(asked), np.concatenate(owner), np.concatenate(tokens)
                order = np.argsort(g, kind="stable")  # an n-gram's documents stand in order already
                g, who = g[order], who[order]
                number += 1
                block = f"{TaskContext.get().partitionId()}-{number}-{int(ids[lo : hi].view(np.uint64).sum()):x}"
                cut, made = np.searchsorted(part_of(g, shards), np.arange(shards + 1)), []
                g = g >> np.uint64(DROPPED_BITS)
                for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if x < y:
                        distinct, held = _holders(g[x:y], who[x:y])
                        made.append((i, block, hi - lo, pack_sorted(distinct), held, None))
                made.append((number % shards, block, len(made), None, ids[lo:hi].tobytes(), count.astype(np.int64).tobytes()))
                yield _rows(made, _ROW)
                release()

    return run


def _dealt(shards: int):
    """Rows of the model by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams_, gains in zip(batch.column(0), batch.column(1), strict=True):
                g, x = unpack_sorted(grams_.as_py()), unpack(gains.as_py(), np.uint32)
                cut = np.searchsorted(part_of(g << np.uint64(DROPPED_BITS), shards), np.arange(shards + 1)).tolist()
                yield _rows([(i, None, None, pack_sorted(g[lo:hi]), None, pack(x[lo:hi])) for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if lo < hi], _ROW)
        release()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's gains joined with the questions to it: the sum for each document of a block."""
    model: dict[int, list] = {}
    asked: dict[int, list] = {}
    for batch in batches:
        for i, (place, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if block is None:
                model.setdefault(place, []).append((unpack_sorted(batch.column(3)[i].as_py()), unpack(batch.column(5)[i].as_py(), np.uint32).view(np.float32)))
            elif batch.column(3)[i].is_valid:
                asked.setdefault(place, []).append((batch, i))
            else:
                yield _rows([(block, batch.column(2)[i].as_py(), batch.column(4)[i].as_py(), batch.column(5)[i].as_py())], _SUMS)
    for place, rows in asked.items():
        parts = model.pop(place, [])
        gram = np.concatenate([g for g, _ in parts] or [np.zeros(0, np.uint64)])
        gain = np.concatenate([x for _, x in parts] or [np.zeros(0, np.float32)]).astype(np.float64)
        order = np.argsort(gram)
        gram, gain = np.append(gram[order], np.uint64(2**64 - 1)), np.append(gain[order], 0.0)
        for batch, i in rows:
            block, docs, h, held = (batch.column(c)[i].as_py() for c in (1, 2, 3, 4))
            times, who, often = _held(held)
            h = unpack_sorted(h)
            at = np.searchsorted(gram, h)
            value = np.where(gram[at] == h, gain[at], 0.0)
            sums = np.bincount(who, weights=np.repeat(value, times) * often, minlength=docs)
            held = np.flatnonzero(sums)
            yield _rows([(block, None, held.astype(np.uint32).tobytes(), sums[held].tobytes())], _SUMS)
        rows.clear()
        release()


def _whole(unknown: float):
    """(id, lm_tokens, perplexity) from the sums of a block's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, sums = {}, {}
        for batch in batches:
            for block, asked, ids, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if asked is None:
                    sums.setdefault(block, []).append((np.frombuffer(ids, np.uint32), np.frombuffer(values, np.float64)))
                else:
                    heads[block] = np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64), asked
        for block, (ids, tokens, asked) in heads.items():
            parts = sums.pop(block, [])
            if len(parts) != asked:
                raise RuntimeError("a block lacks sums: it was cut otherwise when a lost task ran again")
            total = np.zeros(len(ids))
            for who, values in parts:
                total[who] += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.exp(-(total / tokens + unknown)), pa.float64())], names=["id", "lm_tokens", "perplexity"]
            )

    return run


def perplexities(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lm_tokens, perplexity) of every row (id, text). A null text counts as empty, which is an end only."""
    spark = texts.sparkSession
    ship(spark)
    bits, unknown = np.zeros(BITMAP // 8, dtype=np.uint8), 0.0
    for r in model.where("slice <> -1").toLocalIterator():  # a bitmap of a fixed size
        if r["slice"] < 0:
            unknown = float(np.frombuffer(r["gains"])[0])
        else:
            bits[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["grams"], np.uint8)
    known = spark.sparkContext.broadcast(bits)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-size // SHARD_BYTES))
    passes = min(PASSES, 1 + size // PASS_BYTES)
    done = []
    for i in range(passes):  # one pass's questions are on disk at a time
        here = texts.select("id", "text").where(F.pmod("id", F.lit(passes)) == i)
        questions = here.mapInArrow(_ask(shards, known), _ROW)
        answers = model.where("slice = -1").select("grams", "gains").mapInArrow(_dealt(shards), _ROW)
        summed = answers.union(questions).repartition(shards, "shard").mapInArrow(_sum, _SUMS)
        found = summed.repartition(max(1, shards // 4), "block").mapInArrow(_whole(unknown), "id long, lm_tokens long, perplexity double")
        done.append(stored(found, "scores"))
        del here, questions, answers, summed, found
        swept(spark)
    return reduce(DataFrame.union, done)


def score(docs: DataFrame, model: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``lm_tokens`` (words and an end) and ``perplexity``. A null text counts as empty."""
    docs = docs.drop("lm_tokens", "perplexity")
    row, name = fresh(docs, "row", "id")
    rows = docs.withColumn(row, F.xxhash64(*([key] if key else []), text))
    found = perplexities(rows.select(F.col(row).alias("id"), F.col(text).alias("text")), model).dropDuplicates(["id"])
    return rows.join(found.withColumnRenamed("id", name), F.col(row) == F.col(name), "left").drop(row, name)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label_key: str = "doc_id",
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    train_documents: int | None = TRAIN_DOCUMENTS,
) -> DataFrame:
    """Every row of ``docs`` with ``lm_tokens``, ``perplexity``, ``threshold`` and ``keep``.

    Trusted are the keys that ``labels`` gives quality 1 and not toxic 1. Null and empty texts have an end
    only and are judged like others; a null language has the threshold over all languages; a null key is
    never trusted. About ``train_documents`` of the trusted train, short ones; without a number, half of them all
    do, of any length. Repeated rows are judged alike. Without trusted documents, as with empty tables, everything
    is kept and the threshold is null. Columns of ``docs`` with the four new names are replaced; others pass
    through whatever their names. A block is at least a document: a task holds about two hundred bytes for
    each byte of its longest text.
    """
    docs = docs.drop("lm_tokens", "perplexity", "threshold", "keep")
    good = labels.where("quality = 1 and coalesce(toxic, 0) <> 1").select(F.col(label_key).alias("trusted")).where("trusted is not null").distinct()
    plain = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("id"))
    total = good.count()
    # at most half of the trusted documents train; thresholds come from the others
    half = 1 << 29
    share = F.pmod(F.xxhash64(F.lit("trusted"), F.col("trusted")), F.lit(1 << 30)) < (half if train_documents is None else min(train_documents * (1 << 30) // max(1, total), half))
    usable = plain.where(F.length("text") >= 1 if train_documents is None else F.length("text").between(1, TRAIN_CHARS)).select("key", "text")
    trusted = usable.join(good.where(share), F.col("key") == F.col("trusted"), "left_semi")
    model = fit(trusted.select("text")) if total else None
    if not total or model.isEmpty():
        return docs.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("lm_tokens", "long"), ("perplexity", "double"), ("threshold", "double"))), F.lit(True).alias("keep"))
    scored = perplexities(plain.select("id", "text"), model).dropDuplicates(["id"])
    scored = stored(plain.select("id", "key", "lang").join(scored, "id"), "perplexity")
    known = scored.join(good.where(~share), F.col("key") == F.col("trusted"), "left_semi")
    limit = lambda: F.percentile_approx("perplexity", quantile, 10_000).alias("limit")
    by_language = stored(known.groupBy("lang").agg(limit()).where("lang is not null"), "limits")
    overall = known.agg(limit()).first()[0] or float("inf")
    judged = scored.dropDuplicates(["id"]).drop("key").join(by_language, "lang", "left")  # a third of all rows may be of one language: the limits are few rows
    threshold = F.coalesce("limit", F.lit(overall)) * F.lit(margin) * F.exp(F.lit(SLACK) / F.sqrt("lm_tokens"))
    row, name = fresh(docs, "row", "id")
    judged = judged.select(F.col("id").alias(name), "lm_tokens", "perplexity", threshold.alias("threshold")).withColumn("keep", F.col("perplexity") <= F.col("threshold"))
    return docs.withColumn(row, F.xxhash64(key, text)).join(judged, F.col(row) == F.col(name), "left").drop(row, name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its perplexity under the model of trusted text, its language's threshold and the verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify(docs, read(spark, sf_dir, "labels"), train_documents=None)
    return out.select("doc_id", "lang", F.col("lm_tokens").alias("n_tokens"), "perplexity", "threshold", "keep")


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
