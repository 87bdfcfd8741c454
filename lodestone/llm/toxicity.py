"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of the character n-grams of its lower-cased words, each word marked at both ends. On a
bounded sample of labelled texts every n-gram that occurs in ``LEAST_TEXTS`` of them has a log-count ratio,
the log of its smoothed share of the toxic texts' n-grams over that of the others'; those within
``LEAST_ERRORS`` standard errors of zero are left out. A logistic regression is
trained, in numpy, on the sets with each n-gram scaled by its ratio; ratio and weight then fold into one
number an n-gram, and a text's score is the logistic of its n-grams' sum. N-grams are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import SPACED, Words, mix, pieces, read, ship, text_column, widened

ORDERS = (2, 3, 4, 5, 6, 7, 8)
#: The sample: so many texts of each label, chosen by a hash of the key, none of more characters.
TRAIN_PER_LABEL, TRAIN_CHARS = 1500, 20_000
#: N-grams count that occur in so many texts of it and whose ratio is so many standard errors from zero.
LEAST_TEXTS, LEAST_ERRORS = 3, 2.0
SMOOTHING, PENALTY, ROUNDS = 1.0, 1e-3, 150
SLOT_BITS = 20
PIECE, WORDS_AT_ONCE = 4 << 20, 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of lower-cased words, how many each word has)."""
    text = "".join([f"\x02{w}\x03" for w in words]).lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(text, dtype=np.uint32).astype(np.uint64)
    end = np.flatnonzero(points == 3)
    n = np.diff(end, prepend=-1)
    left = np.repeat(end + 1, n) - np.arange(len(points))
    hashes, fits = np.zeros((len(points), len(ORDERS)), dtype=np.uint64), np.zeros((len(points), len(ORDERS)), dtype=bool)
    code = np.zeros(len(points), dtype=np.uint64)
    for k in range(1, max(ORDERS) + 1):
        reach = len(points) - k + 1
        if reach <= 0:
            break
        code = code[:reach] * _STEP + points[k - 1 :] + np.uint64(1)
        if k in ORDERS:
            i = ORDERS.index(k)
            hashes[:reach, i], fits[:reach, i] = mix(code + np.uint64(k)), left[:reach] >= k
    return hashes[fits], np.add.reduceat(fits.sum(axis=1), end + 1 - n) if len(n) else n


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., n[0] of them, then those of start[1], and so on."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


@dataclass
class Model:
    """Sorted hashes of the n-grams, what each adds, and the sum of a text without any."""

    grams: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    bias: float = 0.0
    slots: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self):
        """A table from a hash's high bits to one of the n-grams that have them; the few others are searched."""
        self.slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.slots[self.grams >> np.uint64(64 - SLOT_BITS)] = np.arange(1, len(self.grams) + 1)

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the n-grams, or -1."""
        out = self.slots[h >> np.uint64(64 - SLOT_BITS)]
        out -= 1
        other = np.flatnonzero(out >= 0)
        other = other[self.grams[out[other]] != h[other]]
        at = np.minimum(np.searchsorted(self.grams, h[other]), len(self.grams) - 1)
        out[other] = np.where(self.grams[at] == h[other], at, -1) if len(other) else -1
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of the known n-grams of words, how many each word has)."""
        h, n = word_grams(words)
        at = self.place(h)
        known = at >= 0
        return at[known], np.bincount(np.repeat(np.arange(len(words)), n)[known], minlength=len(words))

    def sums(self, w: Words) -> np.ndarray:
        """The sum of each text's distinct n-grams, and the bias."""
        out = np.full(len(w.first) - 1, self.bias)
        if not len(w.hash):
            return out
        _, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        raw, start, end = w.bytes.tobytes(), w.start[at].tolist(), w.end[at].tolist()
        found, n = self.words([raw[a:b].decode(errors="replace") for a, b in zip(start, end, strict=True)])
        first, seen = np.cumsum(n) - n, np.zeros(len(self.grams), dtype=bool)
        for d in np.flatnonzero(w.counts).tolist():
            distinct = np.unique(inverse[w.first[d] : w.first[d + 1]])
            seen[:] = False
            for i in range(0, len(distinct), WORDS_AT_ONCE):
                some = distinct[i : i + WORDS_AT_ONCE]
                seen[found[ragged(first[some], n[some])]] = True
            out[d] += self.weight[seen].sum()
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def train(texts: list[str], toxic: list[int], share: float | None = None, rounds: int = ROUNDS) -> Model:
    """Fit on whole texts; ``share`` is the share of toxic texts that scores suppose, even odds if it is not given.

    Without texts of both labels no n-gram counts, and the score is the smoothed share for every text.
    """
    y = np.array(toxic, dtype=np.float64)
    prior = 0.0 if share is None else float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    sets = []
    for text in texts:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        w = Words(raw, np.array([0, len(raw)]), SPACED, lower=False)
        data, at = raw.tobytes(), np.unique(w.hash, return_index=True)[1]
        sets.append(np.unique(word_grams([data[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])[0]))
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    del sets
    grams, texts_with = np.unique(every, return_counts=True)
    grams = grams[texts_with >= LEAST_TEXTS]
    del texts_with
    if not len(grams):
        return Model(grams, np.zeros(0), prior)
    place = Model(grams, np.zeros(0)).place(every)
    del every
    place, row = place[place >= 0], row[place >= 0]
    held = [np.bincount(place, weights=(y == k).astype(float)[row], minlength=len(grams)) + SMOOTHING for k in (0, 1)]
    ratio = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())
    clear = np.abs(ratio) >= LEAST_ERRORS * np.sqrt(1 / held[0] + 1 / held[1])
    grams, ratio = grams[clear], ratio[clear]
    row, place = row[clear[place]], (np.cumsum(clear) - 1)[place[clear[place]]]
    # each label weighs half; Nesterov's method with a step from the largest row
    by_row = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    total = lambda v: np.bincount(row, weights=(v * ratio)[place], minlength=len(y))
    step = 1 / (0.25 * float((by_row * total(ratio)).sum()) + PENALTY)
    w = np.zeros(len(grams))
    b, ahead, ahead_b, speed = 0.0, w, 0.0, 1.0
    for _ in range(rounds):
        error = by_row * (_logistic(total(ahead) + ahead_b) - y)
        slope = ratio * np.bincount(place, weights=error[row], minlength=len(grams)) + PENALTY * ahead
        new, new_b = ahead - step * slope, ahead_b - step * error.sum()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, ahead_b = new + (speed - 1) / faster * (new - w), new_b + (speed - 1) / faster * (new_b - b)
        w, b, speed = new, new_b, faster
    return Model(grams, w * ratio, b + prior)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int = TRAIN_PER_LABEL, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int], float]:
    """(texts, labels, share of label 1) of a bounded sample of labelled documents, by a hash of the key.

    Labels other than 0 and 1 do not count, nor rows whose key or text is null. The chosen keys are few, so
    they are sent to the documents; the order by hash, key and text makes the choice the same in every run.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key), F.col(label).alias("label")).distinct()
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    hashed = F.xxhash64(F.lit("sample"), F.col(key))
    place: Column = F.pmod(hashed, F.lit(1 << 30))
    texts, said = [], []
    for y in (0, 1):
        part = min(1.0, 2 * per_label / max(1, sizes.get(y, 0)))
        chosen = known.where((F.col("label") == y) & (place < int(part * (1 << 30)))).orderBy(hashed, key).limit(2 * per_label)
        rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= chars)).join(F.broadcast(chosen), key)
        rows = rows.select(hashed.alias("place"), F.col(key), F.col(text)).orderBy("place", key, text).limit(per_label)
        got = [r[2] for r in rows.collect()]
        texts += got
        said += [y] * len(got)
    return texts, said, (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``toxicity``, the probability of label 1.

    A null or empty text has no n-gram and the score of the bias. Other columns pass through unread; a
    column with the new name is replaced. Equal texts score alike. An empty table gives an empty result.
    A task holds about a hundred bytes for each byte of its longest text.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("toxicity")
    schema = widened(docs, "toxicity double")
    shared = spark.sparkContext.broadcast(model)  # n-grams of the sample: its size has a bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch, text)
            for lo, hi in pieces(offsets, PIECE):
                z = shared.value.sums(Words(buf, offsets[lo : hi + 1], SPACED, lower=False))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(_logistic(z), pa.float64())], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its toxicity at even odds, learned from four fifths of the labelled documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    texts, toxic, _ = sample(docs.where(fold != 0), read(spark, sf_dir, "labels").where(fold != 0), "doc_id", "text", "toxic")
    out = score(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), train(texts, toxic))
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE_SQL: dict[str, str] = {}
