"""Language identification: averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its words' byte n-grams. Embeddings and the output layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents
(``train_per_language`` of each language, chosen by a hash of the key). A temperature fitted on a part
that training does not see calibrates the probabilities; below the confidence at which that part's
precision reaches ``precision`` a prediction is marked as rejected.

After training, an n-gram's embedding and the output layer fold into one row of logits, so prediction
sums table rows: once for each distinct word of a batch, then over each document's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import LETTERS, Words, mix, pieces, read, ship, text_column, widened

BUCKETS = 1 << 16
DIMENSION = 16
ORDERS = (1, 2, 3, 4)
TRAIN_PER_LANGUAGE = 1000
#: Longer documents are not chosen for training; the driver holds at most languages * train * this.
TRAIN_CHARS = 20_000
UNKNOWN = "und"


def word_grams(w: Words, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of the chosen words, how many each word has); words are marked at both ends."""
    n = w.length[distinct] + 2
    at = np.cumsum(n) - n
    data = np.zeros(int(n.sum()), dtype=np.uint64)
    inner = np.ones(len(data), dtype=bool)
    inner[at] = inner[at + n - 1] = False
    data[at], data[at + n - 1] = 1, 2
    source = np.repeat(w.start[distinct] - at - 1, n)[inner] + np.flatnonzero(inner)
    data[inner] = w.bytes[source]
    left = np.repeat(at + n, n) - np.arange(len(data))
    word = np.repeat(np.arange(len(n)), n)
    parts, owners = [], []
    code = np.zeros(len(data), dtype=np.uint64)
    for k in range(1, max(ORDERS) + 1):
        reach = len(data) - k + 1
        if reach <= 0:
            break
        code[:reach] = code[:reach] * np.uint64(257) + data[k - 1 :]
        if k in ORDERS:
            keep = left[:reach] >= k
            parts.append((mix(code[:reach][keep] + np.uint64(k << 56)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(word[:reach][keep])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.bincount(owner, minlength=len(n))


def featurize(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word of each word, n-gram buckets by distinct word, their counts)."""
    _, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    buckets, n = word_grams(w, at)
    return inverse, buckets, n, at


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    least: float = 0.0

    def raw(self, w: Words) -> np.ndarray:
        """Logits of every document of ``w``."""
        out = np.tile(self.bias, (len(w.first) - 1, 1))
        if len(w.hash):
            inverse, buckets, n, _ = featurize(w)
            per_word = np.add.reduceat(self.logits[buckets], np.cumsum(n) - n, axis=0)
            table = np.concatenate([per_word, n[:, None]], axis=1)
            some = np.flatnonzero(w.counts)
            total = np.add.reduceat(table[inverse], w.first[some], axis=0, dtype=np.float64)
            out[some] += total[:, :-1] / total[:, -1:]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    w = Words(raw, np.array([0, len(raw)]), LETTERS)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0)
    inverse, buckets, n, _ = featurize(w)
    weight = np.repeat(np.bincount(inverse), n)
    seen, place = np.unique(buckets, return_inverse=True)
    total = np.bincount(place, weights=weight)
    return seen, (total / total.sum()).astype(np.float64)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 2.0, precision: float = 0.99, seed: int = 13) -> LanguageModel:
    """Fit on whole texts; every fifth is kept for calibration. Needs at least one label."""
    languages = sorted(set(labels))
    index = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    bags = [(_bag(t), index[y]) for t, y in zip(texts, labels, strict=True)]
    bags = [b for b in bags if len(b[0][0])]
    order = rng.permutation(len(bags))
    held, fit = [bags[i] for i in order[::5]], [bags[i] for i in order if i not in set(order[::5].tolist())] or [bags[i] for i in order]
    embed = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    out, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            (seen, weight), y = fit[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = weight @ embed[seen]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            embed[seen] -= lr * 20 * weight[:, None] * back
    model = LanguageModel(languages, embed @ out, bias)
    if held and len(languages) > 1:
        z = np.array([b[1] @ model.logits[b[0]] for b, _ in held]) + bias
        y = np.array([k for _, k in held])
        loss = {}
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            loss[float(t)] = -np.log(model.probabilities(z)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = min(loss, key=loss.get)
        p = model.probabilities(z)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        rank = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[rank]) >= precision * np.arange(1, len(rank) + 1))
        model.least = float(top[rank[good[-1]]]) if len(good) else 1.0
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``lang_score`` (calibrated) and ``lang_accepted``.

    A null text or one without a letter is ``und`` with score 0 and is not accepted. Ties go to the first
    language in alphabetical order. Other columns pass through unread; columns with the three new names
    are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    schema = widened(docs, "lang_pred string, lang_score double, lang_accepted boolean")
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of one number a language
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, null = text_column(batch, text)
            for lo, hi in pieces(offsets):
                w = Words(buf, offsets[lo : hi + 1], LETTERS)
                p = shared.value.probabilities(shared.value.raw(w)) if len(names) > 1 else np.zeros((hi - lo, 1))
                best, score = p.argmax(axis=1), p.max(axis=1)
                letters = np.zeros(hi - lo, dtype=bool)
                ascii_words = (w.bytes[w.start] < 128) if len(w.start) else np.zeros(0, bool)
                letters[np.unique(w.documents()[ascii_words])] = True
                for d in np.flatnonzero((w.counts > 0) & ~letters):
                    letters[d] = any(c.isalpha() for c in bytes(w.bytes[w.bounds[d] : w.bounds[d + 1]]).decode(errors="replace"))
                letters &= ~null[lo:hi] & (len(names) > 1)
                best[~letters], score[~letters] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(lo, hi - lo).columns,
                        pa.array(names[best], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(letters & (score >= shared.value.least)),
                    ],
                    names=[*batch.schema.names, "lang_pred", "lang_score", "lang_accepted"],
                )

    return docs.mapInArrow(run, schema)


def sample(docs: DataFrame, key: str, text: str, label: str, per_label: int, chars: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts, about ``per_label`` of each label, by a hash of the key."""
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= chars))
    sizes = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    part: Column = F.lit(0.0)
    for name, n in sizes.items():
        part = F.when(F.col(label) == name, F.lit(per_label / n)).otherwise(part)
    chosen = usable.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < part * (1 << 20))
    rows = chosen.select(key, text, label).limit(2 * per_label * max(1, len(sizes))).collect()
    rows.sort(key=lambda r: (r[2], str(r[0]), r[1]))
    return [r[1] for r in rows], [r[2] for r in rows]


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the predicted language, learned from two thirds of the documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)))
    texts, labels = sample(docs.where("fold <> 1"), "doc_id", "text", "lang", TRAIN_PER_LANGUAGE)
    model = train(texts, labels)
    out = predict(docs.select("doc_id", "text", F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


QUERIES = {"op10_language": op10_language}
ORACLE_SQL: dict[str, str] = {}
