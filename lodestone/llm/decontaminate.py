"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive tokens; tokens under a 0 are ignored, so a hit survives substitutions
there. Seeds of the benchmark and of the documents are joined on their hashes. Each hit fixes an item
and a diagonal; the item is laid over the document there, and a stretch decides in which enough tokens, and
a large enough share of them, agree.

The benchmark is read in blocks of at most ``BLOCK_TOKENS`` tokens. The seed tables of one block are
broadcast, so what a task holds is bounded whatever the benchmark's size; each further block is one more
pass over the documents. Documents are neither shuffled nor collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernel import SPACED, Words, _gram_factor, mix, pieces, read, ship, stored, text_column, widened

#: Each mask keeps seven of nine to twelve tokens.
MASKS = ("1101110101", "111011011", "110100110111", "101111011")
BLOCK_TOKENS = 1 << 19
MIN_MATCH = 13
#: Items of fewer tokens occur in clean texts by chance and are left out.
MIN_ITEM = 5
MIN_SHARE = 0.8
#: Tokens on diagonals that are compared at once.
VERIFIED_TOKENS = 1 << 20
#: Shares are compared as whole numbers of this unit.
SHARE_UNITS = 10**6


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask laid at every token; entry i starts at token i."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)), dtype=np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out += h[k : k + n] * _gram_factor[k]
    return mix(out)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of some columns, in order."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo .. lo + n - 1 of each range, one after another."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class SeedTable:
    """The seeds of a block of benchmark items. Items too short for a mask are one exact seed.

    What a seed leads to is a list of (item, place) relative to its first place. The seeds of a passage that
    many items share have one list, so a document that holds the passage meets the list once a place.
    """

    def __init__(self, ids: list, texts: list[str], masks: tuple[str, ...]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, SPACED)
        self.ids, self.hash, self.first, self.masks = ids, w.hash, w.first, masks
        least = min(map(len, masks))
        short = sorted({int(n) for n in w.counts if 0 < n < least})
        self.every = [*masks, *("1" * n for n in short)]
        found = []
        for k, mask in enumerate(self.every):
            h = seeds(w.hash, mask)
            at = np.arange(len(h))
            item = np.searchsorted(w.first, at, side="right") - 1
            keep = at + len(mask) <= w.first[item + 1]
            if k >= len(masks):
                keep &= w.counts[item] == len(mask)
            found.append((h[keep], item[keep], at[keep] - w.first[item[keep]]))
        h, item, place = _distinct(*(np.concatenate([f[i] for f in found]) for i in range(3)))
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(h)))
        #: Distinct seeds, the place that their list is relative to, and the list: its first entry and length.
        self.seed, self.base = h[starts], place[starts]
        self.item, self.offset = item, place - np.repeat(self.base, many)
        self.entry, self.many = starts.copy(), many
        lists: dict[bytes, int] = {}
        for k in np.flatnonzero(many > 1):
            lo, hi = starts[k], starts[k] + many[k]
            self.entry[k] = lists.setdefault(self.item[lo:hi].tobytes() + self.offset[lo:hi].tobytes(), int(lo))
        alone = many == 1  # an item's seeds that no other has share a list too
        first = np.full(len(ids), -1, dtype=np.int64)
        first[self.item[starts[alone]][::-1]] = starts[alone][::-1]
        self.entry[alone] = first[self.item[starts[alone]]]
        bits = max(16, int(len(h)).bit_length() + 6)
        self.shift = np.uint64(64 - min(bits, 27))
        self.seen = np.zeros(1 << min(bits, 27), dtype=bool)
        self.seen[(self.seed >> self.shift).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, diagonal); the diagonal is where the item's first token would lie."""
        out = [(np.zeros(0, np.int64),) * 4]
        for mask in self.every if len(self.seed) else ():
            h = seeds(w.hash, mask)
            at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.seed, h[at]), len(self.seed) - 1)
            met = self.seed[k] == h[at]
            at, k = at[met], k[met]
            document = np.searchsorted(w.first, at, side="right") - 1
            inside = at + len(mask) <= w.first[document + 1]
            at, k, document = at[inside], k[inside], document[inside]
            out.append((document, self.entry[k], self.many[k], at - self.base[k]))
        document, entry, many, base = _distinct(*(np.concatenate(c) for c in zip(*out, strict=True)))
        k = _ranges(entry, many)
        return _distinct(np.repeat(document, many), self.item[k], np.repeat(base, many) - self.offset[k])

    def stretches(self, w: Words, min_match: int, min_share: float) -> tuple[np.ndarray, ...]:
        """(document, item, agreeing tokens, tokens, first token in the document, item length), the best of each document and item."""
        document, item, diagonal = self.hits(w)
        size = self.first[item + 1] - self.first[item]
        lo = np.maximum(diagonal, w.first[document])
        n = np.minimum(diagonal + size, w.first[document + 1]) - lo
        ends = np.cumsum(n + 1)
        found, i = [(np.zeros(0, np.int64),) * 6], 0
        while i < len(n):  # some diagonals at a time, laid one behind the other
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + VERIFIED_TOKENS)))
            match, length, start = self._best(w.hash, lo[i:j], self.first[item[i:j]] + lo[i:j] - diagonal[i:j], n[i:j], min_share)
            enough = match >= np.maximum(1, np.minimum(min_match, min_share * size[i:j]))
            columns = (document[i:j], item[i:j], match, length, lo[i:j] + start - w.first[document[i:j]], size[i:j])
            found.append(tuple(c[enough] for c in columns))
            i = j
        document, item, match, length, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((start, length, -match, item, document))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (document[order][1:] != document[order][:-1]) | (item[order][1:] != item[order][:-1])
        return tuple(c[order[new]] for c in (document, item, match, length, start, size))

    def _best(self, tokens: np.ndarray, lo: np.ndarray, at: np.ndarray, n: np.ndarray, min_share: float) -> tuple[np.ndarray, ...]:
        """(agreeing tokens, tokens, start) of the stretch with most agreement on each diagonal, the earliest end first.

        A diagonal is ``n`` tokens from ``lo`` in the document and from ``at`` in the items. A stretch agrees enough
        if the agreement less ``min_share`` of the tokens does not fall over it, so the longest one to an end begins
        where that difference first was as low. All diagonals are searched at once: each is moved below those before.
        """
        first = np.cumsum(n + 1) - (n + 1)
        same = np.zeros(int((n + 1).sum()), dtype=np.int64)
        inner = _ranges(first + 1, n)
        same[inner] = tokens[_ranges(lo, n)] == self.hash[_ranges(at, n)]
        agree = np.cumsum(same)
        agree -= np.repeat(agree[first], n + 1)
        place = _ranges(np.zeros(len(n), np.int64), n + 1)
        over = SHARE_UNITS * agree - round(SHARE_UNITS * min_share) * place
        over -= np.repeat(SHARE_UNITS * (2 * first + n + 1), n + 1)
        start = np.searchsorted(-np.minimum.accumulate(over), -over, side="left")
        hits = agree - agree[start]
        most = np.maximum.reduceat(hits, first)
        top = np.flatnonzero(hits == np.repeat(most, n + 1))
        end = top[np.searchsorted(top, first)]
        return most, end - start[end], start[end] - first


def _blocks(benchmark: DataFrame, item: str, text: str, min_item: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of a bounded number of tokens, fetched one partition at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(item, F.lower(text).alias(text)).where(F.col(text).isNotNull()).toLocalIterator():
        raw = np.frombuffer(row[1].encode(), dtype=np.uint8)
        n = int(Words(raw, np.array([0, len(raw)]), SPACED).counts[0])
        if n < min_item:
            continue
        if ids and held + n > BLOCK_TOKENS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += n
    if ids:
        yield ids, texts


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    masks: tuple[str, ...] = MASKS,
    min_match: int = MIN_MATCH,
    min_share: float = MIN_SHARE,
    min_item: int = MIN_ITEM,
) -> DataFrame:
    """(key, item, n_match, n_tokens, first_token, item_tokens), one row for each document row and item.

    A stretch counts if it has ``min_match`` agreeing tokens, or ``min_share`` of a shorter item's, and
    ``min_share`` of its tokens agree. Texts and items are lower-cased by Unicode; tokens end at ASCII white space. Null or
    empty texts and items match nothing, nor do items of fewer than ``min_item`` tokens; repeated rows are
    reported as often as they occur; ties between stretches go to the earliest. Empty tables give an empty
    result, extra columns are not read, and an ``item`` named like ``key`` is refused. A document is worked on
    as a whole: a task holds about a hundred bytes for each byte of its longest text.
    """
    if item.lower() == key.lower():
        raise ValueError(f"key and item are both named {key}: rename one")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    kind = benchmark.schema[item].dataType
    schema = widened(docs.select("key"), f"item {kind.simpleString()}, n_match int, n_tokens int, first_token int, item_tokens int")

    def scanner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = None
            for batch in batches:
                table = table or shared.value
                buf, offsets, _ = text_column(batch, "text")
                for lo, hi in pieces(offsets):
                    w = Words(buf, offsets[lo : hi + 1], SPACED)
                    document, item, *numbers = table.stretches(w, min_match, min_share)
                    if len(item):
                        columns = [
                            batch.column(0).take(pa.array(lo + document)),
                            pa.array([table.ids[i] for i in item], to_arrow_type(kind)),
                            *(pa.array(c, pa.int32()) for c in numbers),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return run

    found: list[DataFrame] = []
    blocks = _blocks(benchmark, item, text, min_item)
    block = next(blocks, None)
    while block:
        table = spark.sparkContext.broadcast(SeedTable(*block, tuple(masks)))
        hits = docs.mapInArrow(scanner(table), schema)
        block = next(blocks, None)
        if block or found:  # one block's table at a time is on its way
            hits = stored(hits, "overlaps")
            table.destroy()
        found.append(hits)
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"key": key, "item": item})


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", **more) -> DataFrame:
    """One row for each key with a benchmark overlap: its items and its longest one. Null keys are one group."""
    found = find(docs, benchmark, key=key, item=item, **more)
    return found.groupBy(key).agg(
        F.countDistinct(item).alias("n_items"),
        F.array_join(F.array_sort(F.collect_set(item)), ",").alias("item_ids"),
        F.max("n_match").alias("n_match"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, with the items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE_SQL: dict[str, str] = {}
