"""Licence scans: a generalised suffix automaton of licence tokens read over every document.

The automaton holds every substring of every template. Reading a document through it gives matching
statistics: at each word the longest stretch ending there that some template contains. Stretches of at
least ``min_match`` words that cannot be continued are anchors; anchors of one template that follow each
other in both texts are chained, and a chain that covers enough of the template is a detected span.
A word outside the templates' vocabulary resets the statistics, and a match of three words holds two
template bigrams, so only runs of such bigrams are walked: the result is that of the full walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import ALNUM, Words, grams, hash_word, pieces, read, ship, text_column, widened

#: Licence templates (public standard wording), in lower-case words.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "reserved": ["all rights reserved"],
}
#: Phrases that are labelled wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

MIN_MATCH = 3
MIN_COVER = 0.8
MAX_GAP = 4


class SuffixAutomaton:
    """Generalised over several token sequences; each state knows where its strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        own: list[list[tuple[int, int]]] = [[]]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                while len(own) < len(self.len):
                    own.append([])
                own[last].append((which, at + 1))
        self.ends = [list(x) for x in own]
        for state in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(arcs)
        return len(self.len) - 1

    def _split(self, source: int, token: int, target: int) -> int:
        """A copy of ``target`` for the strings that are one longer than ``source``'s."""
        copy = self._state(self.len[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while source >= 0 and self.next[source].get(token) == target:
            self.next[source][token] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, token: int) -> int:
        there = self.next[last].get(token)
        if there is not None:
            return there if self.len[there] == self.len[last] + 1 else self._split(last, token, there)
        state = self._state(self.len[last] + 1, 0, {})
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = state
            last = self.link[last]
        if last >= 0:
            there = self.next[last][token]
            self.link[state] = there if self.len[there] == self.len[last] + 1 else self._split(last, token, there)
        return state

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            there = self.next[state].get(token)
            if there is None:
                state = length = 0
            else:
                state, length = there, length + 1
            yield state, length


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_match: int, min_cover: float, max_gap: int):
        self.min_match, self.min_cover, self.max_gap = max(2, min_match), min_cover, max_gap
        self.label = [name for name, texts in templates.items() for _ in texts]
        tokens = [[hash_word(w) for w in text.split()] for texts in templates.values() for text in texts]
        self.size = [len(t) for t in tokens]
        self.automaton = SuffixAutomaton(tokens)
        pairs = [grams(np.array(t, dtype=np.uint64), 2) for t in tokens]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.phrases = [([np.uint64(hash_word(w)) for w in p.split()], name) for p, name in phrases.items()]

    def base(self, w: Words) -> list[tuple[int, str]]:
        """(word index in the batch, label) of every place of a phrase inside one document."""
        out, h = [], w.hash
        if not len(h):
            return out
        until = np.repeat(w.first[1:], w.counts)
        for words, name in self.phrases:
            at = np.flatnonzero(h == words[0])
            for k, x in enumerate(words[1:], 1):
                at = at[at + k < until[at]]
                at = at[h[at + k] == x]
            out += [(int(i), name) for i in at]
        return out

    def runs(self, w: Words) -> list[tuple[int, int]]:
        """Word ranges inside one document in which each two neighbours are a template's bigram."""
        if len(w.hash) < 2 or not len(self.pairs):
            return []
        g = grams(w.hash, 2)
        at = np.minimum(np.searchsorted(self.pairs, g), len(self.pairs) - 1)
        hit = self.pairs[at] == g
        borders = w.first[1:-1]
        borders = borders[(borders > 0) & (borders < len(w.hash))]
        hit[borders - 1] = False
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        keep = hi - lo >= self.min_match
        return list(zip(lo[keep].tolist(), hi[keep].tolist(), strict=True))

    def anchors(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(template, start and end in it, start and end in the batch's words) of maximal matches."""
        for lo, hi in self.runs(w):
            found = list(self.automaton.statistics(w.hash[lo:hi].tolist()))
            for i, (state, length) in enumerate(found):
                if length >= self.min_match and (i + 1 == len(found) or found[i + 1][1] <= length):
                    for which, end in self.automaton.ends[state]:
                        yield which, end - length, end, lo + i + 1 - length, lo + i + 1

    def spans(self, w: Words) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, covered share) of the chains that cover enough of a template."""
        document = w.documents()
        groups: dict[tuple[int, int], list] = {}
        for which, t0, t1, d0, d1 in self.anchors(w):
            groups.setdefault((int(document[d0]), which), []).append((d0, d1, t0, t1))
        out = []
        for (_, which), found in groups.items():
            found = sorted(set(found))
            best: list[tuple[int, int]] = []
            for i, (d0, _, t0, t1) in enumerate(found):
                own, score, start = t1 - t0, t1 - t0, d0
                for j in range(i - 1, -1, -1):
                    e0, e1, _, u1 = found[j]
                    if d0 - e1 > self.max_gap + self.size[which]:
                        break
                    if e1 <= d0 <= e1 + self.max_gap and u1 <= t0 <= u1 + self.max_gap and best[j][0] + own > score:
                        score, start = best[j][0] + own, best[j][1]
                best.append((score, start))
            out += [
                (which, start, found[i][1], score / self.size[which])
                for i, (score, start) in enumerate(best)
                if score >= self.min_cover * self.size[which]
            ]
        return out


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple, min_match: int, min_cover: float, max_gap: int) -> LicenseScanner:
    return LicenseScanner({k: list(v) for k, v in templates}, dict(phrases), min_match, min_cover, max_gap)


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())])
_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])


def scan(
    docs: DataFrame,
    text: str = "text",
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = MIN_MATCH,
    min_cover: float = MIN_COVER,
    max_gap: int = MAX_GAP,
) -> DataFrame:
    """Every row of ``docs`` with ``license_words``, ``license_spans`` and ``license_phrases``.

    Spans are of the automaton's chains (label, first_word, end_word, cover), phrases the places of the
    phrase list; words count from 0 in each document. A null or empty text has no words and empty lists.
    Other columns pass through unread; columns with the three new names are replaced. Repeated rows are
    scanned alike, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    key = (
        tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items()),
        tuple((PHRASES if phrases is None else phrases).items()),
        min_match,
        min_cover,
        max_gap,
    )
    docs = docs.drop("license_words", "license_spans", "license_phrases")
    schema = widened(
        docs,
        "license_words long, license_spans array<struct<label:string,first_word:long,end_word:long,cover:double>>,"
        " license_phrases array<struct<label:string,word:long>>",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for batch in batches:
            buf, offsets, _ = text_column(batch, text)
            for lo, hi in pieces(offsets):
                w = Words(buf, offsets[lo : hi + 1], ALNUM)
                document = w.documents()
                spans: list[list] = [[] for _ in range(hi - lo)]
                places: list[list] = [[] for _ in range(hi - lo)]
                for which, start, end, cover in scanner.spans(w):
                    d = document[start]
                    spans[d].append({"label": scanner.label[which], "first_word": start - w.first[d], "end_word": end - w.first[d], "cover": cover})
                for at, name in scanner.base(w):
                    d = document[at]
                    places[d].append({"label": name, "word": at - w.first[d]})
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(lo, hi - lo).columns,
                        pa.array(w.counts, pa.int64()),
                        pa.array(spans, pa.list_(_SPAN)),
                        pa.array(places, pa.list_(_PLACE)),
                    ],
                    names=[*batch.schema.names, "license_words", "license_spans", "license_phrases"],
                )

    return docs.mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its licence phrases and labels; score is the largest covered share of a template."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, more = F.col("license_phrases.label"), F.col("license_spans.label")
    return found.select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size("license_phrases").cast("long").alias("n_base"),
        F.array_min("license_phrases.word").alias("first_word"),
        F.array_max("license_phrases.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.coalesce(F.array_max("license_spans.cover"), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op9_licenses": op9_licenses}
ORACLE_SQL: dict[str, str] = {}
