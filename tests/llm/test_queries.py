"""Registered queries on a small fixture with every hard case, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import (
    components,
    decontaminate,
    deleted_interpolation,
    hilbert_ann,
    kneser_ney,
    language_id,
    license_scan,
    ngram_join,
    piece_codec,
    suffix_dedup,
    warc,
)

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rnd, n, syllables):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def make_documents():
    rnd = random.Random(9)
    tongues = {"en": ["the", "er", "on", "and", "ing"], "fr": ["é", "eau", "ou", "ai", "que"]}
    rows, did = [], 0
    base = [prose(rnd, rnd.randint(40, 160), tongues["en"]) for _ in range(12)]
    passage = prose(rnd, 90, tongues["en"])
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        text = prose(rnd, rnd.randint(20, 120), tongues[lang])
        if i % 5 == 1:
            words = base[i % 12].split()
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 7 == 2:
            text = base[i % 12]
        if i % 9 == 4:
            text = f"{text[:90]} {passage} {text[90:]}"
        rows.append((did, text, lang, "src", len(text)))
        did += 1
    odd = [None, "", " \n\t", "x", "One TWO", "  spaces   run ▁ é\x00 ", "Zu " * 700, "日本語 123", "123 456", "All rights reserved. CC BY, general public license", "a\r\nb\vc"]
    odd += ["Licensed under the Apache License, Version 2.0. Released under the MIT License."]
    for text in odd:
        rows.append((did, text, "en", "odd", 0))
        did += 1
    rows.append(rows[3])  # a repeated row
    rows.append((None, rows[5][1], None, None, None))  # no key
    return rows


ROWS = make_documents()
BENCHMARK = [(0, " ".join(ROWS[8][1].split()[:30])), (1, None), (2, ""), (3, "short one"), (4, "nothing like the documents has these words in a row at all ever")]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    rnd = np.random.default_rng(3)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*ROWS, strict=True), kinds, strict=True)]
    extra = {n: pa.array(["other"] * len(ROWS)) for n in ("kept", "class", "component", "token", "keep", "decoded", "lang_pred", "__x")}
    pq.write_table(pa.table(dict(zip(names, columns, strict=True)) | extra), f"{top}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in BENCHMARK]), "text": pa.array([b[1] for b in BENCHMARK])}), f"{top}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": list(range(50)), "quality": [1] * 45 + [0] * 5, "toxic": [0] * 50}), f"{top}/labels.parquet")
    vectors = [v.tolist() for v in rnd.normal(size=(300, 16)).astype(np.float32)]
    vectors[:60] = [vectors[0]] * 60
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3, [float("inf")] * 16]
    pq.write_table(pa.table({"vec_id": list(range(len(vectors))), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0] * len(vectors)}), f"{top}/embeddings.parquet")
    html = [None, "", "short", "short"] + [f"<p>{'é' * 60}{i % 4}</p>" for i in range(20)]
    pages = {"page_id": list(range(len(html)))[::-1], "url": [None, "http://a/\n"] + ["u"] * (len(html) - 2), "html": html}
    pq.write_table(pa.table(pages), f"{top}/pages.parquet")
    return str(top)


@pytest.fixture(scope="module")
def empty(tmp_path_factory, sf):
    top = tmp_path_factory.mktemp("none")
    for name in ("documents", "benchmark", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), f"{top}/{name}.parquet")
    return str(top)


QUERIES = {
    name: run
    for module in (decontaminate, ngram_join, hilbert_ann, kneser_ney, suffix_dedup, deleted_interpolation, piece_codec, warc, license_scan, language_id)
    for name, run in module.QUERIES.items()
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def shingles(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "share"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard(spark, sf, n, share):
    sets = [shingles(r[1], n) for r in ROWS]
    parent = list(range(len(ROWS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            low[root(i)].append(r[0])
    want = by_id((r[0], len(sets[i]), min(low[root(i)]) if sets[i] else r[0]) for i, r in enumerate(ROWS))
    got = ngram_join.join(spark.read.parquet(f"{sf}/documents.parquet"), n=n, share=share).select("doc_id", "n_shingles", "component_id")
    assert by_id(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("leading", [1, 3, 8])
def test_jaccard_of_a_cluster_at_the_threshold(spark, leading, monkeypatch):
    """Near copies of every length, most pairs a little below the threshold, against all pairs."""
    monkeypatch.setattr(ngram_join, "LEADING", leading)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = base[rnd.randint(0, 12) : 150 - rnd.randint(0, 12)]
        for at in rnd.sample(range(len(words)), rnd.randint(1, 7)):
            words[at] = f"x{rnd.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 4) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=4, share=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: root(i) for i in range(len(rows))}
    assert 10 < len({root(i) for i in range(len(rows))}) < 150


@pytest.mark.parametrize(("length", "hot"), [(400, None), (60, None), (60, 0)])
def test_suffix_dedup(spark, sf, length, hot, monkeypatch):
    """With and without the way that splits hot grams, and with clashing names."""
    if hot is not None:
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
    data = [(r[1] or "").encode() for r in ROWS]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    want = []
    for r, d in zip(ROWS, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((r[0], sum(gone), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row_key", F.lit(1)).withColumn("row", F.lit(2)).withColumn("ranges", F.lit("x"))
    got = suffix_dedup.deduplicate(docs, length=length, marked=30)
    assert {(r.row_key, r.row, r.ranges) for r in got.collect()} == {(1, 2, "x")}
    marked = []
    short = collections.Counter(d[i : i + 30] for d in data for i in range(len(d) - 29))
    for r, d in zip(ROWS, data, strict=True):
        there = bytearray(len(d))
        for i in range(len(d) - 29):
            if short[d[i : i + 30]] > 1:
                there[i : i + 30] = b"\1" * 30
        marked.append((r[0], sum(there)))
    assert by_id(tuple(r) for r in got.select("doc_id", "n_marked").collect()) == by_id(marked)
    rows = got.select("doc_id", "n_removed", F.size("removed_spans"), "kept").collect()
    assert by_id((a, b, c, bytes(d)) for a, b, c, d in rows) == by_id(want)


def test_suffix_array_decides(spark, sf, monkeypatch):
    """Without the order of the suffixes, repeated windows are missed."""
    rnd = random.Random(2)
    words = prose(rnd, 400, ["the", "er", "on", "and", "ing"]).split()
    strings = []
    for i in range(30):
        copy = list(words)
        for at in rnd.sample(range(400), 12):
            copy[at] = f"x{i}"
        strings.append(" ".join(copy).encode())
    owned = np.array([len(x) for x in strings])
    count = collections.Counter(x[i : i + 60] for x in strings for i in range(len(x) - 59))
    want = [[i for i in range(len(x) - 59) if count[x[i : i + 60]] > 1] for x in strings]
    assert [f.tolist() for f in suffix_dedup.repeated_starts(strings, owned, (60,))[0]] == want
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: np.arange(len(symbols)))
    assert [f.tolist() for f in suffix_dedup.repeated_starts(strings, owned, (60,))[0]] != want


def test_interpolation_scores(spark, sf, monkeypatch):
    """Scores are the mixture with the learned weights, worked out plainly; blocks and parts do not matter."""
    learned = []
    learn = deleted_interpolation.learn_weights
    monkeypatch.setattr(deleted_interpolation, "learn_weights", lambda *a: learned.append(learn(*a)) or learned[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = by_id((r.doc_id, r.score) for r in deleted_interpolation.score(docs).collect())
    words, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
    texts = [(r[0], [None, *WORDS.findall((r[1] or "").translate(LOWER)), None]) for r in ROWS]
    for k, w in texts:
        if k is None or zlib.crc32(str(k).encode()) % 10:
            words.update(w[1:])
            pairs.update(zip(w[:-1], w[1:], strict=True))
            context.update(w[:-1])
    n, v, want = sum(words.values()), len(words), []
    for k, w in texts:
        total, first = 0.0, True
        for a, b in zip(w[:-1], w[1:], strict=True):
            c = words[None] if first else words[a]
            x, y, z = learned[0][int(deleted_interpolation.bucket_of(np.array([c]))[0])]
            total += math.log10(x * (pairs[a, b] / c if c else 0) + y * words[b] / n + z / (v + 1))
            first = False
        want.append((k, total))
    for (k, x), (i, y) in zip(got, by_id(want), strict=True):
        assert k == i and x == pytest.approx(y)


def test_interpolation(spark, sf):
    docs = [(r[0], [*WORDS.findall((r[1] or "").translate(LOWER)), None]) for r in ROWS]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    count = collections.Counter(w for k, words in docs if not held(k) for w in words)
    n, v = sum(count.values()), len(count)
    want = by_id((k, held(k), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for k, w in docs)
    rows = deleted_interpolation.op6_interpolation(spark, sf).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    for got, ex in zip(by_id(tuple(r)[:6] for r in rows), want, strict=True):
        assert got[:5] == ex[:5] and got[5] == pytest.approx(ex[5])
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_pieces(spark, sf):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in ROWS:
        ids = sp.encode(r[1] or "", add_eos=True)
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert by_id(tuple(r) for r in piece_codec.op7_pieces(spark, sf).collect()) == by_id(want)
    small = piece_codec.encode(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path(piece_codec.MODEL), table_chunks=10)
    assert small.select(F.sha2("piece_ids", 256)).exceptAll(piece_codec.op7_pieces(spark, sf).select("ids_sha256")).count() == 0


def test_warc(spark, sf):
    table = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    bodies = {p["page_id"]: (p["html"] or "").encode() for p in table}
    want = []
    for k, b in bodies.items():
        low = min(j for j, c in bodies.items() if c == b)
        again = len(b) >= 100 and low != k
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None))
    assert by_id(tuple(r) for r in warc.op8_warc(spark, sf).collect()) == by_id(want)


def test_licenses(spark, sf):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = by_id(tuple(r) for r in license_scan.op9_licenses(spark, sf).collect())
    want = []
    for r in ROWS:
        w = words.findall((r[1] or "").translate(LOWER))
        places = [(i, name) for p, name in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want.append((r[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))))
    assert [g[:6] for g in got] == by_id(want)
    assert {g[6] for g in got if g[5]} == {"cc-by,gpl,reserved"} and {g[6] for g in got if not g[5]} == {"", "apache-2.0,mit"}


def test_language(spark, sf):
    rows = language_id.op10_language(spark, sf).collect()
    assert len(rows) == len(ROWS)
    texts = {r[0]: r for r in ROWS}
    for r in rows:
        text = (texts[r.doc_id][1] if r.doc_id is not None else "a") or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    sure = [r.lang_pred == texts[r.doc_id][2] for r in rows if r.doc_id is not None and r.doc_id < 60 and r.held_out and r.doc_id % 5 != 1 and r.doc_id % 7 != 2]
    assert sum(sure) >= 0.9 * len(sure)


def test_decontamination(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    passage = ROWS[8][1].split()[:30]
    want = {r[0] for r in ROWS if " ".join(passage) in (r[1] or "")}
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == want and 8 in want
    passage[5] = passage[14] = "other"
    changed = spark.createDataFrame([(1, "x y " + " ".join(passage)), (2, "short one"), (3, " ".join(passage[:8])), (None, "y short one z")], "doc_id long, text string")
    found = decontaminate.find(changed, items, min_item=1)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 3), (None, 3)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(changed, items).collect()} == {(1, 0)}  # two words say nothing
    named = decontaminate.contaminated(changed, items.withColumnRenamed("item_id", "id"), item="id").collect()
    assert [(r.doc_id, r.n_items, r.item_ids) for r in named] == [(1, 1, "0")]
    with pytest.raises(ValueError, match="rename"):
        decontaminate.find(changed, items, key="doc_id", item="doc_id")


def test_decontamination_of_capitals(spark, sf):
    """Upper-case copies of passages with accented letters are found, also by the pipeline's stage."""
    import corpus_pipeline

    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    passage = " ".join(f"été{i} élève äß{i} Ñandú{i} où" for i in range(6))
    items = items.unionByName(spark.createDataFrame([(7, passage)], items.schema))
    texts = [f"x {passage.replace('ß', 'ss').upper()} y", passage.upper(), passage, passage.title(), "ÉTÉ ÉLÈVE OÙ"]
    docs = spark.createDataFrame([(i, t, "fr", "src", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    fold = lambda t: t.lower().split()
    want = set()
    for i, t in enumerate(texts):
        a, b = fold(passage), fold(t)
        for d in range(-len(a), len(b)):
            same = [a[j - d] == b[j] for j in range(max(0, d), min(len(b), d + len(a)))]
            spans = [same[lo:hi] for lo in range(len(same)) for hi in range(lo + 1, len(same) + 1)]
            if any(sum(s) >= 13 and sum(s) >= 0.8 * len(s) for s in spans):
                want.add(i)
    assert want == {0, 1, 2, 3}
    assert {r.doc_id for r in decontaminate.find(docs, items).where("item_id = 7").collect()} == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "read", lambda *_: items)
        assert [r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, sf).collect()] == [4]


def test_blocks_of_a_benchmark(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontaminate.find(docs, items).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 5)
    assert by_id(map(tuple, decontaminate.find(docs, items).collect())) == by_id(map(tuple, whole))


def overlap(a, b):
    """Whether laying item ``a`` over text ``b`` on some diagonal gives a stretch that counts, found without seeds."""
    for d in range(1 - len(a), len(b)):
        same = [a[j - d] == b[j] for j in range(max(0, d), min(len(b), d + len(a)))]
        for lo in range(len(same)):
            hits = 0
            for hi in range(lo, len(same)):
                hits += same[hi]
                if hits >= min(13, 0.8 * len(a)) and hits >= 0.8 * (hi - lo + 1):
                    return True
    return False


def test_decontamination_recall(spark):
    """Passages with substitutions at every rate, against every item on every diagonal."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(14, 40))] for _ in range(12)]
    texts = []
    for i in range(120):
        words = list(items[i % 12])
        for at in rnd.sample(range(len(words)), int(len(words) * (i % 7) / 24)):
            words[at] = rnd.choice(vocabulary)
        texts.append([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))] + words[rnd.randint(0, 4) :] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))])
    want = {(t, i) for t, b in enumerate(texts) for i, a in enumerate(items) if overlap(a, b)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, benchmark).collect()}
    assert len(want) > 60 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_neighbours(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()[:300]
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in hilbert_ann.op3_neighbours(spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q in range(300) if q % 50 == 0}
    hits = 0
    for q, found in got.items():
        near = x @ x[q]
        order = [i for i in sorted(range(300), key=lambda i: (-round(near[i], 12), i)) if i != q][:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(near[i] - s) < 1e-12 for _, i, s in found)
        hits += len(set(order) & {i for _, i, _ in found})
        if q == 0:
            assert [i for _, i, _ in found] == [1, 2, 3, 4, 5]  # equal vectors: the smallest ids
    assert hits >= 0.9 * 5 * len(got)
    few = spark.createDataFrame([(50, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hilbert_ann.search(few, F.col("vec_id") == 50).collect()] == [(50, 1, 2, 0.0)]


@pytest.mark.parametrize("noise", [0.05, 1e-4])
def test_neighbours_among_near_copies(spark, noise):
    """Thousands of near-copies, all in view of the queries, closer to each other than their codes tell."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=64) + noise * rnd.normal(size=(3000, 64))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in hilbert_ann.search(vectors, F.col("vec_id") % 300 == 0, curves=1, reach=1.0).collect():
        got[r.query_id].add(r.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 10
    for q, found in got.items():
        away = ((x - x[q]) ** 2).sum(axis=1)
        away[q] = np.inf
        assert found == set(np.argsort(away)[:5].tolist())


def test_neighbours_with_a_malformed_first_row(spark):
    rows = [(0, [1.0, 2.0, 3.0]), *((i, [1.0, i / 10]) for i in range(1, 8))]
    got = hilbert_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") < 2, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(1, 1, 2), (1, 2, 3), (1, 3, 4)]


def test_quality(spark, sf):
    """Gains add up to the interpolated probabilities, worked out plainly."""
    texts = [r[1] for r in ROWS[:12]]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    scored = kneser_ney.score(spark.createDataFrame([(t,) for t in [*texts, "never seen", None]], "text string"), model)
    grams = [collections.Counter() for _ in range(4)]
    for t in texts:
        w = [*WORDS.findall(t), None]
        for n in (1, 2, 3):
            grams[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    counts = {3: dict(grams[3])}
    for n in (1, 2):
        before = collections.Counter(g[1:] for g in grams[n + 1])
        counts[n] = {g: before.get(g) or 1 for g in grams[n]}
    off = {}
    for n, c in counts.items():
        t = [sum(k == i for k in c.values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] and t[2] else None
        d = (0.5, 0.5, 0.5) if y is None else (1 - 2 * y * t[2] / t[1], 2 - 3 * y * t[3] / t[2], 3 - 4 * y * t[4] / t[3] if t[3] else 2 - 3 * y * t[3] / t[2])
        off[n] = [min(max(x, 0.1), i - 0.1 + 0.1 * (i > 1)) for i, x in zip((1, 2, 3), d, strict=True)]
    less = lambda n, k: min(off[n][min(k, 3) - 1], 0.999 * k)
    context = {n: collections.defaultdict(lambda: [0, 0.0]) for n in (1, 2, 3)}
    for n, c in counts.items():
        for g, k in c.items():
            context[n][g[:-1]][0] += k
            context[n][g[:-1]][1] += less(n, k)

    def p(g):
        n = len(g)
        lower = 1 / (len(counts[1]) + 1) if n == 1 else p(g[1:])
        total, left = context[n].get(g[:-1], (0, 0))
        if not total:
            return lower
        k = counts[n].get(g, 0)
        return ((k - less(n, k)) if k else 0) / total + left / total * lower

    for r in scored.collect():
        w = [*WORDS.findall(r.text or ""), None]
        want = -sum(math.log(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w))) / len(w)
        assert math.log(r.perplexity) == pytest.approx(want, rel=1e-4) and r.lm_tokens == len(w)
    out = kneser_ney.op4_quality(spark, sf).collect()
    assert len(out) == len(ROWS) and all(r.keep is not None for r in out)


def test_quality_in_passes(spark, monkeypatch):
    """Texts scored in several passes have the same perplexities, and the model takes under 10 bytes an n-gram."""
    texts = [" ".join(f"w{i * j % 997}" for j in range(i % 50, 300)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "a a a b a a a"])], "id long, text string")
    model = kneser_ney.fit(df.where("id < 40"))
    whole = {r.id: r for r in kneser_ney.perplexities(df, model).collect()}
    made, stored = [], kneser_ney.stored
    monkeypatch.setattr(kneser_ney, "stored", lambda rows, what: made.append(what) or stored(rows, what))
    monkeypatch.setattr(kneser_ney, "PASS_BYTES", 1 << 12)
    parts = {r.id: r for r in kneser_ney.perplexities(df, model).collect()}
    assert made == ["scores"] * kneser_ney.PASSES and len(parts) == 63 and parts.keys() == whole.keys()
    for i, r in whole.items():
        assert parts[i].lm_tokens == r.lm_tokens and parts[i].perplexity == pytest.approx(r.perplexity)
    grams = {tuple(w[i : i + n]) for t in texts[:40] for w in [[*t.split(), None]] for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    packed = model.where("slice = -1").selectExpr("sum(octet_length(grams) + octet_length(gains))").first()[0]
    assert packed < 10 * len(grams)


def test_quality_model_in_parts(spark, monkeypatch):
    """N-grams counted in parts give the same model, and no step stores more than about a part of the trigrams."""
    texts = [" ".join(f"w{i * j % 97}" for j in range(i % 50, 300)) for i in range(60)] + ["a", " ", "b b b b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    whole = {r.id: r.perplexity for r in kneser_ney.perplexities(df, kneser_ney.fit(df)).collect()}
    sizes, stored = [], kneser_ney.stored

    def seen(rows, what):
        out = stored(rows, what)
        if what == "trigrams":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(kneser_ney, "stored", seen)
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 1 << 10)
    parts = {r.id: r.perplexity for r in kneser_ney.perplexities(df, kneser_ney.fit(df)).collect()}
    assert len(sizes) == 2 * kneser_ney.PARTS and max(sizes) < sum(sizes) / 2 * 0.4
    assert parts.keys() == whole.keys() and all(parts[i] == pytest.approx(p, rel=1e-5) for i, p in whole.items())


def test_quality_model_in_shards(spark, monkeypatch):
    """Texts are read once a part to count n-grams, and many shards give the model of one."""
    texts = [" ".join(f"w{i * j % 97}" for j in range(i % 50, 300)) for i in range(60)] + ["a", " ", "b b b b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "id long, text string").repartition(3)
    whole = {r.id: r.perplexity for r in kneser_ney.perplexities(df, kneser_ney.fit(df)).collect()}
    asked, counted = [], kneser_ney._counted
    monkeypatch.setattr(kneser_ney, "_counted", lambda *which: asked.append(which) or counted(*which))
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(kneser_ney, "FIT_BYTES", 1 << 12, raising=False)
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 1 << 12)
    model = kneser_ney.fit(df)
    assert len(asked) == kneser_ney.PARTS and model.where("slice = -1").count() > 2 * kneser_ney.PARTS
    cut = {r.id: r.perplexity for r in kneser_ney.perplexities(df, model).collect()}
    assert cut.keys() == whole.keys() and all(cut[i] == pytest.approx(p, rel=1e-5) for i, p in whole.items())
    grams = {tuple(w[i : i + n]) for t in texts for w in [[*t.split(), None]] for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    held = [kneser_ney.unpack_sorted(r.grams) for r in model.where("slice = -1").collect()]
    assert sum(map(len, held)) == len(set(np.concatenate(held).tolist())) == len(grams)
    blank = kneser_ney.fit(spark.createDataFrame([(" ",), ("",)], "text string"))
    assert [len(kneser_ney.unpack_sorted(r.grams)) for r in blank.where("slice = -1").collect()] == [1]
    assert kneser_ney.fit(df.where("false")).isEmpty()


def test_quality_sample_and_margin(spark, monkeypatch):
    """About 2500 of enough trusted documents train, and thresholds are 1.15 quantiles."""
    sizes = []
    fit = kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda trusted, text="text": sizes.append(trusted.count()) or fit(trusted, text))
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('a b c d ', id % 7) as text", "'en' as lang")
    rows = kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic")).collect()
    assert sizes[0] == pytest.approx(2500, rel=0.1)
    limits = {r.threshold / math.exp(kneser_ney.SLACK / math.sqrt(r.lm_tokens)) for r in rows}
    assert len(limits) == 1 and any(limits.copy().pop() / r.perplexity == pytest.approx(1.15) for r in rows)


def test_quality_learns_from_all(spark, monkeypatch, tmp_path):
    """In the query every trusted document, however long, either trains or sets thresholds."""
    seen = []
    monkeypatch.setattr(kneser_ney, "fit", lambda trusted, text="text": seen.append((trusted.count(), trusted.where("length(text) > 20000").count())) or trusted.limit(0))
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat(concat('a b c d ', id % 7), if(id % 2 = 0, 3000, 1)) as text", "'en' as lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert kneser_ney.op4_quality(spark, str(tmp_path)).count() == 6000
    assert seen[0] == (pytest.approx(3000, rel=0.1), pytest.approx(1500, rel=0.1))


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (50, 45)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30, 45: 45, 50: 45}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_pipeline(spark, sf, empty):
    import corpus_pipeline

    columns = list(corpus_pipeline.COLUMNS)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == columns
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    joined = ngram_join.join(docs, n=5, share=80).collect()
    assert kept - {None} == {r.component_id for r in joined if r.doc_id is not None}
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    assert len(cut) == len({r[0] for r in ROWS}) and cut[60].text is None
    hit = {r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, sf).collect()}
    assert 8 not in hit and 0 in hit
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 10


def test_pipeline_near_duplicates_of_one_id(spark, sf):
    """Different texts of one id stay; equal rows are reduced to one; of linked rows that with the smallest id stays."""
    import corpus_pipeline

    a, b, c = (prose(random.Random(i), 60, ["the", "er", "on", "and", "ing"]) for i in (1, 2, 3))
    rows = [(1, a), (1, b), (2, b), (2, c), (None, c), (None, None), (3, None), (1, a)]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert got == by_id([(1, a), (1, b), (2, c), (None, None), (3, None)])


def test_pipeline_contaminated_rows_without_an_id(spark, sf):
    """A null id does not keep a row that holds an item, nor does a clean row go with it."""
    import corpus_pipeline

    held = BENCHMARK[0][1]
    rows = [(None, f"x {held} y"), (None, "clean text"), (None, None), (1, f"x {held} y"), (1, "clean too"), (2, None), (3, "z")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id((r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, sf).collect())
    assert got == by_id(r for r in rows if held not in (r[1] or ""))
