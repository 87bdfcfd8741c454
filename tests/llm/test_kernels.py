"""Array kernels and the parts of operators that need no Spark, against brute force."""

import collections
import io
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontaminate, deleted_interpolation, hilbert_ann, kernel, language_id, license_scan, ngram_join, suffix_dedup, warc
from lodestone.llm.suffix_order import suffix_array

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def columns(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return kernel.text_column(batch)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t|", max_size=12)), max_size=5))
def test_words(texts):
    buf, offsets, null = columns(texts)
    assert null.tolist() == [t is None for t in texts]
    w = kernel.Words(buf, offsets, kernel.SPACED)
    for i, t in enumerate(texts):
        want = [x for x in (t or "").translate(LOWER).replace("\t", " ").replace("\n", " ").split(" ") if x]
        got = w.hash[w.first[i] : w.first[i + 1]].tolist()
        assert got == [kernel.hash_word(x) for x in want]


def test_sliced_columns():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "bc", None, "def"], pa.string())], names=["text"]).slice(1, 3)
    buf, offsets, null = kernel.text_column(batch)
    assert [bytes(buf[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [b"bc", b"", b"def"] and null.tolist() == [False, True, False]


def test_pieces_cover_all():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert [x for a, b in kernel.pieces(offsets, 10) for x in range(a, b)] == list(range(5))


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=4, max_size=40), st.integers(1, 4))
def test_rolling_hash(data, n):
    a = np.frombuffer(data, np.uint8)
    h = kernel.RollingHash(a).windows(n)
    s = kernel.RollingHash(a).spans(np.arange(len(h)), np.arange(len(h)) + n)
    assert (h == s).all()
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (data[i : i + n] == data[j : j + n])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, dtype=np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 5), st.booleans())
def test_repeated_starts(seed, n, spaced):
    rnd = random.Random(seed)
    length = 12
    texts = {"".join(rnd.choice("ab " if spaced else "ab") for _ in range(rnd.randint(12, 40))) for _ in range(n)}
    raw = [t.encode() for t in sorted(texts)]
    owned = np.array([rnd.randint(1, len(r) - length + 1) for r in raw])
    lengths = (length, length + 7)
    got = suffix_dedup.repeated_starts(raw, owned, lengths)
    settled = suffix_dedup.settle([(7, r, int(k)) for r, k in zip(raw, owned, strict=True)], [False] * len(raw), lengths)
    for i, t in enumerate(lengths):
        windows = collections.Counter(r[s : s + t] for r, k in zip(raw, owned, strict=True) for s in range(min(k, len(r) - t + 1)))
        want = [[s for s in range(min(k, len(r) - t + 1)) if windows[r[s : s + t]] > 1] for r, k in zip(raw, owned, strict=True)]
        assert [x.tolist() for x in got[i]] == want
        assert [[] if x is None else x[i].tolist() for x in settled] == want


def test_owners_of_equal_windows_are_equal():
    rnd = random.Random(5)
    shared = bytes(rnd.choice(b"abc ") for _ in range(60))
    docs = [bytes(rnd.choice(b"abc ") for _ in range(k)) + shared + bytes(rnd.choice(b"abc ") for _ in range(k)) for k in (0, 7, 31)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    d, lo, hi, h, _ = suffix_dedup.owners(np.frombuffer(b"".join(docs), np.uint8), offsets, 40, 10)
    seen = {}
    for i in range(len(d)):
        for s in range(lo[i], hi[i] + 1):
            text = b"".join(docs)[s : s + 40]
            assert seen.setdefault(text, h[i]) == h[i]
    assert sum(hi - lo + 1) == sum(len(x) - 39 for x in docs)


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dimensions, bits):
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    key = hilbert_ann.hilbert_keys(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def matching(tokens, templates):
    """Length of the longest stretch ending at each token that a template contains, by trying all."""
    out = []
    for i in range(len(tokens)):
        n = 0
        while n <= i and any(tokens[i - n : i + 1] == t[k : k + n + 1] for t in templates for k in range(len(t) - n)):
            n += 1
        out.append(n)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=6), min_size=1, max_size=3), st.lists(st.integers(0, 3), max_size=15))
def test_matching_statistics(templates, tokens):
    a = license_scan.SuffixAutomaton(templates)
    found = list(a.statistics(tokens))
    assert [n for _, n in found] == matching(tokens, templates)
    for i, (state, n) in enumerate(found):
        if n:
            want = {(w, k + n) for w, t in enumerate(templates) for k in range(len(t) - n + 1) if t[k : k + n] == tokens[i - n + 1 : i + 1]}
            assert set(a.ends[state]) == want


def test_license_runs_do_not_change_the_walk():
    scanner = license_scan._scanner(tuple((k, tuple(v)) for k, v in license_scan.TEMPLATES.items()), (), 3, 0.8, 4)
    words = " ".join(sum(license_scan.TEMPLATES.values(), [])).split()
    rnd = random.Random(2)
    text = " ".join(rnd.choice(words) for _ in range(3000)) + " this work is licensed under the gnu general public license version 3 x"
    buf, offsets, _ = columns([text])
    w = kernel.Words(buf, offsets, kernel.ALNUM)
    state = list(scanner.automaton.statistics(w.hash.tolist()))
    full = {(i, n) for i, (_, n) in enumerate(state) if n >= 3 and (i + 1 == len(state) or state[i + 1][1] <= n)}
    assert {(d1 - 1, d1 - d0) for _, _, _, d0, d1 in scanner.anchors(w)} == full


def test_seeds_survive_substitutions():
    rnd = random.Random(1)
    item = " ".join(f"w{rnd.randint(0, 500)}" for _ in range(30))
    table = decontaminate.SeedTable([7], [item], decontaminate.MASKS)
    words = item.split()
    words[4] = words[15] = words[26] = "x"
    buf, offsets, _ = columns([None, "a b " + " ".join(words) + " c", "d e f"])
    w = kernel.Words(buf, offsets, kernel.SPACED)
    assert [c.tolist() for c in table.stretches(w, 13, 0.8)] == [[1], [0], [27], [30], [2], [30]]


def plain_stretch(a, b, diagonal, least, share):
    """(agreeing, tokens, first token) of the stretch with most agreement on a diagonal, all stretches tried."""
    lo, hi = max(0, diagonal), min(len(b), diagonal + len(a))
    best = None
    for end in range(lo, hi + 1):
        for start in range(lo, end + 1):
            hits = sum(a[j - diagonal] == b[j] for j in range(start, end))
            if 100 * hits >= 100 * share * (end - start) - 1e-6 and (best is None or hits > best[0]):
                best = hits, end - start, start
    return best if best and best[0] >= max(1, min(least, share * len(a))) else None


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_stretches_of_items_with_a_common_prompt(at_once, monkeypatch):
    """Every diagonal that a seed hits, against all stretches on it."""
    monkeypatch.setattr(decontaminate, "VERIFIED_TOKENS", at_once)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 30)}"
    prompt = [word() for _ in range(14)]
    items = [prompt + [word() for _ in range(rnd.randint(0, 12))] for _ in range(6)] + [[word() for _ in range(6)], prompt[3:9] + [word()] * 9]
    texts = [[], prompt * 2, [word() for _ in range(9)] + items[2] + prompt[2:], items[4][:11] + [word()] + items[4][12:], items[6] + items[7]]
    table = decontaminate.SeedTable(list(range(len(items))), [" ".join(i) for i in items], decontaminate.MASKS)
    buf, offsets, _ = columns([" ".join(t) for t in texts])
    w = kernel.Words(buf, offsets, kernel.SPACED)
    want = {}
    for d, i, diagonal in zip(*table.hits(w), strict=True):
        if found := plain_stretch(items[i], texts[d], diagonal - w.first[d], 13, 0.8):
            match, n, start = found
            want[d, i] = max(want.get((d, i), (0,)), (match, -n, -start))
    got = {(d, i): (match, -n, -start) for d, i, match, n, start, _ in zip(*table.stretches(w, 13, 0.8), strict=True)}
    assert got == want and len(want) >= 20


def test_common_prompt_is_met_once_a_place():
    """A thousand items with one prompt and a text that holds it fifty times."""
    prompt = [f"p{i}" for i in range(30)]
    items = [" ".join(prompt + [f"v{i} {j}" for j in range(10)]) for i in range(1000)]
    table = decontaminate.SeedTable(list(range(1000)), items, decontaminate.MASKS)
    assert len(set(table.entry[table.many > 1].tolist())) == 1
    buf, offsets, _ = columns([" ".join(" ".join([*prompt, f"t{i}"]) for i in range(50))])
    w = kernel.Words(buf, offsets, kernel.SPACED)
    began = time.perf_counter()
    found = table.stretches(w, 13, 0.8)
    assert time.perf_counter() - began < 3
    assert found[1].tolist() == list(range(1000)) and set(zip(*(c.tolist() for c in found[2:]), strict=True)) == {(30, 30, 0, 50)}


def test_blocks_open_exactly():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 400, 60)
    sets = [np.unique(np.concatenate([base[rnd.random(60) < 0.95], rnd.integers(0, 400, 3)])).astype(np.uint64) for _ in range(20)]
    block = ngram_join.Block(list(range(20)), sets)
    for s in sets:
        want = [i for i, t in enumerate(sets) if 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))]
        assert block.linked(s, 80).tolist() == want


def test_packed_arrays():
    for a in (np.array([], np.uint64), np.array([3, 9, 2**63], np.uint64)):
        assert (deleted_interpolation.unpack_sorted(deleted_interpolation.pack_sorted(a)) == a).all()


def test_weights_follow_the_evidence():
    n = 1000
    got = deleted_interpolation.learn_weights(np.zeros(n, int), np.full(n, 0.5), np.full(n, 0.01), np.ones(n), 1e-6)
    assert got[0, 0] > 0.9 and np.allclose(got.sum(axis=1), 1)


def test_language_model():
    rnd = random.Random(0)
    make = lambda sy: " ".join("".join(rnd.choice(sy) for _ in range(3)) for _ in range(30))
    texts = [make(["la", "el", "os"]) for _ in range(40)] + [make(["sch", "ung", "der"]) for _ in range(40)]
    model = language_id.train(texts, ["es"] * 40 + ["de"] * 40)
    buf, offsets, _ = columns([make(["la", "os"]), make(["sch", "ung"]), ""])
    p = model.probabilities(model.raw(kernel.Words(buf, offsets, kernel.LETTERS)))
    assert [model.languages[i] for i in p.argmax(axis=1)[:2]] == ["es", "de"] and np.allclose(p.sum(axis=1), 1)


def test_warc_round_trip():
    samples = [warc.record(i, "http://a/%d" % i, b"<p>hello</p>" * 20, 240, "d") for i in range(40)]
    for dictionary in (None, warc.build_dictionary(samples)):
        out = io.BytesIO()
        writer = warc.ArchiveWriter(out, dictionary)
        writer.add(warc.record(1, "http://a/\r\nX: y", "é".encode(), 2, "d1"))
        writer.add(warc.record(None, None, b"", 0, "d2"))
        writer.add(warc.record(3, "u", None, 2, "d1", 1))
        out.seek(0)
        got = list(warc.read_records(out))
        assert [h["warc-type"] for h, _ in got] == ["response", "response", "revisit"]
        assert got[0][1].endswith("é".encode()) and got[0][0]["warc-target-uri"] == "http://a/%0D%0AX:%20y"
        assert "warc-target-uri" not in got[1][0] and got[2][0]["warc-refers-to"] == "<urn:page:1>"
    assert list(warc.read_records(io.BytesIO())) == []
