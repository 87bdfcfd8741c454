"""Toxicity, filter audit and token alignment on small fixtures with every hard case, against plain versions."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, token_alignment, toxicity

ODD = [None, "", " ", "a", " a", "a ", "\n", "\n a", "a \n b", "a\n  b", "a▁b", "<|endoftext|> x", "</s> <0x41>", "日本語 です", "😀👩‍👧 a　d", "a\x00b", "it's 'S 123", "  lead\n\n  trail   ", "\x85 b", "ﬁ İ ß", "a" * 400, "ab " * 300, "ab " * 300]
DOCS = "doc_id long, text string, source string, extra int, pair string"


def plain_alignment(rows, file_a, file_b):
    """Whole texts through the libraries, tokens walked one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(file_a), sentencepiece.SentencePieceProcessor(model_file=file_b)
    a_side.encode_special_tokens = True
    symbols, entry = token_alignment.byte_of_symbol(), {i: e for e, i in a_side.get_vocab().items()}
    bytes_b = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for key, text in rows:
        groups = []
        if text:
            sides = [[(i, bytes(symbols[c] for c in entry[i])) for i in a_side.encode(" " + text, add_special_tokens=False).ids], [(i, bytes_b(i)) for i in b_side.encode(text)]]
            if all(b"".join(x for _, x in side) == (" " + text).encode() for side in sides):
                ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in sides]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [[[], []] for _ in cuts]
                for n, (side, end) in enumerate(zip(sides, ends, strict=True)):
                    at = 0
                    for (i, _), e in zip(side, end, strict=True):
                        groups[at][n].append(i)
                        at += e == cuts[at]
        docs.append((key, groups))
    links = [[(a, b) for x, y in groups for a in x for b in y] for _, groups in docs]
    count = collections.Counter(p for each in links for p in set(each))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(highest.get(a, 0), n)
    for (key, groups), each in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(each), sum(count[p] == highest[p[0]] for p in each), sum(count[p] for p in each), text


@pytest.mark.parametrize(("block", "links"), [(1 << 22, 1 << 20), (300, 40)])
def test_alignment(spark, block, links, monkeypatch):
    """Blocks and slices of any size, with null and repeated keys, columns of clashing names and odd texts."""
    import public_tokenizers

    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment, "SLICE_LINKS", links)
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice(" \t\nab'sé日😀1,.") for _ in range(rnd.randint(1, 40))) for _ in range(200)]
    texts.append("".join(rnd.choice("abcdef éß日. ") for _ in range(60_000)))
    rows = [(i if i % 40 else None, x) for i, x in enumerate(texts)] + [(7, "a b")]
    files = [public_tokenizers.path(x) for x in (token_alignment.FILE_A, token_alignment.FILE_B)]
    docs = spark.createDataFrame([(k, x, "s", 1, "p") for k, x in rows], DOCS)
    got = token_alignment.align(docs, *files)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    order = lambda found: sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order(got.collect()) == order(plain_alignment(rows, *files))
    assert token_alignment.align(docs.limit(0), *files).count() == 0


def test_bitsets():
    rnd = random.Random(2)
    places = sorted(rnd.sample(range(1000), 300))
    bits = token_alignment.bitset(np.array(places), 1000)
    assert token_alignment.select(bits).tolist() == places
    asked = np.arange(1000)
    assert token_alignment.rank(bits, asked).tolist() == [sum(p <= i for p in places) for i in range(1000)]


def test_filter_audit(spark):
    """Null sources, texts and ids, copies among them, repeated rows and labels, against counting row by row."""
    rnd = random.Random(4)
    words = lambda n, of: " ".join(f"w{rnd.randrange(of)}" for _ in range(n))
    rows = []
    for i in range(300):
        text = rnd.choice([None, "", words(60, 500), words(60, 20), words(20, 500), words(55, 400).upper(), words(70, 900) + " #", "the same text", "É" * 30, "\xa0" + words(52, 90)])
        rows.append((None if i % 29 == 0 else i, text, rnd.choice([None, "", "a", "b"]), 0, "p"))
    rows += rows[:12]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    made = filter_audit.audit(filter_audit.verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    good, toxic = ({k for k, *v in labels if v[c] == 1 and k is not None} for c in (0, 1))
    fails = []
    for key, text, part, *_ in rows:
        x = text or ""
        w = [y for y in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in x).split(" ") if y]
        failed = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in x) > 5 * len(x)) + "D" * any(c in "#$%&*|" for c in x)
        failed += "E" * any(key is not None and k is not None and k < key and (t or "") == x for k, t, *_ in rows)
        fails.append((part or "", failed, key in good, key in toxic))
    want, total = {}, collections.Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                failing = [f for f in fails if f[0] == part and letter in f[1]]
                total[part, letter] += len(gone)
                want[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(f[1] == letter for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone))
    got = {(r.part, r.filter_order, r.step): r for r in made.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        r = got[k]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == v and r.shapley == total[k[0], k[1][k[2] - 1]]
    none = filter_audit.audit(filter_audit.verdicts(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert none.count() == 0


def test_audit_visits_each_set_once(spark, monkeypatch):
    """Of 3! = 6 orders the trie has 16 nodes, of which 7 sets still have a filter to come."""
    rows = spark.createDataFrame([("p", 1, 0, True, False, None), (None, 0, 1, True, True, True)], "part string, good int, toxic int, A boolean, B boolean, C boolean")
    kept, kind = [], type(rows)
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: kept.append(1) or persist(self, *a))
    got = filter_audit.audit(rows, "ABC")
    assert got.count() == 2 * 6 * 3 and len(kept) == 7
    first = got.where("part = 'p' and filter_order = 'ABC' and step = 1").first()
    assert (first.kept, first.removed, first.unique_fails, first.good_lost, first.shapley) == (0, 1, 1, 1, 6)


def toxic_corpus(n, seed):
    rnd = random.Random(seed)
    syllables = ["ta", "lo", "mi", "né", "ru", "sk"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 120))]
        bad = i % 4 == 0
        for _ in range(rnd.randint(2, 5) * bad):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vikzo", "Xughi"]) + rnd.choice(syllables))
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxicity_of_texts_not_seen():
    fit, new = toxic_corpus(800, 1), toxic_corpus(400, 2)
    model = toxicity.train([t for t, _ in fit], [y for _, y in fit])
    assert sum((score(model, t) >= 0.5) == (y == 1) for t, y in new) >= 0.98 * len(new)
    assert score(model, "") < 0.5 and score(toxicity.train(["a"], [0]), "x") < 0.5


def score(model, text):
    """A text's score n-gram by n-gram, without the arrays that the operator works on."""
    weight = dict(zip(model.grams.tolist(), model.weight.tolist(), strict=True))
    seen = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        seen |= set(toxicity.word_grams([w])[0].tolist())
    return 1 / (1 + math.exp(-model.bias - sum(weight.get(g, 0.0) for g in seen)))


def test_toxicity_scores(spark, monkeypatch):
    """Every row's score against the plain version: nulls, empty and long texts, repeated rows, a clashing column."""
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    fit = toxic_corpus(300, 3)
    model = toxicity.train([t for t, _ in fit], [y for _, y in fit])
    texts = [*(t for t, _ in fit[:40]), *ODD, "taxughi " * 50_000, fit[0][0]]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, toxicity double").repartition(3)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert math.isclose(got[i], score(model, t or ""), abs_tol=1e-9)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_word_grams():
    grams, n = toxicity.word_grams(["Ab", "x"])
    assert n.tolist() == [3 + 2 + 1, 2 + 1] and len(set(grams.tolist())) == 9  # of 4 and 3 characters with the marks
    assert toxicity.word_grams(["aB"])[0].tolist() == grams[:6].tolist() and toxicity.word_grams([])[0].tolist() == []


def test_toxicity_sample(spark):
    """The same rows in every run, bounded, of both labels, and never of a null or unknown label."""
    docs = spark.createDataFrame([(i, f"text {i}", "s", 1, "p") for i in range(500)], DOCS)
    labels = spark.createDataFrame([(i, [0, 1, None, 7][i % 4]) for i in range(500)] + [(1, 1), (None, 1)], "doc_id long, toxic int")
    first = toxicity.sample(docs, labels, "doc_id", "text", "toxic", per_label=20)
    again = toxicity.sample(docs.repartition(5), labels.repartition(3), "doc_id", "text", "toxic", per_label=20)
    assert first == again and len(first[0]) <= 40 and set(first[1]) == {0, 1}
    assert all(int(t.split()[1]) % 4 == y for t, y in zip(first[0], first[1], strict=True))
    assert toxicity.sample(docs.where(F.lit(False)), labels, "doc_id", "text", "toxic")[0] == []
