import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hmm


def model(rng, k, s):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((s, k)), 0))


def test_forward_and_counts_equal_sums_over_all_paths():
    rng = np.random.default_rng(0)
    m = model(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (6, 4, 4, 2, 1)]
    first, moves, emissions, total = hmm.expected(seqs, m)
    want_first, want_moves, want_emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, got in zip(seqs, hmm.forward(seqs, m), strict=True):
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            paths[path] = p
        z = sum(paths.values())
        assert got == pytest.approx(math.log10(z))
        for path, p in paths.items():
            want_first[path[0]] += p / z
            for t, (k, w) in enumerate(zip(path, s, strict=True)):
                want_emissions[w, k] += p / z
                if t:
                    want_moves[path[t - 1], k] += p / z
    assert np.allclose(first, want_first) and np.allclose(moves, want_moves) and np.allclose(emissions, want_emissions)


def test_rounds_never_lose_likelihood():
    rng = np.random.default_rng(1)
    true = model(rng, 2, 6)
    seqs = sorted((rng.choice(6, rng.integers(1, 40), p=true.emit[:, i % 2]) for i in range(60)), key=len, reverse=True)
    m, last = model(rng, 2, 6), -math.inf
    for _ in range(6):
        *counts, total = hmm.expected(seqs, m)
        assert total >= last - 1e-9
        m, last = hmm.maximise(*counts, np.full(6, 1 / 6), 1e-9), total


def rows():
    random.seed(1)
    kinds = ["the cat and dog ran home to".split(), "der hund und katze lief nach haus".split()]
    out = [(i, " ".join(random.choices(kinds[i % 2], k=random.choice([1, 30, 200])) + [f"rare{i}"] * (i % 3))) for i in range(200)]
    return out + [(300, None), (301, ""), (302, " THE the\n"), (None, "the cat"), (5, out[5][1]), (303, "the " * 20_000), (304, "neverseen " * 3)]


@pytest.mark.parametrize("top", [60_000, 5])
def test_scores(spark, make_docs, top):
    data = rows()
    got = {}
    for r in hmm.score_documents(make_docs(data), top=top).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(data)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(w for i, t in data if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    better = 0
    for i, t in data:
        for r in got[i]:
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
            assert r.base_score == pytest.approx(base) and r.score < 0
            better += r.held_out and r.score > r.base_score
    assert better >= 0.6 * sum(held(i) for i, _ in data)


def test_probabilities_of_next_tokens_sum_to_one(spark, make_docs):
    words = ["a b a", "b c", "a", "d d d e"]
    data = list(enumerate(words))
    vocabulary = sorted({w for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()})
    docs = make_docs(data + [(7 * 10**6 + k, "") for k in range(0)])
    counts = docs.filter(~hmm.held_out())
    from pyspark.sql import functions as F

    table = hmm.text_of(counts).mapInArrow(hmm._count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    voc = hmm.vocabulary(table, top=2)
    assert voc.unigram.sum() == pytest.approx(1) and len(vocabulary) + 1 == voc.distinct
    assert hmm.score_documents(docs.filter("false")).count() == 0
    lone = hmm.score_documents(make_docs([(2, "x y")]).filter(hmm.held_out() | F.lit(True)))
    assert lone.count() == 1


@pytest.mark.parametrize("top", [50, 4])
def test_scores_against_brute_force(spark, make_docs, top, monkeypatch):
    """The whole query from a given start: rounds and scores by sums over plain loops, each word with its own emissions."""
    rng = random.Random(3)
    data = [(i, " ".join(rng.choices("aa bb cc dd ee ff gg hh".split(), [9, 7, 6, 5, 3, 2, 1, 1], k=rng.randrange(0, 25)) + ["new"] * (i % 9 == 0))) for i in range(80)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in data if not held(i) for w in [*t.split(), ""])
    first = []

    def start(sample, unigram, states, **_):
        first.append(model(np.random.default_rng(7), states, len(unigram)))
        return first[-1]

    monkeypatch.setattr(hmm, "fit_sample", start)
    chosen = []
    plain = hmm.vocabulary
    monkeypatch.setattr(hmm, "vocabulary", lambda c, n: chosen.append(plain(c, n)) or chosen[-1])
    got = {r.doc_id: r for r in hmm.score_documents(make_docs(data), top=top, states=2, rounds=2).collect()}
    voc, m, k = chosen[0], first[0], 2
    ways = sum(counts.values()) + len(counts) + 1
    place = lambda w: 0 if w == "" else voc.symbols.get(w.encode(), voc.other)
    assert (len(voc.symbols) == len(counts) - 1) == (top == 50)

    def passes(tokens, begin, move, emission):
        a, b = [begin * emission(tokens[0])], [np.ones(k)]
        for w in tokens[1:]:
            a.append((a[-1] @ move) * emission(w))
        for w in tokens[:0:-1]:
            b.insert(0, move @ (emission(w) * b[0]))
        return a, b

    begin, move, symbol = m.start, m.move, m.emit
    for _ in range(2):
        starts, moves, by_word = np.zeros(k), np.zeros((k, k)), {w: np.zeros(k) for w in counts}
        emission = lambda w, e=symbol: e[place(w)]
        for i, t in data:
            if held(i):
                continue
            tokens = [*t.split(), ""]
            a, b = passes(tokens, begin, move, emission)
            z = a[-1].sum()
            starts += a[0] * b[0] / z
            for n, w in enumerate(tokens):
                by_word[w] += a[n] * b[n] / z
                if n:
                    moves += np.outer(a[n - 1], emission(w) * b[n]) * move / z
        total = sum(by_word.values())
        begin = (starts + 1 / k) / (starts.sum() + 1)
        move = (moves + hmm.PRIOR / k) / (moves.sum(axis=1, keepdims=True) + hmm.PRIOR)
        each = lambda w, e=by_word, s=total: (e.get(w, 0) + voc.weight * (counts[w] + 1) / ways) / (s + voc.weight)
        symbol = np.array([each("")] + [each(w.decode()) for w in voc.symbols] + [sum((each(w) for w in counts if place(w) == voc.other), each("never"))])
    assert np.allclose(sum(each(w) for w in counts) + each("never"), 1)
    for i, t in data:
        a, _ = passes([*t.split(), ""], begin, move, each)
        assert got[i].score == pytest.approx(math.log10(a[-1].sum()), abs=1e-8)


def test_scores_do_not_depend_on_the_layout(spark, make_docs):
    data = [r for r in rows() if r[0] is not None][:150]
    first = None
    for parts in (1, 2, 7):
        got = {r.doc_id: (r.score, r.base_score) for r in hmm.score_documents(make_docs(data, parts=parts), top=6).collect()}
        first = first or got
        for i, pair in got.items():
            assert pair == pytest.approx(first[i], rel=1e-9)


def test_too_many_symbols_are_an_error(spark, make_docs):
    with pytest.raises(ValueError, match="symbols"):
        hmm.score_documents(make_docs(["a"]), top=70_000)


def test_unseen_texts_are_better_told_than_by_the_unigram(spark):
    """Over the whole test table: held-out texts have a higher likelihood than under the add-one unigram, and so have most of them."""
    rows = hmm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.5 * len(rows)


def test_stored_tables_are_small(spark, monkeypatch):
    """A word without a symbol is stored with its text and once with its counts, and pairs of a text and a word pass in parts."""
    from pathlib import Path

    from tessera.llm import common

    paths, plain = [], common.scratch
    monkeypatch.setattr(common, "scratch", lambda *a: paths.append(plain(*a)) or paths[-1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    hmm.score_documents(docs, top=500).count()
    stored = sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet"))
    assert 0 < stored < 2.4 * size
