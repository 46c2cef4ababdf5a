"""Fingerprints against sets of paragraphs, and the query against a plain version."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sketches


def brute(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) with sets in place of sketches."""
    key = lambda r: (r[0] is None, -(r[0] or 0), np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64).item(), r[1] or "")
    rows = sorted(rows, key=key)

    def near(a, b):
        a, b = (set(sketches.digests(x).tolist()) for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    out = []
    for n, (i, text) in enumerate(rows):
        text, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near(text, edited), 9), round(near(text, following), 9)))
    return sorted(out, key=repr)


def texts(rng, n):
    sentence = lambda: " ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(rng.randrange(2, 12))) + rng.choice(". ! ? ... \n .\n".split(" "))
    pool = [sentence() for _ in range(60)]
    out = [" ".join(rng.choice(pool) if rng.random() < 0.5 else sentence() for _ in range(rng.choice([1, 2, 5, 20, 60]))) for _ in range(n)]
    return [*out, None, "", "", " \n ", "x", out[0], out[0], out[1], "same line.\n" * 50, "w" * 5000, "word " * 4000, "𝄞é" * 300, " ".join(sentence().strip(".!?\n") for _ in range(3000))]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_sets(spark, make_docs, parts):
    rng = random.Random(parts)
    rows = list(zip(rng.sample(range(-500, 500), 93), texts(rng, 80), strict=True))
    rows += [(rows[0][0], "another text with this id. And more."), rows[3], rows[3], (None, "no id."), (None, None)]
    got = sketches.fingerprints(make_docs(rows), parts=parts)
    told = [tuple(round(v, 9) if isinstance(v, float) else v for v in (r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in got.collect()]
    assert sorted(told, key=repr) == brute(rows)


def test_equal_texts_have_equal_fingerprints(make_docs):
    rng = random.Random(9)
    some = texts(rng, 40)
    rows = [(i, t) for i, t in enumerate(some + some)]
    prints = {r.doc_id: r.fingerprint for r in sketches.fingerprints(make_docs(rows, parts=5)).collect()}
    assert all(prints[i] == prints[i + len(some)] for i in range(len(some)))
    distinct = {frozenset(sketches.digests(t or "").tolist()) for t in some}
    assert len(set(prints.values())) == len(distinct)


def test_recovers_the_differing_digests():
    rng = np.random.default_rng(2)
    pairs = []
    for common, mine, theirs in [(0, 0, 0), (50, 0, 0), (3000, 2, 1), (10, 500, 0), (0, 300, 280), (1, 0, 1), (900, 40, 35)]:
        d = rng.integers(1, 1 << 63, common + mine + theirs, dtype=np.uint64)
        pairs.append((np.concatenate([d[:common], d[common : common + mine]]), np.concatenate([d[:common], d[common + mine :]])))
    a, b = zip(*pairs, strict=True)
    pair, d, sign = sketches.recovered(list(a), list(b))
    for i, (x, y) in enumerate(pairs):
        assert set(d[(pair == i) & (sign == 1)].tolist()) == set(x.tolist()) - set(y.tolist())
        assert set(d[(pair == i) & (sign == -1)].tolist()) == set(y.tolist()) - set(x.tolist())


def test_small_differences_peel_from_the_smallest_sketch():
    rng = np.random.default_rng(3)
    d = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    pairs = [(d, np.concatenate([d[2:], rng.integers(1, 1 << 63, 1, dtype=np.uint64)])) for _ in range(200)]
    done = sketches.difference(sketches.Sketches([x for x, _ in pairs]), sketches.Sketches([y for _, y in pairs]))[3]
    assert done.mean() > 0.9


def test_empty_single_and_clashing_columns(spark, make_docs):
    assert sketches.fingerprints(make_docs([(1, "a")]).limit(0)).collect() == []
    (row,) = sketches.fingerprints(make_docs([(1, "One. Two. Three.")])).collect()
    assert row.near_next == 1.0 and row.n_chars == 16
    docs = make_docs(list(enumerate(texts(random.Random(5), 20))))
    more = docs.withColumns({c: F.lit("?") for c in "hash luck lot guest to k fingerprint near_next".split()})
    assert sorted(sketches.fingerprints(more).collect()) == sorted(sketches.fingerprints(docs).collect())
