import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from test_bpe import ODD
from tokenizers import Tokenizer

from tessera.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["x<|endoftext|> y", "a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|>word", "a\n<|endoftext|>\n\nb", "<|endoftext|><|endoftext|> ", "<|endof text|> no"]


def rows(e, texts, end=None):
    ids, last = e.encode(pa.array(texts, pa.string()), end)
    return [x.tolist() for x in np.split(ids, last)[:-1]]


def test_word_cache_gives_the_library_ids():
    random.seed(9)
    alphabets = ["aabcdeorstnil  \n\n\t'éß1.,-!?:;🙂日  ", "aé×÷ª²٣ \n\r\t\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u3000'.s1", "ab'sSdDmtlLvere \n.", "ǅɐʰ́ЖΩ中ー“”–€ a1.\n"]
    texts = ODD + ["".join(random.choices(a, k=random.randrange(1, 60))) for a in alphabets for _ in range(3000)] + ["a. b, c.\nD e.\n\nF .. g!? h.\n.i", "don't 'tis he'll'll y'all've"]
    e = tf.Encoder(PATH)
    assert e.cuts
    want = library(texts)
    assert rows(e, texts) == want
    assert rows(e, texts[:5000], 7) == [[*x, 7] for x in want[:5000]]
    pure = library(texts + SPECIAL)
    assert rows(e, texts[-50:] + SPECIAL, 0) == [[*x, 0] for x in pure[-50 - len(SPECIAL) :]]
    assert 50256 in library(["a <|endoftext|> b"])[0]
    assert rows(e, [], 0) == [] and rows(e, [""], 0) == [[0]] and rows(e, ["", "", "a"]) == [[], [], [64]]


@pytest.mark.parametrize("limit", [3, 5, 18])
def test_code_is_optimal_within_the_limit(limit):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8):
        counts = rng.integers(1, 1000, n) ** 2
        counts = np.concatenate((counts, [0]))
        bits = tf.code_lengths(counts, limit)
        assert bits[-1] == 0 and (bits[:-1] > 0).all()
        used = bits[bits > 0]
        assert (0.5**used).sum() <= 1
        if n > 1:
            assert used.max() <= max(limit, int(np.ceil(np.log2(n))) + 1)
            best = min((sum(c * b for c, b in zip(sorted(counts[:-1], reverse=True), lens, strict=True)) for lens in lengths_of(n, max(limit, int(np.ceil(np.log2(n))) + 1))))
            assert (counts * bits).sum() == best


def lengths_of(n, limit):
    """All non-decreasing length lists that satisfy Kraft's inequality."""
    def grow(done, room):
        if len(done) == n:
            yield done
            return
        for b in range(done[-1] if done else 1, min(limit, 8) + 1):
            if room >= 0.5**b:
                yield from grow([*done, b], room - 0.5**b)
    return list(grow([], 1.0))


def test_round_trip_of_blocks():
    rng = np.random.default_rng(2)
    for n in (1, 2, 127, 128, 129, 5000):
        ids = np.minimum(rng.zipf(1.3, n), 3000)
        bits = tf.code_lengths(np.bincount(np.concatenate((ids, np.arange(3001)))), 18)
        payload, marks = tf.compress(ids, bits, tf.canonical(bits))
        assert np.array_equal(tf.expand(payload, n, marks, tf.decoding_table(bits)), ids)


def test_files(spark, make_docs):
    rows = [(i * 7, t) for i, t in enumerate(ODD + SPECIAL)] + [(3, None), (None, "no id"), (5, "w " * 3000), (7, "same id"), (2000, "x\n")]
    path = tf.write_tokens(make_docs(rows), PATH, block=64)
    got = sorted(tf.read_tokens(spark, path, True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = {}
    for (i, _), ids in zip(rows, library([t or "" for _, t in rows]), strict=True):
        want.setdefault(i, []).append([*ids, 0])
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    empty = tf.write_tokens(make_docs(rows).filter("false"), PATH)
    assert tf.read_tokens(spark, empty).count() == 0
