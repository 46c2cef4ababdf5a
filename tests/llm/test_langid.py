import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langid

EN, DE = "the cat and the dog were at the house with them ", "der hund und die katze waren in dem haus mit ihnen "


def brute_grams(text):
    marked = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    marked = " " + " ".join(marked.split()) + " "
    return sorted(g for n in (1, 2, 3) for i in range(len(marked) - n + 1) if (g := marked[i : i + n]).strip())


TEXTS = ["", " ", "a", "  Hello, wörld!! it's 5 o'clock ", "éé\nñ x", "日本 語", "Ω \U00032100 ж", EN]


@pytest.mark.parametrize("more", ["", "".join(map(chr, range(0x4E00, 0x5200)))])
@pytest.mark.parametrize("text", TEXTS)
def test_ngrams(text, more):
    letters = sorted({ord(c.lower()[0]) for c in "".join(TEXTS) + more if c.isalpha()})
    alphabet = langid.Alphabet(letters)
    assert (alphabet.space > langid._DENSE) == bool(more)

    def said(code):
        n = 1 if code < alphabet.two else 2 if code < alphabet.three else 3
        code -= (0, alphabet.two, alphabet.three)[n - 1]
        digits = [code // alphabet.base**k % alphabet.base for k in range(n)][::-1]
        return "".join(" " if d == 0 else chr(letters[d - 1]) for d in digits)

    assert sorted(map(said, alphabet.ngrams(text).tolist())) == brute_grams(text)
    few = langid.Alphabet([97, 98])
    assert len(few.ngrams(text)) == len(brute_grams(text)) and few.ngrams("z").tolist()[0] == 3


@pytest.mark.parametrize("dense", [True, False])
def test_predictions_against_brute_force(spark, make_docs, dense, monkeypatch):
    """The whole query, from character n-grams counted in plain Python; four scripts, so that codes of either kind are met."""
    if not dense:
        monkeypatch.setattr(langid, "_DENSE", 1)
    kinds = {"en": EN, "de": DE, "ru": "кот и собака были в доме с ними всегда ", "el": "η γάτα και ο σκύλος ήταν στο σπίτι "}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(kinds[lang].split(), rng.integers(1, 25))), lang, None, None) for i, lang in ((i, list(kinds)[i % 4]) for i in range(120))]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    order = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    top = 60
    profiles = {}
    for lang in kinds:
        n = Counter(g for i, t, k, *_ in rows if k == lang and not held(i) for g in brute_grams(t))
        profiles[lang] = {g: r for r, g in enumerate(sorted(n, key=lambda g: (-n[g], order(g)))[:top])}
    every = set().union(*profiles.values())
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), top).collect()}
    for i, t, *_ in rows:
        n = Counter(g for g in brute_grams(t) if g in every)
        mine = sorted(n, key=lambda g: (-n[g], order(g)))[:top]
        distance = {k: sum(min(abs(p[g] - r), top) if g in p else top for r, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(kinds), key=distance.__getitem__)
        assert (got[i].lang_pred, got[i].held_out) == (best, held(i)) and got[i].score == pytest.approx(1 - distance[best] / (top * len(mine)))


def test_distance_matches_definition():
    p = langid.Profiles([("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("b", 3, 1)], langid.Alphabet(map(ord, "abc")), top=2)
    lang, score = p.predict("abb")  # a: 1, b: 2, and other n-grams in no profile
    # ranks of the text: b (code 2), a (code 1); to a: |1-0| + |0-1| = 2, to b: |0-0| + 2 = 2; a is first
    assert (lang, score) == ("a", 1 - 2 / 4)


def test_held_out_accuracy_and_odd_rows(spark, make_docs):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice((EN if i % 2 else DE).split(), 30)), "en" if i % 2 else "de", None, None) for i in range(300)]
    rows += [(900, None, "en", None, None), (901, "", "en", None, None), (902, "12 !", None, None, None), (903, "the dog " * 20_000, None, None, None), (None, "the dog and the cat", "en", None, None), (0, rows[0][1], "de", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in range(300):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].lang_pred == ("en" if i % 2 else "de") and 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "en"] and not by[None].held_out
    assert langid.identify(docs.filter("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(docs, 0.05)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 900) == [903]


def test_foreign_and_junk_texts_are_rejected(spark):
    """Real documents all stay; texts in no learned language and noise go. A single letter is too little to tell."""
    rng = np.random.default_rng(2)
    noise = lambda letters, n, size: " ".join("".join(rng.choice(list(letters), size)) for _ in range(n))
    junk = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である",
        noise("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 1, 800),
        noise("abcdefghijklmnopqrstuvwxyz", 100, 6),
        noise("zqxj", 100, 5),
    ]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1 - i, x, None, None, None) for i, x in enumerate([*junk, "x"])], real.schema)
    kept = {r.doc_id for r in langid.keep_identified(real.unionByName(extra), 0.05).select("doc_id").collect()}
    has_letters = {r.doc_id for r in langid.identify(real).collect() if r.lang_pred != "und"}
    assert kept == has_letters | {-1 - len(junk)}
