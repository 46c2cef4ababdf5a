"""Tags learnt from labelled sentences, and look-ups that line up with words."""

import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np

from tessera.operators import tagging as T
from tessera.operators.registry import run

IN, OUT = "input data", "output data"


def sentences(seed, n, fresh=0.1):
    """Words whose tag depends on the word before; endings tell something about words not seen yet."""
    rng = random.Random(seed)
    nouns, verbs, both = [f"{x}tion" for x in "abcdefghij"], [f"{x}ates" for x in "abcdefghij"], ["run", "walk", "play", "watch", "light"]
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice(["the", "a"])]
            tags += ["D"]
            if rng.random() < 0.3:
                words, tags = words + [rng.choice(["big", "red", "old"])], tags + ["A"]
            for tag, known, end in (("N", nouns, "tion"), ("V", verbs, "ates")):
                new = "".join(rng.choices("klmnopqr", k=4)) + end
                words += [new if rng.random() < fresh else rng.choice(both) if rng.random() < 0.5 else rng.choice(known)]
                tags += [tag]
        out.append((words, tags))
    return out


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    for _ in range(30):
        emit, move = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
        score = lambda p, e=emit, m=move: m[-1, p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:], strict=False))
        assert T.viterbi(emit, move) == list(max(product(range(3), repeat=4), key=score))


def test_better_than_the_most_frequent_tag(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 60)
    train, held = sentences(1, 300), sentences(2, 100, fresh=0.3)
    counts = defaultdict(Counter)
    for words, tags in train:
        for w, t in zip(words, tags, strict=True):
            counts[w][t] += 1
    overall = Counter(t for _, tags in train for t in tags).most_common(1)[0][0]
    labelled = spark.createDataFrame([*train, (["x", None], ["N", "V"]), (["x"], ["N", "V"]), ([], []), (None, None)], "words array<string>, tags array<string>").repartition(5)
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(held)] + [(-1, None), (-2, []), (-3, ["the", None, "run"])], "id int, text array<string>")
    made = run("postagging", {IN: df, "train input data": labelled}, attributes=["text"], epochs=3)
    got = {r.id: r.text_postagging for r in made[OUT].collect()}
    total = right = base = new = new_right = 0
    for i, (words, tags) in enumerate(held):
        for w, t, g in zip(words, tags, got[i], strict=True):
            total, right, base = total + 1, right + (g == t), base + ((counts[w].most_common(1)[0][0] if w in counts else overall) == t)
            new, new_right = new + (w not in counts), new_right + (w not in counts and g == t)
    assert right / total > 0.97 > base / total and new > 50 and new_right / new > 0.95
    assert got[-1] is None and got[-2] == [] and got[-3] == ["D", None, "N"]
    again = run("postagging", {"train input data": labelled.coalesce(1)}, attributes=["text"], epochs=3)["model"]
    assert np.allclose(again.emit, made["model"].emit) and np.allclose(again.move, made["model"].move)
    named = run("ner", {IN: df, "model": made["model"]}, attributes=["text"], alias="entities")[OUT]
    assert {r.id: r.entities for r in named.collect()} == got


def test_look_ups_line_up_with_words(spark):
    df = spark.createDataFrame([(1, ["a", "b", None, "c"]), (2, []), (3, None), (4, ["b"])], "id int, w array<string>").repartition(3)
    table = spark.createDataFrame([("a", "A"), ("c", "C2"), ("c", "C"), (None, "none")], "word string, value string")
    got = {r.id: r.w_lemmatization for r in run("lemmatization", {IN: df, "dictionary": table}, attributes=["w"])[OUT].collect()}
    assert got == {1: ["A", None, None, "C"], 2: [], 3: None, 4: [None]}
