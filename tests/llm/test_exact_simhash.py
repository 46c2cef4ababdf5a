import hashlib
import random
import re

import numpy as np
import xxhash

from tessera.llm import exact, simhash
from tessera.llm.graph import connected_components

TEXTS = [(5, "a b"), (3, "ab"), (9, " a\tb "), (1, None), (2, ""), (4, " \n"), (7, "c" * 50_000), (8, "c" * 50_000), (6, "x"), (None, "y"), (None, "y"), (11, "é a"), (12, "éa"), (13, " x")]


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((i, best[3], len(groups[norm]), i == best[3] and -len(t or "") == best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_matches_brute_force(spark, make_docs):
    random.seed(1)
    rows = TEXTS + [(100 + i, random.choice(["p q", "pq ", "p  q", "zz", "z z z"])) for i in range(200)] + [(500, "rep"), (500, "rep")]
    got = [tuple(r) for r in exact.exact_report(make_docs(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == exact_brute(rows)


def test_exact_dedup_keeps_one_row_and_foreign_columns(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(1, "a"), (2, " a"), (500, "rep"), (500, "rep"), (7, "b")]).withColumn("keep_id", F.lit("mine")).withColumn("key", F.lit(1))
    got = exact.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 500]
    assert exact.deduplicate(docs.filter("false")).count() == 0
    assert exact.exact_report(docs.filter("false")).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}
    for a, b in linked:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a
    return {i: top(i) for i in ids}


def test_simhash_matches_brute_force(spark, make_docs):
    random.seed(3)
    base = ["".join(random.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = [(i, " ".join(random.choices(base, k=random.choice([0, 1, 2, 3, 5, 300])))) for i in range(120)]
    long = random.choices(base, k=600)
    for i in range(120, 180):
        t = list(long)
        t[random.randrange(600)] = "CHANGED"
        rows.append((i, " ".join(t)))
    rows += [(190, None), (191, ""), (192, " "), (193, rows[0][1]), (194, "Été " * 9000)]
    fp = {i: brute_print(t) for i, t in rows}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = components(list(fp), linked)
    for tile in (4096, 8):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(make_docs(rows), tile=tile).collect()}
        assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert len(set(want.values())) < len(want) - 10
    assert simhash.simhash_groups(make_docs(rows).filter("false")).count() == 0


def test_pigeonhole_tables_miss_no_pair():
    tables = simhash.pigeonhole_tables()
    for i in range(64):
        for j in range(i, 64):
            assert any(i not in t and j not in t for t in map(set, tables))


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    for bits, radius in ((64, 2), (64, 0), (256, 44), (64, 1)):
        x = (rng.random((300, bits)) < 0.5).astype(np.uint8)
        x[100:200] = x[5] ^ (rng.random((100, bits)) < radius / bits).astype(np.uint8)
        group = np.sort(rng.integers(0, 5, 300))
        got = {(a, b) for lot in simhash.within(x, group, np.zeros(300, int), np.zeros(300, bool), radius) for a, b in zip(*map(np.ndarray.tolist, lot), strict=True)}
        d = (x[:, None, :] != x[None]).sum(2)
        want = {(a, b) for a in range(300) for b in range(300) if a != b and group[a] == group[b] and d[a, b] <= radius}
        assert got == want


def test_components_of_long_chains_and_stars(spark):
    random.seed(5)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000), (None, 4)]
    random.shuffle(pairs)
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(pairs, "x long, y long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark, spark.createDataFrame([], "x long, y long")).count() == 0
