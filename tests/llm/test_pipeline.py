import random

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def corpus():
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 200))) for i in range(60)]
    near = rows[3][1].split()
    for i in range(100, 110):
        t = list(near)
        t[rng.randrange(200)] = "other"
        rows.append((i, " ".join(t)))
    rows += [(200, rows[5][1]), (201, " " + rows[5][1]), (202, None), (203, ""), (204, "12 34 !!"), (300, "twice read text"), (300, "twice read text"), (None, " ".join(words(rng, 50)))]
    return rows


def test_stages(spark, make_docs):
    docs = make_docs(corpus()).withColumn("gone", F.lit(1)).withColumn("fp", F.lit("x"))
    columns = docs.columns
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))
    kept = corpus_pipeline.language(spark, docs, "")
    assert set(ids(docs)) - set(ids(kept)) == {202, 203, 204}
    exact = corpus_pipeline.exact_copies(spark, kept, "")
    assert ids(exact).count(300) == 1 and {5, 200, 201} & set(ids(exact)) == {201}
    near = corpus_pipeline.near_copies(spark, exact, "")
    assert set(ids(exact)) - set(ids(near)) == set(range(100, 110))
    mix = corpus_pipeline.mix(spark, near, "")
    assert [x.columns for x in (kept, exact, near, mix)] == [columns] * 4 and set(ids(mix)) <= set(ids(near))
    out = corpus_pipeline.token_ids(spark, mix, "")
    assert out.count() == mix.count() and out.filter("size(ids) <> n_tokens").isEmpty()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0


def jaccard(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_against_brute_force(spark, make_docs):
    """Of pairs whose shingle similarity is 0.8 to 0.85, 0.95 and more go; of those of 0.7 to 0.8 none does."""
    rng = random.Random(8)
    rows, above, below = [], set(), set()
    while min(len(above), len(below)) < 150:
        t = words(rng, 200)
        u = list(t)
        for k in rng.sample(range(200), rng.choice((4, 5, 6, 7))):
            u[k] = "changed"
        like = jaccard(t, u)
        if 0.7 <= like <= 0.85:
            i = len(rows)
            (above if like >= 0.8 else below).add(i + 1)
            rows += [(i, " ".join(t)), (i + 1, " ".join(u))]
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, make_docs(rows), "").collect()}
    assert set(range(0, len(rows), 2)) <= kept and below <= kept
    assert len(above & kept) <= 0.05 * len(above)


def test_rows_with_shared_and_missing_ids(spark, make_docs):
    """Rows go, not ids: against the groups of all pairs, of each group the row with the least id (null last) stays."""
    rng = random.Random(12)
    rows = []
    for family in range(30):
        t = words(rng, 150)
        for _ in range(rng.randrange(1, 5)):
            u = list(t)
            u[rng.randrange(150)] = "other"
            rows.append((rng.choice([None, family % 7, 500 + len(rows)]), " ".join(u)))
    rows += [rows[0], rows[0], (None, None), (None, ""), (3, "")]
    docs = make_docs(rows, parts=5).withColumn("h", F.lit("x")).withColumn("label", F.lit(2))
    left = corpus_pipeline.near_copies(spark, docs, "")
    assert left.columns == docs.columns
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(max(len((t or "").split()) - 4, 1))} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    groups = [[rows[i] for i in range(len(rows)) if group[i] == g] for g in sorted(set(group))]
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len(got) == len(groups)
    for members in groups:
        (stays,) = [r for r in members if r in got][:1]
        assert sum(r in got for r in set(members)) == 1
        assert (stays[0] is None, stays[0] or 0) == min((i is None, i or 0) for i, _ in members)


def test_near_copy_groups_through_failed_proposals(spark, make_docs):
    """Families in which many proposed pairs fail: groups are those of all pairs of similarity 0.8."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        t = words(rng, 150)
        for step in range(14):  # a walk: neighbours are alike, others less and less
            texts.append(list(t))
            for k in rng.sample(range(150), 2 if step % 5 else 5):
                t[k] = words(rng, 1)[0]
    docs = make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i // 14 * 14, i):
            if jaccard(texts[i], texts[j]) >= 0.8 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = simhash.similar_groups(docs, 0.8, 5, 4, corpus_pipeline.RADIUS, simhash.sampled_tables(), tile=16).collect()
    found = {r.doc_id: r.component_id for r in got}
    assert len(set(group)) > 20 and sum(found[i] != g for i, g in enumerate(group)) <= 0.05 * len(texts)
    assert all(group[i] == group[c] for i, c in found.items())


def test_queries_over_the_smallest_tables(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert len(QUERIES) == 13
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, DATA)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)


def test_run_keeps_going_to_the_end(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "ids" in out.columns
