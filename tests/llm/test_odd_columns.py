"""Further columns whose names the operators use inside, and very long texts, change nothing."""

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, embeddings, exact, hmm, langid, mixing, passages, secrets, simhash, token_files

EXTRA = "spans blob_id done seed a b x place nth shard ids width start n_tokens lang_pred score held_out row symbols rare word fp component component_id label key size chunk least keep_id kept target taken raw".split()
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")

OPERATORS = {
    "secrets": lambda spark, d: secrets.digest(secrets.scan(d)),
    "passages": lambda spark, d: passages.shared_passages(d),
    "tokens": lambda spark, d: token_files.read_tokens(spark, token_files.write_tokens(d, JSON)),
    "bpe": lambda spark, d: bpe.encode_documents(d, RANKS, P.PATTERN),
    "langid": lambda spark, d: langid.identify(d),
    "exact": lambda spark, d: exact.exact_report(d),
    "simhash": lambda spark, d: simhash.simhash_groups(d),
    "similar": lambda spark, d: simhash.similar_groups(d, 0.8, 5, 4, 53, simhash.sampled_tables(tables=8)),
    "mixing": lambda spark, d: mixing.mix_report(d),
    "hmm": lambda spark, d: hmm.score_documents(d),
}


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    some = [" ".join(word() for _ in range(80)) for _ in range(12)]
    return [long, long + " end", "w" * 200_000, " " * 50_000 + "x", *some, some[0], some[1] + " more", None, ""]


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, make_docs, name):
    docs = make_docs(texts())
    want = OPERATORS[name](spark, docs)
    more = docs.withColumns({c: F.lit("?") for c in EXTRA})
    got = OPERATORS[name](spark, more)
    assert got.columns == want.columns
    first = plain(want.collect())
    assert first and plain(got.select(want.columns).collect()) == first


def test_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    rows += [(100 + i, v, k) for i, v, k in rows[:20]] + [(200, None, 1), (201, [0.0] * 4, 1), (202, [float("nan")] * 4, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain(embeddings.near_vectors(df).collect())
    more = df.withColumns({c: F.lit("?") for c in ("key", "vec", "least", "size", "component", "chunk", "blocks", "dim", "n_links", "kept")})
    assert plain(embeddings.near_vectors(more).collect()) == want and len(want) == len(rows)
