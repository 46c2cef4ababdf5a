"""A corpus from raw documents: language, exact copies, near copies, source mix, token ids.

Each stage is a function (spark, docs, sf_dir) that returns a DataFrame; all but the last return the columns of documents.

For all stages: further columns, whatever their names, are carried along; texts of any length are read whole; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact, langid, mixing, simhash
from tessera.llm.common import documents, materialize
from tessera.llm.queries import tokenizer_path, tokenizer_pattern

#: A text nearer to no language than this is rejected (0 is nothing in common, 1 the profile itself).
#: What rejects foreign texts and noise is the share of 3-grams that are in some profile: langid.LEAST_KNOWN.
LEAST_LANGUAGE = 0.05
#: Near copies: sets of shingles of five words with a similarity of 0.8. Fingerprints of 256 bits propose pairs: similarity 0.8
#: means an angle of 27 degrees, on average 39 differing bits with a standard deviation of 6, so that 99 % lie within the radius.
SHINGLE, SIMILARITY, PRINT_WORDS, RADIUS = 5, 0.8, 4, 53


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some learned language. A null or empty text, or one without letters, goes; a text too short to tell stays.
    Repeated rows are judged alike, a null doc_id plays no part, and ties of distance go to the language first by code point."""
    return langid.keep_identified(docs, LEAST_LANGUAGE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text without its white space: the longest, then the smallest doc_id, null last. Null texts are empty ones, of
    which one stays; of repeated rows one stays."""
    return exact.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest id) of each group of near copies; rows go, so texts that share an id, or have none, count
    one by one. Null ids come last, ties of ids go by a hash of the text, and of repeated rows one stays. Texts without words, null
    ones among them, are near copies of one another only."""
    return simhash.near_deduplicate(docs, SIMILARITY, SHINGLE, PRINT_WORDS, RADIUS, simhash.sampled_tables())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them. A null source is one of its own, last in order; null texts have
    no words and are taken as balance has it; repeated rows are interchangeable; ties go by a hash of doc_id and size."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of the ids and of the bytes they decode to. A null text has no ids; repeated rows and null ids
    have rows of their own; an encoding has no ties."""
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), with_ids=True)


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("mix", mix), ("token ids", token_ids)]

#: SQL has no language profiles, fingerprints, balanced sampling or BPE; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
