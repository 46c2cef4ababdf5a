import itertools

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, over a few partitions."""

    def make(rows, parts=3, lang="en"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in zip(itertools.count(), rows, strict=False)]
        return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows], SCHEMA).repartition(parts)

    return make
