"""Tags for words in context: an averaged structured perceptron with Viterbi decoding, learnt from a labelled table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.durable import stored
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator

#: Places of hashed features; sentences of a chunk, about; tags at most.
PLACES, CHUNK, TAGS = 1 << 16, 2000, 256


def features(words: list[str], i: int) -> list[int]:
    """Hashed features of a word in its sentence: itself, its shape, its ends, its neighbours."""
    w = words[i]
    low = w.lower()
    shape = "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in w[:8])
    told = ["b", f"w={low}", f"s={shape}", f"p1={low[:1]}", f"p3={low[:3]}", *(f"e{n}={low[-n:]}" for n in (1, 2, 3, 4) if len(low) >= n)]
    told += [f"-1={words[i - 1].lower() if i else '<'}", f"+1={words[i + 1].lower() if i + 1 < len(words) else '>'}", f"-e={words[i - 1].lower()[-3:] if i else '<'}"]
    return [crc32(t.encode("utf-8", "surrogatepass")) % PLACES for t in told]


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """The best tag sequence; the last row of ``move`` is the start. Ties go to the first tag."""
    score, back = emit[0] + move[-1], []
    for row in emit[1:]:
        through = score[:, None] + move[:-1]
        back.append(through.argmax(axis=0))
        score = through.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Weights:
    """Emissions by place and tag and moves from tag to tag, with what is needed for their average over all steps."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move, self.step = emit.copy(), move.copy(), 1.0
        self.emit_sum, self.move_sum = np.zeros_like(emit), np.zeros_like(move)

    def learn(self, places: list[list[int]], gold: list[int]) -> bool:
        """One sentence: moves towards the right tags where the best ones are not; whether they were."""
        found = viterbi(np.stack([self.emit[p].sum(axis=0) for p in places]), self.move)
        if found != gold:
            start = len(self.move) - 1
            for i, (g, f) in enumerate(zip(gold, found, strict=True)):
                before = (gold[i - 1], found[i - 1]) if i else (start, start)
                if g != f:
                    for sign, tag in ((1.0, g), (-1.0, f)):
                        np.add.at(self.emit[:, tag], places[i], sign)
                        np.add.at(self.emit_sum[:, tag], places[i], sign * self.step)
                if (before[0], g) != (before[1], f):
                    for sign, b, tag in ((1.0, before[0], g), (-1.0, before[1], f)):
                        self.move[b, tag] += sign
                        self.move_sum[b, tag] += sign * self.step
        self.step += 1
        return found == gold

    def average(self) -> tuple[np.ndarray, np.ndarray]:
        return self.emit - self.emit_sum / self.step, self.move - self.move_sum / self.step


def _epoch(shared, number: int):
    """Each chunk learns from the shared weights; (place, tag, weight, average) sums of what differs from them, by sentences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, move, tags = shared.value
        at = {t: i for i, t in enumerate(tags)}
        for batch in batches:
            for sentences in batch.column(0).to_pylist():
                w, n = Weights(emit, move), 0
                order = np.random.default_rng((number, len(sentences))).permutation(len(sentences))
                for i in order:
                    words = [x["word"] for x in sentences[i]]
                    w.learn([features(words, k) for k in range(len(words))], [at[x["tag"]] for x in sentences[i]])
                    n += 1
                mean_emit, mean_move = w.average()
                d, a = np.concatenate([w.emit - emit, w.move - move]) * n, np.concatenate([mean_emit - emit, mean_move - move]) * n
                place, tag = np.nonzero((d != 0) | (a != 0))
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(tag.astype(np.int32)), pa.array(d[place, tag]), pa.array(a[place, tag])], names=["place", "tag", "d", "a"])

    return run


@dataclass
class TagModel:
    emit: np.ndarray
    move: np.ndarray
    tags: list[str]

    def tag(self, words: list[str]) -> list[str]:
        if not words:
            return []
        return [self.tags[i] for i in viterbi(np.stack([self.emit[features(words, k)].sum(axis=0) for k in range(len(words))]), self.move)]

    def transform(self, df: DataFrame, attribute: str, alias: str) -> DataFrame:
        """The rows with an array of tags, one for each word; a null word has a null tag, a null array null."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<string>")
        def tagged(column: pd.Series) -> pd.Series:
            out = []
            for words in column:
                if words is None:
                    out.append(None)
                    continue
                told = iter(shared.value.tag([w for w in words if w is not None]))
                out.append([None if w is None else next(told) for w in words])
            return pd.Series(out)

        return df.withColumn(alias, tagged(F.col(attribute)))


def train(df: DataFrame, words: str, tags: str, epochs: int = 5) -> TagModel:
    """Chunks of sentences learn from the same weights in each epoch, which are then mixed by their sentences; the model is the
    average over all steps of all epochs. Chunks depend on the sentences only. Sentences with nulls, without words or with
    unlike lengths are left out. The driver holds the weights: ``PLACES`` times the number of tags."""
    spark = df.sparkSession
    rows = df.select(F.col(words).alias("w"), F.col(tags).alias("t")).filter((F.size("w") == F.size("t")) & (F.size("w") > 0) & ~F.exists("w", F.isnull) & ~F.exists("t", F.isnull))
    rows = stored(rows.select(F.arrays_zip(F.col("w").alias("word"), F.col("t").alias("tag")).alias("s")), "sentences")
    known = [r[0] for r in rows.select(F.explode("s.tag").alias("t")).distinct().orderBy("t").limit(TAGS + 1).collect()]
    if len(known) > TAGS:
        raise ParameterError(f"more than {TAGS} tags")
    n = rows.count()
    emit, move = np.zeros((PLACES, len(known))), np.zeros((len(known) + 1, len(known)))
    if not n:
        return TagModel(emit, move, known)
    total_emit, total_move = np.zeros_like(emit), np.zeros_like(move)
    # a sentence that is there often may be in several chunks: which copy is where makes no difference
    w = F.row_number().over(_same("s"))
    chunks = -(-n // CHUNK)
    rows = rows.withColumn("copy", w).withColumn("chunk", F.pmod(F.xxhash64("s", "copy"), F.lit(chunks)))
    rows = stored(rows.groupBy("chunk").agg(F.sort_array(F.collect_list("s")).alias("s")).select("s"), "chunks")
    for number in range(epochs):
        shared = spark.sparkContext.broadcast((emit, move, known))
        told = rows.mapInArrow(_epoch(shared, number), "place int, tag int, d double, a double").groupBy("place", "tag").agg(F.sum("d").alias("d"), F.sum("a").alias("a"))
        change, mean = np.zeros((PLACES + len(move), len(known))), np.zeros((PLACES + len(move), len(known)))
        for r in told.toLocalIterator():  # at most PLACES rows a tag
            change[r.place, r.tag], mean[r.place, r.tag] = r.d / n, r.a / n
        total_emit += emit + mean[:PLACES]
        total_move += move + mean[PLACES:]
        emit, move = emit + change[:PLACES], move + change[PLACES:]
        shared.destroy()
    return TagModel(total_emit / epochs, total_move / epochs, known)


def _same(column: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(column).orderBy(F.lit(1))


def tag_or_look_up(slug: str, look_up):
    """The operator: tags from a model or a labelled table where there is one, else a look-up in a dictionary."""

    @operator(slug)
    def run(inputs, attributes=None, alias=None, words_attribute="words", tags_attribute="tags", epochs=5, **params):
        model, labelled = inputs.get("model"), inputs.get("train input data")
        if model is None and labelled is None:
            return look_up(inputs, attributes=attributes, alias=alias, **params)
        model = model or train(labelled, words_attribute, tags_attribute, int(epochs))
        a = names(need(attributes, "attributes"))[0]
        df = inputs.get(IN)
        return {OUT: df if df is None else model.transform(df, a, alias or f"{a}_{slug}"), "model": model}

    return run
