"""Language identification by rank-order profiles.

A language's profile is the list of its ``top`` most frequent character n-grams (1 to 3 characters of letters, word ends
marked by one gap), counted over all training texts. A document's n-grams that occur in some profile are ranked by frequency
as well; its distance to a language is the sum, over its ``top`` first n-grams, of how far each is out of place there, an
n-gram missing from a profile counting ``top``. The nearest language wins. n-grams in no profile would add the same to every
language and take no rank.

Letters of every script count as themselves, in lower case. The alphabet is what the training texts hold; a letter outside it
is in no profile's n-gram and has one code with its like. So n-grams are integers and everything is counted in arrays.

Nulls: a text that is null or without a letter is ``und`` with score 0. Rows with a null language or text teach nothing. A
null doc_id is never held out by the query and keeps its row. Repeated rows count as often as they occur. With nothing to
learn from, every text is ``und``. Ties of distance go to the language that is first by code point, ties of frequency to the
shorter n-gram and then by code points. Very long texts are read whole. Empty table: no rows. Further columns of the input play no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_batches, slices

TOP = 400
#: A text is in no learned language if it knows less than this part of the 3-grams that texts of its nearest language know, and
#: if that is no chance (this many standard deviations).
LEAST_KNOWN, SURE = 1 / 3, 3.0
#: Languages whose counts one task holds before it sends them on, and distinct n-grams up to which they are held in one array.
_HELD, _DENSE = 64, 1 << 21
_letters: np.ndarray | None = None


def _lowered() -> np.ndarray:
    """By code point: the code point of a letter in lower case, 0 for all else."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _letters = table
    return _letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Letters by code point, numbered from 1; 0 is a gap, the number after the last letter stands for all other letters."""

    def __init__(self, letters: Iterable[int]):
        self.letters = np.array(sorted(letters), np.int64)
        bits = int(len(self.letters) + 1).bit_length()
        self.base = 1 << bits
        self.two, self.three = self.base, self.base + self.base**2  # where the codes of 2- and 3-grams begin
        self.space = self.three + self.base**3
        self.kind = np.int32 if self.space < 1 << 31 else np.int64

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    @property
    def table(self) -> np.ndarray:
        """The number of each code point."""
        if "_table" not in self.__dict__:
            number = np.full(0x110000, len(self.letters) + 1, self.kind)
            number[0] = 0
            number[self.letters] = np.arange(1, len(self.letters) + 1)
            self._table = number[_lowered()]
        return self._table

    def ngrams(self, text: str) -> np.ndarray:
        """Codes of all 1-, 2- and 3-grams; runs of other characters are one gap, and a gap alone is no n-gram."""
        codes = self.table[_points(text)]
        keep = np.empty(len(codes), bool)
        if len(codes):
            keep[0] = True
            np.logical_or(codes[1:] != 0, codes[:-1] != 0, out=keep[1:])
        c = np.concatenate(([0], codes[keep], [0])).astype(self.kind)
        if len(c) > 2 and c[1] == 0:
            c = c[1:]
        if len(c) > 2 and c[-2] == 0:
            c = c[:-1]
        two = c[:-1] * self.base + c[1:]
        three = two[:-1] * self.base + c[2:]
        return np.concatenate((c[c > 0], two[two > 0] + self.two, three[(two[:-1] > 0) & (two[1:] > 0)] + self.three))


def _count_letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = np.zeros(0x110000, bool)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            met[_points(text)] = True
    found = np.unique(_lowered()[met])
    yield pa.RecordBatch.from_arrays([pa.array(found[found > 0], pa.int32())], names=["letter"])


class _Counts:
    """How often each n-gram was met."""

    def __init__(self, space: int):
        self.dense = np.zeros(space, np.int64) if space <= _DENSE else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, found: np.ndarray) -> None:
        if self.dense is not None and len(found) > len(self.dense) // 8:
            self.dense += np.bincount(found, minlength=len(self.dense))
            return
        grams, n = np.unique(found, return_counts=True)
        if self.dense is not None:
            self.dense[grams] += n
        else:
            self.parts.append((grams, n))
            self.size += len(grams)
            if self.size > 1 << 20:
                self.parts = [self.total()]
                self.size = len(self.parts[0][0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            grams = np.flatnonzero(self.dense)
            return grams, self.dense[grams]
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        grams, at = np.unique(np.concatenate([g for g, _ in self.parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in self.parts])).astype(np.int64)


def _count(shared):
    """(lang, gram, n) of the task's training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet: Alphabet = shared.value
        held: dict[str, _Counts] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                grams, n = counts.total()
                for at in range(0, len(grams), 20_000):
                    part = grams[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(n[at : at + 20_000], pa.int64())], names=["lang", "gram", "n"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held and len(held) == _HELD:
                    yield from out()
                    held = {}
                held.setdefault(lang, _Counts(alphabet.space)).add(alphabet.ngrams(text))
        yield from out()

    return run


class Profiles:
    """Ranks of the n-grams of some language's profile: one row a language."""

    def __init__(self, rows: Iterable[tuple[str, int, int]], alphabet: Alphabet, top: int = TOP, known: dict[str, float] | None = None):
        rows = list(rows)
        self.top, self.alphabet = top, alphabet
        self.known = known or {}  # by language: share of its 3-grams, repeats counted, that are in its profile
        self.languages = sorted({r[0] for r in rows}, key=lambda x: x.encode("utf-32-be"))
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.languages), len(self.grams)), -1, np.int64)
        for lang, gram, rank in rows:
            self.rank[self.languages.index(lang), np.searchsorted(self.grams, gram)] = rank
        self.index = None
        if alphabet.space <= _DENSE:
            self.index = np.full(alphabet.space, -1, np.int32)
            self.index[self.grams] = np.arange(len(self.grams))

    def _place(self, found: np.ndarray) -> np.ndarray:
        """Which of ``grams`` each is, -1 for those in no profile."""
        if self.index is not None:
            return self.index[found]
        if not len(self.grams):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        return np.where(self.grams[at] == found, at, -1)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self._nearest(self.alphabet.ngrams(text or ""))

    def belongs(self, text: str | None, least: float) -> bool:
        """Whether the text has letters, is at least this near to some language and has enough of its 3-grams in a profile.

        3-grams in no profile, which take no rank in the score, count fully here. Too few to tell are enough.
        """
        found = self.alphabet.ngrams(text or "")
        lang, score = self._nearest(found)
        if lang == "und" or score < least:
            return False
        three = found[found >= self.alphabet.three]
        n, z2 = len(three), SURE * SURE
        if not n:
            return True
        share = float((self._place(three) >= 0).mean())
        most = (share + z2 / (2 * n) + SURE * ((share * (1 - share) + z2 / (4 * n)) / n) ** 0.5) / (1 + z2 / n)
        return most >= LEAST_KNOWN * self.known.get(lang, 0.0)

    def _nearest(self, found: np.ndarray) -> tuple[str, float]:
        if not len(found) or not self.languages:
            return "und", 0.0
        known = self._place(found)
        counts = np.bincount(known[known >= 0], minlength=len(self.grams))
        first = np.argsort(-counts, kind="stable")[: self.top]
        first = first[counts[first] > 0]
        if not len(first):
            return self.languages[0], 0.0
        there = self.rank[:, first]
        place = np.arange(len(first))
        distance = np.where(there < 0, self.top, np.minimum(np.abs(there - place), self.top)).sum(axis=1)
        best = int(np.argmin(distance))
        return self.languages[best], 1 - float(distance[best]) / (self.top * len(first))


def train(rows: DataFrame, top: int = TOP) -> Profiles:
    """Profiles from rows (lang, text). Counting covers every row; what comes to the driver is one row a letter and ``top``
    rows a language."""
    texts = bounded_batches(rows).toDF("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    letters = texts.select("text").mapInArrow(_count_letters, "letter int").distinct().collect()
    alphabet = Alphabet(r.letter for r in letters)
    counts = texts.mapInArrow(_count(rows.sparkSession.sparkContext.broadcast(alphabet)), "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    three = F.when(F.col("gram") >= alphabet.three, F.col("n")).otherwise(0)
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1)
    ranked = ranked.withColumn("three", three).withColumn("threes", F.sum("three").over(Window.partitionBy("lang"))).filter(F.col("rank") < top)
    rows = ranked.select("lang", "gram", "rank", "three", "threes").collect()
    known: dict[str, float] = {}
    for r in rows:
        known[r.lang] = known.get(r.lang, 0.0) + r.three / max(r.threes, 1)
    return Profiles([(r.lang, r.gram, r["rank"]) for r in rows], alphabet, top, known)


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs`` (whose last column is the text) with lang_pred and score instead of the text."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(profiles)  # top rows a language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]]
    return docs.mapInArrow(run, ", ".join([*kept, "lang_pred string, score double"]))


def held_out(modulus: int = 3, remainder: int = 1):
    """Whether crc32 of the id as text leaves this remainder; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learnt from the rows that are not held out."""
    profiles = train(docs.filter(~held_out()).select("lang", "text"), top)
    return predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), profiles)


def keep_identified(docs: DataFrame, least: float, top: int = TOP) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language (see ``Profiles.belongs``), with the columns of ``docs``."""
    profiles = train(docs.filter(~held_out()).select("lang", "text"), top)
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.belongs(t, least) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
