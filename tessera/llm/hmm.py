"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Tokens are the words of a text (A-Z lowered) and one end. Every training word has emission probabilities of its own. Those of
the ``TOP`` most frequent words and of the end are held in memory as symbols; all others are rows of a table that grows with
the corpus, and during the rounds they meet as one shared symbol. One more probability, that of the add-one unigram, is kept
for words never seen. In each state they all sum to 1.

1. Words are counted over all training texts, with counting inside each task first.
2. Texts become symbol sequences, stored once; words without a symbol are stored beside them with their numbers.
3. A start is fitted to a bounded sample (``SAMPLE_DOCS`` texts, at most about ``SAMPLE_TOKENS`` tokens, chosen by hashes of
   their contents; no text of more tokens than that): only to break the symmetry of the states. Each Baum-Welch round then
   runs forward and backward over every training sequence; expected counts of states, transitions and emissions are added up
   across partitions, in two steps so that no task adds up too many. The last round also adds up the expected counts of each
   word without a symbol, by word, in one exchange with the words' counts.
4. Scores: scaled forward recursion over each whole sequence; the words without a symbol find their emissions by a join, the
   texts in ``_PARTS`` parts one after the other, as each pair of a text and a word brings a number for each state.

Many texts are recursed at once, a step of all of them in one array operation. Nothing depends on how rows are dealt to
partitions but the last bits of sums.

Nulls: a null text is empty and has the end as its only token. A null doc_id is not held out and keeps its row; repeated rows
count each. Ties: of equally frequent words those with the smaller hash become symbols. With nothing to learn from, the one
unseen token has probability 1. Very long texts are recursed whole. Further columns play no part. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices, text_of, utf8_bytes

#: Words that are symbols, about, and at most: with the end and the shared symbol they fit 16 bits.
TOP, _MOST = 60_000, 64_000
STATES = 4
ROUNDS = 2
SAMPLE_DOCS = 1500
SAMPLE_TOKENS = 600_000
#: Weight, in tokens, of even chances in the transitions, and the least one of the unigram in each state's emissions.
PRIOR = 200.0
#: Distinct words a task counts before it sends them on; tokens recursed at once; symbols in a piece of the counts.
_HELD, _TOKENS, _PIECE = 300_000, 300_000, 4096
#: Parts of the texts that are scored one after the other, each with shuffle files of its own that are deleted when it is done.
_PARTS = 2


@dataclass
class Vocabulary:
    symbols: dict[bytes, int]  # 0 is the end, the last symbol is shared
    log_base: np.ndarray  # log10 of the add-one unigram by symbol, 0 for the shared one
    unigram: np.ndarray  # its probability by symbol, the shared symbol with all the rest
    total: int
    distinct: int

    @property
    def other(self) -> int:
        return len(self.unigram) - 1

    @property
    def weight(self) -> float:
        """Weight, in tokens, of the unigram in each state's emissions: as many tokens as there are distinct training words.

        Words that a state has not met are as frequent as words it met for the first time; so the share that is left to the
        unigram falls as the texts grow, but no faster than new words come."""
        return max(PRIOR, float(self.distinct))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states): a row is what one token needs


# --- sequences


def _order(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in lots of like length with about _TOKENS tokens, longest first in each."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, int(np.searchsorted(np.cumsum(lengths[order[at:]]), _TOKENS, side="right")))
        yield order[at : at + n]
        at += n


def _steps(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens step by step, for sequences from long to short, where each step begins, and of which token of the sequences
    one behind the other each is."""
    lengths = np.array([len(s) for s in seqs])
    place = np.concatenate([np.arange(n) for n in lengths])
    order = np.argsort(place, kind="stable")
    alive = len(seqs) - np.searchsorted(np.sort(lengths), np.arange(lengths[0]), side="right")
    return np.concatenate(seqs)[order], np.concatenate(([0], np.cumsum(alive))), order


def forward(seqs: list[np.ndarray], model: Model, keep: bool = False, own: tuple[np.ndarray, np.ndarray] | None = None):
    """log10 likelihood of each sequence (long to short, none empty); with ``keep`` also the scaled values of all steps.

    own: which tokens of the sequences one behind the other have emissions of their own, and these.
    """
    flat, at, order = _steps(seqs)
    emitted = model.emit[flat]
    if own is not None and len(own[0]):
        step = np.empty(len(flat), np.int64)
        step[order] = np.arange(len(flat))
        emitted[step[own[0]]] = own[1]
    alphas, scales = np.empty_like(emitted) if keep else None, np.empty(len(flat))
    ones = np.ones(len(model.start))
    a = np.broadcast_to(model.start, (len(seqs), len(model.start)))
    edges = at.tolist()
    for t, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        a = (a[: hi - lo] if t == 0 else a[: hi - lo] @ model.move) * emitted[lo:hi]
        s = np.matmul(a, ones, out=scales[lo:hi])
        a = np.divide(a, s[:, None], out=alphas[lo:hi] if keep else a)
    # rows of a step are the first so many sequences
    total = np.bincount(np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at)), np.log10(scales), len(seqs))
    return (total, flat, at, order, emitted, alphas, scales) if keep else total


def expected(seqs: list[np.ndarray], model: Model, of: int | None = None):
    """Expected counts of first states, moves and emissions, and the log10 likelihood; with ``of`` also the chances of the
    states at each token that is this symbol, in the order of the sequences."""
    total, flat, at, order, emitted, alphas, scales = forward(seqs, model, True)
    k = len(model.start)
    emitted /= scales[:, None]
    back = np.empty_like(alphas)
    b, moved = np.ones((len(seqs), k)), np.ascontiguousarray(model.move.T)
    edges = at.tolist()
    for lo, hi in zip(edges[-2::-1], edges[:0:-1], strict=True):
        back[lo:hi] = b[: hi - lo]
        x = np.multiply(emitted[lo:hi], b[: hi - lo], out=emitted[lo:hi])
        np.matmul(x, moved, out=b[: hi - lo])
    # a token's predecessor stands as far back as the step before is long
    size = np.diff(at)
    later = np.arange(at[1], len(flat))
    moves = alphas[later - np.repeat(size[:-1], size[1:])].T @ emitted[later[0] :] if len(later) else np.zeros((k, k))
    gamma = np.multiply(alphas, back, out=back)
    gamma /= (gamma @ np.ones(k))[:, None]
    emissions = np.stack([np.bincount(flat, x, len(model.emit)) for x in np.ascontiguousarray(gamma.T)], axis=1)
    out = gamma[: at[1]].sum(axis=0), moves * model.move, emissions, float(total.sum())
    if of is None:
        return out
    step = np.empty(len(flat), np.int64)
    step[order] = np.arange(len(flat))
    return *out, gamma[step[np.concatenate(seqs) == of]]


def maximise(first: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray, prior: float = PRIOR, weight: float | None = None) -> Model:
    """weight: that of the unigram in the emissions, ``prior`` if not given."""
    weight = prior if weight is None else weight
    k = len(first)
    start = (first + 1 / k) / (first.sum() + 1)
    move = (moves + prior / k) / (moves.sum(axis=1, keepdims=True) + prior)
    emit = (emissions + weight * unigram[:, None]) / (emissions.sum(axis=0) + weight)
    return Model(start, move, emit)


def fit_sample(seqs: list[np.ndarray], unigram: np.ndarray, states: int, rounds: int = 12, seed: int = 5) -> Model:
    """A first model: states that stay, with each text's words at first given to one random state."""
    rng = np.random.default_rng(seed)
    emissions = np.zeros((len(unigram), states))
    for i, s in enumerate(seqs):
        np.add.at(emissions[:, i % states], s, 1.0)
    emissions *= rng.uniform(0.5, 1.5, emissions.shape)
    model = maximise(np.ones(states), np.eye(states) * 1e4 + 100, emissions, unigram, 50.0)
    if not seqs:
        return model
    seqs = sorted(seqs, key=len, reverse=True)
    lots = [[seqs[i] for i in lot] for lot in _order(np.array([len(s) for s in seqs]))]
    for _ in range(rounds):
        parts = [expected(lot, model) for lot in lots]
        model = maximise(*(sum(p[i] for p in parts) for i in range(3)), unigram, 50.0)
    return model


# --- passes over the documents


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

    for batch in slices(batches):
        for raw in utf8_bytes(batch.column(1)):
            counts.update(raw.lower().split())
            counts[b""] += 1  # the end; no word is empty
        if len(counts) > _HELD:
            yield from out()
            counts.clear()
    yield from out()


_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, symbols binary, rare_at binary, rare array<binary>"
_CODED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("symbols", pa.binary()), ("rare_at", pa.binary()), ("rare", pa.list_(pa.binary()))])


def _code(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = shared.value
        end_known, other = int(voc.total > 0), voc.other
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            rare: list[bytes] = []
            edges = [0]
            for raw in utf8_bytes(batch.column(2)):
                words = raw.lower().split()
                seq = np.array([*map(voc.symbols.get, words, [other] * len(words)), 0], np.int64)
                place: dict[bytes, int] = {}
                at = np.array([place.setdefault(words[i], len(place)) for i in np.flatnonzero(seq == other).tolist()], np.int64)
                columns[0].append(len(seq))
                columns[1].append(len(words) - len(at) + end_known)
                columns[2].append(float(voc.log_base[seq].sum()))
                columns[3].append(seq.astype("<u2").tobytes())
                columns[4].append(at.astype("<u4").tobytes())
                rare += place
                edges.append(len(rare))
            words_of = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(rare, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(_CODED_ARROW)[2:-1], strict=True)), words_of], names=_CODED_ARROW.names)

    return run


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in column.to_pylist()]


_SUMS = "piece int, lot int, sums binary"


def _sums(pieces: Iterable[tuple[int, np.ndarray]], lot: int) -> Iterator[pa.RecordBatch]:
    for piece, x in pieces:
        data = np.ascontiguousarray(x, np.float64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([lot], pa.int32()), pa.array([data], pa.binary())], names=["piece", "lot", "sums"])


def _rows(symbols: pa.Array, words: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    """Rows (symbol or word, its sums, no count)."""
    return pa.RecordBatch.from_arrays([symbols, words, *(pa.array(np.ascontiguousarray(x)) for x in sums.T), pa.array(np.zeros(len(sums), np.int64))], names=["symbol", "word", *_g(sums.shape[1]), "c"])


def _by_word(words: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    """Rows of words, each once."""
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    total = np.stack([np.bincount(at, sums[:, i], len(coded.dictionary)) for i in range(sums.shape[1])], axis=1)
    return _rows(pa.nulls(len(total), pa.int32()), coded.dictionary, total)


def _expect(shared, with_words: bool):
    """Sequences of one task in, its expected counts by pieces of the symbols out; piece -1 has states and moves.

    With words, rows of symbols and of words without a symbol instead; beyond the symbols stand the moves, the states and the
    likelihood."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        k, other = len(model.start), len(model.emit) - 1
        small, emissions = np.zeros(k * k + k + 1), np.zeros(model.emit.shape)
        for batch in batches:
            seqs = _sequences(batch.column(0))
            if with_words:
                places = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
                edges, words = batch.column(2).offsets.to_numpy(), batch.column(2).values
            for lot in _order(np.array([len(s) for s in seqs], np.int64)):
                first, moves, emitted, total, *chances = expected([seqs[i] for i in lot], model, other if with_words else None)
                small += np.concatenate((first, moves.ravel(), [total]))
                emissions += emitted
                if with_words and len(chances[0]):
                    yield _by_word(words.take(pa.array(np.concatenate([edges[i] + places[i] for i in lot]))), chances[0])
        if small.any() and with_words:
            sums = np.concatenate((emissions, small[k:-1].reshape(k, k), small[None, :k], np.full((1, k), small[-1])))
            some = np.flatnonzero(sums.any(axis=1))
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                yield _rows(pa.array(part, pa.int32()), pa.nulls(len(part), pa.binary()), sums[part])
        elif small.any():
            lot = int(np.frombuffer(small[:1].tobytes(), np.uint32)[0] % 64)  # any spread will do
            yield from _sums([(-1, small)] + [(i, emissions[i * _PIECE : (i + 1) * _PIECE]) for i in range(-(-len(emissions) // _PIECE))], lot)

    return run


def _add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in slices(batches, 16):
        for piece, lot, data in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            x = np.frombuffer(data, np.float64)
            held[piece, lot] = held[piece, lot] + x if (piece, lot) in held else x
    for (piece, lot), x in held.items():
        yield from _sums([(piece, x)], lot)


def baum_welch(sequences: DataFrame, model: Model, unigram: np.ndarray, weight: float | None = None) -> tuple[Model, float]:
    """One round over all rows of ``sequences(symbols)``: the next model and the log10 likelihood under this one.

    The driver gets the summed counts: symbols x states numbers, whatever the input.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    parts = sequences.select("symbols").mapInArrow(_expect(shared, False), _SUMS).repartition("piece", "lot").mapInArrow(_add_up, _SUMS)
    sums = parts.withColumn("lot", F.lit(0)).repartition("piece").mapInArrow(_add_up, _SUMS).collect()
    by = {r.piece: np.frombuffer(r.sums, np.float64) for r in sums}
    if not by:
        return model, 0.0
    k = len(model.start)
    emissions = np.concatenate([by[i] for i in sorted(by) if i >= 0]).reshape(-1, k)
    small = by[-1]
    return maximise(small[:k], small[k : k + k * k].reshape(k, k), emissions, unigram, weight=weight), float(small[-1])


def _g(states: int) -> list[str]:
    return [f"g{i}" for i in range(states)]


def last_round(sequences: DataFrame, counts: DataFrame, model: Model, unigram: np.ndarray, weight: float | None = None) -> tuple[Model, DataFrame, np.ndarray]:
    """One round over all rows of ``sequences(symbols, rare_at, rare)`` that also counts the words without a symbol: the next
    model, the words of ``counts(word, n)`` with their count c and expected counts g0, g1 ..., and the states' sums of these.

    Words and symbols are added up by one exchange, together with the words' counts, so nothing is stored before it.
    """
    spark, k, s = sequences.sparkSession, len(model.start), len(model.emit)
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(["symbol int", "word binary", *(f"{g} double" for g in _g(k)), "c long"])
    parts = sequences.select("symbols", "rare_at", "rare").mapInArrow(_expect(shared, True), schema)
    counted = counts.select(F.lit(None).cast("int").alias("symbol"), "word", *(F.lit(0.0).alias(g) for g in _g(k)), F.col("n").alias("c"))
    sums = parts.unionByName(counted).groupBy("symbol", "word").agg(*(F.sum(x).alias(x) for x in (*_g(k), "c")))
    sums = materialize(spark, sums, "emissions")
    words = sums.filter("word IS NOT NULL").drop("symbol")
    got = sums.filter("symbol IS NOT NULL").select("symbol", *_g(k)).toArrow()
    if not got.num_rows:
        return model, words, np.zeros(k)
    total = np.zeros((s + k + 2, k))
    total[got.column("symbol").to_numpy()] = np.stack([got.column(g).to_numpy() for g in _g(k)], axis=1)
    return maximise(total[s + k], total[s : s + k], total[:s], unigram, weight=weight), words, total[:s].sum(axis=0)


def vocabulary(counts: DataFrame, top: int = TOP) -> Vocabulary:
    """From word counts, the end under the empty word: totals and the most frequent words, at most ``top``, which come to the
    driver, give or take the luck of the hash in the last level of counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if top > _MOST:
        raise ValueError(f"at most {_MOST} words can be symbols, not {top}")
    words = counts.filter("word <> X''")
    # how many words have at least each of some thousand counts decides where to cut, and the hash within the last level
    level, whole = F.floor(F.log2("n") * 64).cast("int"), 1 << 30
    least, part, kept = None, 0, 0
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        least, room = r.level, top - kept
        part = whole if r.words <= room else int(room / r.words * whole)
        kept += min(r.words, room)
        if kept >= top:
            break
    chosen = (level > least) | ((level == least) & (F.pmod(F.xxhash64("word"), F.lit(whole)) < part)) if kept else F.lit(False)
    best = sorted(words.filter(chosen).collect(), key=lambda r: (-r.n, bytes(r.word)))
    ends = counts.filter("word = X''").collect()
    n = np.array([ends[0].n if ends else 0] + [r.n for r in best] + [0], np.float64)
    unigram = (n + 1) / (total + distinct + 1)
    unigram[-1] = max(1 - unigram[:-1].sum(), 1e-300) if total else 1.0
    if not total:
        unigram[0] = 1.0
    log_base = np.log10(unigram)
    log_base[-1] = 0.0
    return Vocabulary({bytes(r.word): i + 1 for i, r in enumerate(best)}, log_base, unigram, int(total), int(distinct))


def held_out(modulus: int = 7, remainder: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(coded: DataFrame, counts: DataFrame, voc: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, DataFrame, np.ndarray]:
    """The model, all words with their counts and expected counts, and the states' sums of expected counts."""
    learn = coded.filter("NOT held_out")
    docs, tokens = learn.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    part = min(1.0, SAMPLE_DOCS / max(docs, 1), SAMPLE_TOKENS / max(tokens, 1))
    name = F.xxhash64("symbols")
    chosen = learn.filter(F.pmod(name, F.lit(1 << 40)) < int(part * (1 << 40))).filter(F.col("n_tokens") <= SAMPLE_TOKENS)
    sample = [np.frombuffer(bytes(r.symbols), "<u2").astype(np.int64) for r in sorted(chosen.select("symbols", name.alias("name")).collect(), key=lambda r: (r.name, bytes(r.symbols)))]
    model = fit_sample(sample, voc.unigram, states)
    for _ in range(rounds - 1):
        model, _ = baum_welch(learn, model, voc.unigram, voc.weight)
    if rounds:
        return last_round(learn, counts, model, voc.unigram, voc.weight)
    return model, counts.select("word", *(F.lit(0.0).alias(g) for g in _g(states)), F.col("n").alias("c")), np.zeros(states)


def _score(shared, total: int, distinct: int, weight: float, sums: np.ndarray):
    """Each text (at -1, head) followed by what is known of its words without a symbol (at, c, g0, g1 ...) in, its score out."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def scored(table: pa.Table) -> pa.RecordBatch:
        model: Model = shared.value
        k = len(model.start)
        at = table.column("at").to_numpy()
        first = np.flatnonzero(at < 0)
        head = table.column("head").combine_chunks().take(pa.array(first))
        doc_id, held, n_tokens, n_known, base, symbols, rare_at = head.flatten()
        seqs, places = _sequences(symbols), [np.frombuffer(x, "<u4").astype(np.int64) for x in rare_at.to_pylist()]
        own = np.array([x.max() + 1 if len(x) else 0 for x in places], np.int64)  # a text's distinct words without a symbol
        begin = np.cumsum(own) - own
        of = np.repeat(np.arange(len(first)), own)
        # words in no training text have no row
        met = np.flatnonzero(at >= 0)
        where = begin[np.searchsorted(first, met) - 1] + at[met]
        c, g = np.zeros(len(of)), np.zeros((len(of), k))
        c[where] = table.column("c").to_numpy()[met]
        for i, name in enumerate(_g(k)):
            g[where, i] = table.column(name).to_numpy()[met]
        unigram = (c + 1) / float(total + distinct + 1)
        emission = (g + weight * unigram[:, None]) / (sums + weight)
        tokens = [b + x for b, x in zip(begin, places, strict=True)]
        n = np.bincount(np.concatenate(tokens), minlength=len(of))
        out, other = np.zeros(len(seqs)), len(model.emit) - 1
        for lot in _order(np.array([len(s) for s in seqs], np.int64)):
            spots = np.flatnonzero(np.concatenate([seqs[i] for i in lot]) == other)
            out[lot] = forward([seqs[i] for i in lot], model, own=(spots, emission[np.concatenate([tokens[i] for i in lot])]))
        base = base.to_numpy() + np.bincount(of, n * np.log10(unigram), len(first))
        n_known = n_known.to_numpy() + np.bincount(of, n * (c > 0), len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([doc_id, held, n_tokens, pa.array(n_known), pa.array(base), pa.array(out)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        texts = rows = 0
        for batch in slices(batches, 2048):
            wait.append(batch)
            texts += int((batch.column(1).to_numpy() < 0).sum())
            rows += batch.num_rows
            if texts > 1 and (texts > 512 or rows > 100_000):
                table = pa.Table.from_batches(wait)
                last = int(np.flatnonzero(table.column("at").to_numpy() < 0)[-1])  # the last text may have more rows to come
                yield scored(table.slice(0, last))
                wait = table.slice(last).to_batches()
                texts, rows = 1, table.num_rows - last
        if rows:
            yield scored(pa.Table.from_batches(wait))

    return run


def score_documents(docs: DataFrame, top: int = TOP, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    texts = text_of(docs)
    counts = texts.filter(~held_out()).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(spark, counts, "words")
    voc = vocabulary(counts, top)
    coded = texts.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_code(spark.sparkContext.broadcast(voc)), _CODED)
    coded = materialize(spark, coded.withColumn("row", F.monotonically_increasing_id()), "sequences")
    model, words, sums = train(coded, counts, voc, states, rounds)

    # what the last round's maximisation gives a word without a symbol in each state goes to each text that has it
    score = _score(spark.sparkContext.broadcast(model), voc.total, voc.distinct, voc.weight, sums)
    known = [*_g(states), "c"]
    done = []
    for part in range(_PARTS):
        some = coded.filter(F.pmod(F.xxhash64("row"), F.lit(_PARTS)) == part)
        met = some.select("row", F.posexplode("rare").alias("at", "word")).join(words, "word").select("row", "at", F.lit(None).alias("head"), *known)
        head = some.select("row", F.lit(-1).alias("at"), F.struct("doc_id", "held_out", "n_tokens", "n_known", "base", "symbols", "rare_at").alias("head"), *(F.lit(0.0 if x != "c" else 0).alias(x) for x in known))
        ordered = head.unionByName(met).repartition("row").sortWithinPartitions("row", "at")
        scored = ordered.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        done.append(materialize(spark, scored, "scores"))
    scored = reduce(DataFrame.unionByName, done)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(voc.total).cast("long").alias("train_tokens"), "base_score", "score")
