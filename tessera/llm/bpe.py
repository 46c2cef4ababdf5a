"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding. It is found from shorter prefixes: token t
may follow the encoding of the rest if BPE, given the bytes of the rest's last token and of t, leaves the two apart. Storing
that last token for every prefix makes appending exact (only new prefixes are computed), and makes re-encoding after an edit
start at the edit. Prefixes are kept across pieces, so words with a common beginning share their work; of a short piece only
the prefixes before a token that may end a longer one are looked at, the others are filled in when a piece needs them.

A text is cut into pieces by the pattern; cutting first at single blanks between two characters that are not white space
never changes the pieces, since a piece holds a blank only at its start or within white space. Each distinct word is encoded
once per task while the bounded cache lasts.

Nulls: a null text is an empty text with no ids; a null doc_id keeps its row; repeated rows are encoded each; an empty table
gives no rows. Unpaired surrogates cannot occur in Spark strings.
Texts of any length are encoded whole, and so are pieces of any length. There are no ties: each prefix has one encoding. Further
columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import slices, text_of

#: Entries of the word and prefix caches of one worker; full caches are emptied.
CACHE = 300_000

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Characters that Python counts as white space, a superset of the pattern's ``\s``.
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def words(text: str) -> list[str]:
    """The text cut at each single blank between two characters that are not white space; the blank belongs to the next
    word and is left out."""
    parts = text.split(" ")
    if "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _WHITE):
        return _BETWEEN.split(text)
    if parts[-1] == "" and len(parts) > 1 or parts[0] == "" and len(parts) > 1:
        return _BETWEEN.split(text)
    return parts


class PrefixBPE:
    """Encoder for ranks (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: By a prefix's last three bytes: the lengths of the tokens that may end it, longest first.
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                sizes.setdefault(token[-3:], set()).add(len(token))
        self._sizes = {tail: (*sorted(found, reverse=True), 2, 1) for tail, found in sizes.items()}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._last: dict[bytes, int] = {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for one byte. A token that merging its own bytes does not
        give is never part of an encoding of several tokens and has no halves either, see ``valid``."""
        if token not in self._split:
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._split[token]

    def valid(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is these two tokens.

        Undo the merges of both, latest first. At each moment the tokens at the border must not be a pair that BPE would
        have merged before the merge undone last. Never so for a right token that is not ``valid``.
        """
        known = self._apart.get((left, right))
        if known is not None:
            return known
        a, b, bound, answer = left, right, 1 << 60, self.valid(right)
        while answer:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            # on the left side an equal rank further right comes later, on the right side it comes first
            if joined is not None and joined < bound:
                answer = False
                break
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                break
            if hb is None or (ha is not None and a > b):
                bound, a = a, ha[1]
            else:
                bound, b = b + 1, hb[0]
        if len(self._apart) > 4 * CACHE:
            self._apart.clear()
        self._apart[left, right] = answer
        return answer

    def _last_of(self, prefix: bytes) -> int:
        """The last token of a prefix, from those of the shorter prefixes that may stand before a token; all are stored."""
        last, ranks, known, n = self._last, self.ranks, self._apart, len(prefix)
        for size in self._sizes.get(prefix[-3:], (2, 1)):
            if size > n:
                continue
            token = ranks.get(prefix[n - size :])
            if token is None:
                continue
            if size == n:
                if not self.valid(token):
                    continue
            else:
                before = prefix[: n - size]
                left = last.get(before)
                if left is None:
                    left = self._last_of(before)
                answer = known.get((left, token))
                if not (self.apart(left, token) if answer is None else answer):
                    continue
            last[prefix] = token
            return token
        raise ValueError("the ranks lack a single byte")

    def extend(self, piece: bytes, lasts: list[int], to: int | None = None) -> list[int]:
        """Fill ``lasts`` (last token of each prefix, by length - 1) up to the whole piece."""
        for n in range(len(lasts) + 1, (len(piece) if to is None else to) + 1):
            window = piece[max(0, n - self.longest) : n]
            for size in range(len(window), 0, -1):
                token = self.ranks.get(window[len(window) - size :])
                if token is not None and self.valid(token) and (size == n or self.apart(lasts[n - size - 1], token)):
                    lasts.append(token)
                    break
            else:
                raise ValueError("the ranks lack a single byte")
        return lasts

    def back(self, lasts: list[int]) -> list[int]:
        out, n = [], len(lasts)
        while n:
            out.append(lasts[n - 1])
            n -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self.back(self.extend(piece, []))
        last = self._last
        if len(last) > CACHE:
            last.clear()
        out, n = [], len(piece)
        while n:
            prefix = piece[:n]
            token = last.get(prefix)
            if token is None:
                token = self._last_of(prefix)
            out.append(token)
            n -= len(self.bytes_of[token])
        return out[::-1]


class Piece:
    """One piece under editing: its bytes, and the last token of each prefix."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.lasts = bpe, data, []
        bpe.extend(data, self.lasts)

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.back(self.lasts)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.lasts)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Prefixes before the edit keep their tokens. Behind it, once as many prefixes as the longest token has bytes end
        in the same tokens as before, all later ones do too: a prefix's last token depends on no more."""
        old, old_lasts = self.data, self.lasts
        self.data = old[:start] + new + old[stop:]
        self.lasts = old_lasts[:start]
        self.bpe.extend(self.data, self.lasts, start + len(new))
        shift, same = stop - start - len(new), 0
        while len(self.lasts) < len(self.data):
            n = len(self.lasts) + 1
            self.bpe.extend(self.data, self.lasts, n)
            same = same + 1 if n + shift - 1 < len(old_lasts) and self.lasts[-1] == old_lasts[n + shift - 1] else 0
            if same >= 2 * self.bpe.longest:
                self.lasts += old_lasts[n + shift :]


class TextCodec:
    """Whole texts to ids and back, with a cache of words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.bpe = PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern = regex.compile(pattern)
        self.bytes_of_word = {str(i): b for i, b in self.bpe.bytes_of.items()}
        self.cache: dict[str, str] = {}

    def _said(self, text: str) -> str:
        return "".join(f"{i} " for m in self.pattern.finditer(text) for i in self.bpe.encode_piece(m[0].encode()))

    def encode(self, text: str) -> str:
        """Decimal ids, each followed by one blank."""
        first, *rest = words(text)
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        for w in set(rest).difference(cache):
            cache[w] = self._said(" " + w)
        return self._said(first) + "".join(map(cache.__getitem__, rest))

    def forget(self) -> None:
        """Empty the caches: a worker that waits for other work holds only the ranks."""
        for cache in (self.cache, self.bpe._last, self.bpe._apart):
            cache.clear()

    def decode(self, said: str) -> bytes:
        return b"".join(map(self.bytes_of_word.__getitem__, said.split()))


_codecs: dict[tuple[str, str], TextCodec] = {}


def _codec(path: str, pattern: str) -> TextCodec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TextCodec(path, pattern)
    return _codecs[path, pattern]


def _encoded(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        try:
            for batch in slices(batches, 64):
                said = [codec.encode(t) for t in batch.column(1).to_pylist()]
                counts = [s.count(" ") for s in said]
                digests = [hashlib.sha256(s[:-1].encode()).hexdigest() for s in said]
                decoded = [hashlib.sha256(codec.decode(s)).hexdigest() for s in said]
                ids = [pa.array([[int(i) for i in s.split()] for s in said], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *ids], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        finally:
            codec.forget()

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids for every row. Map only: nothing is shuffled."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return text_of(docs).mapInArrow(_encoded(path, pattern, with_ids), schema)
