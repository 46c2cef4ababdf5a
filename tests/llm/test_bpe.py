import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "\n", " \n ", "a  b", "a \n b", " a b ", "it's we'll I'M", "x y 　z", "\x1c a \x1d", "a\x85b", "日本語 テスト", "🙂🙂 🙂", "12 3456 7", "a" * 3000, "ab" * 900, "...!!! ??", "é è́ ü", "tab\tsep \t x", "\r\n\r\n x", "don't 'tis", "a ​ b", " a  ", " 've", "a\x1cb \x1c c"]


@pytest.fixture(scope="module")
def codec():
    return bpe.TextCodec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(2)
    alphabet = "aabcdeorstnil  \n\t'éß1.,-🙂日  "
    return ODD + ["".join(random.choices(alphabet, k=random.randrange(1, 60))) for _ in range(1500)] + ["".join(random.choices("theranointsd", k=random.randrange(1, 40))) for _ in range(1500)]


def test_same_ids_as_the_library(codec, library):
    for t in texts():
        said = codec.encode(t)
        assert [int(x) for x in said.split()] == library.encode_ordinary(t), repr(t)
        assert codec.decode(said) == t.encode()


def test_appends_and_edits_are_exact(codec):
    random.seed(4)
    for _ in range(120):
        piece = bpe.Piece(codec.bpe)
        for _ in range(6):
            piece.append(bytes(random.choices(b"theranoists ", k=random.randrange(0, 90))))
            a = random.randrange(len(piece.data) + 1)
            b = random.randrange(a, min(len(piece.data), a + 9) + 1)
            piece.replace(a, b, bytes(random.choices(b"theranoists", k=random.randrange(0, 7))))
        assert piece.ids() == codec.bpe.back(codec.bpe.extend(piece.data, [])) or piece.ids() == [codec.bpe.ranks.get(piece.data)]
        if len(piece.data) < 400:
            assert piece.ids() == codec.bpe.merge(piece.data)


def test_documents(spark, make_docs, library):
    rows = list(enumerate(ODD)) + [(900, None), (None, "x y"), (0, "again")]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(make_docs(rows), PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(make_docs(rows).filter("false"), PATH, P.PATTERN, True).count() == 0
