"""The coder against the tokenizers library."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewarden.llm import bpe

own = bpe.coder(bpe.default_path())
library = Tokenizer.from_file(bpe.default_path())

ODD = [None, "", " ", "\n \n", "a" * 3000, "ab" * 500, "héé ß ñ  x", "\x1c\x1d\x85᠎​", "it's we'll I'D", "<|endoftext|>", "a<|endoftext|> b<|endoft", "日本語テキスト", "١٢٣ ½ ²", "🙂🙃", "  lead", "trail  ", "\t\tx\r\ny", "!!!???...", "é" * 400]


def ours(text):
    import numpy as np

    return np.frombuffer(next(own.encoded([text or ""])), dtype="<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    assert ours(text) == ids and own.decoded(ids) == library.decode(ids, skip_special_tokens=False)
    assert next(own.encoded_by_rank([text or ""])) == next(own.encoded([text or ""]))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    text = text.encode(errors="replace").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours(text) == ids and own.decoded(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB1.' \n\t\x1c\x85\u2003é", max_size=14))
def test_white_space(text):
    assert ours(text) == library.encode(text, add_special_tokens=False).ids


def test_white_space_class():
    import regex

    space = {chr(c) for c in range(0x110000) if regex.match(r"\p{White_Space}", chr(c))}
    assert space == {chr(c) for c in range(0x110000) if bpe.DOUBLE.match(chr(c) * 2)}


def test_token_soup():
    r = random.Random(1)
    tokens = [b.decode(errors="ignore") for b in own.ids]
    texts = ["".join(r.choice(tokens).replace(" ", "") for _ in range(r.randint(2, 6))) for _ in range(20_000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ours(t) for t in texts[:2000]] == expected[:2000]
    import numpy as np

    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encoded(texts)] == expected
    assert 0 < own.n_exact < own.n_words
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encoded_by_rank(texts, longest=40)] == expected


def test_tables(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ODD)] + [(None, "x", 1), (3, "\n \n", 9)], "doc_id long, text string, ids int")
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert bpe.digests(docs).count() == len(ODD) + 2
    assert bpe.digests(docs.limit(0)).count() == 0
