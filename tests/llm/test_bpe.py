import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_util import awkward, empty

from conftest import SF_SMALL
from gavel.llm import bpe as B
from gavel.llm import text as tx
from gavel.llm.common import table


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(B.VOCABULARY), "rb") as f:
        return B.Codec(B.load_ranks(f.read().splitlines()))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


pieces_st = st.lists(st.sampled_from(["a", "b", "'s", "'re", "'", "'ll", "'d", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "ñ", "ß", "中",
                                      " ", " ", "!", "$$$", "the", "ing", "tion", "S", "\U0001f600", "́", "ſ", "ⅷ", "\x1c"]), max_size=16).map("".join)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(pieces_st, st.text(max_size=60)))
def test_pieces_and_ids_are_the_librarys(codec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    cuts = B.piece_starts(*B.code_points(text)).tolist()
    assert [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])] == regex.findall(public_tokenizers.PATTERN, text)
    ids = codec.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(word=st.text(st.sampled_from("abcdefghijklmnopqrstuvwxyzéè"), min_size=1, max_size=80), times=st.integers(1, 40))
def test_one_long_piece(codec, library, word, times):
    assert codec.encode(word * times).tolist() == library.encode_ordinary(word * times)


def test_join_of_any_halves(codec):
    """The monoid: wherever a piece is cut, joining the parts' encodings gives the same tokens."""
    b = "unbelievablystrungouttionnnnnningingéé".encode()
    whole = list(codec.merge(b))
    for i in range(len(b) + 1):
        assert list(codec.join(codec.merge(b[:i]), codec.merge(b[i:]))) == whole


def test_texts_of_a_block_do_not_touch(codec, library):
    texts = ["a ", " b", "", "'s", "don", "'t", " ", " ", "x\n", "\ny", "é", "é" * 3]
    for _, _, buf, offs in tx.blocks(pa.array(texts)):
        ids, at = B.encode_block(codec, buf.tobytes(), offs)
        got = [np.frombuffer(ids[4 * s:4 * e], "<u4").tolist() for s, e in zip(at, at[1:])]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_query_on_the_table(spark, library):
    docs = {d.doc_id: d.text for d in table(spark, SF_SMALL, "documents").collect()}
    rows = B.op5_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(library.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    rows = B.tokenize(docs).collect()
    want = sorted((str(d.doc_id), library.encode_ordinary(d.text or "")) for d in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert B.tokenize(empty(docs)).count() == 0
