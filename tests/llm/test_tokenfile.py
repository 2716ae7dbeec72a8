import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_util import awkward, empty
from tokenizers import Tokenizer

from conftest import SF_SMALL
from gavel.llm import tokenfile as K
from gavel.llm.common import table


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path(K.VOCABULARY), "rb") as f:
        definition = f.read()
    return K.PieceIds(definition, K.stand_ins(definition))


ids_st = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=90)


@settings(max_examples=300, deadline=None)
@given(docs=st.lists(ids_st, max_size=6))
def test_round_trip_of_any_ids(docs):
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    words, stops = K.pack(np.array([x for d in docs for x in d], np.uint64), ends)
    assert K.unpack(words).tolist() == [x for d in docs for x in d]
    for d, s, e in zip(docs, [0, *stops.tolist()], stops.tolist()):
        assert K.unpack(words[s:e]).tolist() == d  # a document's words stand alone


def test_words_are_as_stated():
    words, stops = K.pack(np.array([1] * 60 + [5, 2**60, 7]), np.array([63]))
    assert [int(w) >> 60 for w in words] == [1, 14, 15, 14, 14] and stops.tolist() == [5]
    assert int(words[0]) == (1 << 60) | (2**60 - 1) and int(words[2]) == (15 << 60) | 1 and int(words[3]) == 14 << 60
    words, _ = K.pack(np.array([50256, 1000, 3, 9]), np.array([4]))
    assert [int(w) for w in words] == [(12 << 60) | 50256 | 1000 << 20 | 3 << 40, (14 << 60) | 9]
    with pytest.raises(ValueError):
        K.unpack(np.array([3], np.uint64))


odd = st.lists(st.sampled_from(["a", "'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", "\r\n", "23", "é", "ß", "中", " ", " ", "!", "$$$", "the",
                                "tion", "<|endoftext|>", "\U0001f600", "́", "ſ", "\x1c", "\x85", "﻿"]), max_size=16).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.one_of(odd, st.text(max_size=40)), max_size=4))
def test_ids_are_the_librarys(pieces, library, texts):
    data = [t.encode("utf-8", "ignore") for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    ids, ends = K.encode_texts(pieces, b"".join(data), offs, 0)
    got = [ids[s:e].tolist() for s, e in zip([0, *ends.tolist()], ends.tolist())]
    assert got == [[*library.encode(d.decode(), add_special_tokens=False).ids, 0] for d in data]


def test_every_character_is_cut_as_by_the_library(pieces, library):
    from gavel.llm.bpe import code_points, piece_starts
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 1 << 16):
        text = "".join(f"a{chr(c)}1" for c in every[lo:lo + (1 << 16)])
        code, ends = code_points(text)
        own = piece_starts(pieces.seen[code], ends).tolist()
        assert own == [s for _, (s, _) in library.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.one_of(odd, st.text("ab é1!", max_size=30)), min_size=1, max_size=6), bits=st.sampled_from([0, 3, 64]))
def test_equal_hashes_of_different_pieces(pieces, library, texts, bits):
    """Whatever the hashes and slots have in common, pieces are told apart."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(K, "SLOTS", 4)
        m.setattr(K, "REMEMBERED", 30)
        plain = K._piece_hashes
        m.setattr(K, "_piece_hashes", lambda *a: plain(*a) & np.uint64((1 << bits) - 1))
        pieces.forget()
        for t in texts * 2:
            data = t.encode()
            ids, _ = K.encode_texts(pieces, data, np.array([0, len(data)]), 0)
            assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]
    pieces.forget()


def _by_library(rows, library):
    """(doc_id, start, n_tokens, crc) by encoding whole texts, in ascending order of ids."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_the_table(spark, library):
    docs = sorted((d.doc_id, d.text) for d in table(spark, SF_SMALL, "documents").collect())
    got = sorted(map(tuple, K.op11_tokenfile(spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == _by_library(docs, library)


def test_several_files_and_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_IDS", 500)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = K.fresh_folder(spark)
        docs = table(spark, SF_SMALL, "documents")
        K.write_tokens(docs.orderBy("text"), folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert spark.read.parquet(f"{folder}/shards").count() > 4 and spark.read.parquet(f"{folder}/blocks").count() > 20
    rows = K.read_tokens(spark, folder).collect()
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows)
    assert got == _by_library(sorted((d.doc_id, d.text) for d in docs.collect()), library)


def test_awkward_rows(spark, library):
    docs = awkward(spark).withColumnsRenamed({"source": "words", "lang": "shard"})
    folder = K.fresh_folder(spark)
    K.write_tokens(docs, folder)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in K.read_tokens(spark, folder).collect())
    ids = [x[1] for x in got]
    assert ids == [None, None, *sorted(x for x in ids if x is not None)]
    assert [x[0] for x in got] == np.concatenate(([0], np.cumsum([x[2] for x in got])[:-1])).tolist()
    want = [x[0::2] + x[3:] for x in _by_library([(d.doc_id, d.text) for d in docs.collect()], library)]
    assert sorted(map(str, ((x[1], x[2], x[3]) for x in got))) == sorted(map(str, want))


def test_empty_table(spark):
    folder = K.fresh_folder(spark)
    K.write_tokens(empty(awkward(spark)), folder)
    assert K.read_tokens(spark, folder).count() == 0
