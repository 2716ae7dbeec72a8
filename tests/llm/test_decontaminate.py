import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_util import awkward, empty, lower
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gavel.llm import decontaminate as D
from gavel.llm.common import table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, window=13):
    at = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            at[tuple(w[i:i + n])].add(str(item))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in at}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in at:
                    hit |= set(range(i, i + n))
                    found |= at[k]
        out.append([len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)])
    return out


def block(ids, texts, window=13):
    """All test items in one block."""
    (row,) = D.block_rows([None if i is None else str(i) for i in ids], pa.array(texts, pa.string())) or [None]
    return D.Block(row, window)


text_st = st.lists(st.sampled_from(["a", "b", "A", "c1", "é", "-", "\n"]), max_size=30).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.one_of(st.none(), text_st), max_size=6), items=st.lists(st.one_of(st.none(), text_st), max_size=5),
       window=st.integers(1, 5), cut=st.integers(0, 5))
def test_against_brute_force(docs, items, window, cut):
    ids = list(range(len(items)))
    blocks = [block(ids[s], items[s], window) for s in (slice(cut), slice(cut, None)) if items[s]]
    got = [r[:5] for r in D.judge(pa.array(docs, pa.string()), blocks)]
    assert got == brute(docs, list(zip(ids, items)), window)


def test_matches_are_the_longest():
    index = block([7], ["p q r s t u"], 3)
    (row,) = D.judge(pa.array(["x p q r s t y q r s p q r"]), [index])
    assert row[5] == [("7", 1, 0, 5), ("7", 7, 1, 3), ("7", 10, 0, 3)]


def test_a_shared_hash_is_no_match(monkeypatch):
    """Equal hashes of different words are told apart by their bytes, also inside a match."""
    real = D.tx.span_hashes
    monkeypatch.setattr(D.tx, "span_hashes", lambda buf, s, e: real(buf, s, s + np.minimum(1, e - s)))
    index = block([1, 2], ["ant bee cat", "one two six ten sun day"], 3)
    texts = ["axe bit cup", "ant bee cat", "one two six top sun day", "one two six top sin day", "one two sit ten sun day"]
    rows = D.judge(pa.array(texts), [index])
    assert [r[1] for r in rows] == [0, 3, 3, 3, 3]
    assert [m[1:] for m in rows[4][5]] == [(3, 3, 3)]
    assert [r[1] for r in D.judge(pa.array(["one two six ten sun day", "day one two six"]), [index])] == [6, 3]


@settings(max_examples=60, deadline=None)
@given(runs=st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_suffix_array_is_in_full_order(runs):
    words = np.array([w for r in runs for w in r], np.uint64)
    left = np.array([n for r in runs for n in range(len(r), 0, -1)])
    suffixes = [tuple(words[i:i + n].tolist()) for i, n in enumerate(left)]
    assert D.suffix_array(words, left).tolist() == sorted(range(len(words)), key=lambda i: suffixes[i])


def test_matches_do_not_depend_on_the_slices(monkeypatch):
    items = ["a a a a b", "a a a", "b a a a a b", "c"]
    docs = ["a a a a a b a a", "c b a", None, "b a a a a b c"]
    whole = D.judge(pa.array(docs), [block(range(4), items, 3)])
    monkeypatch.setattr(D, "HITS", 1)
    assert D.judge(pa.array(docs), [block(range(4), items, 3)]) == whole


def test_query_on_the_table(spark):
    docs, items = table(spark, SF_SMALL, "documents").collect(), table(spark, SF_SMALL, "benchmark").collect()
    got = {r.doc_id: list(r)[1:] for r in D.op4_decontaminate(spark, SF_SMALL).collect()}
    want = brute([d.text for d in docs], [(b.item_id, b.text) for b in items])
    assert got == {d.doc_id: w for d, w in zip(docs, want)} and any(w[4] for w in want)


def test_awkward_rows_and_many_blocks(spark):
    docs = awkward(spark).withColumn("n_words", F.col("doc_id"))
    items = spark.createDataFrame([(1, None), (2, ""), (3, "brown fox"), (None, "no id"), (4, "brown fox")], "item_id long, text string")
    for size, held in ((1, 1), (1, 1 << 20), (1 << 20, 1 << 20)):
        found = D.find_matches(docs, items, block_bytes=size, pass_bytes=held)
        rows = found.collect()
        assert found.columns[:3] == ["doc_id", "n_words", "n_hit"] and len(rows) == 12
        assert sorted(str(r.n_hit) for r in rows if r.n_hit) == ["2", "2", "2", "2"]
        kept = D.decontaminate(docs, items, block_bytes=size, pass_bytes=held)
        assert kept.columns == docs.columns and kept.count() == 8
    assert D.decontaminate(docs, empty(items)).count() == 12
    assert D.find_matches(empty(docs), items).count() == 0


def test_a_planted_passage_goes_and_clean_documents_stay(spark):
    items = table(spark, SF_SMALL, "benchmark")
    passage = items.first().text
    docs = spark.createDataFrame([(1, "before it " + passage + " after it"), (2, "nothing of the kind " * 20)], "doc_id long, text string")
    assert [r.doc_id for r in D.decontaminate(docs, items).collect()] == [2]


@pytest.mark.parametrize("n", [0, 1, 12, 13, 14, 100])
def test_items_of_any_length(n):
    text = " ".join(f"w{i}" for i in range(n))
    (row,) = D.judge(pa.array(["zz " + text]), [block([0], [text])])
    assert row[1] == n


def test_many_passes_are_one(spark):
    """A test set of many blocks, handed on one at a time between passes, gives what one pass gives."""
    docs, items = table(spark, SF_SMALL, "documents").select("doc_id", "text"), table(spark, SF_SMALL, "benchmark")
    size = items.selectExpr("sum(octet_length(text))").first()[0]
    once = {r.doc_id: r for r in D.find_matches(docs, items).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        blocks = [len(p) for p in D.test_passes(items, block_bytes=size // 9, pass_bytes=size)]
        assert len(blocks) > 1 and sum(blocks) > 8
        assert {r.doc_id: r for r in D.find_matches(docs, items, block_bytes=size // 9, pass_bytes=size).collect()} == once
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shards_end_with_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 1000)
    docs, items = table(spark, SF_SMALL, "documents").select("doc_id", "text"), table(spark, SF_SMALL, "benchmark")
    want = brute([d.text for d in docs.collect()], [(b.item_id, b.text) for b in items.collect()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.doc_id: list(r)[1:6] for r in D.find_matches(docs, items).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {d.doc_id: w for d, w in zip(docs.collect(), want)}
