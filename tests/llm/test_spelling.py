import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_util import awkward, empty, lower

from conftest import SF_SMALL
from gavel.llm import spelling as S
from gavel.llm.common import table


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    """All pairs compared."""
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) <= 1 and x != w and one_edit(x, w)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return sorted((w, f, root(w), n, near, words[f] if f else None) for w, (f, n, near) in out.items())


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_on_the_table(spark):
    words = counted((d.doc_id, d.text) for d in table(spark, SF_SMALL, "documents").collect())
    got = rows_of(S.op13_spelling(spark, SF_SMALL))
    assert got == brute(words) and any(r[4] for r in got) and any(r[1] for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark).withColumnsRenamed({"source": "word", "lang": "n"}).withColumnRenamed("n_chars", "rest")
    more = [(9, "colour Colours COLOUR colour Étéssss Étéssss Étéssss étéssss étéssss étéssss x×y÷z " * 3, None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(more * 2, docs.schema))
    assert rows_of(S.variants(S.vocabulary(docs))) == brute(counted((d.doc_id, d.text) for d in docs.collect()))
    assert S.variants(S.vocabulary(empty(docs))).count() == 0


words_st = st.dictionaries(st.text("abé", min_size=5, max_size=9), st.integers(3, 40), max_size=60)


@settings(max_examples=150, deadline=None)
@given(words=words_st, abreast=st.sampled_from([1, 7, 4096]))
def test_scan_of_one_sorted_list(words, abreast):
    """One list of all words against all pairs."""
    every = sorted(words)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "ABREAST", abreast)
        code, sizes = S._codes(every, max(map(len, every), default=0))
        asks = np.arange(len(every)) % 3 != 1
        got = sorted((every[q], every[w]) for qs, ws in S.scan(code, sizes, np.zeros(len(every), int), asks) for q, w in zip(qs, ws))
    assert got == sorted((a, b) for i, a in enumerate(every) if i % 3 != 1 for b in every if a != b and one_edit(a, b))


def test_long_lists_are_split(spark):
    """Queries of one list in many parts, a chain of forms, ties, and a word of 20,000 characters."""
    words = {"aa" + "".join(x) + "zz": 3 + (ord(x[0]) + ord(x[1])) % 9 for x in zip("abcdefgh" * 8, "aaaaaaaabbbbbbbbccccccccddddddddeeeeeeeeffffffffgggggggghhhhhhhh")}
    words |= {"b" * 5 + "c" * k: 3 * 2 ** k for k in range(9)} | {"y" * 20_000: 3, "y" * 20_001: 9, "y" * 9_999 + "x" + "y" * 10_000: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(S.variants(df, queries=5)) == rows_of(S.variants(df)) == brute(words)


def test_roots_need_few_rounds(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(62)], "word string, form string")
    assert {r.root for r in S._roots(chain).collect()} == {"w62"}
