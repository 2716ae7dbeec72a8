import numpy as np
import public_tokenizers
import pytest
from llm_util import awkward, empty
from pyspark.sql import functions as F

from conftest import SF_MID
from gavel.llm import language as L
from gavel.llm.bpe import VOCABULARY, load_ranks
from gavel.llm.common import table


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        return [b for b, _ in sorted(load_ranks(f.read().splitlines()).items(), key=lambda x: x[1])]


def segmentations(word, known):
    """All ways to cut a word into pieces."""
    if not word:
        return [[]]
    return [[known[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in known
            for rest in segmentations(word[n:], known)]


def words(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    spaced, s, e, h, first = L.words_of(buf, np.array([0, len(buf)]))
    raw = spaced.tobytes()
    return [raw[a:b] for a, b in zip(s, e)], (spaced, s, e, h)


def test_forward_sums_all_segmentations(pieces):
    known = {b: i for i, b in enumerate(pieces)}
    prob = np.random.default_rng(0).random((len(pieces), 3))
    cut, parts = words("The Thing über naïve xyz inth")
    assert cut == ["the", "thing", "über", "naïve", "xyz", "inth"] and 0 or [c.decode() for c in cut] == [" the", " thing", " über", " naïve", " xyz", " inth"]
    got = np.exp(L.Scorer(L.Vocabulary(pieces), prob).words(*parts))
    want = [sum(np.prod(prob[s], axis=0) for s in segmentations(c, known)) for c in cut]
    assert np.allclose(got, want)


def test_long_pieces_count(pieces):
    known = {b: i for i, b in enumerate(pieces)}
    prob = np.random.default_rng(2).random((len(pieces), 2))
    cut, parts = words("understanding international representatives")
    assert all(c in known for c in cut)

    def total(word):
        reach = [np.ones(2)] + [np.zeros(2) for _ in word]
        for high in range(1, len(word) + 1):
            for low in range(high):
                if word[low:high] in known:
                    reach[high] = reach[high] + reach[low] * prob[known[word[low:high]]]
        return reach[-1]
    assert np.allclose(np.exp(L.Scorer(L.Vocabulary(pieces), prob).words(*parts)), [total(c) for c in cut])


LONG = ["donaudampfschifffahrtsgesellschaftskapitänswitwenrente", "语言识别是自然语言处理的一项基本任务" * 2, "x" * 300, "สวัสดีชาวโลกทุกคนในวันนี้"]


def log_sums(word, known, logs):
    """Forward sums of one word in plain Python."""
    reach = [np.zeros(logs.shape[1])] + [None] * len(word)
    for high in range(1, len(word) + 1):
        ways = [reach[low] + logs[known[word[low:high]]] for low in range(high) if word[low:high] in known]
        top = np.max(ways, 0)
        reach[high] = top + np.log(np.exp(np.array(ways) - top).sum(0))
    return reach[-1]


def test_runs_of_any_length_are_whole(pieces):
    """Runs of 50 to 300 bytes, without spaces, against all segmentations (by plain forward sums)."""
    known = {b: i for i, b in enumerate(pieces)}
    prob = np.random.default_rng(4).dirichlet(np.ones(len(pieces)), 2).T
    cut, parts = words(" ".join(LONG))
    assert cut == [b" " + w.encode() for w in LONG] and all(len(c) > L.SHORT for c in cut)
    got = L.Scorer(L.Vocabulary(pieces), prob).words(*parts)
    assert np.allclose(got, [log_sums(c, known, np.log(prob)) for c in cut])


def test_both_ways_of_a_word_agree(pieces, monkeypatch):
    """The same words by length and one by one: scores and expected counts."""
    vocabulary, prob = L.Vocabulary(pieces), np.random.default_rng(5).dirichlet(np.ones(len(pieces)), 3).T
    _, parts = words("a thing international über представление 语言")
    plain = L.Scorer(vocabulary, prob).words(*parts)
    monkeypatch.setattr(L, "SHORT", 0)
    assert np.allclose(L.Scorer(vocabulary, prob).words(*parts), plain)
    word = np.frombuffer(b" international", np.uint8)
    found = vocabulary.pieces(word[None])
    a, b = L.forward(found, len(word), 1, prob), L.backward(found, len(word), 1, prob)
    arcs = vocabulary.arcs(word)
    got = {(lo, hi): x for lo, hi, x in zip(arcs[0], arcs[1], L.long_expected(arcs, len(word), np.log(prob)))}
    assert len(got) == len(found)
    for (lo, hi), (_, piece) in found.items():
        assert np.allclose(got[lo, hi], a[lo][0] * prob[piece[0]] * b[hi][0] / a[-1][0])


def test_training_counts_every_word(spark, pieces):
    """A round over the table of words against one over the words as they come; long runs included."""
    rows = [("the thing the " + LONG[0], "en"), (LONG[1] + " thing", "zh"), ("", "en"), (None, "zh"), ("The üb", "en"), ("the", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    shared = spark.sparkContext.broadcast(pieces)
    got = L.fit(docs, shared, rounds=1)
    vocabulary, n = L.Vocabulary(pieces), len(pieces)
    want = np.zeros((n, 2))
    for text, lang in rows:
        for w in words(text)[0] if text and lang else []:
            arcs = vocabulary.arcs(np.frombuffer(w, np.uint8))
            np.add.at(want[:, ["en", "zh"].index(lang)], arcs[2], L.long_expected(arcs, len(w), np.full((n, 1), -np.log(n)))[:, 0])
    want += L.SMOOTHING
    assert got["langs"] == ["en", "zh"] and np.allclose(got["prob"], want / want.sum(0), rtol=1e-4)


def test_expected_counts_are_posterior(pieces):
    """Forward-backward against the posterior over listed segmentations."""
    known = {b: i for i, b in enumerate(pieces)}
    vocabulary, prob = L.Vocabulary(pieces), np.random.default_rng(1).random((len(pieces), 1))
    word = b" thing"
    rows = np.frombuffer(word, np.uint8)[None]
    found = vocabulary.pieces(rows)
    a, b = L.forward(found, len(word), 1, prob), L.backward(found, len(word), 1, prob)
    got = {}
    for (low, high), (_, piece) in found.items():
        share = (a[low] * prob[piece] * b[high] / a[-1])[0, 0]
        got[int(piece[0])] = got.get(int(piece[0]), 0) + share
    ways = [(s, np.prod(prob[s, 0])) for s in segmentations(word, known)]
    total = sum(p for _, p in ways)
    want = {}
    for s, p in ways:
        for k in s:
            want[k] = want.get(k, 0) + p / total
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_held_out_accuracy_and_blind_inputs(spark):
    docs = table(spark, SF_MID, "documents")
    rows = {r.doc_id: r for r in L.op7_language(spark, SF_MID).collect()}
    truth = {d.doc_id: d.lang for d in docs.collect()}
    held = [k for k, r in rows.items() if r.held_out]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert sum(rows[k].lang_pred == truth[k] for k in held) / len(held) > 0.98
    training = docs.where(~L.held_out("doc_id"))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 10**6})
    again = {r.doc_id - 10**6: r for r in L.identify(other, training).collect()}
    assert all((again[k].lang_pred, again[k].score) == (r.lang_pred, r.score) for k, r in rows.items())


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang_pred", F.lit("mine"))
    training = table(spark, SF_MID, "documents").withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).limit(300)
    rows = L.identify(docs, training, rounds=1).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(r.lang_pred == "und" for r in rows).count(True) == sum(
        not any(c.isalpha() for c in d.text or "") for d in docs.collect())
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in L.identify(docs, empty(training)).collect()} == {"und"}
    assert L.identify(empty(docs), training, rounds=1).count() == 0
