"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces of the product of their probabilities, computed by the forward algorithm; a text's is
the product over its words. Training counts the words of every language once, by a group-by; its rounds then run over
this table of different words and take expected piece counts from the forward-backward algorithm, at first under equal
piece probabilities and then under those learned. A round's tasks emit one row for each language and piece. The model's
size is that of the vocabulary times the languages, whatever the documents.

Words are runs of letters, lower-cased in ASCII, each led by a space. The dynamic programme runs over all different words
of a length at once, place by place; a run of over ``SHORT`` bytes, such as a sentence without spaces, goes by itself and in
logarithms, place by place over the pieces that end there, whatever its length. Defined results: a text that is null
or has no letter is ``und`` with score 0, and so is any text without training rows; ties go to the first language by
name; repeated rows are judged alike; texts and words of any length are taken whole; an empty table gives none; only
the named columns are read, whatever others are called.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.bpe import VOCABULARY, load_ranks
from gavel.llm.common import arrow_schema, saved, table

#: Bytes of a word, with its space, up to which words of a length go together.
SHORT = 32
ROUNDS = 2
SMOOTHING = 0.1
#: Expected counts are summed as whole numbers of this fraction, so that sums don't depend on their order.
GRAIN = 1 << 20
#: Different words a task counts before it hands them on, and whose scores it remembers.
WORDS_AT_ONCE, WORDS_KNOWN = 200_000, 600_000
UNKNOWN = "und"


class Vocabulary:
    """Pieces by the hash of their bytes, one sorted list for each length."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.by_length = {}
        for length in range(1, max(map(len, pieces)) + 1):
            own = [(i, p) for i, p in enumerate(pieces) if len(p) == length]
            buf = np.frombuffer(b"".join(p for _, p in own), np.uint8)
            at = np.arange(len(own)) * length
            hashes = tx.span_hashes(buf, at, at + length)
            order = np.argsort(hashes)
            sieve = np.zeros(1 << 19, bool)
            sieve[(hashes >> np.uint64(45)).astype(np.int64)] = True
            self.by_length[length] = (hashes[order], np.array([i for i, _ in own], np.int64)[order], sieve)

    def pieces(self, rows: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For equally long words, by (from, to): which words have a piece there, and which piece."""
        total = tx.prefixes(rows)
        found = {}
        for start in range(rows.shape[1]):
            for length, (hashes, ids, sieve) in self.by_length.items():
                if start + length > rows.shape[1] or not len(hashes):
                    continue
                h = tx.stretch_hash(total, start, length)
                own = np.flatnonzero(sieve[(h >> np.uint64(45)).astype(np.int64)])
                at = np.minimum(np.searchsorted(hashes, h[own]), len(hashes) - 1)
                true = hashes[at] == h[own]
                if true.any():
                    found[start, start + length] = own[true], ids[at[true]]
        return found


    def arcs(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For one word: (from, to, piece) of all pieces in it in the order of their ends, and where each end's begin."""
        n = len(word)
        low, high, piece = [], [], []
        for length, (hashes, ids, _) in self.by_length.items():
            if length > n or not len(hashes):
                continue
            at = np.arange(n - length + 1)
            h = tx.span_hashes(word, at, at + length)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            true = np.flatnonzero(hashes[place] == h)
            low.append(true)
            high.append(true + length)
            piece.append(ids[place[true]])
        low, high, piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (low, high, piece))
        order = np.argsort(high, kind="stable")
        high = high[order]
        return low[order], high, piece[order], np.searchsorted(high, np.arange(n + 2))


def _summed(logs: np.ndarray) -> np.ndarray:
    """log of the sum of exp over rows."""
    top = logs.max(0)
    return top + np.log(np.exp(logs - np.where(np.isfinite(top), top, 0)).sum(0)) if len(logs) else top


def long_forward(arcs, n: int, logs: np.ndarray) -> np.ndarray:
    """``forward`` of one word in logarithms, a row for every place."""
    low, _, piece, first = arcs
    reach = np.full((n + 1, logs.shape[1]), -np.inf)
    reach[0] = 0
    for place in range(1, n + 1):
        own = slice(first[place], first[place + 1])
        if first[place] < first[place + 1]:
            reach[place] = _summed(reach[low[own]] + logs[piece[own]])
    return reach


def long_expected(arcs, n: int, logs: np.ndarray) -> np.ndarray:
    """Expected count of every arc of one word in every language."""
    low, high, piece, first = arcs
    ahead = long_forward(arcs, n, logs)
    order = np.argsort(low, kind="stable")
    start = np.searchsorted(low[order], np.arange(n + 2))
    back = np.full((n + 1, logs.shape[1]), -np.inf)
    back[n] = 0
    for place in range(n - 1, -1, -1):
        own = order[start[place]: start[place + 1]]
        if len(own):
            back[place] = _summed(back[high[own]] + logs[piece[own]])
    return np.exp(ahead[low] + logs[piece] + back[high] - ahead[n])


def forward(found, size: int, n: int, prob: np.ndarray) -> list[np.ndarray]:
    """For every place of n words of ``size`` bytes, the summed probability of all segmentations up to it."""
    reach = [np.zeros((n, prob.shape[1])) for _ in range(size + 1)]
    reach[0] += 1
    for (low, high), (word, piece) in sorted(found.items()):
        reach[high][word] += reach[low][word] * prob[piece]
    return reach


def backward(found, size: int, n: int, prob: np.ndarray) -> list[np.ndarray]:
    """The same from every place to the end."""
    reach = [np.zeros((n, prob.shape[1])) for _ in range(size + 1)]
    reach[size] += 1
    for (low, high), (word, piece) in sorted(found.items(), reverse=True):
        reach[low][word] += reach[high][word] * prob[piece]
    return reach


def by_size(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(which words, their bytes as rows) for the words of each length, some thousands at a time."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], size[order][1:] != size[order][:-1])))
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
        for low in range(s, e, 1 << 14):
            own = order[low: min(e, low + (1 << 14))]
            yield own, buf[starts[own][:, None] + np.arange(size[own[0]])]


def words_of(buf: np.ndarray, offs: np.ndarray):
    """Words led by a space: bytes, starts, ends, hashes and where each text's words begin."""
    low, high, first = tx.spans(buf, offs, tx.LETTER_WORD)
    size = high - low
    spaced = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    kept = tx.LOWER[buf[tx.LETTER_WORD[buf]]]
    spaced[np.arange(len(kept)) + np.repeat(np.arange(len(size)), size) + 1] = kept
    begin = np.cumsum(size + 1) - (size + 1)
    return spaced, begin, begin + size + 1, tx.span_hashes(spaced, begin, begin + size + 1), first


def _vocabulary(shared) -> Vocabulary:
    """A worker keeps the vocabulary from task to task."""
    kept = sys.modules.setdefault("_gavel_llm_language", types.SimpleNamespace(vocabulary=None, key=None, scorer=(None, None)))
    key = hash(tuple(shared.value))
    if kept.key != key:
        kept.vocabulary, kept.key = Vocabulary(shared.value), key
    return kept.vocabulary


class Words:
    """Rows of different words, found by their hashes."""

    def __init__(self, width: int):
        self.seen: dict[int, int] = {}
        self.values = np.zeros((1 << 12, width))

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's row, and which words are new and got their rows now."""
        seen, base = self.seen, len(self.seen)
        at = np.fromiter((seen.get(k, -1) for k in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(base, base + len(new))
        seen.update(zip(hashes[new].tolist(), range(base, base + len(new))))
        if len(seen) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros((len(self.values) + len(new), self.values.shape[1]))))
        return at, new


def word_counts(docs: DataFrame, langs: list[str], text: str, lang: str) -> DataFrame:
    """(word, lang, n): how often each language has each word, ``lang`` being its number."""
    number = {x: i for i, x in enumerate(langs)}
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("lang", T.IntegerType()), T.StructField("n", T.LongType())])
    out = arrow_schema(schema)

    def told(words, chunks):
        done = 0
        for buf, starts, ends in chunks:
            word, kind = np.nonzero(words.values[done: done + len(starts)])
            times = words.values[done: done + len(starts)][word, kind].astype(np.int64)
            done += len(starts)
            size = (ends - starts)[word]
            stops = np.cumsum(size)
            data = buf[np.repeat(starts[word] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
            binary = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(np.concatenate(([0], stops)).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([binary, pa.array(kind.astype(np.int32)), pa.array(times)], schema=out)

    def run(batches):
        words, chunks = Words(len(langs)), []
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b, buf, offs in tx.blocks(batch.column(1)):
                spaced, starts, ends, hashes, first = words_of(buf, offs)
                kind = own[a:b][tx.owner(first)]
                _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
                times = np.bincount(which * len(langs) + kind, minlength=len(sample) * len(langs)).reshape(-1, len(langs))
                at, new = words.rows(hashes[sample])
                words.values[at] += times
                chunks.append((spaced, starts[sample[new]], ends[sample[new]]))
                if len(words.seen) >= WORDS_AT_ONCE:
                    yield from told(words, chunks)
                    words, chunks = Words(len(langs)), []
        yield from told(words, chunks)
    return docs.select(lang, text).mapInArrow(run, schema).groupBy("word", "lang").agg(F.sum("n").alias("n"))


def expected(counted: DataFrame, langs: int, pieces, prob) -> np.ndarray:
    """Expected counts of every piece in every language under the given probabilities, from one pass over the words."""
    shared = counted.sparkSession.sparkContext.broadcast(prob)
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
    out = arrow_schema(schema)

    def run(batches):
        vocabulary, p = _vocabulary(pieces), shared.value
        logs = np.log(np.maximum(p, 1e-300))
        total = np.zeros((vocabulary.size, langs))
        for batch in batches:
            if not len(batch):
                continue
            word = batch.column(0)
            offs = np.frombuffer(word.buffers()[1], np.int32)[word.offset: word.offset + len(word) + 1].astype(np.int64)
            buf = np.frombuffer(word.buffers()[2], np.uint8)
            hashes = tx.span_hashes(buf[offs[0]: offs[-1]], offs[:-1] - offs[0], offs[1:] - offs[0])
            # A word of several languages goes once.
            _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
            times = np.zeros((len(sample), langs))
            np.add.at(times, (which, batch.column(1).to_numpy()), batch.column(2).to_numpy())
            starts, ends = offs[:-1][sample], offs[1:][sample]
            short = ends - starts <= SHORT
            for own, rows in by_size(buf, starts[short], ends[short]):
                n, size = rows.shape
                found = vocabulary.pieces(rows)
                a, b = forward(found, size, n, p), backward(found, size, n, p)
                scale = times[short][own] / np.maximum(a[size], 1e-300)
                pieces_, shares = [], []
                for (low, high), (at, piece) in found.items():
                    pieces_.append(piece)
                    shares.append(a[low][at] * p[piece] * b[high][at] * scale[at])
                if pieces_:
                    piece, share = np.concatenate(pieces_), np.concatenate(shares)
                    for k in range(langs):
                        total[:, k] += np.bincount(piece, share[:, k], minlength=vocabulary.size)
            for i in np.flatnonzero(~short).tolist():
                arcs = vocabulary.arcs(buf[starts[i]: ends[i]])
                np.add.at(total, arcs[2], long_expected(arcs, int(ends[i] - starts[i]), logs) * times[i])
        whole = np.round(total * GRAIN).astype(np.int64).ravel()
        seen = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(whole[seen])], schema=out)
    sums = counted.mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n"))
    result = np.zeros(len(pieces.value) * langs)
    for r in sums.collect():  # a row for each piece and language at most
        result[r.cell] = r.n / GRAIN
    return result.reshape(-1, langs)


def fit(docs: DataFrame, pieces, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> dict:
    """Languages and their piece probabilities, learned from the rows that have a language."""
    docs = docs.where(F.col(lang).isNotNull())
    langs = sorted(r[0] for r in docs.select(lang).distinct().collect())
    n = len(pieces.value)
    prob = np.full((n, 1), 1 / n)
    counted = saved(word_counts(docs, langs, text, lang)) if langs else None
    for _ in range(rounds if langs else 0):
        got = expected(counted, len(langs), pieces, prob) + SMOOTHING
        prob = got / got.sum(0)
    return {"langs": langs, "prob": prob}


class Scorer:
    """Log-probabilities of words in every language; a word that came before is looked up."""

    def __init__(self, vocabulary: Vocabulary, prob: np.ndarray):
        self.vocabulary, self.prob, self.logs = vocabulary, prob, np.log(np.maximum(prob, 1e-300))
        self.known = Words(prob.shape[1])

    def words(self, spaced, starts, ends, hashes) -> np.ndarray:
        if len(self.known.seen) > WORDS_KNOWN:
            self.known = Words(self.prob.shape[1])
        at, new = self.known.rows(hashes)
        long = new[ends[new] - starts[new] > SHORT]
        new = new[ends[new] - starts[new] <= SHORT]
        for own, rows in by_size(spaced, starts[new], ends[new]):
            total = forward(self.vocabulary.pieces(rows), rows.shape[1], len(rows), self.prob)[-1]
            self.known.values[at[new[own]]] = np.log(np.maximum(total, 1e-300))
        for i in long.tolist():
            n = int(ends[i] - starts[i])
            self.known.values[at[i]] = long_forward(self.vocabulary.arcs(spaced[starts[i]: ends[i]]), n, self.logs)[n]
        return self.known.values[at]

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        spaced, starts, ends, hashes, first = words_of(buf, offs)
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        logs = self.words(spaced, starts[sample], ends[sample], hashes[sample])[which]
        total = np.concatenate((np.zeros((1, self.prob.shape[1])), np.cumsum(logs, 0)))
        return total[first[1:]] - total[first[:-1]]


def _scorer(pieces, model) -> Scorer:
    """A worker keeps the scores of words from task to task, as long as the model is the same."""
    vocabulary = _vocabulary(pieces)
    kept, name = sys.modules["_gavel_llm_language"], getattr(model, "_path", None)
    if name is None or kept.scorer[0] != name:
        kept.scorer = name, Scorer(vocabulary, model.value["prob"])
    return kept.scorer[1]


def identify(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(key, lang_pred, score) of every row, the score being the language's share of the summed likelihoods."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        pieces = [b for b, _ in sorted(load_ranks(f.read().splitlines()).items(), key=lambda x: x[1])]
    sc = docs.sparkSession.sparkContext
    pieces = sc.broadcast(pieces)
    model = sc.broadcast(fit(training, pieces, text, lang, rounds))
    docs = docs.select(key, text, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = T.StructType([docs.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = arrow_schema(schema)

    def run(batches):
        langs = model.value["langs"]
        scorer = _scorer(pieces, model) if langs else None
        for batch in batches:
            n = len(batch)
            letters = np.array(batch.column(2).to_pylist(), bool)
            if scorer is None:
                names, score = [UNKNOWN] * n, np.zeros(n)
            else:
                like = np.concatenate([scorer.texts(buf, offs) for _, _, buf, offs in tx.blocks(batch.column(1))]) if n else np.zeros((0, 1))
                best = like.argmax(1)
                share = 1 / np.exp(like - like.max(1, keepdims=True)).sum(1)
                names = [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist())]
                score = np.round(np.where(letters, share, 0.0), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), pa.array(names, pa.string()), pa.array(score)], schema=out)
    return docs.mapInArrow(run, schema)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(~held_out("doc_id")))
    return found.withColumn("held_out", held_out("doc_id"))
