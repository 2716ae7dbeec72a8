"""Quality rules: counts of every text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. Their counts over all documents give the raw multinomial, those of
trusted documents the target one; a document's verdict is the mean over its n-grams of log target - log raw against a
fixed bar, so equal texts always get equal verdicts. Trusted are all labelled documents of label 1; the raw counts take
in every document, in a narrow pass whose tasks emit one row for each bucket. Documents that a bitmap of the trusted ids'
hashes lets through are joined with these ids by a shuffle, exactly and at every size, and counted likewise, so other
texts stay where they are. A last narrow pass judges.

Defined results: a null or empty text has no words and fails; without trusted documents the ratio is zero and the
counts alone decide; repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.common import arrow_schema, map_batches, table

BUCKET_BITS = 16
#: Bits of the map that keeps most untrusted texts out of the join with the trusted ids (4 MB).
ID_BITS = 1 << 25
#: Pseudo-count of every bucket.
SMOOTHING = 1.0
#: Mean log ratio from which a document is kept.
BAR = -0.1
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 10, 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def ngrams(buf: np.ndarray, offs: np.ndarray):
    """(buckets, text) of the words and word pairs of every text, with the words' hashes and where texts begin."""
    starts, ends, first = tx.spans(buf, offs, tx.WS_WORD)
    words = tx.span_hashes(buf, starts, ends)
    text = tx.owner(first)
    pair = tx.windows(first, 2)
    pairs = tx.chain(words, 2)[pair] if len(pair) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate((words >> shift, pairs >> shift)).astype(np.int64), np.concatenate((text, text[pair])), words, first


def maybe_trusted(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key's bit is set in a bitmap of the trusted keys' hashes: all trusted rows and few others. The
    bitmap has at most ``ID_BITS`` bits whatever the tables hold, so it may be broadcast."""
    def bit(x):
        return F.pmod(F.xxhash64(x), F.lit(ID_BITS)) + 1
    bits = ids.select(bit("__id").alias("bit"))
    bitmap = bits.groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    place = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    near = docs.join(F.broadcast(bitmap), F.bitmap_bucket_number(bit(key)) == F.col("__bucket"))
    return near.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0).select(docs.columns)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of every bucket over one column of texts."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    out = arrow_schema(schema)

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, buf, offs in tx.blocks(batch.column(0)):
                total += np.bincount(ngrams(buf, offs)[0], minlength=1 << BUCKET_BITS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=out)
    result = np.zeros(1 << BUCKET_BITS)
    for r in texts.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        result[r.bucket] = r.n
    return result


def trusted_texts(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """The texts of the trusted documents. An inner join with different ids, as the optimizer would move a semi join
    below the bitmap."""
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    ids = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("__id")).distinct()
    near = maybe_trusted(docs, ids, "__key")
    return near.join(ids.hint("merge"), F.col("__key") == F.col("__id")).select("__text")


def counts(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> np.ndarray:
    """Counts of every bucket over all documents, and over the trusted ones."""
    return np.stack((bucket_counts(docs.select(text)), bucket_counts(trusted_texts(docs, trusted, key, text))))


def log_ratio(both: np.ndarray) -> np.ndarray:
    if not both[1].any():
        return np.zeros(both.shape[1])
    smooth = both + SMOOTHING
    share = smooth / smooth.sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def judge(buf: np.ndarray, offs: np.ndarray, ratio: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the mean log ratio of every text."""
    n = len(offs) - 1
    bucket, owner, words, first = ngrams(buf, offs)
    n_words = np.diff(first)
    chars = tx.per_text(tx.WS_WORD[buf] & ((buf & 0xC0) != 0x80), offs)
    symbols = tx.per_text(_SYMBOL[buf], offs)
    starts, ends, line_first = tx.spans(buf, offs, _LINE)
    solid = np.concatenate(([0], np.cumsum(tx.WS_WORD[buf])))
    full = solid[ends] > solid[starts]
    line_text = tx.owner(line_first)[full]
    lines = _per_text_key(tx.span_hashes(buf, starts, ends)[full], line_text)
    once = np.unique(lines, return_index=True)[1]
    dup = np.bincount(line_text, minlength=n) - np.bincount(line_text[once], minlength=n)
    at = tx.windows(first, REPEAT_WORDS)
    cover = np.zeros(len(words) + 1, np.int64)
    if len(at):
        text = tx.owner(first)
        _, which, times = np.unique(_per_text_key(tx.chain(words, REPEAT_WORDS)[at], text[at]), return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        cover[again] += 1
        cover -= np.concatenate((np.zeros(REPEAT_WORDS, np.int64), cover[:-REPEAT_WORDS] > 0))[: len(cover)] if len(again) else 0
    repeat = tx.per_text(np.cumsum(cover)[:-1] > 0, first)
    total = np.bincount(owner, ratio[bucket], minlength=n) if len(bucket) else np.zeros(n)
    size = np.bincount(owner, minlength=n)
    return [n_words, chars, symbols, dup, repeat, np.divide(total, size, out=np.zeros(n), where=size > 0)]


def _per_text_key(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return tx.mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def quality_rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", bar: float = BAR) -> DataFrame:
    """(key, counts, log_ratio, base_failed, kept) of every row; ``trusted`` holds the ids of trusted documents."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio(counts(docs, trusted, key, text)))
    docs = docs.select(key, text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([docs.schema[0], *(T.StructField(x, T.LongType()) for x in names), T.StructField("log_ratio", T.DoubleType()),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    out = arrow_schema(schema)

    def run(batch: pa.RecordBatch):
        parts = [judge(buf, offs, shared.value) for _, _, buf, offs in tx.blocks(batch.column(1))]
        got = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]
        ratio = np.round(got[5], 9)
        failed = (got[0] < MIN_WORDS) | (100 * got[4] > REPEAT_PERCENT * got[0])
        return pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), *(pa.array(x.astype(np.int64)) for x in got[:5]), pa.array(ratio),
                                           pa.array(failed), pa.array(~failed & (ratio >= bar))], schema=out)
    return map_batches(docs, run, schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)
