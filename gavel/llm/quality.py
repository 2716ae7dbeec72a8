"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's features are its words and its word shapes (runs of character classes, and words that repeat their
predecessor), hashed into a fixed number of buckets, weighted by tf-idf and normalised for each of the two kinds.
The inverse document frequencies count every document. A bounded sample of labelled documents gives the latent
space (the leading singular vectors) and the neighbours; its vectors are broadcast. Every document is then projected
and compared with all of them by exact blocked cosine products; the nearest ones vote, weighted by similarity and
by what their label's share of the sample stands for.

Sizes that do not follow the data: 2 * ``SAMPLE`` neighbours, ``BUCKETS`` features, ``RANK`` dimensions. Defined results: a null or
empty text has no neighbours and gets the share of label 1; without any labelled row every score is 1 (nothing
speaks against a document); repeated rows score alike; several labels of one id are averaged, and of several texts of
one id the first by their features is learned from; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.common import arrow_schema, map_batches, saved, table

WORD_BITS, SHAPE_BITS = 15, 10
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Labelled documents of either label at most, in the order of a hash of their ids.
SAMPLE = 1024
RANK = 64
NEIGHBOURS = 25
#: A neighbour's vote is its similarity to this power.
SHARPNESS = 4
THRESHOLD = 0.7

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("0")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x80:] = ord("a")


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of every bucket that occurs in a text, sorted by text, then bucket."""
    starts, ends, first = tx.spans(buf, offs, tx.WS_WORD)
    text = tx.owner(first)
    words = tx.span_hashes(buf, starts, ends)
    # Shapes: equal classes in a row count once.
    kind = _CLASS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    kept = np.flatnonzero(edge[:-1] | (kind != np.concatenate(([0], kind[:-1])))) if len(buf) else np.zeros(0, np.int64)
    short = kind[kept]
    low, high, _ = tx.spans(short, np.searchsorted(kept, offs), tx.WS_WORD)
    shapes = tx.span_hashes(short, low, high)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = np.where(again, np.uint64(0), shapes)
    word_bucket = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    shape_bucket = (shapes >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    key, times = np.unique(np.concatenate((text * BUCKETS + word_bucket, text * BUCKETS + shape_bucket)), return_counts=True)
    return key // BUCKETS, key % BUCKETS, times


def weights(text: np.ndarray, bucket: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf, of length one for each text's words and for its shapes."""
    w = np.where(bucket < (1 << WORD_BITS), 1 + np.log(times), np.sqrt(times)) * idf[bucket]
    part = 2 * text + (bucket >= (1 << WORD_BITS))
    size = np.sqrt(np.bincount(part, w * w))[part] if len(part) else w
    return np.divide(w, size, out=np.zeros(len(w)), where=size > 0)


def labelled(labels: DataFrame, key: str, label: str, sample: int) -> tuple[dict, float]:
    """{id: label} of a bounded sample, and label 1's share of all labelled ids."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("y"))
    total, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not total:
        return {}, 1.0
    # A union, as a limit that is collected by itself sends ``sample`` rows of every partition to the driver.
    zeros, units = (rows.where(F.col("y") == y).orderBy(F.xxhash64(F.col(key)), key).limit(sample) for y in (0, 1))
    return {r[0]: r[1] for r in zeros.unionByName(units).collect()}, ones / total


def survey(docs: DataFrame, key: str, text: str, chosen: dict) -> DataFrame:
    """Document frequencies of the buckets over all documents (bucket -1: the documents), and the sampled ones'
    features, in one pass."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(chosen))
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("id", T.StringType()),
                           T.StructField("buckets", T.BinaryType()), T.StructField("times", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, buf, offs in tx.blocks(batch.column(1)):
                text_, bucket, times = features(buf, offs)
                total += np.bincount(bucket, minlength=BUCKETS)
                n += b - a
                picked = [i for i in range(a, b) if ids[i] in wanted.value]
                if picked:
                    at = np.searchsorted(text_, np.array([[i - a, i - a + 1] for i in picked]))
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(len(picked), pa.int32()), pa.nulls(len(picked), pa.int64()), pa.array([str(ids[i]) for i in picked]),
                        pa.array([bucket[s:e].astype("<u4").tobytes() for s, e in at], pa.binary()),
                        pa.array([times[s:e].astype("<u4").tobytes() for s, e in at], pa.binary())], schema=out)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(([-1], seen)).astype(np.int32)), pa.array(np.concatenate(([n], total[seen]))),
            *(pa.nulls(len(seen) + 1, t) for t in (pa.string(), pa.binary(), pa.binary()))], schema=out)
    return docs.select(key, text).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, rank: int = RANK) -> dict | None:
    """The latent space, the neighbours' vectors and labels; None without labelled documents.

    One task decomposes the sample, whose size is bounded; the driver only gets the model."""
    chosen, share = labelled(labels, key, label, sample)
    if not chosen:
        return None
    seen = saved(survey(docs, key, text, chosen))
    # Of several texts with one id the first by features counts, however the rows are dealt.
    seen = seen.groupBy("bucket", "id").agg(F.sum("n").alias("n"), F.min(F.struct("buckets", "times")).alias("first"))
    seen = seen.select("bucket", "n", "id", "first.buckets", "first.times")
    by_name = {str(k): y for k, y in chosen.items()}
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches):
        n, df, rows = 0, np.zeros(BUCKETS), []
        for batch in batches:
            counted = batch.filter(batch.column(0).is_valid())
            bucket, times = counted.column(0).to_numpy(), counted.column(1).to_numpy()
            n += int(times[bucket < 0].sum())
            df[bucket[bucket >= 0]] = times[bucket >= 0]
            rows += zip(*(batch.filter(batch.column(2).is_valid()).column(c).to_pylist() for c in (2, 3, 4)))
        if rows:
            for name, value in decomposed(np.log((1 + n) / (1 + df)), sorted(rows), by_name, share, rank):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([value.tobytes()], pa.binary())], schema=out)
    found: dict[str, list] = {}
    for name, value in seen.repartition(1).mapInArrow(run, schema).collect():
        found.setdefault(name, []).append(value)
    if not found:
        return None
    model = {name: np.frombuffer(b"".join(parts), "<f4" if name in ("space", "near") else "<f8") for name, parts in found.items()}
    for name, length in (("space", BUCKETS), ("near", len(model["y"]))):
        model[name] = model[name].reshape(length, -1)
    return model | {"share": share}


def decomposed(idf: np.ndarray, rows: list[tuple], by_name: dict, share: float, rank: int):
    """Named arrays of the model, the space in stretches of buckets; ``rows`` are ids, buckets and times of the sample."""
    bucket = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows]).astype(np.int64)
    times = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) // 4 for r in rows])
    w = weights(doc, bucket, times, idf)
    # Singular vectors by the Gram matrix, a stretch of buckets at a time.
    order = np.argsort(bucket, kind="stable")
    doc, bucket, w = doc[order], bucket[order], w[order]
    step, m = 4096, len(rows)
    cuts = np.searchsorted(bucket, np.arange(0, BUCKETS + step, step))

    def stretch(i):
        x = np.zeros((m, step))
        own = slice(cuts[i], cuts[i + 1])
        x[doc[own], bucket[own] - i * step] = w[own]
        return x
    gram = np.zeros((m, m))
    for i in range(len(cuts) - 1):
        x = stretch(i)
        gram += x @ x.T
    del x
    value, vector = np.linalg.eigh(gram)
    del gram
    top = np.argsort(value)[::-1][:rank]
    top = top[value[top] > 1e-9]
    vector, scale = vector[:, top], np.sqrt(value[top])
    near = vector * scale
    size = np.linalg.norm(near, axis=1, keepdims=True)
    y = np.array([by_name[r[0]] for r in rows], float)
    ones = y.mean()
    yield "idf", idf
    for i in range(len(cuts) - 1):
        yield "space", (stretch(i).T @ (vector / scale))[:BUCKETS - i * step].astype("<f4")
    yield "near", (near / np.where(size > 0, size, 1)).astype("<f4")
    yield "y", y
    # A label's votes count as much as its share of all labelled rows, whatever its share of the sample.
    yield "vote", np.where(y > 0, share / max(ones, 1e-9), (1 - share) / max(1 - ones, 1e-9))


def votes(model: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The score of every text of a block."""
    n = len(offs) - 1
    text, bucket, times = features(buf, offs)
    w = weights(text, bucket, times, model["idf"]).astype(np.float32)
    latent = np.zeros((n, model["space"].shape[1]), np.float32)
    full, at = np.unique(text, return_index=True)
    if len(full) and latent.shape[1]:
        for low in range(0, len(full), 256):
            s, e = at[low], at[low + 256] if low + 256 < len(at) else len(text)
            latent[full[low: low + 256]] = np.add.reduceat(model["space"][bucket[s:e]] * w[s:e, None], at[low: low + 256] - s)
    size = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.divide(latent, size, out=np.zeros_like(latent), where=size > 0)
    out = np.full(n, float(model["share"]))
    k = min(NEIGHBOURS, len(model["near"]))
    # In double precision, as a product in single precision depends on a text's place in its block.
    near = model["near"].T.astype(float)
    for low in range(0, n, 256):
        cosine = latent[low: low + 256].astype(float) @ near
        best = np.argpartition(cosine, -k, axis=1)[:, -k:]
        like = np.maximum(np.take_along_axis(cosine, best, 1), 0) ** SHARPNESS * model["vote"][best]
        total = like.sum(1)
        some = total > 1e-12
        out[low: low + 256][some] = ((like * model["y"][best]).sum(1)[some]) / total[some]
    return np.clip(out, 0, 1)


def scores(batch: pa.Array, shared) -> np.ndarray:
    if shared.value is None:
        return np.ones(len(batch))
    parts = [votes(shared.value, buf, offs) for _, _, buf, offs in tx.blocks(batch)]
    return np.round(np.concatenate(parts), 9) if parts else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """(key, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, **how))
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    out = arrow_schema(schema)

    def run(batch: pa.RecordBatch):
        s = scores(batch.column(1), shared)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=out)
    return map_batches(docs, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """The documents that reach the threshold, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, **how))
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        return batch.filter(pa.array(scores(batch.column(at), shared) >= threshold))
    return map_batches(docs, run, docs.schema)


def training(labels: DataFrame) -> DataFrame:
    """Rows that labels may be learned from: one id in four is held out."""
    return labels.where(~held_out("doc_id"))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), training(table(spark, sf_dir, "labels")))
    return found.withColumn("held_out", held_out("doc_id"))
