"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint holds the majority bits of the XXH64 of a text's word shingles. Equal fingerprints meet in a plain
aggregate; different ones are linked through 32-bit keys: of four 16-bit quarters two agree whenever at most two
bits differ, so six tables of keys bring every link's ends together. Within a key the fingerprints stand in Gray
order, neighbours share most bits, and each node above them keeps the bits that all of its members share (a mask
and a pattern). The join walks pairs of nodes downwards and drops a pair, with everything below, once the
shared bits alone differ too often. Keys with many fingerprints are dealt again by 16 further bits, after which a
group has 65,536 members at most; none is capped. A group yields a star of links instead of all its pairs, and
large-star/small-star rounds in shared storage turn links into components.

Defined results: a null or wordless text has fingerprint zero and links like any other; repeated rows and ids meet
in the same component; a component without any non-null id has a null component id; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.common import arrow_schema, map_batches, saved, table

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: A key with more fingerprints is dealt again by further bits.
SPLIT_ROWS = 4096
#: Fingerprints indexed together; several small groups share an index, a group is never cut.
INDEX_ROWS = 1 << 16
FANOUT = 8
PAIRS_AT_ONCE = 1 << 18

QUARTERS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and where each text's shingles begin."""
    starts, ends, first = tx.spans(buf, offs, tx.WS_WORD)
    sizes = ends - starts
    spaced = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    kept = tx.LOWER[buf[tx.WS_WORD[buf]]]
    spaced[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = kept
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    low = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    high = np.minimum(low + words, np.repeat(first[1:], count)) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(begin[low].tolist(), (begin + sizes)[high].tolist())),
                         np.uint64, int(at[-1]))
    return hashes, at


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes; zero for a text that has none."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # Eight bit counters share a 64-bit word, so at most 255 hashes are summed before they are spread.
    pieces = (n[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), pieces)
    cut = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    piece = at[full][owner] + 255 * (np.arange(len(owner)) - cut[owner])
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), piece)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), cut, axis=0)
        for lane in range(8):
            out[full] |= (2 * counts[:, lane] > n[full]).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fingerprint as a signed long) of every row."""
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[0], T.StructField("fp", T.LongType())])
    out = arrow_schema(schema)

    def run(batch: pa.RecordBatch):
        parts = [majority(*shingle_hashes(buf, offs, words)) for _, _, buf, offs in tx.blocks(batch.column(1))]
        fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), pa.array(fp.view(np.int64))], schema=out)
    return map_batches(docs, run, schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the Gray code's order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


class GrayIndex:
    """Fingerprints in Gray order within their groups, under nodes that keep the bits all members share."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.fp, self.group = fp[order], group[order]
        full = np.full(len(fp), ~np.uint64(0))
        self.levels = [(self.fp, full, self.group, self.group)]  # pattern, mask, first and last group
        while len(self.levels[-1][0]) > FANOUT:
            pattern, mask, low, high = self.levels[-1]
            cut = np.arange(0, len(pattern), FANOUT)
            every = np.bitwise_and.reduceat(pattern, cut)
            some = np.bitwise_or.reduceat(pattern, cut)
            self.levels.append((every, np.bitwise_and.reduceat(mask, cut) & ~(every ^ some), low[cut],
                                high[np.minimum(cut + FANOUT, len(pattern)) - 1]))

    def links(self, bits: int):
        """Arrays of places (i, j), i < j, in one group and at most ``bits`` apart."""
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            pattern, mask, low, high = self.levels[level]
            near = high[a] >= low[b]
            a, b = a[near], b[near]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level == 0:
                keep = (a < b) & (self.group[a] == self.group[b])
                yield a[keep], b[keep]
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            a = (a[:, None, None] * FANOUT + step[:, None] + 0 * step).reshape(-1)
            b = (b[:, None, None] * FANOUT + step + 0 * step[:, None]).reshape(-1)
            keep = (a <= b) & (b < below)
            stack.append((level - 1, a[keep], b[keep]))


def stars(n: int, links) -> np.ndarray:
    """The smallest place reachable from each place."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _quarter(column, which: int, width: int = 16):
    return F.shiftrightunsigned(column, which * width).bitwiseAND((1 << width) - 1)


def _keys(base, pairs: int, width: int):
    """An array of (table, key) for two of four ``width``-bit parts of a column."""
    return F.array(*[F.struct(F.lit(t).alias("t"), F.shiftleft(_quarter(base, a, width), width)
                              .bitwiseOR(_quarter(base, b, width)).alias("k")) for t, (a, b) in enumerate(QUARTERS[:pairs])])


def _rest(fp, t):
    """The 32 bits of a fingerprint outside the two quarters of table ``t``."""
    out = F.lit(None).cast("long")
    for number, pair in enumerate(QUARTERS):
        c, d = (x for x in range(4) if x not in pair)
        out = F.when(t == number, F.shiftleft(_quarter(fp, c), 16).bitwiseOR(_quarter(fp, d))).otherwise(out)
    return out


def group_links(keyed: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) as stars per group of equal (t, k)."""
    parts = keyed.repartition("t", "k").sortWithinPartitions("t", "k")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    out = arrow_schema(schema)

    def emit(t, k, fp):
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new)
        shared = np.bincount(group)[group] > 1
        if not shared.any():
            return None
        index = GrayIndex(group[shared], fp[shared].view(np.uint64))
        root = stars(len(index.fp), index.links(bits))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(index.fp[x].view(np.int64)) for x in (moved, root[moved])], schema=out)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, batch.column(c).to_numpy())) for c, h in zip("tkf", held)]
            if len(held[0]) < INDEX_ROWS:
                continue
            t, k, _ = held
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]))
            if len(new):
                end = int(new[-1]) + 1
                if (got := emit(*(x[:end] for x in held))) is not None:
                    yield got
                held = [x[end:] for x in held]
        if len(held[0]) and (got := emit(*held)) is not None:
            yield got
    return parts.select(F.col("t").cast("long"), F.col("k").cast("long"), F.col("fp").alias("f")).mapInArrow(run, schema)


def links(distinct: DataFrame, bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Links between different fingerprints at most ``bits`` (up to 2) apart, as stars."""
    if not 0 <= bits <= 2:
        raise ValueError("two of four quarters agree for up to two differing bits only")
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), 6, 16)).alias("x")).select("x.t", "x.k", "fp")
    keyed = saved(keyed)
    size = keyed.groupBy("t", "k").count()
    hot = saved(size.where(F.col("count") > split_rows).select("t", "k"))
    shared = size.where((F.col("count") > 1) & (F.col("count") <= split_rows)).select("t", "k")
    out = group_links(keyed.join(shared, ["t", "k"]), bits)
    again = keyed.join(hot, ["t", "k"]).select(
        "t", "k", "fp", F.explode(_keys(_rest(F.col("fp"), F.col("t")), 6, 8)).alias("x"))
    again = again.select((F.col("t") * 6 + F.col("x.t")).alias("t"),
                         F.shiftleft(F.col("k"), 16).bitwiseOR(F.col("x.k")).alias("k"), "fp")
    return out.unionByName(group_links(again, bits))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (u, v), by large-star and small-star rounds."""
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _tangled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
                      .where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one: no plain stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    ends = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return bool(ends.where("low > 1 or low + high > 1").head(1))


def named_components(prints: DataFrame, key: str, bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(fp, root, component_id) of every different fingerprint: the smallest fingerprint and key reachable over links."""
    distinct = saved(prints.groupBy("fp").agg(F.min(key).alias("least")))
    rooted = distinct.join(components(links(distinct, bits, split_rows)), F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(rooted.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row per document: key, ``fp`` and ``component_id``, the smallest key reachable over links."""
    prints = saved(fingerprints(docs, key, text, words))
    return prints.join(named_components(prints, key, bits, split_rows), "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
               bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One document of each component, the one with the smallest id; of a component's rows that share this id, or of
    one without any id, the first by all columns."""
    order = docs.columns
    prints = saved(fingerprints(docs, key, text, words))
    named = named_components(prints, key, bits, split_rows)
    first = prints.join(named, "fp").where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(key).agg(F.count("*").alias("n"))
    first = saved(first)
    # Most documents stay, so the ids to keep grow with the documents: a shuffle join at every size.
    kept = docs.join(first.where("n = 1").select(key).hint("merge"), key, "left_semi").select(order)
    shared = first.where(F.col(key).isNull() | (F.col("n") > 1)).select(F.col(key).alias("__key"))
    if shared.head(1):
        # Ids that several rows share, and rows without one: told apart by their components.
        rows = docs.join(shared, F.col(key).eqNullSafe(F.col("__key")), "left_semi").withColumn("__row", F.xxhash64(*order))
        own = fingerprints(rows, "__row", text, words).distinct().join(named, "fp").select("__row", "root", F.col("component_id").alias("__id"))
        rows = rows.join(own, "__row").where(F.col(key).eqNullSafe(F.col("__id")))
        one = rows.groupBy(F.col(key).alias("__key"), "root").agg(F.min(F.struct(*order)).alias("__first"))
        kept = kept.unionByName(one.select("__first.*"))
    return kept


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
