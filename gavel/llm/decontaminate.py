"""Benchmark decontamination by suffix arrays.

A shard is a stretch of about ``SHARD_BYTES`` of whole training texts in one task. Its suffix array orders the suffixes
of its words in full, and every suffix of a test item is searched in it by bisection: the range of suffixes that share
the item's window gives every place of that window, and windows that follow each other on one diagonal are one longest
verbatim match. Two words can only stand in a match if some test item has them side by side, so only runs of such words
get into the array (a sparse suffix array): no match is lost and most of a training text is never sorted. Words are
compared by 64-bit hashes; what matches is compared again by its bytes.

Spark. Tasks cut the test items into words and write them as blocks into the shared checkpoint folder; the driver only
hands the blocks on, at most ``PASS_BYTES`` of them at a time. Training texts are read in one narrow pass for that many
bytes of blocks and nothing is shuffled; a larger test set takes one more pass for every further ``PASS_BYTES``, between
which the table is written with the matches so far.

Defined results: a null or wordless text has no words and stays; a null or wordless item matches nothing; repeated
items and repeated rows are each judged alone; an empty test set leaves every document; texts of any length are searched
whole; ties (a place that several items hold) count for each item; columns of the input that share a name with a result
column are left out of ``find_matches`` and kept as they are by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.common import arrow_schema, saved, table

WINDOW_WORDS = 13
#: Bytes of test texts in a block, and of blocks that travel at a time.
BLOCK_BYTES = 8 << 20
PASS_BYTES = 64 << 20
#: A shard ends with the text that reaches this many bytes, or this many words in the array.
SHARD_BYTES = 32 << 20
SHARD_WORDS = 1 << 20
#: Matches that are put together at a time.
HITS = 1 << 22
#: A document is contaminated from this many hit words in 100.
HIT_PERCENT = 5

MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()),
    T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()), T.StructField("matches", T.ArrayType(MATCH))])
#: A block of test items: ids, where each item's words begin, and the words as hashes, sizes and bytes.
BLOCK = T.StructType([T.StructField("ids", T.ArrayType(T.StringType()))] + [
    T.StructField(name, T.BinaryType()) for name in ("first", "hashes", "sizes", "chars")])


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every place of the stretches that begin at ``starts``."""
    return np.repeat(starts, sizes) + _within(sizes)


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def block_rows(ids: list, column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[list]:
    """Rows of BLOCK of some test items."""
    for a, b, buf, offs in tx.blocks(column, size):
        buf = tx.LOWER[buf]
        starts, ends, first = tx.spans(buf, offs, tx.ALNUM_WORD)
        yield [ids[a:b], first.astype("<i8").tobytes(), tx.span_hashes(buf, starts, ends).astype("<u8").tobytes(),
               (ends - starts).astype("<i8").tobytes(), buf[_spread(starts, ends - starts)].tobytes()]


class Sieve:
    """Membership in a set of hashes: a small table answers most of what is not in it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(44)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[self._slot(hashes)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = self.hashes[place] == hashes[at]
        return out


class Block:
    """A block of test items as a task searches with it."""

    def __init__(self, row, window: int):
        self.ids, (first, hashes, sizes, chars) = row[0], row[1:]
        self.first, self.hashes = np.frombuffer(first, "<i8"), np.frombuffer(hashes, "<u8")
        self.sizes, self.chars = np.frombuffer(sizes, "<i8"), np.frombuffer(chars, np.uint8)
        self.begin = _before(self.sizes)
        length = np.diff(self.first)
        #: Words of each item's windows, and the suffixes (item, first word) that start with a whole window.
        self.size = np.minimum(length, window)
        count = np.where(length > 0, length - self.size + 1, 0)
        self.item, self.at = np.repeat(np.arange(len(length)), count), _spread(self.first[:-1], count)
        inside = np.ones(max(len(self.hashes) - 1, 0), bool)
        ends = self.first[1:-1]
        inside[ends[(ends > 0) & (ends <= len(inside))] - 1] = False
        self.pairs = Sieve(tx.chain(self.hashes, 2)[inside])
        self.lone = Sieve(self.hashes[np.repeat(self.size == 1, length)])
        self.least = int(self.size[self.size > 1].min(initial=max(window, 2)))


class Shard:
    """Runs of words of some texts that may match, and their suffix array."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.least = min((b.least for b in blocks), default=2)
        self.n_words: list[np.ndarray] = []
        self.parts: list[tuple] = []
        self.texts = self.bytes = self.words = 0

    def add(self, column: pa.Array) -> None:
        for a, b, buf, offs in tx.blocks(column):
            buf = tx.LOWER[buf]
            starts, ends, first = tx.spans(buf, offs, tx.ALNUM_WORD)
            hashes = tx.span_hashes(buf, starts, ends)
            keep, left = self.runs(hashes, first)
            at = np.flatnonzero(keep)
            sizes = (ends - starts)[at]
            text = np.searchsorted(first, at, "right") - 1
            self.parts.append((hashes[at], left[at], self.texts + text, at - first[text], sizes, buf[_spread(starts[at], sizes)]))
            self.n_words.append(np.diff(first))
            self.texts += b - a
            self.bytes += len(buf)
            self.words += len(at)

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a word is in a run that may hold a match, how many words are left of its run)."""
        n = len(hashes)
        # Whether the word before a place stands before it in a test item too.
        linked = np.zeros(n + 1, bool)
        lone = np.zeros(n, bool)
        pairs = tx.chain(hashes, 2)
        for block in self.blocks:
            if n > 1:
                linked[1:-1] |= block.pairs(pairs)
            if len(block.lone.hashes):
                lone |= block.lone(hashes)
        linked[first] = False
        edge = np.flatnonzero(~linked)  # where a run begins, and the end
        size = np.diff(edge)
        left = np.repeat(edge[1:], size) - np.arange(n)
        return np.repeat(size >= self.least, size) | lone, left

    @property
    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.words >= SHARD_WORDS

    def build(self) -> None:
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        self.hashes, self.left, self.text, self.word, self.sizes, self.chars = columns
        self.begin = _before(self.sizes)
        # A run kept for a lone word alone may lack its other words.
        follows = np.zeros(len(self.left) + 1, bool)
        follows[1:-1] = (self.text[1:] == self.text[:-1]) & (self.word[1:] == self.word[:-1] + 1)
        edge = np.flatnonzero(~follows)
        self.left = np.minimum(self.left, np.repeat(edge[1:], np.diff(edge)) - np.arange(len(self.left)))
        self.array = suffix_array(self.hashes, self.left)

    def search(self) -> list[list[tuple]]:
        """For each text its longest matches: (item id, word of the text, word of the item, words)."""
        out: list[list[tuple]] = [[] for _ in range(self.texts)]
        if self.words:
            self.build()
            for block in self.blocks:
                for place, item, at, length in self.matches(block):
                    for p, i, w, m in zip(place.tolist(), item.tolist(), (at - block.first[item]).tolist(), length.tolist()):
                        out[self.text[p]].append((block.ids[i], int(self.word[p]), w, m))
        return out

    def matches(self, block: Block) -> Iterator[tuple]:
        """Longest matches with a block's items: place in the shard, item, word of the block and length arrays."""
        size = block.size[block.item]
        low = self.bisect(block, size, False)
        found = np.flatnonzero(low < len(self.array))
        found = found[self.order(self.array[low[found]], block, block.at[found], size[found]) == 0]
        times = np.zeros(len(low), np.int64)
        times[found] = self.bisect(block, size, True, found) - low[found]
        # Whole items at a time, since a diagonal stays in one.
        total = np.cumsum(np.bincount(block.item, times, len(block.size)).astype(np.int64))
        a = 0
        while a < len(total):
            held = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, held + HITS, "right")))
            mine = found[(block.item[found] >= a) & (block.item[found] < b)]
            if len(mine):
                place = self.array[_spread(low[mine], times[mine])]
                yield from self.same_bytes(block, *self.joined(block, place, np.repeat(mine, times[mine])))
            a = b

    def order(self, place: np.ndarray, block: Block, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the shard's suffix comes before, starts with or comes after the item's window."""
        out = np.zeros(len(place), np.int8)
        todo = np.arange(len(place))
        for k in range(int(size.max(initial=0))):
            todo = todo[size[todo] > k]
            ended = self.left[place[todo]] <= k
            out[todo[ended]] = -1
            todo = todo[~ended]
            if not len(todo):
                break
            ours, theirs = self.hashes[place[todo] + k], block.hashes[at[todo] + k]
            out[todo[ours < theirs]] = -1
            out[todo[ours > theirs]] = 1
            todo = todo[ours == theirs]
        return out

    def bisect(self, block: Block, size: np.ndarray, after: bool, which: np.ndarray | None = None) -> np.ndarray:
        """The first place in the array whose suffix does not come before the window, or with ``after`` comes after it."""
        at = block.at if which is None else block.at[which]
        size = size if which is None else size[which]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.array))
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) >> 1
            up = self.order(self.array[middle], block, at[todo], size[todo]) < int(after)
            low[todo[up]] = middle[up] + 1
            high[todo[~up]] = middle[~up]
        return low

    def joined(self, block: Block, place: np.ndarray, suffix: np.ndarray) -> tuple:
        """Windows that follow each other on one diagonal become one match."""
        item, at = block.item[suffix], block.at[suffix]
        run = place + self.left[place]  # no match goes beyond a run
        order = np.lexsort((place, place - at, item))
        place, item, at, run = place[order], item[order], at[order], run[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1) | (item[1:] != item[:-1]) | (run[1:] != run[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate((begin, [len(place)])))
        return place[begin], item[begin], at[begin], count + block.size[item[begin]] - 1

    def same_bytes(self, block: Block, place: np.ndarray, item: np.ndarray, at: np.ndarray, length: np.ndarray) -> Iterator[tuple]:
        """The matches whose words are equal by their bytes; one that holds a word of equal hash only is cut there."""
        ours, theirs = _spread(place, length), _spread(at, length)
        same = self.sizes[ours] == block.sizes[theirs]
        alike = np.flatnonzero(same)
        n = self.sizes[ours[alike]]
        equal = self.chars[_spread(self.begin[ours[alike]], n)] == block.chars[_spread(block.begin[theirs[alike]], n)]
        same[alike] = np.logical_and.reduceat(equal, _before(n)) if len(n) else False
        if not same.all():
            own = np.repeat(np.arange(len(length)), length)
            old = np.zeros(len(same) + 1, bool)
            old[1:-1] = same[:-1] & (own[1:] == own[:-1])
            begin = np.flatnonzero(same & ~old[:-1])
            after = np.ones(len(same), bool)
            after[:-1] = ~(same[1:] & (own[1:] == own[:-1]))
            count = np.flatnonzero(same & after) + 1 - begin
            place, at, item, length = ours[begin], theirs[begin], item[own[begin]], count
            whole = length >= block.size[item]
            place, at, item, length = place[whole], at[whole], item[whole], length[whole]
        yield place, item, at, length


def suffix_array(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling; ``left`` words remain from a place to the end of its run,
    and a suffix that ends comes first. Suffixes of equal words keep the order of their places."""
    _, rank = np.unique(words, return_inverse=True)
    n, step = len(words), 1
    longest = int(left.max(initial=0))
    while step < longest and (rank.max(initial=0) + 1 < n):
        ahead = np.zeros(n, np.int64)
        more = np.flatnonzero(left > step)
        ahead[more] = rank[more + step] + 1
        _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def verdict(n_words: int, matches: list[tuple]) -> list:
    """A row of RESULT."""
    matches = sorted(matches, key=lambda m: (m[1], str(m[0]), m[2]))
    n_hit = end = 0
    for _, word, _, length in matches:
        n_hit += max(0, word + length - max(word, end))
        end = max(end, word + length)
    items = sorted({str(m[0]) for m in matches})
    return [n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
            n_hit > 0 and 100 * n_hit >= HIT_PERCENT * n_words, matches]


def judge(column: pa.Array, blocks: list[Block]) -> list[list]:
    """Rows of RESULT for each text of a column, as one shard."""
    shard = Shard(blocks)
    shard.add(column)
    n_words = np.concatenate([np.zeros(0, np.int64), *shard.n_words]).tolist()
    return [verdict(n, own) for n, own in zip(n_words, shard.search())]


def test_passes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                pass_bytes: int = PASS_BYTES) -> Iterator[list]:
    """Rows of BLOCK that travel together; at most ``pass_bytes`` of them, or one block, are on the driver."""
    out = arrow_schema(BLOCK)

    def run(batches):
        for batch in batches:
            for row in block_rows(batch.column(0).to_pylist(), batch.column(1), block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)
    items = benchmark.select(F.col(item_id).cast("string"), F.col(text))
    held, size = [], 0
    for row in saved(items.mapInArrow(run, BLOCK)).toLocalIterator():
        n = sum(len(x) for x in row[1:]) + sum(len(x or "") for x in row[0])
        if held and size + n > pass_bytes:
            yield held
            held, size = [], 0
        held.append(tuple(row))
        size += n
    yield held


def _passes(docs: DataFrame, at: int, benchmark: DataFrame, window: int, finish: Callable, schema: T.StructType, **index) -> DataFrame:
    """``finish(batch, rows of RESULT)`` of every batch of ``docs``, after all passes of the test set."""
    sc = docs.sparkSession.sparkContext
    width = len(docs.columns)
    carried = "matches"
    while carried in docs.columns:
        carried += "_"
    between = T.StructType([*docs.schema.fields, T.StructField(carried, T.ArrayType(MATCH))])

    def step(blocks: list, last: bool) -> DataFrame:
        shared = sc.broadcast(blocks)

        def flush(shard, held):
            found, row = shard.search(), 0
            n_words = np.concatenate([np.zeros(0, np.int64), *shard.n_words]).tolist()
            for batch in held:
                n = batch.num_rows
                own = found[row:row + n]
                if batch.num_columns > width:
                    earlier = batch.column(width).to_pylist()
                    own = [[tuple(m.values()) for m in old] + new for old, new in zip(earlier, own)]
                if last:
                    rows = [verdict(w, x) for w, x in zip(n_words[row:row + n], own)]
                    yield finish(pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]), rows)
                else:
                    matches = pa.array([[dict(zip(MATCH.names, m)) for m in x] for x in own], arrow_schema(between)[width].type)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], matches], schema=arrow_schema(between))
                row += n

        def run(batches):
            tests = [Block(b, window) for b in shared.value]
            shard, held = Shard(tests), []
            for batch in batches:
                shard.add(batch.column(at))
                held.append(batch)
                if shard.full:
                    yield from flush(shard, held)
                    shard, held = Shard(tests), []
            if held:
                yield from flush(shard, held)
        out = docs.mapInArrow(run, schema if last else between)
        if not last:
            out = saved(out)
            shared.destroy()
        return out
    blocks = None
    for following in test_passes(benchmark, **index):
        if blocks is not None:
            docs = step(blocks, False)
        blocks = following
    return step(blocks, True)


def find_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, **index) -> DataFrame:
    """One row per document: its key, counts, verdict, and every longest match with its places."""
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[0], *RESULT.fields])
    out = arrow_schema(schema)

    def finish(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*rows)] or [[] for _ in RESULT.fields]
        columns[-1] = [[dict(zip(MATCH.names, m)) for m in own] for own in columns[-1]]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), *(pa.array(x, f.type) for x, f in zip(columns, list(out)[1:]))], schema=out)
    return _passes(docs, 1, benchmark, window, finish, schema, **index)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW_WORDS, **index) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    def finish(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not row[4] for row in rows], pa.bool_()))
    return _passes(docs, docs.columns.index(text), benchmark, window, finish, docs.schema, **index)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), {WINDOW_WORDS}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW_WORDS}) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, h.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM di) h JOIN bw USING (n, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 100 * coalesce(n_hit, 0) >= {HIT_PERCENT} * len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
