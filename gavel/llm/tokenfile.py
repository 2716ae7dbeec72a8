"""Token ids in word-aligned files (Simple-8b), written in key order and read back.

Words. A 64-bit word holds a selector in its top four bits and 60 bits of ids below: selector s packs ``COUNTS[s]`` ids of
``BITS[s]`` bits each, the first in the lowest bits. Every id up to 60 bits fits some selector; a longer one takes two
words, an ``ESCAPE`` whose payload is the id's upper bits, then its lower 60 bits under selector ``LAST``. A document
starts a new word and its last words hold exactly what is left, so the selectors alone say how many ids a word has.

Files. A token file is a folder with two Parquet tables. Each row of ``blocks`` is one block: about ``BLOCK_IDS`` ids of
whole documents (a longer document is its own block) as words, the keys of its documents, and for each where its ids
and its words end, so that a whole block, or one document of it, is unpacked with one array operation per selector.
``shards`` says how many ids come before each file. Ids continue from file to file in ascending key order; every
document ends with one ``end`` id.

Spark. Texts are dealt to files by ranges of the key; each task encodes, packs and writes its texts in order, and a sum
over files gives their starts. Spark's own committer writes all files, so a lost executor costs only its tasks.

Encoding is that of the tokenizers library without special tokens. The library splits a text by its pattern and
encodes each piece by itself, so a piece's ids don't depend on its text; here each distinct piece goes to the library
once and a text's ids are put together from them (equal pieces are compared, not only their hashes). Cutting alone costs the
library 320 seconds a GB.

Defined results: a null text counts as empty and has only the end id; rows of one key keep together, ordered by a
hash of their texts, and equal rows are interchangeable; null keys come first; texts of any length are encoded whole; an empty
table gives an empty file; only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

import functools
import hashlib
import os
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.bpe import LETTER, NUMBER, OTHER, SPACE, classes, code_points, piece_starts
from gavel.llm.common import arrow_schema, map_batches, table
from gavel.session import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of texts that a task encodes together, and ids in a block of a file.
TEXT_BYTES = 1 << 20
BLOCK_IDS = 1 << 16
#: Distinct pieces that a worker remembers (about 80 bytes each); beyond, remembering starts anew. And slots of its table.
REMEMBERED = 1_000_000
SLOTS = 1 << 21
#: Words that go to the library as one text.
LOT = 128
#: Fixed values of the coding: ids in a word and bits of each, by selector.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.uint8)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.uint8)
LAST, ESCAPE = 14, 15
_LOW = np.uint64((1 << 60) - 1)


_SHORT = np.maximum(np.ceil(np.log2(np.arange(1, (1 << 16) + 1))), 1).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, one at least."""
    if ids.max() < len(_SHORT):
        return _SHORT[ids]
    return np.searchsorted(np.uint64(1) << np.arange(1, 64, dtype=np.uint64), ids, "right").astype(np.uint8) + 1


def _wider(top: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The widest of the n ids from every place (beyond the end nothing is added). ``top`` has it for 1 and keeps what
    it finds for powers of two."""
    half = 1 << (n.bit_length() - 1)
    while half not in top:
        k = max(top)
        wide = top[k].copy()
        if k < len(wide):
            np.maximum(wide[:-k], top[k][k:], out=wide[:-k])
        top[2 * k] = wide
    if half == n or n - half >= len(top[half]):
        return top[half]
    wide = top[half].copy()
    np.maximum(wide[: half - n], top[half][n - half:], out=wide[: half - n])
    return wide


def pack(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, where each document's words end) of the ids of some documents, whose ids end at ``ends``."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    # The selector of a word that starts at any given id: the one with most ids that fit and end in the document.
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(ids))
    left = np.minimum(left, COUNTS.max()).astype(np.uint8)
    top = {1: _widths(ids)}
    choice = np.full(len(ids), ESCAPE, np.uint8)
    for s in range(LAST, 0, -1):
        fits = (_wider(top, int(COUNTS[s])) <= BITS[s]) & (left >= COUNTS[s])
        if not fits.any():  # nor do more ids in fewer bits
            break
        np.copyto(choice, np.uint8(s), where=fits)
    step = np.maximum(COUNTS, 1)[choice]
    # Following the words from the first id is the one sequential part.
    steps, at, starts = step.tolist(), 0, []
    add, end = starts.append, len(steps)
    while at < end:
        add(at)
        at += steps[at]
    starts = np.array(starts)
    choice = choice[starts]
    long = choice == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(long)  # of a word, the second one of an escaped id
    words = np.zeros(len(starts) + int(long.sum()), np.uint64)
    words[place[long] - 1] = np.uint64(ESCAPE << 60) | (ids[starts[long]] >> np.uint64(60))
    words[place[long]] = np.uint64(LAST << 60) | (ids[starts[long]] & _LOW)
    for s in range(1, ESCAPE):
        mine = choice == s
        if mine.any():
            n, width = int(COUNTS[s]), np.uint64(BITS[s])
            shifted = ids[starts[mine][:, None] + np.arange(n)] << (np.arange(n, dtype=np.uint64) * width)
            words[place[mine]] = np.bitwise_or.reduce(shifted, axis=1) | np.uint64(s << 60)
    before = np.searchsorted(starts, ends)  # words of documents up to each end, without the escapes' first ones
    return words, before + np.concatenate(([0], np.cumsum(long)))[before]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole documents' words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():
        raise ValueError("not a word of a token file")
    counts = COUNTS[selector].astype(np.int64)
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, ESCAPE):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            n, width = int(COUNTS[s]), np.uint64(BITS[s])
            values = (words[mine][:, None] >> (np.arange(n, dtype=np.uint64) * width)) & np.uint64((1 << int(width)) - 1)
            out[at[mine][:, None] + np.arange(n)] = values
    long = np.flatnonzero(selector == ESCAPE)
    out[at[long]] |= (words[long] & _LOW) << np.uint64(60)
    return out


def load(definition: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(definition.decode())
    library.encode_special_tokens = True  # their strings in a text are ordinary text
    return library


@functools.cache
def stand_ins(definition: bytes) -> list[tuple[int, int]]:
    """(code point, one of the class that the library gives it) where the library's Unicode tables class a character
    otherwise than ours do. A character belongs to the class of which it continues a run."""
    split = load(definition).pre_tokenizer.pre_tokenize_str
    runs = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
    out = []
    for lo in range(0, 0x110000, 1 << 15):
        code = np.array([c for c in range(lo, lo + (1 << 15)) if not 0xD800 <= c < 0xE000], np.int64)
        text = "".join(f"a{c}1{c}!{c}" for c in map(chr, code.tolist()))
        cut = np.zeros(len(text) + 1, bool)
        cut[[s for _, (s, _) in split(text)]] = True
        kind = np.full(len(code), SPACE)
        for i, (name, _) in enumerate(runs):
            kind[~cut[2 * i + 1: len(text): 6]] = name
        of = dict(runs) | {SPACE: "\t"}
        out += [(int(c), ord(of[k])) for c, k, ours in zip(code, kind, classes()[code]) if k != ours]
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every place of the stretches that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Rows:
    """A growing array of stretches, such as the ids of every remembered piece."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(data) > len(self.data):
            self.data = np.concatenate((self.data[:self.used], np.zeros(self.used + len(data), self.data.dtype)))
        self.data[self.used:self.used + len(data)] = data
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(data)


class PieceIds:
    """Ids of pieces by the tokenizers library, each distinct piece encoded once while it is remembered.

    Remembered pieces have numbers; a table over the lowest bits of a 64-bit hash leads to the last piece with these
    bits, whose hash, length and characters are then compared."""

    def __init__(self, definition: bytes, others: list[tuple[int, int]]):
        self.library = load(definition)
        self.seen = np.arange(0x110000, dtype=np.uint32)
        for code, stand_in in others:
            self.seen[code] = stand_in
        self.forget()

    def forget(self) -> None:
        self.number = np.full(SLOTS, -1, np.int32)
        self.key = np.zeros(SLOTS, np.uint64)
        self.chars, self.ids = Rows(np.uint32), Rows(np.uint32)

    def encode(self, whole: str, kinds: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Have the library encode some different pieces, and remember them."""
        # Words behind a space are cut again as they were when they follow each other, so many go as one text.
        ones = stops - starts
        plain = (ones > 1) & (kinds[starts] == SPACE) & (kinds[np.minimum(starts + 1, len(kinds) - 1)] == LETTER)
        pieces = [whole[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        words = int(plain.sum())
        lots = [order[i:min(i + LOT, words)].tolist() for i in range(0, words, LOT)]
        got = self.library.encode_batch(["".join(map(pieces.__getitem__, lot)) for lot in lots], add_special_tokens=False)
        if words < len(order):
            lots.append(order[words:].tolist())
            got.append(self.library.encode(list(map(pieces.__getitem__, lots[-1])), is_pretokenized=True, add_special_tokens=False))
        sizes = np.concatenate([np.bincount(g.word_ids, minlength=len(lot)) for g, lot in zip(got, lots)])
        rows = Rows(np.uint32)
        rows.add(np.concatenate([np.array(g.ids, np.uint32) for g in got]), sizes)
        back = np.argsort(order)
        self.ids.add(rows.data[_spread(rows.starts[back], sizes[back])], sizes[back])

    def __call__(self, whole: str, code: np.ndarray, kinds: np.ndarray, cuts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of every piece of a text, known or new."""
        if len(self.ids.sizes) > REMEMBERED:
            self.forget()
        size = stops - cuts
        key = _piece_hashes(code, cuts, stops)
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        number = np.where(self.key[slot] == key, self.number[slot], -1)
        # The pieces follow each other, so each character has a place in the remembered piece that it is compared with.
        at = self.chars.starts[number] - cuts if len(self.chars.starts) else np.zeros(len(cuts), np.int64)
        fits = (number >= 0) & (self.chars.sizes[number] == size) if len(self.chars.sizes) else np.zeros(len(cuts), bool)
        at[~fits] = -cuts[~fits]
        place = np.repeat(at, size) + np.arange(len(code))
        if size.max() > len(self.chars.data):  # an unknown piece longer than all that is remembered
            place = np.minimum(place, len(self.chars.data) - 1)
        same = self.chars.data[place] == code
        number[~(fits & np.logical_and.reduceat(same, cuts))] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            sample, which = distinct_pieces(code, cuts[new], stops[new], key[new])
            first = new[sample]
            base = len(self.chars.sizes)
            self.encode(whole, kinds, cuts[first], stops[first])
            self.chars.add(code[_spread(cuts[first], size[first])], size[first])
            number[new] = base + which
            self.number[slot[first]] = base + np.arange(len(first))
            self.key[slot[first]] = key[first[self.number[slot[first]] - base]]  # one piece of several with one slot
        return number


def _piece_hashes(code: np.ndarray, cuts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    up, down = tx._powers(len(code) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(tx.mix(code.astype(np.uint64) + np.uint64(0x51ED2701)) * up[:-1], dtype=np.uint64)))
    return tx.mix((total[stops] - total[cuts]) * down[cuts] + (stops - cuts).astype(np.uint64))


def distinct_pieces(code: np.ndarray, cuts: np.ndarray, stops: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a piece of each distinct kind, the kind of every piece), by hashes and then by their characters."""
    size = stops - cuts
    _, sample, which = np.unique(key, return_index=True, return_inverse=True)
    if (size[sample][which] == size).all() and (code[_spread(cuts[sample][which], size)] == code[_spread(cuts, size)]).all():
        return sample, which
    kinds: dict[bytes, int] = {}
    first = []
    which = np.zeros(len(cuts), np.int64)
    for i, (s, e) in enumerate(zip(cuts.tolist(), stops.tolist())):
        k = kinds.setdefault(code[s:e].tobytes(), len(first))
        if k == len(first):
            first.append(i)
        which[i] = k
    return np.array(first), which


def encode_texts(library: PieceIds, data: bytes, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each text's ids end) of the texts in a block of UTF-8 bytes, each with the end id."""
    whole = data.decode("utf-8", "replace")
    code, _ = code_points(whole)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    at = lead[offs]
    seen = library.seen[code]
    cuts = piece_starts(seen, at)
    if len(cuts):
        number = library(whole, code, classes()[seen], cuts, np.concatenate((cuts[1:], [len(code)])))
        sizes = library.ids.sizes[number]
        ids = library.ids.data[_spread(library.ids.starts[number], sizes)]
        before = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(cuts, at[1:])]
    else:
        ids, before = np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
    ends = before + np.arange(1, len(before) + 1)
    out = np.full(len(ids) + len(before), end, np.uint32)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


def _library(shared) -> PieceIds:
    """The worker's library for a broadcast definition."""
    kept = sys.modules.setdefault("_gavel_llm_tokenfile", types.SimpleNamespace(by_digest={}, last=(None, None)))
    value = shared.value
    if kept.last[0] is not value:
        digest = hashlib.sha256(value[0]).hexdigest()
        if digest not in kept.by_digest:
            kept.by_digest.clear()
            kept.by_digest[digest] = PieceIds(*value)
        kept.last = (value, kept.by_digest[digest])
    return kept.last[1]


def _block_schema(key: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType([T.StructField("shard", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()),
                         T.StructField("keys", T.ArrayType(key)), T.StructField("id_ends", longs), T.StructField("word_ends", longs),
                         T.StructField("words", T.BinaryType())])


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> None:
    """Write the token file of a table of texts into ``folder``, which all executors share. ``path`` names a definition
    of the tokenizers library, whose size is that of the vocabulary."""
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast((definition, stand_ins(definition)))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.length("text")]
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _block_schema(docs.schema["key"].dataType)
    out = arrow_schema(schema)

    def run(batches):
        library, shard, before = _library(shared), TaskContext.get().partitionId(), 0
        keys, counts, rows, size = [], [], [], 0

        def block():
            nonlocal before, size
            row = [shard, before, size, list(keys), np.cumsum(counts).tolist(), np.cumsum([len(w) // 8 for w in rows]).tolist(), b"".join(rows)]
            before, size = before + size, 0
            for held in (keys, counts, rows):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)
        for batch in batches:
            for a, b, buf, offs in tx.blocks(batch.column(1), TEXT_BYTES):
                ids, ends = encode_texts(library, buf.tobytes(), offs, end)
                words, stops = pack(ids, ends)
                data, stops = words.astype("<u8").tobytes(), (8 * stops).tolist()
                for k, n, s, e in zip(batch.column(0)[a:b].to_pylist(), np.diff(ends, prepend=0).tolist(), [0, *stops], stops):
                    if keys and size + n > BLOCK_IDS:
                        yield block()
                    keys.append(k)
                    counts.append(n)
                    rows.append(data[s:e])
                    size += n
        if keys:
            yield block()
    # The words are as dense as they get.
    ranged.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    sums = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One small row a file.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start")).write.parquet(f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every document of a token file: how many ids come before it, how many it has and
    the ids as little-endian unsigned 32-bit integers."""
    blocks, shards = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/shards")
    # The sizes of both tables are known, so Spark copies the few rows of shards to all tasks as long as they are few.
    blocks = blocks.join(shards, "shard").select((F.col("start") + F.col("before")).alias("start"), "keys", "id_ends", "words")
    element = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, element), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batch: pa.RecordBatch):
        for start, keys, ends, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            data = unpack(np.frombuffer(words.as_buffer(), "<u8")).astype("<u4").tobytes()
            ends = np.array(ends.values)
            begins = np.concatenate(([0], ends[:-1]))
            ids = pa.array([data[4 * s:4 * e] for s, e in zip(begins.tolist(), ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([keys.values.cast(out[0].type), pa.array(start + begins), pa.array(ends - begins), ids], schema=out)
    return map_batches(blocks, run, schema)


def fresh_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"


def op11_tokenfile(spark, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
