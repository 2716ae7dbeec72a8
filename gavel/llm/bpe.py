"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text falls into pieces (the matches of the pre-token pattern), which are encoded separately, so pieces join by plain
concatenation. Within a piece the encodings of its halves are joined: the last token of the left half and the first
one of the right half stand if encoding the two together gives just these two; otherwise a boundary window of k
tokens on either side is encoded anew, with growing k, until its outermost tokens agree with their outer
neighbours. A token sequence in which every two neighbours stand is the encoding of its bytes, because a merge
across a boundary would already happen between those two alone; so tokens outside the window are proven
stable. Short strings, which the halves of most words are, repeat all the time and are remembered.

Pieces are cut with array operations over code points, equal ones of a block are encoded once, and nothing is
shuffled. Defined results: a null text counts as empty and has no tokens; repeated rows are encoded alike; texts of
any length are encoded whole (one piece of n bytes takes n log n work); an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import types

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gavel.llm import text as tx
from gavel.llm.common import arrow_schema, map_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Remembered strings of a worker; beyond, remembering starts anew.
REMEMBERED = 200_000
#: Bytes up to which a string is merged directly and remembered.
LEAF = 12
#: Bytes up to which every pair is looked at anew after a merge.
SHORT = 24

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_STEALS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def load_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one rank file. Ids are kept as little-endian 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.packed = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        size = max(ranks.values()) + 1
        self.word: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.word[i] = b
        self.longest = max(map(len, ranks))
        self.short: dict[bytes, tuple[bytes, ...]] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, b: bytes) -> tuple[bytes, ...]:
        """Merging by lowest rank, leftmost first."""
        if len(b) > SHORT:
            return self.merge_long(b)
        parts = [b[i: i + 1] for i in range(len(b))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def merge_long(self, b: bytes) -> tuple[bytes, ...]:
        """The same by a heap of neighbouring tokens, in n log n steps."""
        n, ranks, longest = len(b), self.ranks, self.longest
        after = list(range(1, n + 1))  # the start of the next token, for every token's start
        before = list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(b[i: i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i):
            mid = after[i]
            if mid < n and (end := after[mid]) - i <= longest and (r := ranks.get(b[i:end])) is not None:
                heapq.heappush(heap, (r, i, mid, end))
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if after[i] != mid or after[mid] != end:
                continue  # one of the two has changed since
            after[i], after[mid] = end, 0
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(b[i: after[i]])
            i = after[i]
        return tuple(out)

    def tokens(self, b: bytes) -> tuple[bytes, ...] | list[bytes]:
        """The encoding of a byte string: halves, then their join."""
        got = self.short.get(b)
        if got is not None:
            return got
        if len(b) <= 4:
            got = self.merge(b)
        else:
            half = len(b) // 2
            while half > 1 and b[half] & 0xC0 == 0x80:
                half -= 1
            got = self.join(self.tokens(b[:half]), self.tokens(b[half:]))
        if len(b) <= LEAF:
            if len(self.short) >= REMEMBERED:
                self.short.clear()
            self.short[b] = got = tuple(got)
        return got

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        both = a + b
        if len(both) <= LEAF:
            got = self.short.get(both)
            if got is None:
                if len(self.short) >= REMEMBERED:
                    self.short.clear()
                got = self.short[both] = self.merge(both)
        else:
            got = self.merge(both)
        return len(got) == 2 and got[0] == a

    def join(self, left, right) -> list[bytes]:
        if not left or not right:
            return list(left) + list(right)
        if self.stands(left[-1], right[0]):
            return [*left, *right]
        k = 1
        while True:
            low, high = max(0, len(left) - k), min(k, len(right))
            inner = self.merge(b"".join(left[low:]) + b"".join(right[:high]))
            if (low == 0 or self.stands(left[low - 1], inner[0])) and (high == len(right) or self.stands(inner[-1], right[high])):
                return [*left[:low], *inner, *right[high:]]
            k *= 4

    def piece(self, piece: str) -> bytes:
        """Packed ids of one match of the pattern; a whole match in the vocabulary is its own token."""
        got = self.pieces.get(piece)
        if got is None:
            b = piece.encode("utf-8", "replace")
            got = self.packed.get(b)
            if got is None:
                got = b"".join(map(self.packed.__getitem__, self.tokens(b)))
            if len(b) <= 64:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        cuts = piece_starts(*code_points(text))
        ends = [*cuts.tolist()[1:], len(text)]
        return np.frombuffer(b"".join(self.piece(text[s:e]) for s, e in zip(cuts.tolist(), ends)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenation up the tree."""
        if len(ids) > 1 << 16:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.word.__getitem__, ids.tolist()))


def code_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            s, e = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            out[s:e] = kind
    return out


def _kept() -> types.SimpleNamespace:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_gavel_llm_bpe", types.SimpleNamespace(classes=None, codecs={}))


def classes() -> np.ndarray:
    kept = _kept()
    if kept.classes is None:
        kept.classes = code_classes()
    return kept.classes


def code_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.array([0, len(text)])


def piece_starts(code: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where the matches of the pre-token pattern begin, within the texts that ``offs`` delimits.

    A run of letters, of numbers or of other characters is one piece and takes in one space right before it; a run of
    white space without that space is one piece, but its last character stands alone if a text goes on after it
    without taking it in; an apostrophe alone takes in the letters of 's, 't, 're, 've, 'm, 'll and 'd."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[code]
    text_start = np.zeros(n + 1, bool)
    text_start[offs] = True
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    end = np.concatenate((run[1:], [n]))
    run_kind = kind[run]
    follows = np.zeros(len(run), bool)  # a run of the same text follows
    follows[:-1] = ~text_start[run[1:]]
    white = run_kind == SPACE
    # The last white character before more text: a space joins what follows, another one stands alone.
    last = end - 1
    taken = white & follows & (code[last] == 0x20)
    alone = white & follows & ~taken
    start[last[taken | alone]] = True
    start[end[taken]] = False
    # Contractions: one apostrophe that took in no space, letters after it.
    mark = np.flatnonzero((run_kind == OTHER) & (end - run == 1) & (code[run] == 0x27) & follows)
    if len(mark):
        led = np.zeros(len(mark), bool)
        led[mark > 0] = taken[mark[mark > 0] - 1]
        led &= ~text_start[run[mark]]
        mark = mark[~led]
    if len(mark):
        nxt = mark + 1
        at, size = run[nxt], (end - run)[nxt]
        letters = run_kind[nxt] == LETTER
        a, b = code[at], code[np.minimum(at + 1, n - 1)]
        one = letters & np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(mark), bool)
        for x, y in ("re", "ve", "ll"):
            two |= letters & (size > 1) & (a == ord(x)) & (b == ord(y))
        took = np.where(one, 1, np.where(two, 2, 0))
        some = took > 0
        start[at[some]] = False
        rest = at[some] + took[some]
        more = rest < (at + size)[some]
        start[rest[more]] = True
    return np.flatnonzero(start)


def encode_block(codec: Codec, data: bytes, offs: np.ndarray):
    """(packed ids of all pieces in order, ids before each text) of the texts in a block of UTF-8 bytes."""
    whole = data.decode("utf-8", "replace")
    code, _ = code_points(whole)
    # Offsets in code points: bytes that don't continue a character, counted up to each text.
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    at = lead[offs]
    cuts = piece_starts(code, at)
    if not len(cuts):
        return b"", np.zeros(len(offs), np.int64)
    ends = np.concatenate((cuts[1:], [len(code)]))
    # Equal pieces are found by their hash and their length, and encoded once a block.
    up, down = tx._powers(len(code) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(tx.mix(code.astype(np.uint64) + np.uint64(0x51ED2701)) * up[:-1], dtype=np.uint64)))
    key = tx.mix((total[ends] - total[cuts]) * down[cuts] + (ends - cuts).astype(np.uint64))
    _, sample, which = np.unique(key, return_index=True, return_inverse=True)
    piece = codec.piece
    packed = [piece(whole[s:e]) for s, e in zip(cuts[sample].tolist(), ends[sample].tolist())]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    ids = b"".join(map(packed.__getitem__, which.tolist()))
    before = np.concatenate(([0], np.cumsum(sizes[which])))
    return ids, before[np.searchsorted(cuts, at)]


def codec_of(shared) -> Codec:
    """The worker's codec for a broadcast rank file."""
    kept = _kept()
    lines = shared.value
    name = hashlib.sha256(lines).hexdigest() if len(kept.codecs) != 1 or next(iter(kept.codecs))[0] != id(lines) else None
    if name is None:
        return next(iter(kept.codecs.values()))
    for (_, digest), codec in kept.codecs.items():
        if digest == name:
            return codec
    kept.codecs.clear()
    kept.codecs[id(lines), name] = codec = Codec(load_ranks(lines.splitlines()))
    return codec


RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                       T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids as little-endian 32-bit bytes unless left out, digests of the ids and of the bytes that
    they decode to) of every row. ``path`` names a rank file (public_tokenizers' multilingual one by default); its
    size is that of the vocabulary, whatever the documents."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[0], *(f for f in RESULT if ids or f.name != "ids")])
    out = arrow_schema(schema)

    def run(batch: pa.RecordBatch):
        codec = codec_of(shared)
        rows: list[list] = [[], [], [], []]
        for a, b, buf, offs in tx.blocks(batch.column(1)):
            packed, at = encode_block(codec, buf.tobytes(), offs)
            for i in range(b - a):
                own = packed[4 * at[i]: 4 * at[i + 1]]
                decoded = codec.decode(np.frombuffer(own, "<u4"))
                for column, x in zip(rows, (len(own) // 4, own if ids else None, hashlib.sha256(own).hexdigest(), hashlib.sha256(decoded).hexdigest())):
                    column.append(x)
        kept = [rows[0], *([rows[1]] if ids else []), rows[2], rows[3]]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), *(pa.array(x, f.type) for x, f in zip(kept, list(out)[1:]))], schema=out)
    return map_batches(docs, run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), ids=False)
