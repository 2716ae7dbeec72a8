"""Spelling variants: words at one edit from each other, by dynamic programming over sorted lists.

Words are runs of letters of the texts; a fixed share of the runs, chosen by a checksum, loses a character first, so that
every corpus has variants to find. Two words are near if one inserted, deleted or replaced character makes
one the other. A word's form is its most frequent near word, if that is at least twice as frequent; its root is
where following forms ends.

Scan. The edit matrix of a query against a sorted list of words is filled row by row, a row for each character of a list
word, and only in the band of cells next to the diagonal that one edit can reach. A word's rows up to the length
of its common prefix with the word before it (LCP) are those of the words before, so words that share a prefix
share its rows: the rows at one depth stand for ranges of the list, cut where an LCP is shorter than the depth. A range
whose row has no cell of at most one edit is skipped with all its words. All queries of a list go down one depth at a
time, so a row step is a few array operations over all (query, range) states.

Spark. One edit leaves the first or the last half of a word as it is (of two words, half the length of the shorter one).
So words are dealt to lists of equal length class and equal first half, and, read backwards, to lists of equal last half;
a pair that shares both is taken from the first. A query in a list is compared with the whole list, but lists are
short, and the queries of a long one are dealt to several tasks. Only each word's number of near words and its best one
leave a task. Words are counted with partial counts; forms are followed by doubling, at most six joins.

Defined results: a null text has no words; a null id counts as the empty text in the checksum; repeated rows count
each; words of any length are compared whole; of equally frequent near words the first in code-point order is the
form; an empty table gives no rows; only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.common import arrow_schema, saved, table

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a character; words have so many characters and occurrences at least; a form is so many
#: times as frequent as its variants.
LOSS, SHORTEST, OCCURRENCES, TIMES = 97, 5, 3, 2
#: Queries of one list that go to one task.
QUERIES = 20_000
#: List words that a task takes up at a time (a longer list is taken whole), and queries that go down together.
LOT, ABREAST = 1 << 16, 1 << 13

FOUND = "word string, near long, best_n long, best string"


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", loss: int = LOSS, shortest: int = SHORTEST,
               occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({LETTERS})"), F.lit(1))
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).where(F.length("run") >= shortest)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    found = found.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = found.select(F.when(F.pmod(F.col("h"), F.lit(loss)) == 0, lost).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def lists(words: DataFrame, shortest: int = SHORTEST, queries: int = QUERIES) -> DataFrame:
    """Every word in its lists: of the class of its own length and of one less, by its first and by its last half."""
    size = F.length("word")
    classes = F.when(size > shortest, F.array(size - 1, size)).otherwise(F.array(size))
    rows = words.select("word", "n", F.explode(classes).alias("class"))
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = _div(F.col("class"), 2)
    rows = rows.select("class", "back", "word", "n",
                       F.when(F.col("back"), F.substring("word", size - half + 1, half)).otherwise(F.substring("word", F.lit(1), half)).alias("half"),
                       F.when(F.col("back"), F.reverse(F.substring("word", F.lit(1), size - half))).otherwise(F.substring("word", half + 1, size)).alias("rest"))
    of = ["class", "back", "half"]
    long = saved(rows.groupBy(*of).agg(F.count("*").alias("m")).where(F.col("m") > queries).select(*of, _div(F.col("m") + queries - 1, queries).alias("parts")))
    if not long.head(1):
        return rows.select(*of, F.lit(0).alias("part"), F.lit(True).alias("asks"), "rest", "word", "n")
    rows = rows.join(long, of, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.select(*of, "part", (F.pmod(F.xxhash64("word"), F.col("parts")) == F.col("part")).alias("asks"), "rest", "word", "n")


def _codes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points of texts of at most ``width`` characters, filled up with zeros; their lengths)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), width + 2), np.uint32)
    out[np.arange(width + 2) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return out, sizes


def scan(code: np.ndarray, sizes: np.ndarray, group: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, list word) pairs at exactly one edit. The words of each group are sorted and follow each other; ``asks``
    says which of them are queries."""
    n, width = len(code), code.shape[1] - 2
    lcp = np.full(n, -1)  # with the word before; below 0 where a group begins
    if n > 1:
        same = code[1:] == code[:-1]
        joint = np.where(same.all(axis=1), width, same.argmin(axis=1))
        lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(joint, np.minimum(sizes[1:], sizes[:-1])), -1)
    begins = [np.flatnonzero(lcp < d) for d in range(width + 1)]  # ranges of equal prefixes, by depth
    queries = np.flatnonzero(asks)
    for lo in range(0, len(queries), ABREAST):
        query = queries[lo:lo + ABREAST]
        ranges = np.searchsorted(begins[0], query, "right") - 1
        # The cells of one row: query prefixes one shorter than, as long as and one longer than the list prefix.
        less, even, more = (np.full(len(query), x, np.uint8) for x in (2, 0, 1))
        for depth in range(width + 1):
            first = begins[depth][ranges]
            # A word that ends here stands first in its range; the last cell of the query's row is the distance.
            over = sizes[query] - depth
            end = (sizes[first] == depth) & (np.abs(over) <= 1)
            cell = np.where(over < 0, less, np.where(over > 0, more, even))
            hit = end & (cell == 1)
            if hit.any():
                yield query[hit], first[hit]
            if depth == width:
                break
            # Ranges of the next depth inside each range, without the word that ends here.
            edge = np.append(begins[depth], n)
            lower = np.searchsorted(begins[depth + 1], first, "left")
            lower += (sizes[first] == depth) & (lcp[first] < depth + 1)
            upper = np.searchsorted(begins[depth + 1], edge[ranges + 1], "left")
            count = np.maximum(upper - lower, 0)
            ends = np.cumsum(count)
            if not len(ends) or not ends[-1]:
                break
            which = np.repeat(np.arange(len(query)), count)
            ranges = np.arange(ends[-1]) + np.repeat(lower - ends + count, count)
            query = query[which]
            letter = code[begins[depth + 1][ranges], depth]
            less, even, more = less[which], even[which], more[which]
            before = code[query, depth - 1] if depth else np.zeros(len(query), np.uint32)
            new_less = np.minimum(even + 1, less + (before != letter))
            new_even = np.minimum(np.minimum(more + 1, even + (code[query, depth] != letter)), new_less + 1)
            new_more = np.minimum(more + (code[query, depth + 1] != letter), new_even + 1)
            alive = np.minimum(np.minimum(new_less, new_even), new_more) <= 1
            query, ranges = query[alive], ranges[alive]
            less, even, more = (np.minimum(x[alive], 2).astype(np.uint8) for x in (new_less, new_even, new_more))


def _answers(rows: pa.Table, out: pa.Schema) -> pa.RecordBatch:
    """(word, near, best_n, best) of every query with near words, of some whole lists of one class, sorted."""
    words = rows.column("word").to_pylist()
    n = np.array(rows.column("n"))
    size = rows.column("class")[0].as_py()
    half = size // 2
    back, asks, part = (rows.column(c).to_numpy() for c in ("back", "asks", "part"))
    halves = np.unique(np.array(rows.column("half").to_pylist(), object), return_inverse=True)[1]
    group = (halves * 2 + back) * (int(part.max()) + 1) + part
    heads = np.unique(np.array([w[:half] for w in words], object), return_inverse=True)[1]
    code, sizes = _codes(rows.column("rest").to_pylist(), size + 1 - half)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    asked, met = [], []
    for q, w in scan(code, sizes, group, asks):
        # Two words of the longer length are the next class's; a pair that shares its first half is found there.
        own = (sizes[q] + sizes[w] <= 2 * (size - half) + 1) & ~(back[q] & (heads[q] == heads[w]))
        asked.append(q[own])
        met.append(w[own])
    q, w = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (asked, met))
    order = np.lexsort((rank[w], -n[w], q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    near = np.diff(np.append(first, len(q)))
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in q[first].tolist()], pa.string()), pa.array(near), pa.array(n[w[first]]),
                                       pa.array([words[i] for i in w[first].tolist()], pa.string())], schema=out)


def near_words(words: DataFrame, shortest: int = SHORTEST, queries: int = QUERIES) -> DataFrame:
    """(word, near, best_n, best): how many words are near each word, and the most frequent one, where there are any."""
    of = ["class", "back", "half", "part"]
    listed = lists(words, shortest, queries).repartition(*of).sortWithinPartitions(*of, "rest")
    out = arrow_schema(T.StructType.fromDDL(FOUND))

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            # Whole lists only: the last one may go on in the next batch.
            if len(held) > LOT:
                keys = [held.column(c).to_numpy() for c in ("class", "back", "part")] + [np.array(held.column("half").to_pylist(), object)]
                edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                if len(edges):
                    yield from per_class(held.slice(0, int(edges[-1])))
                    held = held.slice(int(edges[-1])).combine_chunks()
        if held is not None and len(held):
            yield from per_class(held)

    def per_class(rows):
        classes = rows.column("class").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(classes)) + 1).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:]):
            yield _answers(rows.slice(a, b - a), out)
    found = listed.mapInArrow(run, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return found.select("word", "near", (-F.col("b.less")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form), twice as far each round. Every step at least doubles the frequency, so
    no chain is longer than 62 steps."""
    roots = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = saved(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = longer.select("word", "root")
        if not longer.where("moved").head(1):
            return roots


def variants(words: DataFrame, shortest: int = SHORTEST, times: int = TIMES, queries: int = QUERIES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n)."""
    near = near_words(words, shortest, queries)
    rows = words.join(near, "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                             F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(saved(vocabulary(table(spark, sf_dir, "documents"))))


def _oracle_sql() -> str:
    """The query in DuckDB SQL: the checksum bit by bit, near words by the texts that deletions leave."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    octets = ("flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] "
              "ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))")
    crc = (f"xor(list_reduce({octets}, lambda r, b: list_reduce(CAST([0,0,0,0,0,0,0,0] AS BIGINT[]), lambda x, i: {bit}, xor(r, b)), "
           f"CAST(4294967295 AS BIGINT)), 4294967295)")
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS m FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY ALL),
sums AS MATERIALIZED (SELECT run, m, {crc} AS h FROM runs),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (
    SELECT m, CASE WHEN h % {LOSS} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(m) >= {OCCURRENCES}),
less AS MATERIALIZED (SELECT word, i, left(word, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT x.word, count(*) AS n_near, arg_min(x.other, (-v.n, x.other)) AS other, max(v.n) AS other_n FROM near x JOIN vocabulary v ON v.word = x.other GROUP BY x.word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * n THEN other END AS form, CASE WHEN other_n >= {TIMES} * n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN way w USING (word) JOIN forms e ON e.word = w.at WHERE e.form IS NULL"""


ORACLE_SQL = _oracle_sql()
