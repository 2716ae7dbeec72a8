"""Secret scans in DataFrame functions alone: three fixed patterns and sliding-window entropy.

``split`` and ``regexp_extract_all`` on one pattern give the gaps and the matches of a text in turn, and running sums
of their lengths give every match's place in code points. Candidate strings outside the fixed patterns are walked
once by a window of ``window`` characters: the counts of the characters in it change by one in and one out, and the
sum of c*log2(c) follows these two changes, so no window is counted afresh. A candidate with a window whose entropy
reaches the bar of its character class is a span; the allow-list suppresses what looks random but is no secret.

No shuffle, no state between rows. Defined results: a null or empty text has no spans (and stays null in
``redact``); repeated rows are scanned alike; an empty table gives an empty result; further columns pass through, and
a column that is already named like the result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import table

# The three patterns, shortest lengths and kinds in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Character class, its alphabet, and the entropy in bits a character from which a window counts.
CLASSES = [
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("base64", r"^[A-Za-z0-9+/_=-]+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.6),
]
#: Candidates that are no secrets: plain numbers, words without digits, ids and paths, placeholders.
ALLOW = [
    r"^[0-9]+$", r"^[A-Za-z+/_=-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^([a-z0-9_-]{1,19}/)+[a-z0-9_-]{0,19}$", r"^([a-z0-9]{1,12}[-_])+[a-z0-9]{1,12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh",
]
#: What may stand right before a candidate that is a public digest.
ALLOW_BEFORE = r"(?i)(sha(1|224|256|384|512)|md5|commit|integrity)[-:=\x20\"']{1,3}$"

#: Matches whose places are summed before they are joined to the text's other ones.
RUN = 256
MASK = "[SECRET]"

_SPAN = "array<struct<at:int,end:int,word:string,before:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern: place, end, the match and the end of the gap before it."""
    pieces = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")),
        lambda x: F.struct(F.length(x["gap"]).alias("skip"), F.length(x["hit"]).alias("size"), x["hit"].alias("word"),
                           F.right(x["gap"], F.lit(12)).alias("before")))

    def step(acc, x):
        at = acc["pos"] + x["skip"]
        end = at + F.coalesce(x["size"], F.lit(0))
        one = F.struct(at.alias("at"), end.alias("end"), x["word"].alias("word"), x["before"].alias("before"))
        return F.struct(end.alias("pos"), F.when(x["word"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def run(pieces, acc, k):
        part = F.slice(pieces, k * RUN + 1, RUN)
        return _let(F.aggregate(part, F.struct(acc["pos"].alias("pos"), F.array().cast(_SPAN).alias("out")), step),
                    lambda got: F.struct(got["pos"].alias("pos"), F.concat(acc["out"], got["out"]).alias("out")))

    def runs(pieces):
        count = F.ceil(F.size(pieces) / F.lit(RUN)).cast("int")
        return F.aggregate(F.sequence(F.lit(0), count - 1), F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out")),
                           lambda acc, k: run(pieces, acc, k))["out"]
    return F.when(text.rlike(pattern), _let(pieces, runs)).otherwise(F.array().cast(_SPAN))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["at"].alias("at"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns by place, then kind."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["word"], ASSIGN, 2)) >= ASSIGN_CHARS)
    return F.array_sort(F.concat(_spans(assign, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")))


def _weight(count: Column) -> Column:
    """c * log2(c), zero at zero."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _peak_entropy(word: Column, alphabet: str, window: int) -> Column:
    """The highest entropy, in bits a character, among a candidate's windows."""
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("weight"), F.lit(-1.0).alias("peak"))

    def changed(counts, weight, place, by):
        """One more or one less of a character."""
        old = F.element_at(counts, place)
        return F.struct(F.transform(counts, lambda c, j: F.when(j + 1 == place, c + by).otherwise(c)).alias("counts"),
                        (weight + _weight(old + by) - _weight(old)).alias("weight"))

    def step(places, acc, i):
        def seen(now):
            entropy = F.lit(math.log2(window)) - now["weight"] / window
            return F.struct(now["counts"].alias("counts"), now["weight"].alias("weight"),
                            F.when(i + 1 >= window, F.greatest(acc["peak"], entropy)).otherwise(acc["peak"]).alias("peak"))
        into = changed(acc["counts"], acc["weight"], F.element_at(places, i + 1), 1)
        gone = _let(into, lambda x: F.when(i >= window, changed(x["counts"], x["weight"], F.element_at(places, F.greatest(i + 1 - window, F.lit(1))), -1)).otherwise(x))
        return _let(gone, seen)
    letters = F.transform(F.regexp_extract_all(word, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    return _let(letters, lambda places: F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, lambda acc, i: step(places, acc, i)))["peak"]


def entropy_spans(text: Column, window: int = WINDOW, allow: list[str] = ALLOW) -> Column:
    """Candidates with a window of high entropy that the allow-list doesn't suppress."""
    allowed = "|".join(f"(?:{x})" for x in allow) or r"(?!)"
    open_ = F.filter(matches(text, CANDIDATE), lambda x: ~x["word"].rlike(allowed) & ~x["before"].rlike(ALLOW_BEFORE))

    def hot(x):
        found = F.lit(False)
        for _, members, alphabet, bar in reversed(CLASSES):
            found = F.when(x["word"].rlike(members), _peak_entropy(x["word"], alphabet, window) >= bar).otherwise(found)
        return found
    return _spans(F.filter(open_, hot), "entropy")


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", window: int = WINDOW,
                 allow: list[str] = ALLOW) -> DataFrame:
    """``docs`` with a column ``out`` of (base, all): arrays of (at, kind, end), kind a number into KINDS, sorted by
    place, then kind. Entropy spans inside a base span say nothing new and are left out."""
    body = F.coalesce(F.col(text), F.lit(""))

    def both(base):
        more = F.filter(entropy_spans(body, window, allow), lambda x: ~F.exists(base, lambda b: (b["at"] <= x["at"]) & (b["end"] >= x["end"])))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("all"))
    return docs.withColumn(out, _let(base_spans(body), both))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["at"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = MASK, **how) -> DataFrame:
    """The same rows with every span of a text replaced by a mask; ``length`` follows the new text."""
    order = docs.columns
    found = find_secrets(docs, text, "__secrets", **how)

    def step(source, acc, x):
        fresh = x["at"] > acc["pos"]
        piece = F.when(fresh | ((acc["pos"] == 0) & (F.size(acc["out"]) == 0)),
                       F.array(source.substr(acc["pos"] + 1, F.greatest(x["at"] - acc["pos"], F.lit(0))), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], piece).alias("out"))

    def cleaned(source, spans):
        done = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")), lambda acc, x: step(source, acc, x))
        return _let(done, lambda x: F.concat(F.array_join(x["out"], ""), source.substr(x["pos"] + 1, F.length(source))))
    spans = F.col("__secrets")["all"]
    found = found.withColumn(text, F.when(F.size(spans) > 0, cleaned(F.col(text), spans)).otherwise(F.col(text)))
    if length in order:
        kind = docs.schema[length].dataType
        found = found.withColumn(length, F.when(F.size(spans) > 0, F.length(text).cast(kind)).otherwise(F.col(length)))
    return found.select(order)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = F.col("secrets")["base"], F.col("secrets")["all"]

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


def _oracle_sql() -> str:
    """The query in DuckDB SQL: the same patterns, places by lengths, entropy by counting every window afresh."""
    patterns = [ASSIGN, ACCESS, HEX, CANDIDATE]
    q = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT doc_id, {kind} AS kind, string_split_regex(body, {q(p)}) AS gaps, regexp_extract_all(body, {q(p)}, 0) AS hits FROM t"
                               for kind, p in enumerate(patterns))
    allowed = " OR ".join(f"regexp_matches(word, {q(p)})" for p in ALLOW)
    bars = " ".join(f"WHEN regexp_matches(word, {q(members)}) THEN {bar}" for _, members, _, bar in CLASSES)
    names = "[" + ", ".join(map(q, KINDS)) + "]"
    line = f"string_agg(({names})[kind + 1] || ':' || pos || ':' || (pos + length(word)), ',' ORDER BY pos, kind)"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS[:3]))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
f AS ({found}),
u AS (SELECT doc_id, kind, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM f WHERE len(hits) > 0),
s AS (SELECT doc_id, kind, hits[i] AS word, right(gaps[i], 12) AS before,
        CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM u),
base AS (SELECT * FROM s WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(word, {q(ASSIGN)}, 2)) >= {ASSIGN_CHARS}),
more AS (SELECT * FROM s WHERE kind = 3 AND NOT ({allowed}) AND NOT regexp_matches(before, {q(ALLOW_BEFORE)})
  AND list_max(list_transform(range(1, length(word) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(word, i, {WINDOW}), ''), 'entropy')))
      >= CASE {bars} END
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.pos <= s.pos AND b.pos + length(b.word) >= s.pos + length(s.word))),
b AS (SELECT doc_id, {counts}, {line} AS spans FROM base GROUP BY doc_id),
e AS (SELECT doc_id, {line} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:3])},
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)
"""


ORACLE_SQL = _oracle_sql()
