import collections
import math
import re

import numpy as np
from llm_util import awkward, empty, ws_words
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from gavel.llm import rules as R
from gavel.llm.common import table


def brute(text):
    text = text or ""
    w = ws_words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if ws_words(line):
            dup += line in lines
            lines.add(line)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


def check(rows, texts):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(k), *brute(t)) for k, t in texts)


def test_query_on_the_table(spark):
    rows = R.op6_quality_rules(spark, SF_MID).collect()
    check(rows, [(d.doc_id, d.text) for d in table(spark, SF_MID, "documents").collect()])
    assert all(r.kept == (not r.base_failed and r.log_ratio >= R.BAR) for r in rows)


def test_ratio_against_plain_counts(spark):
    docs = table(spark, SF_SMALL, "documents")
    trusted = table(spark, SF_SMALL, "labels").where("quality = 1").select("doc_id")
    good = {r.doc_id for r in trusted.collect()}
    both = R.counts(docs, trusted, "doc_id", "text")
    all_rows = docs.collect()
    n = lambda rows: sum(2 * len(w) - 1 for r in rows if (w := ws_words(r.text)))
    assert both.sum(1).tolist() == [n(all_rows), n([r for r in all_rows if r.doc_id in good])]
    smooth = both + R.SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    assert np.allclose(R.log_ratio(both), ratio)
    for r in R.op6_quality_rules(spark, SF_SMALL).limit(20).collect():
        (_, _, buf, offs), = R.tx.blocks(R.pa.array([docs.where(f"doc_id = {r.doc_id}").first().text]))
        bucket = R.ngrams(buf, offs)[0]
        assert math.isclose(r.log_ratio, sum(ratio[b] for b in bucket) / len(bucket), abs_tol=1e-6)


def test_all_trusted_documents_count(spark):
    n = 60_000
    docs = spark.range(n + 500).selectExpr("id AS doc_id", "concat('w', id % 7, ' same') AS text")
    both = R.counts(docs, spark.range(n).selectExpr("id AS doc_id"), "doc_id", "text")
    assert both.sum(1).tolist() == [3 * (n + 500), 3 * n]


def test_clean_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    rows = R.op6_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    sound = rows[~rows.base_failed]
    assert sound[sound.quality == 1].kept.mean() > 0.995 and sound[sound.quality == 0].kept.mean() < 0.05


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("kept", F.lit("mine"))
    trusted = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    rows = R.quality_rules(docs, trusted).collect()
    check(rows, [(d.doc_id, d.text) for d in docs.collect()])
    bare = R.quality_rules(docs, empty(trusted)).collect()
    assert all(r.log_ratio == 0 and r.kept == (not r.base_failed) for r in bare)
    assert R.quality_rules(empty(docs), trusted).count() == 0


def test_the_bitmap_lets_all_trusted_rows_through(spark, monkeypatch):
    """With few bits many other rows pass too; the join with the ids leaves only the trusted ones."""
    docs = spark.range(-500, 3_000).selectExpr("id AS doc_id", "concat('w', id % 7, ' same') AS text").union(
        spark.createDataFrame([(None, "no id"), (1, "again")], "doc_id long, text string"))
    ids = spark.range(-500, 3_000, 9).selectExpr("id AS __id")
    good = {r[0] for r in ids.collect()}
    for bits in (1, 64, 1 << 15, 1 << 25):
        monkeypatch.setattr(R, "ID_BITS", bits)
        near = [r.doc_id for r in R.maybe_trusted(docs, ids, "doc_id").collect()]
        assert good <= set(near) and near.count(1) == (2 if 1 in near else 0)
        assert (len(near) < 600) == (bits > 64)
        both = R.counts(docs, ids.withColumnRenamed("__id", "doc_id"), "doc_id", "text")
        n = sum(1 if r.text == "again" else 3 for r in docs.collect() if r.doc_id in good)
        assert both[1].sum() == n


def test_other_texts_are_not_shuffled(spark):
    """The bitmap is met before the shuffle."""
    docs, trusted = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels").where("quality = 1").select("doc_id")
    texts = R.trusted_texts(docs, trusted, "doc_id", "text")
    plan = texts._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = {name: next(len(line) - len(line.lstrip(" :+-")) for line in plan if name in line) for name in ("SortMergeJoin", "BroadcastHashJoin")}
    assert depth["SortMergeJoin"] < depth["BroadcastHashJoin"]
    assert len([line for line in plan if "Join" in line]) == 2
