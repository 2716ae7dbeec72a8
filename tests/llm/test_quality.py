import tracemalloc

import numpy as np
import pyarrow as pa
from llm_util import awkward, empty
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from gavel.llm import quality as Q
from gavel.llm import text as tx
from gavel.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.op10_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 800
    assert rows[rows.quality == 1].predicted.mean() > 0.98 and rows[rows.quality == 0].predicted.mean() < 0.05


def test_votes_against_plain_neighbours(spark):
    docs = table(spark, SF_MID, "documents")
    model = Q.fit(docs, Q.training(table(spark, SF_MID, "labels")))
    texts = [r.text for r in docs.where("doc_id < 60").orderBy("doc_id").collect()] + ["", None]
    got = np.concatenate([Q.votes(model, buf, offs) for _, _, buf, offs in tx.blocks(pa.array(texts, pa.string()), 4096)])
    for text, score in zip(texts, got):
        (_, _, buf, offs), = tx.blocks(pa.array([text], pa.string()))
        t, bucket, times = Q.features(buf, offs)
        w = Q.weights(t, bucket, times, model["idf"])
        v = w.astype(np.float32) @ model["space"][bucket] if len(w) else np.zeros(model["space"].shape[1])
        cosine = model["near"] @ (v / np.linalg.norm(v)) if np.linalg.norm(v) else np.zeros(len(model["near"]))
        best = np.argsort(-cosine, kind="stable")[:Q.NEIGHBOURS]
        like = np.maximum(cosine[best], 0).astype(float) ** Q.SHARPNESS * model["vote"][best]
        want = (like @ model["y"][best]) / like.sum() if like.sum() > 1e-12 else model["share"]
        assert abs(score - want) < 2e-2


def test_labels_of_held_out_rows_and_other_columns_play_no_part(spark):
    labels = table(spark, SF_SMALL, "labels")
    flipped = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = table(spark, SF_SMALL, "documents")
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a = sorted(map(tuple, Q.score(docs, Q.training(labels)).collect()))
    assert a == sorted(map(tuple, Q.score(changed, Q.training(flipped)).collect()))
    assert sorted(r[0] for r in a) == sorted(r.doc_id for r in docs.collect())


def test_several_texts_of_one_id_in_any_order(spark):
    """The model doesn't depend on how rows are dealt to tasks."""
    docs = table(spark, SF_SMALL, "documents").withColumn("doc_id", F.col("doc_id") % 40)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (sorted(map(tuple, Q.score(docs.repartition(n, by), labels).collect())) for n, by in ((2, "text"), (7, "n_chars")))
    assert a == b


def test_awkward_rows(spark):
    docs = awkward(spark).withColumns({"score": F.lit("mine"), "bucket": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (6, 0), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    rows = Q.score(docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert {r.score for r in Q.score(docs, empty(labels)).collect()} == {1.0}
    assert Q.score(empty(docs), labels).count() == 0


def test_the_driver_only_gets_the_model(spark):
    """Neither the driver's memory nor the number of jobs follows the sample or the number of partitions."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 40))) for i in range(2 * Q.SAMPLE + 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    sc = spark.sparkContext
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    jobs = {}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (4, 24):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            sc.setJobGroup(f"fit-{n}", "fit")
            tracemalloc.start()
            model = Q.fit(docs, labels)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"fit-{n}"))
            assert len(model["y"]) == len(model["near"]) == 2 * Q.SAMPLE and model["space"].shape == (Q.BUCKETS, Q.RANK)
            assert peak < 64 << 20, f"{peak >> 20} MB"
    finally:
        tracemalloc.stop()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert 0 < jobs[4] == jobs[24]
