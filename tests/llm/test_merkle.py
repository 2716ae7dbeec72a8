import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_util import awkward, empty
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gavel.llm import merkle as M
from gavel.llm.common import table


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """(root, the siblings of each leaf by level as pairs before and behind)."""
    paths = [[] for _ in digests]
    where = list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i:i + 3] for i in range(0, len(digests), 3)]
        for leaf, at in enumerate(where):
            run, d = runs[at // 3], at % 3
            paths[leaf].append(("".join(run[:d]), "".join(run[d + 1:])))
        digests, where = [h(*run) for run in runs], [at // 3 for at in where]
    return (digests[0] if digests else None), paths


def brute(rows):
    """The contract in plain Python, a row for each row."""
    by_source = {}
    for r in rows:
        leaf = h(*(field(r[c]) for c in M.FIELDS))
        text = r["text"]
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        now = h(*(field(text if c == "text" else r[c]) for c in M.FIELDS))
        by_source.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf, now, r["doc_id"]))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(by_source[s])]) for s in sources}
    root, ways = climb([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, ways):
        for (_, leaf, now, doc_id), path in zip(sorted(by_source[s]), trees[s][1]):
            way, folded = path + above, now
            for a, b in way:
                folded = h(a, folded, b)
            out.append((doc_id, leaf, trees[s][0], root, h(*(a + b for a, b in way)), folded, folded == root))
    return sorted(out, key=str)


def query(spark, docs):
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    got = M.verdicts(docs, F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text")))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(M.proof(F.col("path")), 256), "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=str)


def test_query_on_the_table(spark):
    got = M.op12_merkle(spark, SF_SMALL).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == brute(table(spark, SF_SMALL, "documents").collect())
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_trees_of_all_sizes(spark, monkeypatch, levels):
    """Groups of 1 to 90 leaves, whose trees end at, below and above a pack's edge."""
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "PACK", 3 ** levels)
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 90]
    rows = [(100 * k + i, f"text {i}\n" * (i % 3), "en", f"s{k}" if k else None, i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query(spark, docs) == brute(docs.collect())


def test_awkward_rows(spark):
    docs = awkward(spark).unionByName(awkward(spark).where("doc_id = 1")).withColumns({"at": F.lit(1), "group": F.lit("x"), "digest": F.lit("y"), "one": F.lit(9)})
    docs = docs.unionByName(docs.where("doc_id = 5").withColumn("source", F.lit("")))
    assert query(spark, docs) == brute(docs.collect())
    assert query(spark, empty(docs)) == []


def test_one_row(spark):
    docs = spark.createDataFrame([(4, "a\nb", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    ((_, leaf, subroot, root, proof, folded, ok),) = query(spark, docs)
    assert leaf == subroot == root and proof == h("") and ok == (folded == leaf)


def test_store_is_content_addressed(spark):
    """Every record's digest is that of its children, and the records lead from the root to every leaf."""
    docs = table(spark, SF_SMALL, "documents")
    known = M.manifest(docs)
    records = {r.digest: r.children for part in (known.top, known.groups) for r in part.records().collect()}
    assert all(d == h(*children) for d, children in records.items())
    (root,) = known.top.trees.collect()
    reached, open_ = [], [root.digest]
    while open_:
        d = open_.pop()
        if d in records:
            open_ += records[d]
        else:
            reached.append(d)
    assert sorted(reached) == sorted(r.leaf for r in known.leaves.collect())


def test_some_requests_only(spark):
    docs = table(spark, SF_SMALL, "documents")
    known = M.manifest(docs)
    asked = known.leaves.where("at % 7 = 3").select("group", "at", "what")
    got = known.prove(asked).collect()
    assert len(got) == asked.count() > 0
    for r in got:
        assert r.digest == r.what.leaf
        folded = r.digest
        for s in reversed(r.path):
            folded = h(s.before, folded, s.behind)
        assert folded == r.root


@settings(max_examples=60, deadline=None)
@given(n=st.integers(0, 3 ** 12))
def test_depth(spark, n):
    want = 0
    while 3 ** want < n:
        want += 1
    assert spark.range(1).select(M._depth(F.lit(n))).first()[0] == want


def test_plan_needs_no_python(spark):
    plan = M.op12_merkle(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
