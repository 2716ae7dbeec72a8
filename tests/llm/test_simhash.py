import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_util import awkward, empty, lower, ws_words
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gavel.llm import simhash as S
from gavel.llm import text as tx
from gavel.llm.common import table


def brute_print(text):
    w = ws_words(lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint) pairs; {row: smallest id reachable}."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab ABé\n\t\x1c"), max_size=700)), max_size=5))
def test_fingerprints_against_brute_force(texts):
    got = [S.majority(*S.shingle_hashes(buf, offs, 3)) for _, _, buf, offs in tx.blocks(pa.array(texts, pa.string()), 64)]
    assert [int(x) for part in got for x in part] == [brute_print(t) for t in texts]


def clustered(rng, n, centres=12, flips=3):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64)
    out = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * rng.integers(0, 2, n, dtype=np.uint64)
    return np.unique(out)


@pytest.mark.parametrize("n", [2, 9, 400, 3000])
def test_index_finds_every_link(n):
    rng = np.random.default_rng(n)
    fp = clustered(rng, n)
    group = rng.integers(0, 3, len(fp))
    index = S.GrayIndex(group, fp)
    assert (np.diff(S.gray_rank(index.fp)[index.group == index.group[0]].astype(object)) >= 0).all()
    got = {(min(x, y), max(x, y)) for a, b in index.links(2) for x, y in zip(index.fp[a].tolist(), index.fp[b].tolist())}
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    i, j = np.nonzero(np.triu(near & (group[:, None] == group[None]), 1))
    assert got == {(min(x, y), max(x, y)) for x, y in zip(fp[i].tolist(), fp[j].tolist())}


def test_index_prunes_whole_groups():
    fp = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    index = S.GrayIndex(np.zeros(5000, np.int64), fp)
    real, tried = np.bitwise_count, 0

    class Counting:
        def __call__(self, x):
            nonlocal tried
            tried += len(x)
            return real(x)
    S.np.bitwise_count = Counting()
    try:
        list(index.links(2))
    finally:
        S.np.bitwise_count = real
    assert tried < 5000 * 4999 / 2 / 4


@pytest.mark.parametrize("split_rows", [1, 4096])
def test_components_from_fingerprints(spark, split_rows):
    """Hot keys, dealt again or not, lose no link."""
    rng = np.random.default_rng(3)
    fp = np.concatenate((clustered(rng, 500), rng.integers(0, 2**63, 200, dtype=np.uint64)))
    signed = fp.view(np.int64)
    distinct = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(distinct, split_rows=split_rows)).collect()}
    want = brute_components([(int(x), int(y)) for x, y in zip(signed, fp)])
    mine = [roots.get(int(x), int(x)) for x in signed]
    assert len(set(want)) > 10
    same = {}
    assert all(same.setdefault(a, b) == b for a, b in zip(mine, want)) and len(set(same.values())) == len(same)


def test_query_on_the_table(spark):
    docs = table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    prints = [(d.doc_id, brute_print(d.text)) for d in docs]
    want = {k: (f"{p:016x}", c) for (k, p), c in zip(prints, brute_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op8_simhash(spark, SF_SMALL).collect()} == want


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0))
    found = S.near_duplicates(docs)
    rows = found.collect()
    assert found.columns == ["doc_id", "fp", "component_id"] and len(rows) == 12
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert {c for (k, f), c in by.items() if f == 0} == {2}  # wordless texts are one component
    assert {c for (k, _), c in by.items() if k is None} == {None}
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    # ids 3 and 4 join 2; one row each of id 1 and of the row without id; the two texts of id 8 are two components
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "7", "8", "8", "None"]
    assert S.near_duplicates(empty(docs)).count() == 0 and S.keep_first(empty(docs)).count() == 0


def test_a_large_group_of_copies(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'one and the same old text of some words' "
                                        "ELSE concat('text ', id, ' ', sha2(cast(id AS string), 256), ' ', md5(cast(id AS string))) END AS text")
    rows = S.near_duplicates(docs).where("doc_id % 2 = 0").select("component_id").distinct().collect()
    assert [r.component_id for r in rows] == [0]
