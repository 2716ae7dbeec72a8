import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from llm_util import awkward, empty
from test_decontaminate import brute as brute_benchmark
from test_secrets import brute_redact
from test_simhash import brute_components, brute_print

import corpus_pipeline
from conftest import SF_SMALL
from gavel.llm import bpe, quality
from gavel.llm.common import saved, table


def test_run_against_brute_force(spark):
    docs = {d.doc_id: d.text for d in table(spark, SF_SMALL, "documents").collect()}
    scores = quality.score(table(spark, SF_SMALL, "documents"), quality.training(table(spark, SF_SMALL, "labels")))
    kept = sorted(r.doc_id for r in scores.collect() if r.predicted)
    assert 0 < len(kept) < len(docs)
    roots = brute_components([(k, brute_print(docs[k])) for k in kept])
    kept = [k for k, r in zip(kept, roots) if k == r]
    items = [(b.item_id, b.text) for b in table(spark, SF_SMALL, "benchmark").collect()]
    kept = [k for k, b in zip(kept, brute_benchmark([docs[k] for k in kept], items)) if not b[4]]
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = bpe.load_ranks(f.read().splitlines())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {k: hashlib.sha256(np.array(library.encode_ordinary(brute_redact(docs[k])), "<u4").tobytes()).hexdigest() for k in kept}
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert len(rows) == len(want) and {r.doc_id: r.ids_sha256 for r in rows} == want
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in rows)


def test_stages_keep_the_columns(spark):
    docs = awkward(spark)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(docs), SF_SMALL).count() == 0
        out = saved(stage(spark, docs, SF_SMALL))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out if out.columns == docs.columns else docs
    assert docs.count() > 0
