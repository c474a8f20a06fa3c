"""The pipeline's stages on odd and on given documents."""

import re

import corpus_pipeline
from laurel.llm import cgk
from tests.llm.test_documents import expected_prints, expected_repeats, texts_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).count()


def test_run_against_brute_force(spark, sf_docs):
    kept = corpus_pipeline.quality_rules(spark, sf_docs, SF)
    prints = dict(expected_prints(texts_of(kept)))
    left, groups = sorted(prints), []
    for doc_id in left:
        near = [g for g in groups if any((prints[doc_id] ^ prints[o]).bit_count() <= 4 for o in g)]
        groups = [g for g in groups if g not in near] + [[doc_id, *(o for g in near for o in g)]]
    firsts = {min(g) for g in groups}
    docs = [(d, t) for d, t in texts_of(kept) if d in firsts]
    stripped = {d: t if not gone else rest for (d, t), (_, _, gone, rest) in zip(docs, expected_repeats(docs), strict=True)}
    words = lambda t: " " + " ".join(w.decode() for w in cgk.words_of((t or "").encode())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d: t for d, t in stripped.items() if not any(i in words(t) for i in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean)
    assert all(got[d].size == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in clean.items())
    assert sum(r.taken for r in got.values()) <= 2 * sum(r.size for r in got.values())
