"""The pipeline's stages against brute force on their own input."""

import re

import corpus_pipeline as P
from glosspan.llm import decontaminate, neardup, pii
from glosspan.llm.common import materialise, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names, columns = [n for n, _ in P.STAGES], docs.columns
    assert len(names) == 5
    held = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        held.append(materialise(stage(spark, held[-1], sf), "test-stage"))
        if k < 4:
            assert held[-1].columns == columns
    good, single, clean, masked, packed = held[1:]
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in good.collect()}
    assert after <= set(before) and len(after) > 0.6 * len(before)
    classes = {r.doc_id: r.class_id for r in neardup.classify(good).collect()}
    assert {r.doc_id for r in single.collect()} == set(classes.values())
    items = [" ".join(decontaminate.words(r.text)) for r in table(spark, sf, "benchmark").collect()]
    leaks = {r.doc_id for r in single.collect() if any(i in " ".join(decontaminate.words(r.text)) for i in items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    text = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(text[r.doc_id]) and not re.search("[0-9]", text[r.doc_id]):
            assert r.text == text[r.doc_id]
    assert {r.doc_id for r in packed.collect()} == set(text)


def test_empty_and_odd_documents(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES[1:]:
            docs = materialise(stage(spark, docs, sf), "test-stage")
        assert "sequence_id" in docs.columns
