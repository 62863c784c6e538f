"""Each stage of the pipeline on its own input."""

import collections
import hashlib

import numpy as np
import pytest
from conftest import SF

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from palimpsest.llm import minhash, mixing, suffixes, toxicity
    from palimpsest.llm.exchange import written
    from palimpsest.llm.queries import held_out, table

    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (docs, out)
        if name != "bpe":
            assert out.columns == list(pipeline.COLUMNS)
        docs = out
    before, after = seen["toxicity"]
    model = toxicity.fit(before, table(spark, SF, "labels").filter(~held_out("doc_id", 5, 0)))
    kept = {r.doc_id for r in toxicity.score(before, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["near_dedup"]
    near = minhash.near_duplicates(before).collect()
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in near}
    before, after = seen["suffix_dedup"]
    left = {r._id: bytes(r.kept).decode(errors="replace") for r in suffixes.remove_repeats(before).collect()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert sum(r.text == left[r.doc_id] for r in after.collect()) >= 0.9 * after.count() and after.count() == before.count()
    before, after = seen["mix"]
    target = {r.source: r.target for r in mixing.mix_sources(before)[0].collect()}
    words = collections.Counter()
    for r in after.collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= max(3 * mixing.BLOCK_WORDS, 0.02 * t) for s, t in target.items())
    before, after = seen["bpe"]
    texts = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in after.collect()) == texts
    assert all(r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in after.collect())
    assert pipeline.run(spark, SF).count() == after.count()
