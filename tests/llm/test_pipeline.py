"""The pipeline's stages, one after another, against what each must keep."""

import collections

import numpy as np

import corpus_pipeline
from earshift.llm import bpe, mixing, rules
from earshift.llm.queries import tokenizer
from tests.llm.test_documents import LOWER, SCHEMA, classes_of, corpus, plain_mix, prose, words


def test_stages(spark, tmp_path):
    long = [(200 + k, prose(30 + k, 60) + " the of and", "en", f"s{k % 3}", 1, None, None, None) for k in range(12)]
    long += [(300 + k, long[k][1].upper() if k == 2 else long[k][1], "en", "s1", 1, None, None, None) for k in range(4)]
    rows = corpus() + long
    docs = spark.createDataFrame(rows, SCHEMA)
    good = {(r.doc_id, r.text) for r in rules.judge(docs, keep=("doc_id", "text")).where("kept").collect()}
    kept = [r for r in rows if (r[0], r[1]) in good]
    seen = {}
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, "")
        df.write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
        docs = out[-1]
        if k < 4:
            assert docs.columns == spark.createDataFrame([], SCHEMA).columns
    assert collections.Counter((r.doc_id, r.text) for r in out[0].collect()) == collections.Counter((r[0], r[1]) for r in kept)
    for r in sorted(kept, key=lambda r: -1 if r[0] is None else r[0]):
        seen[r[1].translate(LOWER)] = r
    assert collections.Counter(r.doc_id for r in out[1].collect()) == collections.Counter(r[0] for r in seen.values())
    near = classes_of(list(seen.values()))
    assert collections.Counter(r.doc_id for r in out[2].collect()) == collections.Counter(max(ids) for ids in near.values())
    size = sum(len(words(r.text)) for r in out[2].collect())
    assert abs(sum(len(words(r.text)) for r in out[3].collect()) - 1.5 * size) <= 5
    assert out[4].count() == out[3].count() and {"doc_id", "n_tokens", "ids"} <= set(out[4].columns)
    # stage 4 by document and text, as a plain mix of what stage 3 wrote; stage 5 row by row
    sourced = [tuple(r) for r in out[2].collect()]
    mixed = collections.Counter((r.doc_id, r.source, r.text) for r in out[3].collect())
    source = {r[0]: r[3] for r in sourced}
    assert len(source) == len(sourced)
    assert mixed == collections.Counter((i, source[i], t) for i, t in plain_mix(sourced, mixing.BLOCK_WORDS))
    encoding = bpe.Codec(*tokenizer()).encoding
    want = collections.Counter((i, s, np.array(encoding.encode_ordinary(t), "<u4").tobytes()) for i, s, t in mixed.elements())
    assert collections.Counter((r.doc_id, r.source, bytes(r.ids)) for r in out[4].collect()) == want
