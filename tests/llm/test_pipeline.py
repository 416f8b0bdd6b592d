import zlib

import numpy as np

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert out.columns == docs.columns and 0.5 * before < out.count() <= docs.count()
        docs = out
    from tokenizers import Tokenizer

    from sluice.llm import packing

    pieces = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    encode = Tokenizer.from_file(packing.vocabulary_path()).encode
    for r in docs.limit(20).collect():
        ids = [*encode(r.text, add_special_tokens=False).ids, packing.END]
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == r.doc_id)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in own)
