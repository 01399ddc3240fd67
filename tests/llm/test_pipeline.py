"""The pipeline's rows against its decisions taken in plain Python, and its stages on odd rows."""

import corpus_pipeline
import public_tokenizers
from tests.llm import plain

from millrace.llm import bpe, queries, surrogates, toxicity


def test_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.5]
    root = plain.components(rows, 5)
    ids = [d for d, t in rows if root[d] == d and not plain.contamination(t, items)[1]]
    texts = {r.doc_id: r.text for r in surrogates.replace_pii(docs.where(docs.doc_id.isin(ids)), queries.pii_key(spark)).collect()}
    library = bpe.rank_file_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = corpus_pipeline.run(spark, small).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in found) == sorted((d, len(library.encode_ordinary(t)), plain.sha(t)) for d, t in texts.items())


def test_stages_on_odd_rows(spark, small, odd, empty):
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert last.count() == docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
