"""Functions that SQL cannot show, against Python's own values."""

import hashlib
import math

from pyspark.sql import functions as F

from millrace.operators import etl, reads, retrieval


def test_quoted_tails_go(spark):
    bodies = {
        "Seen.\n\nOn Mon, 3 Jun 2024 Ana <a@b.org> wrote:\n> old": "Seen.",
        "Seen.\n-----Original Message-----\nFrom: x": "Seen.",
        "Seen.\n   > quoted": "Seen.",
        "On Monday the pump tripped.\nThe operator wrote: all well.\nEnd": "On Monday the pump tripped.\nThe operator wrote: all well.\nEnd",
        "a\n-- \nsignature": "a\n-- \nsignature",
        "a\nFrom: b\nc": "a",
    }
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", etl.strip_quotes(F.col("b")).alias("kept")).collect()
    assert {r.b: r.kept for r in rows} == bodies


def test_hash_embedding(spark):
    def plain(text, dim):
        vector = [0.0] * dim
        for i, word in enumerate(text.lower().split()):
            h = int(hashlib.md5(word.encode()).hexdigest(), 16)
            vector[h % dim] += (1 if h >> 4 & 1 else -1) / (1 + 0.1 * i)
        norm = math.sqrt(sum(x * x for x in vector))
        return [x / norm for x in vector] if norm else [1.0, *vector[1:]]

    texts = ["The pump P-101A leaks at the seal", "one", "", "Ünïcode Wörter und und und"]
    for dim in (16, 64, 37, 1536):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.hash_embedding(F.col("t"), dim).alias("v")).collect():
            assert all(abs(a - b) < 1e-9 for a, b in zip(r.v, plain(r.t, dim), strict=True))


def test_chunks_of_documents(spark):
    chunks = spark.createDataFrame([("chunk:doc:a#0",), ("chunk:doc:a#1",), ("chunk:doc:b#0",)], "chunk_id string")
    found = reads.chunks_of(chunks, spark.createDataFrame([("doc:a",), ("doc:a",)], "doc_id string"))
    assert sorted(r.chunk_id for r in found.collect()) == ["chunk:doc:a#0", "chunk:doc:a#1"]
