"""Token store and byte-level BPE against the libraries' own calls."""

import public_tokenizers
import pytest
from tests.llm import plain
from tokenizers import Tokenizer

from millrace.llm import bpe, shared, tokenstore

WORD, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_ids(text):
    return Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    return bpe.rank_file_encoding(RANKS, public_tokenizers.PATTERN)


def test_store_equals_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = tokenstore.read_back(spark, tokenstore.write_store(docs, WORD, 2))
    wanted = plain.token_rows([(r.doc_id, r.text) for r in docs.collect()], word_ids, 2)
    assert sorted(map(tuple, found.collect())) == wanted


def test_store_with_odd_rows(spark, odd, odd_rows):
    path = tokenstore.write_store(odd, WORD, 2)
    found = tokenstore.read_back(spark, path).collect()
    assert len(found) == len(odd_rows)
    sizes = sorted((r.start, r.n_tokens) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(sizes, sizes[1:], strict=False)) and sizes[0][0] == 0
    wanted = {(d, len(word_ids(t or "")) + 1) for d, t in odd_rows}
    assert {(r.doc_id, r.n_tokens) for r in found} == wanted
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    ids = {(r.doc_id, bytes(r.ids)) for r in tokenstore.read_documents(spark, path).collect()}
    import numpy as np

    assert ids == {(d, np.array([*word_ids(t or ""), 2], "<u4").tobytes()) for d, t in odd_rows}


def test_store_shares_chunks_and_sees_damage(spark, prose):
    docs = spark.createDataFrame([(i, prose(9000, 1) if i < 5 else prose(30, i) + " " + prose(9000, 1)) for i in range(10)], "doc_id bigint, text string")
    path = tokenstore.write_store(docs, WORD, 2)
    recipes = tokenstore.recipes(spark, path)
    used = sum(len(r.digests) for r in recipes.select("digests").collect())
    assert spark.read.parquet(f"{path}/chunks").count() < used / 2
    with pytest.raises(ValueError):
        list(tokenstore._chunk_sums(iter([spark.read.parquet(f"{path}/chunks").selectExpr("unhex('00') digest", "payload").toArrow().to_batches()[0]])))


def rewritten(spark, path, name, change):
    """A copy of a store with one of its tables changed."""
    copy = shared.scratch(spark, "copy")
    for table in ("chunks", "parts", "manifest", "store"):
        rows = spark.read.parquet(f"{path}/{table}")
        (change(rows) if table == name else rows).write.parquet(f"{copy}/{table}")
    return copy


@pytest.mark.parametrize("name,change", [("chunks", lambda t: t.exceptAll(t.limit(1))), ("parts", lambda t: t.where("doc_id <> 3")), ("parts", lambda t: t.where("part <> 0")), ("manifest", lambda t: t.where("part <> 0")), ("manifest", lambda t: t.selectExpr("part", "n_docs", "n_tokens + 1 n_tokens", "start", "root"))])
def test_lost_chunks_documents_and_parts_are_errors(spark, prose, name, change):
    path = tokenstore.write_store(spark.createDataFrame([(i, prose(40, i)) for i in range(6)], "doc_id bigint, text string"), WORD, 2)
    assert tokenstore.read_back(spark, rewritten(spark, path, "store", lambda t: t)).count() == 6
    with pytest.raises(Exception, match="missing|agree"):
        tokenstore.read_back(spark, rewritten(spark, path, name, change)).collect()


def test_empty_tables(spark, empty):
    assert tokenstore.read_back(spark, tokenstore.write_store(empty, WORD, 2)).count() == 0
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


def check_bpe(docs, rows, library):
    found = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, found)) == sorted(map(str, bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()))
    import numpy as np

    ids = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found), key=key) == sorted(((d, len(i), np.array(i, "<u4").tobytes(), b) for d, i, b in ids), key=key)


def test_bpe_equals_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_bpe(docs, [(r.doc_id, r.text) for r in docs.collect()], library)


def test_bpe_with_odd_rows(odd, odd_rows, library):
    check_bpe(odd, odd_rows, library)
