"""Content-addressed token store: chunks cut by a rolling hash, recipes, and Merkle manifests.

A store is a folder of Parquet tables:

* ``chunks(digest, n, payload)``: each distinct chunk once; payload is zstd-compressed ids, 16 bits
  wide where all ids fit, else 32 bits (first byte of the payload: 2 or 4);
* ``parts(part, doc_id, at, n_tokens, root, digests)``: documents in ascending doc_id order over the
  parts; ``at`` counts the ids before a document in its part, ``digests`` are its chunks in order,
  ``root`` its Merkle root;
* ``manifest(part, n_docs, n_tokens, start, root)``: one row a part with the Merkle root of its documents;
* ``store(n_parts, n_docs, n_tokens, root)``: one row with the Merkle root of the parts.

Reading checks every level: chunks against digests, documents, parts and the store against their roots.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import tokenizer_file_encoder
from millrace.llm.shared import materialize, scratch
from millrace.llm.textblocks import mix, text_blocks

#: A chunk ends where the rolling hash of the last 16 ids has its low bits clear, on average after
#: 1024 ids, and after 16384 ids at the latest.
WINDOW, MASK, LONGEST = 16, 1023, 16_384
_SEEN = 50_000
#: Documents of a part, on average; a part's roots are gathered in one row.
PART_DOCS = 100_000


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the content-defined chunks of each id stream; ``bounds`` are where streams begin (and the end).

    A cut depends on the WINDOW ids before it in its own stream only, so an insertion moves the cuts
    near it and no others.
    """
    h, span = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while span < WINDOW:  # h[i] = sum of hash(id i - j) << j over ``span`` ids
        step = np.zeros_like(h)
        step[span:] = h[:-span] << np.uint64(span)
        h += step
        span *= 2
    found = np.flatnonzero((h >> np.uint64(12)) & np.uint64(MASK) == 0) + 1
    own = np.searchsorted(bounds, found, side="left") - 1
    keep = found - bounds[own] >= WINDOW  # no window across streams
    found, own = found[keep], own[keep]
    at = np.searchsorted(own, np.arange(len(bounds)))
    out = []
    for k, (last, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        ends = []
        for e in [*found[at[k] : at[k + 1]].tolist(), end]:
            while e - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if e > last:
                ends.append(e)
                last = e
        out.append(ends)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree over digests (the last of an odd level goes up alone)."""
    if not digests:
        return hashlib.blake2b(b"", digest_size=16).digest()
    while len(digests) > 1:
        digests = [hashlib.blake2b(b"".join(digests[i : i + 2]), digest_size=16).digest() if i + 1 < len(digests) else digests[i] for i in range(0, len(digests), 2)]
    return digests[0]


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def pack(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if narrow else b"\4") + zstandard.compress(ids.astype("<u2" if narrow else "<u4").tobytes(), 1)


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload[1:]), "<u2" if payload[0] == 2 else "<u4").astype("<u4")


_STAGED = "doc_id bigint, n_tokens bigint, root binary, digests array<binary>, new array<struct<digest: binary, n: int, payload: binary>>"


def _stage(path: str, end_id: int):
    """Encode and cut documents. A task emits a chunk's payload the first time it meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        encoder = tokenizer_file_encoder(path)
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                ids, bounds = encoder.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                roots, recipes, new, begin = [], [], [], 0
                for ends in chunk_ends(ids, bounds):
                    recipe, fresh = [], []
                    for end in ends:
                        part = ids[begin:end]
                        recipe.append(digest := _digest(part))
                        if digest not in seen:
                            fresh.append({"digest": digest, "n": len(part), "payload": pack(part)})
                            if len(seen) >= _SEEN:
                                seen.clear()
                            seen.add(digest)
                        begin = end
                    roots.append(merkle_root(recipe))
                    recipes.append(recipe)
                    new.append(fresh)
                kind = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(roots, pa.binary()), pa.array(recipes, pa.list_(pa.binary())), pa.array(new, kind)], ["doc_id", "n_tokens", "root", "digests", "new"])

    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode ``docs(doc_id, text)`` into a new store and return its path.

    Null and empty texts are documents of the end id alone. Documents are stored in ascending doc_id
    order, null ids first; rows that share a doc_id follow each other in the order of their Merkle
    roots and are told apart by their starts. An empty table gives empty tables. Parts hold about
    PART_DOCS documents at any size of the corpus.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokenstore")
    staged = materialize(docs.select("doc_id", "text").mapInArrow(_stage(tokenizer, end_id), _STAGED), "encoded")
    chunks = staged.select(F.inline("new")).dropDuplicates(["digest"])
    chunks.write.parquet(f"{path}/chunks")
    parts = max(1, spark.sparkContext.defaultParallelism, math.ceil(staged.count() / PART_DOCS))
    # the last key spreads rows that are equal in the others
    keys = ["doc_id", "root", "row"]
    ordered = staged.select("doc_id", "n_tokens", "root", "digests", F.monotonically_increasing_id().alias("row")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("row")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_positions, "part int, doc_id bigint, at bigint, n_tokens bigint, root binary, digests array<binary>").write.parquet(f"{path}/parts")
    sums = part_sums(spark.read.parquet(f"{path}/parts"))
    # One row a part reaches the window that turns sizes into starts.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")
    _whole(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/store")
    return path


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each document within its part."""
    at = 0
    for batch in batches:
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        begin = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(0), pa.array(begin, pa.int64()), batch.column(1), batch.column(2), batch.column(3)], ["part", "doc_id", "at", "n_tokens", "root", "digests"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root([x["root"] for x in ordered]) for ordered in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], ["part", "n_docs", "n_tokens", "root"])


def part_sums(parts: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root) of the documents of each part. A part holds about PART_DOCS documents."""
    ordered = parts.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "root"))).alias("roots"))
    return ordered.mapInArrow(_roots, "part int, n_docs bigint, n_tokens bigint, root binary")


def _whole(manifest: DataFrame) -> DataFrame:
    """One row (n_parts, n_docs, n_tokens, root) over the parts, of which there are few."""
    rows = manifest.agg(F.count("*").alias("n_parts"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.array_sort(F.collect_list(F.struct(F.col("part").alias("at"), "root"))).alias("roots"))
    return rows.mapInArrow(_roots, "n_parts bigint, n_docs bigint, n_tokens bigint, root binary")


def verify(spark: SparkSession, path: str) -> None:
    """Raise ValueError unless documents, parts and store agree with the roots and counts written for them."""
    manifest = spark.read.parquet(f"{path}/manifest")
    values = ["n_docs", "n_tokens", "root"]
    seen = part_sums(spark.read.parquet(f"{path}/parts")).select("part", F.struct(*values).alias("seen"))
    wrong = manifest.select("part", F.struct(*values).alias("written")).join(seen, "part", "full").where(~F.col("written").eqNullSafe(F.col("seen")))
    if damaged := [r.part for r in wrong.select("part").limit(5).collect()]:
        raise ValueError(f"parts {damaged} do not agree with the manifest of {path}")
    if _whole(manifest).exceptAll(spark.read.parquet(f"{path}/store")).count():
        raise ValueError(f"the manifest of {path} does not agree with its root")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store with their global start."""
    starts = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("before"))
    return spark.read.parquet(f"{path}/parts").join(starts, "part").select("part", "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "root", "digests")


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Check each stored chunk against its digest; its length and CRC-32."""
    for batch in batches:
        sizes, sums = [], []
        for digest, payload in zip(batch.column(0), batch.column(1), strict=True):
            raw = unpack(payload.as_py()).tobytes()
            if _digest(raw) != digest.as_py():
                raise ValueError(f"chunk {digest.as_py().hex()} is damaged")
            sizes.append(len(raw))
            sums.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["digest", "n_bytes", "crc"])


def _shift_matrix() -> list[list[int]]:
    """powers[k] applies 2**k zero bytes to a CRC-32, as a matrix over GF(2) by columns."""
    one = [0xEDB88320, *(1 << i for i in range(31))]
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    for _ in range(3):  # a bit, 2, 4, 8 bits
        one = [times(one, c) for c in one]
    powers = [one]
    for _ in range(40):
        powers.append([times(powers[-1], c) for c in powers[-1]])
    return powers


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


_SHIFTS = _shift_matrix()


def combine_crc32(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two joined byte strings, from theirs and the length of the second."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            first = _xor(c for i, c in enumerate(_SHIFTS[k]) if first >> i & 1)
        n_bytes >>= 1
        k += 1
    return first ^ second


def _joined_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sums = [], []
        for doc, start, root, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            crc = 0
            for p in parts:
                if p["crc"] is None:
                    raise ValueError(f"document {doc} at {start}: chunk {p['digest'].hex()} is missing")
                crc = combine_crc32(crc, p["crc"], p["n_bytes"])
            if merkle_root([p["digest"] for p in parts]) != root:
                raise ValueError(f"document {doc} at {start}: its chunks do not give its Merkle root")
            sizes.append(sum(p["n_bytes"] for p in parts) // 4)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of a store.

    Counts and roots of parts and store are verified first. Every stored chunk is read, checked against
    its digest and summed; a document's CRC-32 follows from its chunks' (CRCs of joined strings combine),
    so no ids are shuffled: only digests are. A missing or damaged chunk, document or part is an error.
    """
    verify(spark, path)
    sums = spark.read.parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(_chunk_sums, "digest binary, n_bytes bigint, crc bigint")
    exploded = recipes(spark, path).select("doc_id", "start", "root", F.posexplode("digests").alias("pos", "digest"))
    # a document has at least its end id, so starts are unique
    per_doc = exploded.join(sums, "digest", "left").groupBy("doc_id", "start", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes", "crc"))).alias("parts"))
    return per_doc.mapInArrow(_joined_sums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian 32-bit) of each document, rebuilt from its chunks."""
    verify(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "payload")
    exploded = recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    grouped = exploded.join(chunks, "digest", "left").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column(2).to_pylist():
                if missing := [p["digest"].hex() for p in parts if p["payload"] is None]:
                    raise ValueError(f"chunks {missing[:3]} are missing")
                ids.append(b"".join(unpack(p["payload"]).tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return grouped.mapInArrow(run, "doc_id bigint, start bigint, ids binary")
