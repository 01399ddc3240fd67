"""Substring dedup by content-defined chunks: cuts by a gear rolling hash, digests, and first owners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize
from millrace.llm.textblocks import CODES, text_blocks

#: Bytes under the gear hash; a cut follows the byte whose hash is the least within REACH bytes on
#: either side (chunks of about 49 bytes); LONGEST bounds a chunk of text without such bytes.
GEAR, REACH, LONGEST = 32, 24, 1024
#: Runs of repeated chunks are removed from this many bytes. Shorter repeats (a common line) stay. The
#: chunks at either end of a repeat may differ, so one of about 100 to 300 bytes may hold no such run.
LEAST_RUN = 90
_TABLE = (CODES >> np.uint64(31)).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, rows) of the chunks of each row, in order. They depend on the row's own bytes near a
    cut only, so insertions move no cuts but those near them."""
    n_rows, sizes = len(offsets) - 1, np.diff(offsets)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = REACH + 1
    row = np.repeat(np.arange(n_rows), sizes)
    place = np.arange(len(data)) + (row + 1) * gap
    h = np.zeros(len(data) + (n_rows + 1) * gap, np.uint32)
    h[place] = _TABLE[data]
    span = 1
    while span < GEAR:  # h[i]: sum of table[byte i - j] << j over GEAR bytes
        step = np.zeros_like(h)
        step[span:] = h[:-span] << np.uint32(span)
        h += step
        span *= 2
    h = h * np.uint32(0x9E3779B1)
    full = np.full(len(h), 0xFFFFFFFF, np.uint32)
    # a row's first bytes have no full window of their own and are never cut after
    own = np.arange(len(data)) - offsets[row] >= GEAR - 1
    full[place[own]] = h[place[own]]
    least, width = full.copy(), 1  # least[i]: minimum of full[i : i + width]
    while width < REACH:
        step = min(width, REACH - width)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        width += step
    left = np.full(len(full), 0xFFFFFFFF, np.uint32)
    left[REACH:] = least[:-REACH]
    right = np.full(len(full), 0xFFFFFFFF, np.uint32)
    right[:-1] = least[1:]
    found = np.flatnonzero((full[place] < left[place]) & (full[place] <= right[place])) + 1
    for _ in range(3):  # never inside a character
        inside = (found < len(data)) & ((data[np.minimum(found, len(data) - 1)] & 0xC0) == 0x80)
        found = found + inside
    ends = np.unique(np.concatenate((found, offsets[1:][sizes > 0])))
    begins = np.concatenate(([0], ends[:-1]))
    if (ends - begins > LONGEST).any():
        more = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(begins, ends, strict=True) if b - a > LONGEST]
        extra = np.concatenate(more)
        for _ in range(3):
            extra = extra + ((data[np.minimum(extra, len(data) - 1)] & 0xC0) == 0x80)
        ends = np.unique(np.concatenate((ends, extra)))
    return ends, row[ends - 1]


_OCCURRENCE = "d bigint, t bigint, seq int, start int, stop int, high bigint, low bigint"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, "text"):
            ends, row = cut_points(data, offsets)
            if not len(ends):
                continue
            begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
            raw = data.tobytes()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), "<i8").reshape(-1, 2)
            seq = np.arange(len(ends)) - np.searchsorted(row, row)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(at), rows.column(1).take(at), pa.array(seq, pa.int32()), pa.array(begins - offsets[row], pa.int32()), pa.array(ends - offsets[row], pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])],
                ["d", "t", "seq", "start", "stop", "high", "low"],
            )


def _without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the byte ranges of long enough runs of repeated chunks; a chunk without an owner repeats its own document."""
    for batch in batches:
        out: list[tuple] = []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            text, found = text.as_py(), found.as_py() or []
            runs: list[dict] = []
            for c in sorted(found, key=lambda c: c["seq"]):
                if runs and runs[-1]["next"] == c["seq"]:
                    runs[-1]["stop"], runs[-1]["next"] = c["stop"], c["seq"] + 1
                    runs[-1]["owners"].add((c["other"], c["owner"]))
                else:
                    runs.append({"start": c["start"], "stop": c["stop"], "next": c["seq"] + 1, "owners": {(c["other"], c["owner"])}})
            runs = [r for r in runs if r["stop"] - r["start"] >= LEAST_RUN]
            if runs:
                raw, parts, at = text.encode(), [], 0
                for r in runs:
                    parts.append(raw[at : r["start"]])
                    at = r["stop"]
                kept = b"".join([*parts, raw[at:]]).decode()
                others = sum(any(other for other, _ in r["owners"]) for r in runs)
                owners = sorted({o for r in runs for other, o in r["owners"] if other and o is not None})
                out.append((others, len(runs) - others, len(text) - len(kept), owners, kept))
            else:
                out.append((0, 0, 0, [], text))
        n, own, removed, owners, texts = zip(*out, strict=True) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, own, removed)), pa.array(owners, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["doc_id", "n_runs", "n_own_runs", "n_removed", "first_doc_ids", "text"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``, with passages that stand earlier in the corpus removed.

    Columns: doc_id, n_runs (runs removed that other documents keep), n_own_runs (runs removed that the
    document itself has before), n_removed (code points), first_doc_ids (the other documents that keep
    passages, sorted), text. Texts are cut into content-defined chunks; of the occurrences of a digest
    the one with the least (doc_id, text hash, place) owns it; runs of consecutive chunks owned elsewhere
    are removed from LEAST_RUN bytes on. Shorter repeats stay, so short copies of short texts do.

    Null texts stay null; empty texts and those without repeats stay as they are. A null doc_id
    comes before all others and is left out of first_doc_ids. Rows with equal doc_id and text are
    one document: each gets that document's result, and none is a repeat of another. Digests are reduced
    by partial sums before any shuffle, and those that repeat are written before their occurrences are
    joined to them, so Spark can split the rows of a passage that a third of all documents share.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"))
    occurrences = keyed.select("d", "t", "text").mapInArrow(_chunked, _OCCURRENCE)
    key = ["high", "low"]
    firsts = occurrences.groupBy(*key).agg(F.min(F.struct("d", "t", "seq")).alias("first"), F.count("*").alias("n"))
    shared = materialize(firsts.where("n > 1").select(*key, "first"), "shared")
    repeats = occurrences.join(shared, key).where(F.struct("d", "t", "seq") != F.col("first"))
    other = (F.col("d") != F.col("first.d")) | (F.col("t") != F.col("first.t"))
    owner = F.when(F.col("first.d") != -(1 << 63), F.col("first.d"))
    # equal rows have the same chunks: a set holds each once
    per_doc = repeats.groupBy("d", "t").agg(F.collect_set(F.struct("seq", "start", "stop", other.alias("other"), owner.alias("owner"))).alias("found"))
    joined = keyed.join(per_doc.hint("shuffle_hash"), ["d", "t"], "left")
    return joined.select("doc_id", "text", "found").mapInArrow(_without_runs, "doc_id bigint, n_runs bigint, n_own_runs bigint, n_removed bigint, first_doc_ids array<bigint>, text string")
