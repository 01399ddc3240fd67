"""Benchmark decontamination by winnowing: k-gram fingerprints, a join, and extended exact hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize
from millrace.llm.textblocks import ALNUM, LOWER, gram_hashes, row_bounds, span_hashes, text_blocks, word_spans

#: Words in a window that counts as shared, and in the k-grams whose hashes are fingerprints. Each
#: run of WINDOW - GRAM + 1 consecutive k-grams keeps its least hash, so every shared span of WINDOW
#: words shares a kept fingerprint.
WINDOW, GRAM = 10, 5
#: The benchmark goes to the executors as one index up to this many bytes of text; beyond it, fingerprints
#: are joined by a shuffle. Its windows are at most half its bytes, and one takes about 1 kB of the index
#: (92 MB for 100,000), so an index takes 64 MB of a Python worker at most.
INDEX_BYTES = 131_072
RESULT = "n_words bigint, n_hit bigint, item_ids array<string>"


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost least hash of each ``width`` consecutive hashes (all of fewer: one)."""
    n = len(hashes)
    if n <= width:
        return np.array([int(np.argmin(hashes))]) if n else np.zeros(0, np.int64)
    least, span = np.arange(n), 1
    while span < width:  # doubling: least[i] is where the window of ``span`` hashes from i has its minimum
        step = min(span, width - span)
        a, b = least[: len(least) - step], least[step:]
        least, span = np.where(hashes[b] < hashes[a], b, a), span + step
    return np.unique(least)


def item_words(text: str | None) -> list[bytes]:
    """The words of a text, as bytes."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _hash_words(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(data, ends - np.array([len(w) for w in words]), ends)


class WindowIndex:
    """Windows of benchmark items, found by the fingerprints that winnowing keeps of them.

    Short items (fewer words than WINDOW) are one window of their own length; below GRAM words their
    only k-gram is the whole item.
    """

    def __init__(self, items: list[tuple[str, str | None]]):
        self.windows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = item_words(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                self.windows.setdefault(tuple(words[i : i + WINDOW]), set()).add(item)
        # window length -> fingerprint -> [(window, offset of the fingerprint in it)]
        self.prints: dict[int, dict[int, list[tuple[tuple[bytes, ...], int]]]] = {}
        for window in self.windows:
            k = min(GRAM, len(window))
            grams = gram_hashes(_hash_words(list(window)), k)
            if len(window) == WINDOW:
                at = int(np.argmin(grams))
            else:
                at = 0  # documents keep every k-gram for the short lengths
            self.prints.setdefault(len(window), {}).setdefault(int(grams[at]), []).append((window, at))
        self.sorted = {n: np.array(sorted(p), np.uint64) for n, p in self.prints.items()}

    def hits(self, data: np.ndarray, offsets: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Per row: words, words inside an occurring window, and the items with occurring windows."""
        low = LOWER[data]
        starts, ends, at = word_spans(low, offsets, ALNUM)
        words, bounds = span_hashes(low, starts, ends), row_bounds(at, n_rows)
        covered, items = np.zeros(len(words) + 1, np.int64), [set() for _ in range(n_rows)]
        for length, known in self.sorted.items():
            k = min(GRAM, length)
            grams = gram_hashes(words, k)
            kept = self._kept(grams, at, k, length)
            place = np.searchsorted(known, grams[kept])
            place[place == len(known)] = 0
            for p in kept[known[place] == grams[kept]] if len(kept) else ():
                for window, shift in self.prints[length][int(grams[p])]:
                    a = int(p) - shift
                    if a < bounds[at[p]] or a + length > bounds[at[p] + 1]:
                        continue
                    if all(bytes(low[starts[a + i] : ends[a + i]]) == w for i, w in enumerate(window)):
                        covered[a] += 1
                        covered[a + length] -= 1
                        items[at[p]] |= self.windows[window]
        inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
        return np.diff(bounds), inside[bounds[1:]] - inside[bounds[:-1]], items

    @staticmethod
    def _kept(grams: np.ndarray, at: np.ndarray, k: int, length: int) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.int64)
        whole = at[: len(grams)] == at[k - 1 :]
        kept = winnow(grams, WINDOW - GRAM + 1) if length == WINDOW else np.arange(len(grams))
        return kept[whole[kept]]


def _doc_fingerprints(lengths: list[int]):
    """Row key and kept fingerprints, for the window lengths that the benchmark has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                low = LOWER[data]
                starts, ends, at = word_spans(low, offsets, ALNUM)
                words = span_hashes(low, starts, ends)
                for length in lengths:
                    grams = gram_hashes(words, min(GRAM, length))
                    kept = WindowIndex._kept(grams, at, min(GRAM, length), length)
                    found = np.unique(np.stack((at[kept].astype(np.uint64), grams[kept])), axis=1)
                    pick = pa.array(found[0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pick), rows.column(1).take(pick), pa.array(found[1].astype(np.int64))], ["d", "t", "print"])

    return run


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of an item, as its words between spaces, with its length and fingerprint."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = WindowIndex([(item, text)]).prints
            rows = [(b" ".join(w).decode(), n, p) for n, prints in found.items() for p, windows in prints.items() for w, _ in windows]
            texts, lengths, prints = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.string()), pa.array(texts, pa.string()), pa.array(lengths, pa.int32()), pa.array(np.array(prints, np.uint64).astype(np.int64))], ["item", "window", "length", "print"])


def _columns(found: tuple[np.ndarray, np.ndarray, list[set[str]]]) -> list[pa.Array]:
    n, hit, items = found
    return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]


def _scan(index, passed: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                found = _columns(index.value.hits(data, offsets, rows.num_rows))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(passed))), *found], [*passed, "n_words", "n_hit", "item_ids"])

    return run


def _scan_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (doc_id, text, d, t, windows) against its own candidate windows; gives those that occur."""
    for batch in batches:
        for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
            index = WindowIndex([(w, w) for w in one.column(4).to_pylist()[0] or []])
            for rows, data, offsets in text_blocks(one, "text"):
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(4)), *_columns(index.hits(data, offsets, 1))], ["doc_id", "text", "d", "t", "n_words", "n_hit", "windows"])


def _clean_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                yield rows.filter(pa.array(index.value.hits(data, offsets, rows.num_rows)[1] == 0))

    return run


def _index(items: DataFrame, index_bytes: int):
    """The broadcast index, or None if the benchmark has more bytes than allowed."""
    size = items.agg(F.sum(F.octet_length("item_text")).alias("n")).first().n or 0
    return items.sparkSession.sparkContext.broadcast(WindowIndex([tuple(r) for r in items.distinct().collect()])) if size <= index_bytes else None


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("item_text"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` with n_words, n_hit and item_ids (sorted) of occurring benchmark windows.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is 10
    consecutive words of an item, or the whole of a shorter one. Fingerprints select candidates;
    every hit is confirmed word by word. Null texts have no words; items with null ids are named
    by the empty string; repeated items count once per id; an empty benchmark hits nothing.

    The benchmark's bytes are counted first: up to ``index_bytes`` its index is broadcast and
    documents are scanned in place; beyond, kept fingerprints of documents and of the benchmark's distinct
    windows are joined by a shuffle, each document is checked against its candidate windows only, and
    windows that occur are joined to their items. Both sides of joins are written or scanned, so that
    Spark can split a window that many documents share.
    """
    docs, items = docs.select("doc_id", "text"), _items(benchmark)
    if index := _index(items, index_bytes):
        return docs.mapInArrow(_scan(index, ("doc_id", "text")), f"doc_id bigint, text string, {RESULT}")
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"))
    of_items = materialize(items.distinct().mapInArrow(_item_windows, "item string, window string, length int, print bigint").distinct(), "windows")
    lengths = sorted(r.length for r in of_items.select("length").distinct().collect())  # WINDOW values at most
    prints = keyed.select("d", "t", "text").mapInArrow(_doc_fingerprints(lengths), "d bigint, t bigint, print bigint")
    windows = materialize(of_items.select("print", "window").distinct(), "prints")
    near = prints.join(windows, "print").groupBy("d", "t").agg(F.collect_set("window").alias("candidates"))
    scanned = keyed.join(near.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "d", "t", "candidates")
    scanned = materialize(scanned.mapInArrow(_scan_own, "doc_id bigint, text string, d bigint, t bigint, n_words bigint, n_hit bigint, windows array<string>"), "scanned")
    hit = scanned.where("n_hit > 0").select("d", "t", F.explode("windows").alias("window"))
    named = hit.join(of_items.select("window", "item"), "window").groupBy("d", "t").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return scanned.join(named.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "n_words", "n_hit", F.coalesce("item_ids", none).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The contract's columns for each document; see find_overlaps."""
    found = find_overlaps(docs, benchmark, index_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` (all columns, any names) without the rows that hold a benchmark window."""
    names, at = docs.columns, docs.columns.index("text")
    inner = docs.toDF(*["text" if i == at else f"c{i}" for i in range(len(names))])
    if index := _index(_items(benchmark), index_bytes):
        return inner.mapInArrow(_clean_rows(index), inner.schema).toDF(*names)
    keyed = inner.withColumn("k", F.xxhash64("text"))
    bad = find_overlaps(keyed.select(F.col("k").alias("doc_id"), "text"), benchmark, index_bytes).where("n_hit > 0").select(F.col("doc_id").alias("k")).distinct()
    return keyed.join(bad.hint("shuffle_hash"), "k", "left_anti").select(*inner.columns).toDF(*names)
