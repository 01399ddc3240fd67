"""Byte-pair encoding of whole texts by the tiktoken and tokenizers libraries, and decoding.

Both vocabularies split a text before merging, and no piece spans the start of ASCII white space
after a visible character, or the step from a letter to an ASCII mark; so a text may be cut
there without changing its ids. Each distinct
segment is encoded once by the library and its ids are gathered for all its occurrences.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from millrace.llm.textblocks import LOWER, byte_table, span_hashes, text_blocks

#: Segments whose ids are kept; beyond, the cache starts anew. A tokenizer file's cache lives as long
#: as the Python worker; a rank file's, whose library is fast, as long as a task.
CACHE_SEGMENTS, TASK_SEGMENTS = 800_000, 200_000
_SPACE = byte_table([(0x09, 0x0D), (0x20, 0x20)])
_VISIBLE = byte_table([(0x21, 0x7E), (0x80, 0xFF)])
_LETTER = byte_table([(0x41, 0x5A), (0x61, 0x7A)])
_MARKS = byte_table([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
#: First bytes of two-byte characters that are all letters, and 0xC3, whose two signs are not.
_LETTER_LEAD = byte_table([(0xC3, 0xC5), (0xD0, 0xD1)])
_SIGN_TAIL = byte_table([(0x97, 0x97), (0xB7, 0xB7)])
#: Second last bytes of characters that Unicode counts as white space (and of some others): no cut after these.
_MAYBE_SPACE = byte_table([(0xC2, 0xC2), (0x9A, 0x9A), (0x80, 0x81)])


def safe_segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of segments that cover all bytes: cut where white space follows a visible
    character, or an ASCII mark a letter; ``bounds`` are where rows begin among them (rows + 1 positions)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data), bool)
    cut[1:] = _SPACE[data[1:]] & _VISIBLE[data[:-1]]
    cut[2:] &= ~((data[1:-1] >= 0x80) & _MAYBE_SPACE[data[:-2]])
    marks = _MARKS[data]
    cut[1:] |= marks[1:] & _LETTER[data[:-1]]
    cut[2:] |= marks[2:] & _LETTER_LEAD[data[:-2]] & ~_SIGN_TAIL[data[1:-1]]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class SegmentEncoder:
    """Encodes blocks of texts; ``encode_all`` is the library's call on a list of strings: how many
    ids each has, and all ids.

    ``fold``: the vocabulary ignores the case of A-Z and white space before a segment, so segments
    that differ in these only are one. Texts that hold one of the strings ``whole`` (the vocabulary's
    added tokens, which the library finds before all else) go through the library as they are.
    """

    def __init__(self, encode_all: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fold: bool = False, limit: int = CACHE_SEGMENTS, whole: tuple[bytes, ...] = ()):
        self.encode_all, self.fold, self.limit, self.whole = encode_all, fold, limit, whole
        self._reset()

    def _reset(self) -> None:
        self.place: dict[int, int] = {}
        self.used = 0
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _add(self, keys: list[int], segments: list[str]) -> np.ndarray:
        """Places of new segments."""
        sizes, flat = self.encode_all(segments)
        k, n = len(self.place), len(self.place) + len(keys)
        self.place.update(zip(keys, range(k, n), strict=True))
        self.ids, self.start, self.size = _room(self.ids, self.used + len(flat)), _room(self.start, n), _room(self.size, n)
        self.start[k:n], self.size[k:n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return np.arange(k, n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where each row's begin (rows + 1 positions)."""
        raw = data.tobytes() if self.whole else b""
        if not any(w in raw for w in self.whole):
            return self._encode(data, offsets)
        ids, sizes = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if any(raw.find(w, a, b) >= 0 for w in self.whole):
                own = self.encode_all([raw[a:b].decode()])[1]
            else:
                own = self._encode(data[a:b], np.array([0, b - a]))[0]
            ids.append(own)
            sizes.append(len(own))
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(sizes)))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, bounds = safe_segments(data, offsets)
        if not len(starts):
            return self.ids[:0], bounds
        if self.fold:
            data = LOWER[data]
            starts = starts + (_SPACE[data[starts]] & (ends - starts > 1))
        codes, unique = pd.factorize(span_hashes(data, starts, ends))
        if len(self.place) + len(unique) > self.limit:
            self._reset()
        keys = unique.tolist()
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            # codes count up in order of first occurrence
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))[new]
            raw = data.tobytes()
            at[new] = self._add(unique[new].tolist(), [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sizes, begin = self.size[at][codes], self.start[at][codes]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        gather = np.repeat(begin - total[:-1], sizes)
        gather += np.arange(total[-1])
        return self.ids[gather], total[bounds]


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """``held``, or a copy with more room if it has less than ``n``."""
    return held if n <= len(held) else np.concatenate((held, np.zeros(max(n, len(held) * 3 // 2) - len(held), held.dtype)))


def _flat(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    return sizes, np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))


_encoders: dict[str, SegmentEncoder] = {}
_libraries: dict[str, tiktoken.Encoding] = {}


def rank_file_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """tiktoken's encoding of a local rank file; one for each Python worker."""
    if path not in _libraries:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _libraries[path] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _libraries[path]


def rank_file_encoder(path: str, pattern: str) -> SegmentEncoder:
    encoding = rank_file_encoding(path, pattern)
    return SegmentEncoder(lambda texts: _flat([encoding.encode_ordinary(x) for x in texts]), limit=TASK_SEGMENTS)


#: A character put between segments, as a piece of its own, when many go through the library in one call.
MARK, JOINED = "\x01", 64


def _encode_joined(tokenizer: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of all texts. One call for many short texts, as a call for each costs more than its merges.

    The mark is one id that can only come from the mark's own byte, so it shows where texts end; if
    the counts do not agree, as a text holds the mark, each text goes through the library alone.
    """
    alone = lambda some: [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    mark = alone([MARK])[0]
    sizes, ids = [], []
    for at in range(0, len(texts), JOINED):
        part = texts[at : at + JOINED]
        found = np.array(alone([f" {MARK} ".join([*part, ""])])[0], np.uint32)
        ends = np.flatnonzero(found == mark[0])
        if len(part) > 1 and len(mark) == 1 and len(ends) == len(part):
            sizes.append(np.diff(ends, prepend=-1) - 1)
            ids.append(np.delete(found, ends))
        else:
            size, found = _flat(alone(part))
            sizes.append(size)
            ids.append(found)
    return np.concatenate(sizes), np.concatenate(ids)


def tokenizer_file_encoder(path: str) -> SegmentEncoder:
    if path not in _encoders:
        tokenizer = Tokenizer.from_file(path)
        added = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())
        # one id for two texts that differ in case and white space: the file's normalizer ignores both
        fold = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("A  b") == tokenizer.normalizer.normalize_str("a b")
        _encoders[path] = SegmentEncoder(lambda texts: _encode_joined(tokenizer, texts), fold=fold, whole=added)
    return _encoders[path]


def _coded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_file_encoder(path, pattern)
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                ids, bounds = encoder.encode(data, offsets)
                raw = ids.astype("<u4").tobytes()
                blobs = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row of ``docs(doc_id, text)``.

    Ids are those of tiktoken's encode_ordinary on the whole text. Null and empty texts have no ids.
    A null doc_id is passed on; repeated rows give repeated results; extra columns are left out.
    """
    return docs.select("doc_id", "text").mapInArrow(_coded(ranks, pattern), "doc_id bigint, n_tokens bigint, ids binary")


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_file_encoding(path, pattern)
        size = max(encoding._mergeable_ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in encoding._mergeable_ranks.items():
            lengths[rank] = len(token)
        begin = np.concatenate(([0], np.cumsum(lengths)))
        table = np.zeros(begin[-1], np.uint8)
        for token, rank in encoding._mergeable_ranks.items():
            table[begin[rank] : begin[rank + 1]] = np.frombuffer(token, np.uint8)
        for batch in batches:
            texts = []
            for blob in batch.column(2):
                ids = np.frombuffer(blob.as_buffer() or b"", "<u4") if blob.is_valid else np.zeros(0, "<u4")
                parts = []
                for at in range(0, len(ids), 1 << 18):  # bounded index arrays for very long texts
                    part = ids[at : at + (1 << 18)]
                    sizes = lengths[part]
                    total = np.cumsum(sizes)
                    parts.append(table[np.repeat(begin[part] - total + sizes, sizes) + np.arange(total[-1])].tobytes())
                texts.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded(doc_id, n_tokens, ids)`` with decoded: the concatenated raw bytes of the ids (which need not be UTF-8)."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoded(ranks, pattern), "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass: a task needs one Python worker, and ids stay in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(ranks, pattern)(_coded(ranks, pattern)(batches))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
