"""Phrase collocations: generalised suffix automata of shards, counts reduced over the corpus.

A shard is a block of texts. Its automaton has the words of all its pieces as alphabet and is bounded
in depth: a state is a class of phrases with the same end positions, written down by the longest of
them, the length of the shortest, and the number of end positions; its suffix link leads to the
longest suffix with more of them. It is built level by level with numpy: the windows of d words are
ranked by the ranks of their first d - 1 words and their last word, which gives the endpos counts, and
a window whose suffix ends at as many places shares that suffix's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import materialize
from millrace.llm.textblocks import LOWER, byte_table, gram_hashes, span_hashes, text_blocks, word_spans

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of the filter of frequent words or pairs: its size is fixed, and a bit too many costs time, never a result.
FILTER_BITS = 1 << 26
#: Bytes of a shard (a longer text is one of its own), and shares of a hot word's or language's rows.
SHARD_BYTES, SALTS = 2 << 20, 16

_BREAK = byte_table([(c, c) for c in b".,;:!?"] + [(0x0A, 0x0D)])
_WORD = ~(_BREAK | byte_table([(0x20, 0x20), (0x09, 0x09)]))
_STATES = "lang string, phrase string, longest int, shortest int, f bigint"


@dataclass
class Automaton:
    """States in order of their longest phrases' lengths, without the root."""

    longest: np.ndarray  # words of the longest phrase
    shortest: np.ndarray  # words of the shortest phrase
    count: np.ndarray  # end positions
    start: np.ndarray  # where a longest phrase begins
    link: np.ndarray  # the state of the longest suffix with more end positions, -1: the root


def suffix_automaton(symbols: np.ndarray, ends: np.ndarray, depth: int) -> Automaton:
    """The automaton of the pieces of ``symbols``; ``ends[i]`` is where the piece of place i ends. Phrases have ``depth`` symbols at most."""
    places, rank, counts = np.arange(len(symbols)), np.zeros(len(symbols) + 1, np.int64), np.zeros(1, np.int64)
    base, levels = int(symbols.max(initial=0)) + 1, []
    for d in range(1, depth + 1):
        places = places[places + d <= ends[places]]
        # rank: of the d - 1 symbols from each place
        _, first, own, n = np.unique(rank[places] * base + symbols[places + d - 1], return_index=True, return_inverse=True, return_counts=True)
        suffix = rank[places[first] + 1]
        levels.append((places[first], n, suffix, n == counts[suffix]))
        rank[places], counts = own, n
    # a phrase belongs to the state of the longer one that ends at the same places, if there is one
    state = [np.full(len(n), -1) for _, n, _, _ in levels]
    parts, total = [], 0
    for d in reversed(range(len(levels))):
        at, n, suffix, shares = levels[d]
        mine = np.flatnonzero(state[d] < 0)
        state[d][mine] = total + np.arange(len(mine))
        total += len(mine)
        parts.append((np.full(len(mine), d + 1), n[mine], at[mine]))
        if d:
            state[d - 1][suffix[shares]] = state[d][shares]
    shortest, link = np.zeros(total, np.int64), np.full(total, -1)
    for d, (_, _, suffix, shares) in enumerate(levels):
        lone = state[d][~shares]
        shortest[lone] = d + 1
        if d:
            link[lone] = state[d - 1][suffix[~shares]]
    longest, count, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Automaton(longest, shortest, count, start, link)


class Filter:
    """Keys of frequent (lang, phrase), as bits of a fixed number: tells surely which are not frequent."""

    def __init__(self, bits: bytes):
        self._bits = np.frombuffer(bits, np.uint8)

    @staticmethod
    def positions(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - (FILTER_BITS - 1).bit_length())).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.positions(keys)
        return (self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _keys(langs: pa.Array, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key of each word with its row's language."""
    names = langs.dictionary_encode()
    raw = b"".join(x.encode() for x in names.dictionary.to_pylist())
    cuts = np.cumsum([0, *(len(x.encode()) for x in names.dictionary.to_pylist())])
    of_lang = span_hashes(np.frombuffer(raw, np.uint8), cuts[:-1], cuts[1:])
    return of_lang[names.indices.to_numpy()[rows]] ^ span_hashes(data, starts, ends)


def frequent_filter(phrases: DataFrame) -> Filter:
    """The filter of ``phrases(lang, phrase)`` of one or two words. Bits are set in tasks; the driver gets FILTER_BITS of them at any size."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "phrase"):
                starts, ends, rows = word_spans(data, offsets, _WORD)
                keys = _keys(part.column(0), rows, data, starts, ends)
                second = np.flatnonzero(np.diff(rows, prepend=-1) == 0)
                alone = np.diff(rows, prepend=-1, append=-1)
                alone = (alone[:-1] != 0) & (alone[1:] != 0)
                both = np.concatenate((keys[alone], gram_hashes(keys, 2)[second - 1] if len(second) else keys[:0]))
                yield pa.RecordBatch.from_arrays([pa.array(Filter.positions(both) + 1)], ["at"])

    found = phrases.select("lang", "phrase").mapInArrow(positions, "at bigint")
    rows = found.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = r.bits
    return Filter(bytes(out))


def _ends(fresh: np.ndarray) -> np.ndarray:
    """Where the piece of each place ends; ``fresh`` tells where pieces begin."""
    begins = np.flatnonzero(fresh)
    return np.repeat(np.append(begins[1:], len(fresh)), np.diff(np.append(begins, len(fresh)))) if len(fresh) else begins


def _shards(sizes: tuple[int, int], known: Callable[[], Filter] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """States with phrases of ``sizes`` words of each shard. ``known`` has the frequent words (for pairs) or pairs (for longer phrases)."""
    low, high = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text", SHARD_BYTES):
                data = LOWER[data]
                starts, ends, rows = word_spans(data, offsets, _WORD)
                if not len(starts):
                    continue
                flag = _WORD[data]
                texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)), pa.py_buffer(data[flag]))
                broken = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
                fresh = np.diff(rows, prepend=-1) + np.diff(broken, prepend=-1) != 0
                langs = part.column(0).dictionary_encode()
                lang = langs.indices.to_numpy()[rows].astype(np.int64)
                if known is not None:
                    keys = _keys(part.column(0), rows, data, starts, ends)
                    if low == 2:
                        alive = known().has(keys)
                    else:
                        fresh[1:] |= ~known().has(gram_hashes(keys, 2))
                        alive = _ends(fresh) - np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0)) >= low
                    lost = np.cumsum(~alive)
                    fresh, lang, rows = fresh[alive] | (np.diff(lost[alive], prepend=-1) != 0), lang[alive], rows[alive]
                    texts = texts.filter(pa.array(alive))
                words = texts.dictionary_encode()
                codes = words.indices.to_numpy().astype(np.int64)
                if len(codes):
                    a = suffix_automaton(lang * len(words.dictionary) + codes, _ends(fresh), high)
                    keep = np.flatnonzero(a.longest >= low)
                    size, at = a.longest[keep], a.start[keep]
                    bounds = np.concatenate(([0], np.cumsum(size)))
                    flat = np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])
                    phrases = words.dictionary.take(pa.array(codes[flat]))
                    phrases = phrases if high == 1 else pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), phrases), " ")
                    columns = [langs.dictionary.take(pa.array(lang[at])), phrases, pa.array(size, pa.int32()), pa.array(np.maximum(a.shortest[keep], low), pa.int32()), pa.array(a.count[keep], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "longest", "shortest", "f"])
                if low == 1:  # the roots: all places of a language
                    n = np.bincount(lang, minlength=len(langs.dictionary))
                    none = pa.array(np.zeros(len(n)), pa.int32())
                    yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([""] * len(n)), none, none, pa.array(n, pa.int64())], ["lang", "phrase", "longest", "shortest", "f"])

    return run


def _words(count: Column) -> Column:
    """The first ``count`` words of ``phrase``, or its last ones for a negative count."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), count)


def _counted(texts: DataFrame, sizes: tuple[int, int], least: int, known: DataFrame | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``sizes`` words with f >= ``least``, and of the empty phrase where sizes begin at 1."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_filter(known)) if known is not None else None
    states = texts.mapInArrow(_shards(sizes, (lambda: shared.value) if shared else None), _STATES)
    if sizes[0] < sizes[1]:  # all phrases of a state, by their lengths
        states = states.select("lang", "phrase", "f", F.explode(F.sequence("shortest", "longest")).alias("size"))
        states = states.select("lang", _words(-F.col("size")).alias("phrase"), "f")
    return materialize(states.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f): all phrases of up to ``longest`` words with f >= ``least``, and the empty one with all words' count.

    A phrase is frequent only if its words and pairs are: pairs are counted within runs of frequent
    words, longer ones within runs of frequent pairs, each in one more pass over the texts.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = _counted(texts, (1, 1), least, None)
    pairs = _counted(texts, (2, 2), least, words.where("phrase <> ''"))
    return words.union(pairs).union(_counted(texts, (3, longest), least, pairs)) if longest > 2 else words.union(pairs)


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's best ``top`` phrases of ``docs(lang, text)``: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase and of its two parts at the lowest-scoring cut, n that of
    all words, score floor(1000 * a * n / (l * r)) in decimals of 38 digits. A phrase within a longer
    one of the same count is left out: links of the corpus's automaton, over prefixes and suffixes, tell
    so from phrases of one word more, since counts do not rise with length. Null texts are empty; a null
    lang is ``und``; rows that repeat count each time; an empty table gives no phrases.

    Shards emit one row for each state, whose phrases are told apart and summed by partial aggregates.
    What is broadcast is a filter of FILTER_BITS bits. Parts of one word are joined under SALTS copies,
    and a language's best are taken within SALTS shares first.
    """
    known = frequent_phrases(docs, longest, least)
    totals = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    size = F.size(F.split("phrase", " "))
    phrases = known.where("phrase <> ''").select("lang", "phrase", "f", size.alias("size"))
    found = phrases.where("size > 1")

    inner = found.where("size > 2").select("lang", F.explode(F.array(_words(F.col("size") - 1), _words(1 - F.col("size")))).alias("phrase"), "f")
    both = found.select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("bigint").alias("over")).union(inner.select("lang", "phrase", F.lit(None).cast("bigint"), "f"))
    kept = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("over").alias("over")).where("over is null or over < a").select("lang", "phrase", "a")

    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)).alias("k"))
    cuts = cuts.select("*", _words(F.col("k")).alias("left"), _words(F.col("k") - F.size(F.split("phrase", " "))).alias("right"))
    salted = lambda part: F.when(F.instr(part, " ") == 0, salt).otherwise(0)
    cuts = cuts.withColumn("ls", salted(F.col("left"))).withColumn("rs", salted(F.col("right")))
    parts = phrases.where(F.col("size") < longest).select("lang", "phrase", "f", F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    named = lambda p, s, f: parts.select("lang", F.col("phrase").alias(p), F.col("salt").alias(s), F.col("f").alias(f))
    cuts = cuts.join(named("left", "ls", "l"), ["lang", "left", "ls"]).join(named("right", "rs", "r"), ["lang", "right", "rs"])

    cuts = cuts.join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * whole("a")) * whole("n"), whole("l") * whole("r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rank = lambda *share: F.row_number().over(Window.partitionBy("lang", *share).orderBy(*order))
    best = lowest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", rank("share")).where(F.col("rank") <= top)
    return best.withColumn("rank", rank().cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
