"""Places of pattern matches in a text, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries summed in one pass; sums of blocks are then joined, so time grows with the entries and not with their square.
_BLOCK = 512


def running_sums(sizes: Column) -> Column:
    """array<int>: for each entry of an array of ints, the sum of those before it."""
    none = F.array().cast("array<int>")

    def block(b: Column) -> Column:
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(F.slice(sizes, b * _BLOCK + 1, _BLOCK), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), block)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    join = lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(F.transform(b["out"], lambda n: n + s["at"]))).alias("out"))
    return F.when(F.size(sizes) > 0, F.flatten(F.aggregate(blocks, start, join)["out"])).otherwise(none)


def match_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches, in code points.

    Gaps and matches alternate in a text, so the running sums of their lengths give the places.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    # the last gap has no match: it is left out
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("value")))
    begins = running_sums(F.transform(pairs, lambda p: p["gap"] + p["n"]))
    return F.zip_with(pairs, begins, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("stop"), p["value"].alias("value")))
