"""Citations in answers and their grounding (STR-10, STR-11, ETL-30, ETL-33)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Citation formats.
DOC = r"\[doc:([^\]\s]+?)(?:\s+p\d+)?\]"
BARE = r"(?i)\[([a-f0-9]{6,})(?:\s+p\d+)?\]"
LEAST_PREFIX = 6


def cited_docs(text: Column) -> Column:
    """Distinct ids in [doc:...] and bare [hash] citations, sorted."""
    both = F.concat(F.regexp_extract_all(text, F.lit(DOC), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)), F.lower))
    return F.array_sort(F.array_distinct(both))


def resolved(cited: Column, available: Column) -> Column:
    """The available id that a citation names, in full or by six or more leading characters; else null."""
    prefixed = F.filter(available, lambda a: (F.length(cited) >= LEAST_PREFIX) & a.startswith(cited))
    return F.when(F.array_contains(available, cited), cited).otherwise(F.get(F.array_sort(prefixed), 0))


def grounding(text: Column, available: Column) -> Column:
    """struct(grounding, confidence) of an answer against the ids of its evidence."""
    cited = cited_docs(text)
    strange = F.exists(cited, lambda c: resolved(c, available).isNull())
    kind = F.when(strange, "unverified").when(F.size(cited) == 0, "general").otherwise("documents")
    sure = F.when(strange, "low").when(F.size(cited) >= 2, "high").otherwise("medium")
    return F.struct(kind.alias("grounding"), sure.alias("confidence"))


def citation_hit(cited_files: Column, expected: Column) -> Column:
    return F.exists(cited_files, lambda c: F.exists(expected, lambda e: F.contains(c, e)))
