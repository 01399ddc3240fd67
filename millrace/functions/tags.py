"""Equipment and instrument tags, slugs and canonical ids (STR-1..5, STR-9, STR-19, PRJ-8, PRJ-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag grammar, instrument prefixes and id prefixes of the data model.
TAG = r"\b([A-Za-z]{1,4})[-\s]?(\d{2,5})(?:\s*([A-Za-z])(?![-\s]?\d{2,5}))?\b"
CLEAN_TAG = r"^([A-Z]{1,4})-?(\d{2,5})-?([A-Z]?)$"
INSTRUMENT_PREFIXES = ("PI", "PT", "PIC", "PSV", "PCV", "TI", "TT", "TIC", "TCV", "FI", "FT", "FIC", "FCV", "LI", "LT", "LIC", "LCV", "AI", "AT", "XV", "HS")
ID_PREFIXES = {"Equipment": "equip", "Instrument": "inst", "Line": "line", "Document": "doc", "Section": "sec", "Chunk": "chunk", "WorkOrder": "wo", "FailureMode": "fm", "FaultMode": "fault", "Procedure": "proc", "RegulationClause": "reg", "Person": "person"}


def _squeezed(raw: Column) -> Column:
    return F.regexp_replace(F.upper(raw), r"[\s_]+", "")


def normalize(raw: Column) -> Column:
    """A tag in its one form, with a hyphen before its number; what is no tag is trimmed and upper-cased."""
    clean = F.regexp_replace(_squeezed(raw), "&", "")
    return F.when(clean.rlike(CLEAN_TAG), F.regexp_replace(clean, CLEAN_TAG, "$1-$2$3")).otherwise(F.upper(F.trim(raw)))


def looks_like_tag(raw: Column) -> Column:
    return _squeezed(raw).rlike(CLEAN_TAG)


def is_instrument(tag: Column) -> Column:
    return F.substring_index(tag, "-", 1).isin(*INSTRUMENT_PREFIXES)


def find_tags(text: Column) -> Column:
    """Normalised tags of all tag-shaped mentions, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), normalize)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_id(label: Column, surface: Column) -> Column:
    """An id that depends on label and normalised surface only; unknown labels give null."""
    prefix = F.create_map(*(F.lit(x) for pair in ID_PREFIXES.items() for x in pair))[label]
    body = F.when(label.isin("Equipment", "Instrument", "Line"), normalize(surface)).when(label.isin("Document", "Section", "Chunk"), surface).when(label == "WorkOrder", F.upper(F.trim(surface))).otherwise(slug(surface))
    return F.concat(prefix, F.lit(":"), body)


def failure_mode(label: Column) -> Column:
    return F.replace(F.upper(F.trim(label)), F.lit(" "), F.lit("-"))


def family_of(tag: Column) -> Column:
    """The tag without its trailing capitals; null where nothing would be left (a family of all is no family)."""
    cut = F.regexp_replace(tag, "[A-Z]+$", "")
    return F.when(cut != "", cut)


def unit_area(tag: Column) -> Column:
    return F.substring_index(tag, ".", 1)


def doc_of_chunk(chunk_id: Column) -> Column:
    return F.substring_index(F.regexp_replace(chunk_id, "^chunk:", ""), "#", 1)
