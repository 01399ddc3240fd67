"""Rules over labels, questions, permits and limits (FLT-12..14, STR-13..18, MTH-5..8, FLT-15..17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns that the rules of the data model name.
DOC_REFERENCE = r"(?i)^(IR|WO|INS|SOP|PD|IOM|DWG|PID)-?\d"
MECHANISMS = ("cavitation", "corrosion", "erosion", "fatigue", "fouling", "scaling", "blockage", "wear", "misalignment", "imbalance", "overload", "overheat", "contamination")
HYPHENATED_MECHANISMS = ("dead-head", "dead-headed")
CONNECTIVES = ("leading to", "led to", "due to", "caused by", "resulting in", "because of", "from")
CAUSAL_WORDS = ("why", "cause", "caused", "lead", "led", "result", "because", "affect", "impact", "downstream", "upstream", "explain how", "could", "trigger")
CAUSAL_TYPES = ("CONNECTED_TO", "HAS_FAILURE", "FIXED_BY")
COMPLIANCE_TYPES = ("GOVERNED_BY", "MENTIONED_IN")
COMPLIANCE_WORDS = ("standard", "regulation", "compliance", "overdue", "inspection", "governed", "oisd", "ibr", "statutory")
DIGEST_WORDS = ("overdue", "statutory", "inspection", "compliance", "most frequent", "most common", "how many", "which equipment")
PERMIT_RULES = (
    (r"(?i)\b(weld|cut|grind|spark|flame|hot.?work)\b", "Hot Work"),
    (r"(?i)\b(confined.?space|vessel|tank|manhole|enter)\b", "Confined Space Entry"),
    (r"(?i)\b(electrical|motor|panel|MCC|switchgear|de.?energ)\b", "Electrical Isolation"),
    (r"(?i)\b(cold.?work|mechanical|replac|overhaul|inspect)\b", "Cold Work"),
)
DRAWING_HINTS = ("pnid", "p&id", "pid-", "-pid", "dwg", "drawing")
SEVERITY_RANKS = {"info": 0, "warning": 1, "critical": 2}
MANUAL_PAGES, SNIFF_WORDS = 16, 30


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: low.contains(w)), F.lit(False))


def is_doc_reference(surface: Column) -> Column:
    return F.trim(surface).rlike(DOC_REFERENCE)


def looks_like_mechanism(label: Column) -> Column:
    """Any word of the label is a mechanism. Hyphenated entries are looked for in the whole label."""
    low = F.lower(label)
    words = F.arrays_overlap(F.split(low, r"[-\s]+"), F.array(*(F.lit(w) for w in MECHANISMS)))
    return words | low.rlike(rf"(^|[\s-])({'|'.join(HYPHENATED_MECHANISMS)})($|[\s-])")


def looks_like_sentence(label: Column) -> Column:
    low = F.replace(F.lower(label), F.lit("-"), F.lit(" "))
    return contains_any(low, CONNECTIVES) | (F.size(F.split(label, "-")) >= 5) | (F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) >= 6)


def route(question: Column, n_seeds: Column) -> Column:
    return F.when(n_seeds == 0, "vector").when((n_seeds >= 2) | contains_any(question, CAUSAL_WORDS), "path").otherwise("local")


def edge_types(question: Column) -> Column:
    some = lambda names: F.array(*(F.lit(n) for n in names))
    return F.when(contains_any(question, COMPLIANCE_WORDS), some(CAUSAL_TYPES + COMPLIANCE_TYPES)).otherwise(some(CAUSAL_TYPES))


def wants_digest(question: Column) -> Column:
    return contains_any(question, DIGEST_WORDS)


def permit_type(work: Column) -> Column:
    out = F.lit("General Maintenance")
    for pattern, kind in reversed(PERMIT_RULES):
        out = F.when(work.rlike(pattern), kind).otherwise(out)
    return out


def revision_key(revision: Column) -> Column:
    """Month words as stems, without case, spaces and punctuation."""
    stems = F.regexp_replace(F.coalesce(revision, F.lit("")), r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", "$1")
    return F.regexp_replace(F.lower(stems), "[^a-z0-9]", "")


def document_kind(filename: Column, sniff: Column, n_pages: Column) -> Column:
    """The lane of a document by name, first words and page count, in the order of precedence."""
    name = F.lower(filename)
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    words = F.size(F.filter(F.split(F.coalesce(sniff, F.lit("")), r"\s+"), lambda w: w != ""))
    hint = F.exists(F.array(*(F.lit(h) for h in DRAWING_HINTS)), lambda h: name.contains(h))
    return (
        F.when(name.endswith(".correction.md"), "correction")
        .when(ext.isin("csv", "tsv", "xlsx", "xls", "xlsm"), "table")
        .when(ext.isin("eml", "msg") | ((ext == "") & sniff.rlike(r"(?m)^(From|To|Subject|Received|Return-Path|Date):")), "email")
        .when((ext == "svg") | hint, "pnid")
        .when(ext.isin("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"), "image")
        .when(ext == "pdf", F.when((words > SNIFF_WORDS) & (n_pages >= MANUAL_PAGES), "manual").otherwise("text"))
        .otherwise("text")
    )


def level_inclusive(value: Column, ll: Column, l: Column, h: Column, hh: Column) -> Column:  # noqa: E741
    """HH, H, LL, L in this order; limits themselves count."""
    return F.when(value >= hh, "HH").when(value >= h, "H").when(value <= ll, "LL").when(value <= l, "L")


def level_strict(value: Column, ll: Column, l: Column, h: Column, hh: Column, lowest: Column, highest: Column) -> Column:  # noqa: E741
    """As level_inclusive, but limits themselves do not count; hh falls back to the maximum, ll to the minimum."""
    return F.when(value > F.coalesce(hh, highest), "HH").when(value > h, "H").when(value < F.coalesce(ll, lowest), "LL").when(value < l, "L")


def draft_priority(siblings: Column, count: Column, clauses: Column, verified: Column) -> Column:
    again = (siblings > 0) & (count >= 2)
    return (
        F.when(~verified, F.when(again, "medium").otherwise("low"))
        .when(again & (clauses > 0), "immediate")
        .when(again | (clauses > 0), "high")
        .when(count >= 2, "medium")
        .otherwise("low")
    )


def severity_of_peak(magnitude: Column) -> Column:
    return F.when(magnitude >= 15, "critical").when(magnitude >= 6, "warning").otherwise("info")


def passes_severity(severity: Column, least: str) -> Column:
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY_RANKS.items() for x in pair))[severity]
    return F.coalesce(rank, F.lit(0)) >= SEVERITY_RANKS[least]


def is_live_alarm(kind: Column, tag: Column, what: Column) -> Column:
    return (kind == "process_limit") & (F.coalesce(tag, F.lit("")) != "") & (F.coalesce(what, F.lit("")) != "investigation")


def due_status(next_due: Column, today: str, days: int = 90) -> Column:
    """Dates are ISO strings and compare as such."""
    horizon = F.date_format(F.date_add(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    return F.when(next_due < today, "overdue").when(next_due <= horizon, "due_soon").otherwise("compliant")
