"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import match_spans

#: Kinds in their order among spans that begin at the same place.
KINDS = ("assign", "access", "hex", "entropy")
#: Base patterns. assign is matched without a least length, as shorter values use up what they match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What base spans cover is no part of a candidate.
COVERED = rf"{ACCESS}|{HEX}|{ASSIGN.removesuffix('+)')}{{8,}})"
#: A candidate string is a whole run of these characters, of 20 or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Entropy is taken over windows of this many characters; a string counts from so many bits in some window.
WINDOW_CHARS = 20
LEAST_BITS = {"hex": 3.0, "alnum": 3.5, "base64": 3.6}
# The allow-list. Repeated groups are possessive: Java runs those as loops, and others by recursion.
#: Whole candidates that look random but are no secrets: identifiers, hashes by name, and paths or slugs of short words.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^(?:sha1|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/]++={0,2}$",
    r"^(?:[A-Za-z0-9]{1,12}[-_/]){3,}+[A-Za-z0-9]{0,12}$",
)
#: A placeholder silences the part of a candidate, between separators, that it stands in; a run of one character only itself.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000000|1234567"
PARTS = r"[A-Za-z0-9+]++|[/_=-]++"
REPEATED = r"(.)\1{7,}+"


def window_entropy(value: Column, window: int = WINDOW_CHARS) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` characters of a string over ALPHABET.

    With counts c of a window's characters, entropy is log2(w) - sum(c log2 c) / w. Counts and sum are
    carried along in one pass: counts are a string with one place for each character of ALPHABET, which
    holds its count as a character. What enters with count c adds (c+1)log(c+1) - c log c to the sum,
    what leaves takes it away; only those two counts are read and changed. Shorter strings have 0.
    """
    zero = 48
    gains = F.array(*(F.lit(c * math.log2(c) - (c - 1) * math.log2(max(1, c - 1))) for c in range(1, window + 1)))
    places = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))

    def change(s: Column, e: Column) -> Column:
        """One character more (by = 1) or less (by = -1) at its place."""
        count = F.ascii(F.substr(s["counts"], e["place"], F.lit(1))) - zero
        total = s["sum"] + e["by"] * F.element_at(gains, count + F.greatest(e["by"], F.lit(0)))
        return F.struct(F.overlay(s["counts"], F.char(zero + count + e["by"]), e["place"], F.lit(1)).alias("counts"), total.alias("sum"))

    def step(places: Column, s: Column, i: Column) -> Column:
        event = lambda at, by: F.struct(F.element_at(places, at).alias("place"), F.lit(by).alias("by"))
        events = F.when(i > window, F.array(event(i - window, -1), event(i, 1))).otherwise(F.array(event(i, 1)))
        held = F.aggregate(events, s["held"], change)
        return F.struct(held.alias("held"), F.when(i > window, F.least(s["least"], s["held"]["sum"])).otherwise(s["least"]).alias("least"))

    start = F.struct(F.struct(F.lit(chr(zero) * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum")).alias("held"), F.lit(float("inf")).alias("least"))
    # the sum of a full window counts when the next character is met, the last one at the end
    last = lambda s: F.least(s["least"], s["held"]["sum"])
    bits = lambda p: F.when(F.size(p) >= window, F.log2(F.lit(float(window))) - F.aggregate(F.sequence(F.lit(1), F.size(p)), start, lambda s, i: step(p, s, i), last) / window).otherwise(0.0)
    return F.element_at(F.transform(F.array(places), bits), 1)


def _entropic(m: Column) -> Column:
    """Whether a candidate, without placeholders, is random enough for its class of characters and not allowed."""
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    least = lambda x: F.when(x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), LEAST_BITS["hex"]).when(x.rlike("^[A-Za-z0-9]+$"), LEAST_BITS["alnum"]).otherwise(LEAST_BITS["base64"])
    parts = F.transform(F.regexp_extract_all(m, F.lit(PARTS), F.lit(0)), lambda p: F.when(p.rlike(PLACEHOLDER), " ").otherwise(p))
    cleared = F.when(m.rlike(PLACEHOLDER), F.array_join(parts, "")).otherwise(m)
    rest = F.filter(F.split(F.regexp_replace(cleared, REPEATED, " "), " "), lambda x: F.length(x) >= WINDOW_CHARS)
    random = F.exists(rest, lambda x: F.when(mixed(x), window_entropy(x) >= least(x)).otherwise(False))
    return F.when(mixed(m) & ~m.rlike("|".join(ALLOWED)), random).otherwise(False)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs(doc_id, text)``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind in the order of
    KINDS, comma-joined. base_sha256 covers the base kinds; spans adds candidate strings by entropy,
    taken from what base matches leave of the text. Null and empty texts have none. Null ids are
    passed on, repeated rows give repeated results, extra columns are left out. Time grows with the
    length of a text, whatever it holds.
    """
    text = F.col("m_text")
    kind = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"], F.lit(KINDS.index(k)).alias("order"), s["stop"], F.lit(k).alias("kind")))
    none = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")
    long_values = lambda spans: F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("m_text")).withColumns(
        {
            "m_assign": F.when(text.rlike(ASSIGN), kind(long_values(match_spans(text, ASSIGN)), "assign")).otherwise(none),
            "m_access": F.when(text.contains("AKIA"), kind(match_spans(text, ACCESS), "access")).otherwise(none),
            "m_hex": F.when(text.rlike(HEX), kind(match_spans(text, HEX), "hex")).otherwise(none),
        }
    )
    found = found.withColumn("m_base", F.concat("m_assign", "m_access", "m_hex"))
    blanks = F.transform(F.regexp_extract_all(text, F.lit(COVERED), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    bare = F.array_join(F.zip_with(F.split(text, COVERED, -1), blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")
    found = found.withColumn("m_bare", F.when(F.size("m_base") > 0, bare).otherwise(text))
    random = F.filter(match_spans(F.col("m_bare"), CANDIDATE), lambda s: _entropic(s["value"]))
    found = found.withColumn("m_any", F.when(F.col("m_bare").rlike(CANDIDATE), kind(random, "entropy")).otherwise(none))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select(
        "doc_id",
        *(F.size(f"m_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.col("m_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("m_base", "m_any")).alias("spans"),
    )
