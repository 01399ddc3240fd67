"""Mails as MIME trees, in DataFrame functions (SRC-7, ETL-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.etl import email_header, people, strip_quotes

#: Levels of multiparts within multiparts that are opened.
DEEPEST = 5


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _body(part: Column) -> Column:
    """What follows the first blank line; empty without one."""
    return F.regexp_extract(part, r"(?s)\A(?:.*?\r?\n)??\r?\n(.*)\z", 1)


def _type(part: Column) -> Column:
    """The content type, small letters; plain text where none is named."""
    kind = F.lower(F.trim(F.regexp_extract(email_header(part, "Content-Type"), r"^\s*([^;\s]+)", 1)))
    return F.when(kind == "", "text/plain").otherwise(kind)


def _parameter(part: Column, header: str, name: str) -> Column:
    quoted = rf"""(?i);\s*{name}\s*=\s*(?:"([^"]*)"|([^\s;]+))"""
    value = email_header(part, header)
    return F.concat(F.regexp_extract(value, quoted, 1), F.regexp_extract(value, quoted, 2))


def _children(part: Column) -> Column:
    """The parts between a multipart's boundary lines; what stands before the first and after the closing one is none."""

    def cut(boundary: Column) -> Column:
        line = F.concat(F.lit(r"(?m)^--\Q"), boundary, F.lit(r"\E(?:--)?[ \t]*\r?$"))
        closing = F.concat(F.lit(r"(?s)(?m)^--\Q"), boundary, F.lit(r"\E--[ \t]*\r?$.*"))
        inner = F.regexp_replace(F.concat(F.lit("\n"), _body(part)), closing, F.lit(""))
        pieces = F.split(inner, line)
        # the line break before a boundary line belongs to the boundary
        return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.regexp_replace(F.regexp_replace(p, r"\A\r?\n", ""), r"\r?\n\z", ""))

    return _once(_parameter(part, "Content-Type", "boundary"), cut)


def leaves(raw: Column, deepest: int = DEEPEST) -> Column:
    """array<string>: the parts of a mail that are no multiparts, in order; multiparts are opened level by level. Null gives null."""
    parts = F.array(raw)
    for _ in range(deepest):
        multi = lambda p: F.startswith(_type(p), F.lit("multipart/")) & (_parameter(p, "Content-Type", "boundary") != "")
        parts = F.flatten(F.transform(parts, lambda p: F.when(multi(p), _children(p)).otherwise(F.array(p))))
    return F.when(raw.isNotNull(), parts)


def _unquoted(text: Column) -> Column:
    """The bytes of a quoted-printable text; an equals sign without two hex digits stays."""
    joined = F.regexp_replace(F.regexp_replace(text, r"=[ \t]*\r?\n", ""), r"=(?![0-9A-Fa-f]{2})", "=3D")
    pieces = F.split(joined, "=")
    coded = lambda p: F.concat(F.substr(p, F.lit(1), F.lit(2)), F.hex(F.encode(F.substr(p, F.lit(3)), "UTF-8")))
    return F.unhex(F.concat(F.hex(F.encode(F.element_at(pieces, 1), "UTF-8")), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), coded), "")))


def content(part: Column) -> Column:
    """The text of a part: base64 and quoted-printable decoded, in its charset (UTF-8, Latin 1 or a subset; others are read as Latin 1)."""
    way = F.lower(F.trim(email_header(part, "Content-Transfer-Encoding")))
    charset = F.lower(_parameter(part, "Content-Type", "charset"))
    raw = F.when(way == "base64", F.try_to_binary(F.regexp_replace(_body(part), r"[^A-Za-z0-9+/=]", ""), F.lit("base64"))).when(way == "quoted-printable", _unquoted(_body(part))).otherwise(F.encode(_body(part), "UTF-8"))
    own = charset.isin("", "utf-8", "utf8", "us-ascii", "ascii") | ~way.isin("base64", "quoted-printable")
    return _once(raw, lambda b: F.when(own, F.decode(b, "UTF-8")).otherwise(F.decode(b, "ISO-8859-1")))


def mail_body(raw: Column) -> Column:
    """The text of a mail: its first plain part that is no attachment, else its first HTML part with spaces for tags, else empty. Null gives null."""
    shown = F.filter(leaves(raw), lambda p: ~F.startswith(F.lower(email_header(p, "Content-Disposition")), F.lit("attachment")))

    def choose(parts: Column) -> Column:
        plain, html = (F.get(F.filter(parts, lambda p: _type(p) == kind), F.lit(0)) for kind in ("text/plain", "text/html"))
        return F.coalesce(content(plain), F.regexp_replace(content(html), "<[^>]+>", " "), F.lit(""))

    return F.when(raw.isNotNull(), _once(shown, choose))


def mail_documents(mails: DataFrame) -> DataFrame:
    """mails(doc_id, raw) as (doc_id, subject, sender, receiver, date, text): the subject as heading over the body without its quoted tail."""
    subject, text = email_header(F.col("raw"), "Subject"), strip_quotes(mail_body(F.col("raw")))
    whole = F.when(subject != "", F.concat(F.lit("# "), subject, F.lit("\n\n"), text)).otherwise(text)
    return mails.select("doc_id", subject.alias("subject"), email_header(F.col("raw"), "From").alias("sender"), email_header(F.col("raw"), "To").alias("receiver"), email_header(F.col("raw"), "Date").alias("date"), whole.alias("text"))


def mail_people(mails: DataFrame) -> DataFrame:
    """ETL-8: MENTIONED_IN edges (src, type, dst, role, email) of the people in a mail's headers, once for each role."""
    roles = F.array(*(F.struct(F.lit(role.lower()).alias("role"), people(email_header(F.col("raw"), role)).alias("people")) for role in ("From", "To", "Cc")))
    each = mails.select("doc_id", F.inline(roles)).select("doc_id", "role", F.inline("people"))
    surface = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("address"))
    return each.select(surface.alias("src"), F.lit("MENTIONED_IN").alias("type"), F.col("doc_id").alias("dst"), "role", F.col("address").alias("email")).distinct()
