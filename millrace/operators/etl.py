"""Document ETL (SRC-5, SRC-7, SRC-21, PRJ-5, ETL-1..6, ETL-8, AGG-18, STR-7, STR-8, FLT-18..20)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import tags

# Canonical columns of the two known tables.
WORK_ORDER_FIELDS = ("wo_id", "equipment_tag", "failure_code", "date", "description", "action_taken", "technician", "downtime_hours")
INSPECTION_FIELDS = ("record_id", "equipment_tag", "inspection_type", "standard", "result", "date", "next_due", "remarks")
WORK_ORDER_REQUIRED = {"wo_id", "equipment_tag", "failure_code"}
INSPECTION_REQUIRED = {"equipment_tag", "inspection_type"}
CHUNK_CHARS = 2400


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def doc_id(content: Column) -> Column:
    return F.substring(content_hash(content), 1, 16)


def first_by_content(docs: DataFrame, order: str) -> DataFrame:
    """One row for each content: the first by ``order``."""
    return docs.groupBy(content_hash(F.col("content")).alias("content_hash")).agg(F.min(order).alias(order))


def unseen(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    return docs.join(ledger.select("content_hash"), "content_hash", "left_anti")


def table_kind(columns: list[str]) -> str | None:
    """work_orders or inspections by header, work orders first; else None."""
    have = set(columns)
    return "work_orders" if WORK_ORDER_REQUIRED <= have else "inspections" if INSPECTION_REQUIRED <= have else None


def remap(rows: DataFrame, mapping: dict[str, str], fields: tuple[str, ...]) -> DataFrame:
    """Canonical, trimmed columns; a missing one is empty. A mapped column that does not exist is an error."""
    if missing := set(mapping.values()) - set(rows.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return rows.select(*(F.coalesce(F.trim(F.col(mapping[f])), F.lit("")).alias(f) if f in mapping else F.lit("").alias(f) for f in fields))


def non_empty(rows: DataFrame) -> DataFrame:
    """Rows with any value."""
    return rows.where(F.exists(F.array(*(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns)), lambda v: v != ""))


def work_order_edges(rows: DataFrame, doc: Column) -> DataFrame:
    """HAS_FAILURE, FIXED_BY and MENTIONED_IN edges of work orders(row, wo_id, equipment_tag, failure_code, date)."""
    good = rows.where("wo_id <> '' and equipment_tag <> ''").withColumns({"equip": tags.canonical_id(F.lit("Equipment"), F.col("equipment_tag")), "wo": tags.canonical_id(F.lit("WorkOrder"), F.col("wo_id")), "mode": tags.canonical_id(F.lit("FailureMode"), F.col("failure_code")), "doc": doc})
    one = lambda src, kind, dst, where="true": good.where(where).select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"), F.col("row").alias("page"), "date")
    return one("equip", "HAS_FAILURE", "mode", "failure_code <> ''").union(one("equip", "FIXED_BY", "wo")).union(one("wo", "MENTIONED_IN", "doc"))


#: Where a quoted tail begins. A line with '>', a reply header, or a forwarded head.
QUOTED = r"(?m)^(?:[^\S\n]*>|On .{5,80} wrote:[^\S\n]*$|-{3,}[^\S\n]*(?i:Original Message)[^\S\n]*-{3,}|From:)"


def strip_quotes(body: Column) -> Column:
    """An e-mail's text before the quoted tail."""
    return F.trim(F.element_at(F.split(body, QUOTED, 2), 1), F.lit(" \t\r\n"))


def people(header: Column) -> Column:
    """array<struct<name, address>> of a header; commas inside quotes do not part."""
    entries = F.filter(F.split(F.coalesce(header, F.lit("")), r""",(?=(?:[^"]*"[^"]*")*[^"]*$)"""), lambda e: F.trim(e) != "")
    address = lambda e: F.lower(F.coalesce(F.nullif(F.regexp_extract(e, r"<([^>]+)>", 1), F.lit("")), F.trim(e)))
    name = lambda e: F.trim(F.regexp_replace(F.regexp_replace(e, r"<[^>]*>", ""), '"', ""))
    return F.transform(entries, lambda e: F.struct(name(e).alias("name"), address(e).alias("address")))


def email_header(raw: Column, name: str) -> Column:
    """A header of a message, folded lines joined; empty if there is none."""
    head = F.regexp_extract(raw, r"(?s)^(.*?)(\r?\n\r?\n|\z)", 1)
    return F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?mi)^{name}:[ \t]*((?:.*)(?:\r?\n[ \t]+.*)*)", 1), r"\r?\n[ \t]+", " "))


def email_body(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)^.*?\r?\n\r?\n", "")


def correction_section(text: Column, heading: str) -> Column:
    """The text under a '## heading' up to the next one."""
    return F.trim(F.regexp_extract(text, rf"(?ms)^##[ \t]*{re.escape(heading)}[ \t]*\r?\n(.*?)(?=^##|\z)", 1), F.lit(" \t\r\n"))


def front_matter(text: Column, key: str) -> Column:
    return F.trim(F.regexp_extract(F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1), rf"(?m)^{re.escape(key)}:[ \t]*(.*)$", 1))


def split_sections(text: str, max_chars: int = CHUNK_CHARS) -> list[tuple[int, str, int, int, int]]:
    """(section, title, chunk, start, end): sections begin at lines with '#'; chunks are whole paragraphs
    packed up to max_chars, so text[start:end] is a chunk and no paragraph is cut."""
    heads = [m.start() for m in re.finditer(r"(?m)^#", text)]
    bounds = sorted({0, *heads, len(text)})
    out = []
    for s, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        line = text[lo:hi].split("\n", 1)[0]
        title, begin, chunk = line.lstrip("#").strip() if line.startswith("#") else "", None, 0
        end = lo
        for m in re.finditer(r"(?s)\S.*?(?=\n\s*\n|\Z)", text[lo:hi]):
            a, b = lo + m.start(), lo + m.start() + len(m[0].rstrip())
            if begin is not None and b - begin > max_chars:
                out.append((s, title, chunk, begin, end))
                chunk, begin = chunk + 1, a
            begin = a if begin is None else begin
            end = b
        if begin is not None:
            out.append((s, title, chunk, begin, end))
    return out


def chunks(docs: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, section, title, chunk, start, stop and text of the chunks of docs(doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, s, title, c, a, b, t[a:b]) for d, t in zip(frame["doc_id"], frame["text"], strict=True) if t for s, title, c, a, b in split_sections(t, max_chars)]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "title", "chunk", "start", "stop", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, section int, title string, chunk int, start int, stop int, text string")


def page_furniture(pages: DataFrame, fraction: float = 0.6, least: int = 4) -> DataFrame:
    """Digit-masked lines among the first and last two of the pages(doc, page, text) of a document that recur
    on max(4, 60 %) of them; documents under four pages have none."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    ends = F.array_distinct(F.concat(F.slice(lines, 1, 2), F.when(F.size(lines) >= 2, F.slice(lines, -2, 2)).otherwise(lines)))
    n = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= least)
    seen = pages.select("doc", "page", F.explode(ends).alias("line")).select("doc", F.regexp_replace(F.trim("line"), "[0-9]+", "#").alias("pattern"))
    return seen.groupBy("doc", "pattern").agg(F.count("*").alias("n")).join(n, "doc").where(F.col("n") >= F.greatest(F.lit(least), F.floor(fraction * F.col("n_pages")))).select("doc", "pattern", "n")


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, tag) once for each tag that a text names."""
    return docs.select("doc_id", F.explode(F.array_distinct(tags.find_tags(F.coalesce("text", F.lit(""))))).alias("tag"))


def good_and_bad(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON rows(value, ...) that fit the schema, as columns beside the others, and the rest as they are for the dead-letter table."""
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = raw.withColumn("_row", read)
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    others = [c for c in raw.columns if c != "value"]
    return parsed.where(~bad).select(*others, "_row.*").drop("_bad"), parsed.where(bad).select(*raw.columns)


def latest_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")
