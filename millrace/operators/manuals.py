"""Manuals as trees: furniture removed, sections that own pages, and packed chunks, in one plan (ETL-7, WIN-6, WIN-7, AGG-18, STR-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.etl import CHUNK_CHARS, page_furniture
from millrace.operators.lanes import DEEPEST, outline

LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_EDGES = r"^\s+|\s+$"


def packed(text: Column, most: int = CHUNK_CHARS) -> Column:
    """array<string>: the paragraphs of a text (parted by blank lines, trimmed, blank ones left out) in pieces of up to ``most`` characters.

    A paragraph is never cut: one that would pass the limit opens the next piece. The fold carries the
    size of the open piece and where pieces begin, so its state grows with the pieces only. Null gives null.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, _EDGES, "")), lambda p: p != "")

    def pieces(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("begins"))

        def step(s: Column, p: Column) -> Column:
            opens = (s["at"] == 0) | (s["size"] + F.length(p) > most)
            size = F.when(opens, F.length(p)).otherwise(s["size"] + F.length(p))
            begins = F.when(opens, F.concat(s["begins"], F.array(s["at"] + 1))).otherwise(s["begins"])
            return F.struct((s["at"] + 1).alias("at"), size.alias("size"), begins.alias("begins"))

        begins = F.aggregate(rows, start, step, lambda s: s["begins"])
        cut = lambda b: F.transform(b, lambda a, i: F.array_join(F.slice(rows, a, F.coalesce(F.get(b, i + 1), F.size(rows) + 1) - a), "\n\n"))
        return F.element_at(F.transform(F.array(begins), cut), 1)

    return F.element_at(F.transform(F.array(paragraphs), pieces), 1)


def without_furniture(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) without the lines that recur at the tops and bottoms of most pages of their document.

    A document has at most four such lines a page and each is on most pages, so its patterns are a handful and travel with the page.
    """
    found = page_furniture(pages.select(F.col("doc_id").alias("doc"), "page", "text")).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("pattern").alias("patterns"))
    masked = lambda line: F.regexp_replace(F.regexp_replace(line, _EDGES, ""), "[0-9]+", "#")
    kept = F.filter(F.split("text", LINE_BREAKS), lambda line: ~F.array_contains("patterns", masked(line)))
    return pages.join(found, "doc_id", "left").select("doc_id", "page", F.when(F.col("patterns").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def section_tree(pages: DataFrame) -> DataFrame:
    """The sections of pages(doc_id, page, text): (doc_id, nth, title, level, path, parent, page_start, page_end).

    Numbered headings are sections, in order of page and line, from 0; a document without one is one
    section 'Manual'. A section owns the pages up to the next one's, its own at least, and the last one the rest.
    Its parent is the nearest earlier one of a lower level (``doc_id#secN``), else the document;
    its path has the titles from the top down. Levels are bounded, so each looks back by one window a level.
    """
    lengths = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    heads = outline(pages)
    without = lengths.join(heads.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("line_no"), F.lit("Manual").alias("title"), F.lit(1).alias("level"))
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    rows = heads.union(without).withColumn("nth", (F.row_number().over(w) - 1).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    latest = {k: F.last(F.when(F.col("level") == k, F.struct("nth", "title")), ignorenulls=True).over(before) for k in range(1, DEEPEST)}
    rows = rows.withColumns({f"at_{k}": c for k, c in latest.items()} | {"next_page": F.lead("page").over(order)})
    # a heading stands over later ones until one of its level or a lower one comes
    stands = {k: F.col(f"at_{k}").isNotNull() & (F.col("level") > k) & (F.col(f"at_{k}.nth") > F.greatest(F.lit(-1), *(F.coalesce(f"at_{m}.nth", F.lit(-1)) for m in range(1, k)), F.lit(-1))) for k in range(1, DEEPEST)}
    over = F.filter(F.array(*(F.when(stands[k], F.col(f"at_{k}")) for k in stands)), lambda s: s.isNotNull())
    rows = rows.join(lengths, "doc_id").withColumn("over", over)
    parent = F.coalesce(F.concat(F.col("doc_id").cast("string"), F.lit("#sec"), F.try_element_at("over", F.lit(-1))["nth"].cast("string")), F.col("doc_id").cast("string"))
    path = F.array_join(F.concat(F.transform("over", lambda s: s["title"]), F.array("title")), " > ")
    last = F.greatest(F.coalesce(F.col("next_page") - 1, F.col("n_pages")), F.col("page"))
    return rows.select("doc_id", "nth", "title", "level", path.alias("path"), parent.alias("parent"), F.col("page").alias("page_start"), last.alias("page_end"))


def manual_chunks(pages: DataFrame, sections: DataFrame, files: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """The packed chunks of all sections: (doc_id, idx, section, page, context, text); idx counts through the document.

    pages(doc_id, page, text) meet the sections that own them by an equi-join on the page; files(doc_id, filename) name the context.
    """
    owned = sections.select("doc_id", "nth", "page_start", "path", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    joined = owned.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    bodies = joined.groupBy("doc_id", "nth", "page_start", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("body"))
    pieces = bodies.select("doc_id", "nth", "page_start", "path", F.posexplode(packed(F.col("body"), most)).alias("piece", "text"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "piece")) - 1
    context = F.concat(F.lit("From "), "filename", F.lit(", "), "path", F.lit(": "))
    return pieces.withColumn("idx", idx).join(files, "doc_id").select("doc_id", "idx", F.concat(F.col("doc_id").cast("string"), F.lit("#sec"), F.col("nth").cast("string")).alias("section"), F.col("page_start").alias("page"), context.alias("context"), "text")


def part_of(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """ETL-6, ETL-7: PART_OF edges (src, dst, doc_id, page) of sections to their parents and of chunks to their sections."""
    name = lambda kind, c: F.concat(F.col("doc_id").cast("string"), F.lit(kind), F.col(c).cast("string")).alias("src")
    return sections.select(name("#sec", "nth"), F.col("parent").alias("dst"), "doc_id", F.col("page_start").alias("page")).union(chunks.select(name("#chunk", "idx"), "section", "doc_id", "page"))
