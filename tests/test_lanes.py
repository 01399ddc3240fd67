"""Rules and ETL steps on small inputs with known values."""

from pyspark.sql import functions as F

from millrace.functions import grounding, rules, tags
from millrace.operators import etl, graph, historian, retrieval
from millrace.sources import files


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_rules(spark):
    c = F.col
    one = lambda rows, column: values(spark, rows, "a string", column)
    assert one(["PI-101", "P-101", "PSV-2"], tags.is_instrument(c("a"))) == [True, False, True]
    assert one(["hot work on line", "tank entry", "motor swap", "inspect flange", "paint"], rules.permit_type(c("a"))) == ["Hot Work", "Confined Space Entry", "Electrical Isolation", "Cold Work", "General Maintenance"]
    assert one(["critical", "warning", "info", None], rules.passes_severity(c("a"), "warning")) == [True, True, False, False]
    assert one(["PUMP-FAILED-DUE-TO-WEAR", "SEAL-LEAK"], rules.looks_like_sentence(c("a"))) == [True, False]
    assert one(["bearing wear", "trip"], rules.looks_like_mechanism(c("a"))) == [True, False]
    plain, wide = one(["why did it stop", "which statutory inspection is overdue"], rules.edge_types(c("a")))
    assert set(plain) < set(wide)
    live = spark.createDataFrame([("process_limit", "T", None), ("process_limit", "", None), ("process_limit", "T", "investigation"), ("failure", "T", None)], "k string, t string, w string")
    assert [r[0] for r in live.select(rules.is_live_alarm(c("k"), c("t"), c("w"))).collect()] == [True, False, False, False]
    named = [("a.correction.md", "", 1), ("b.CSV", "", 1), ("c.eml", "", 1), ("mail", "Hello\nSubject: x", 1), ("d.svg", "", 1), ("e.png", "", 1), ("f.pdf", "w " * 400, 400), ("g.pdf", "w", 400), ("h.txt", "", 1)]
    assert values(spark, named, "a string, s string, n int", rules.document_kind(c("a"), c("s"), c("n"))) == ["correction", "table", "email", "email", "pnid", "image", "manual", "text", "text"]


def test_grounding(spark):
    rows = [("[doc:abcdef12] and [abcdef99 p3]",), ("nothing cited",), ("[doc:ffffff]",), ("[doc:abcdef12 p4]",)]
    known = F.array(F.lit("abcdef12"), F.lit("abcdef99ffff"))
    found = spark.createDataFrame(rows, "t string").select(grounding.grounding(F.col("t"), known).alias("g"), grounding.cited_docs(F.col("t")).alias("c")).collect()
    assert [tuple(r.g) for r in found] == [("documents", "high"), ("general", "medium"), ("unverified", "low"), ("documents", "medium")]
    assert found[0].c == ["abcdef12", "abcdef99"]
    hit = spark.createDataFrame([(["a/b.pdf"], ["b.pdf"]), (["a"], ["b"]), ([], ["b"])], "c array<string>, e array<string>").select(grounding.citation_hit(F.col("c"), F.col("e")).alias("h"))
    assert [r.h for r in hit.collect()] == [True, False, False]


def test_tables(spark):
    assert [etl.table_kind(c) for c in (["wo_id", "equipment_tag", "failure_code", "inspection_type"], ["equipment_tag", "inspection_type"], ["x"])] == ["work_orders", "inspections", None]
    raw = spark.createDataFrame([(" 1 ", "P-101", None), ("2", None, "x")], "no string, asset string, code string")
    mapped = etl.remap(raw, {"wo_id": "no", "equipment_tag": "asset", "failure_code": "code"}, ("wo_id", "equipment_tag", "failure_code", "date"))
    assert sorted(map(tuple, mapped.collect())) == [("1", "P-101", "", ""), ("2", "", "x", "")]
    edges = etl.work_order_edges(mapped.withColumn("row", F.lit(1)), F.lit("doc:d")).collect()
    assert sorted((e.src, e.type, e.dst) for e in edges) == [("equip:P-101", "FIXED_BY", "wo:1"), ("wo:1", "MENTIONED_IN", "doc:d")]
    seen = spark.createDataFrame([("a",)], "content_hash string")
    assert [r[0] for r in etl.unseen(spark.createDataFrame([("a",), ("b",)], "content_hash string"), seen).collect()] == ["b"]
    good, bad = etl.good_and_bad(spark.createDataFrame([('{"a": 1}',), ("{",), ('{"a": "x"}',), (None,)], "value string"), "a int")
    assert [tuple(r) for r in good.collect()] == [(1,)] and sorted(str(r[0]) for r in bad.collect()) == ["None", "{", '{"a": "x"}']


def test_messages(spark):
    mail = "From: Ana <A@b.org>\r\nSubject: a long\r\n line\r\n\r\nBody: text\r\n\r\nmore"
    row = spark.createDataFrame([(mail,)], "m string").select(etl.email_header(F.col("m"), "Subject").alias("s"), etl.email_header(F.col("m"), "Cc").alias("c"), etl.email_body(F.col("m")).alias("b"), etl.people(etl.email_header(F.col("m"), "From")).alias("p")).first()
    assert (row.s, row.c, row.b, [tuple(p) for p in row.p]) == ("a long line", "", "Body: text\r\n\r\nmore", [("Ana", "a@b.org")])
    note = "---\nauthor: Ana\ntag: P-1\n---\n# x\n## Fix\nturn it\n## Why\nold"
    row = spark.createDataFrame([(note,)], "t string").select(etl.front_matter(F.col("t"), "author").alias("a"), etl.correction_section(F.col("t"), "Fix").alias("f"), etl.correction_section(F.col("t"), "Why").alias("w")).first()
    assert tuple(row) == ("Ana", "turn it", "old")
    pages = [("d", p, f"Plant manual\nbody {chr(97 + p)}\nmore {chr(97 + p)}\nend {chr(97 + p)}\nPage {p} of 5") for p in range(5)]
    found = etl.page_furniture(spark.createDataFrame(pages, "doc string, page int, text string"))
    assert sorted((r.pattern, r.n) for r in found.collect()) == [("Page # of #", 5), ("Plant manual", 5)]


def test_graph_writes(spark):
    nodes = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "id string, superseded boolean")
    assert sorted(r.id for r in graph.current(nodes).collect()) == ["b", "c"]
    schema = "src string, type string, dst string, prov_hash string, cause string"
    before = spark.createDataFrame([("a", "HAS_FAILURE", "b", "1", "old"), ("a", "HAS_FAILURE", "c", "2", "stays")], schema)
    batch = spark.createDataFrame([("a", "HAS_FAILURE", "b", "1", "new"), ("a", "HAS_FAILURE", "z", "3", "no end")], schema)
    assert sorted(r.cause for r in graph.upsert_edges(before, batch, nodes).collect()) == ["new", "stays"]


def test_samples(spark):
    rows = [("T", "2024-01-01 00:00:00", "1.5", None, None), ("T", "1704067201", "x", "u", "BAD"), ("T", "never", "2", "u", "GOOD"), ("", "2024-01-01", "1", "u", "GOOD")]
    entries = spark.createDataFrame(rows, "tag_id string, timestamp string, value string, unit string, status string").withColumn("ingested", F.lit("2024-02-01 00:00:00"))
    found = sorted((str(r.ts), r.value is None, r.quality, r.unit) for r in historian.from_stream(entries).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value", "quality", "unit").collect())
    assert found == [("2024-01-01 00:00:00", False, "GOOD", ""), ("2024-01-01 00:00:01", True, "BAD", "u"), ("2024-02-01 00:00:00", False, "GOOD", "u")]


def test_answer_cache(spark):
    rows = [("a", [1.0, 0.0], 1, ["n1"]), ("b", [0.9, 0.1], 2, ["n2"]), ("c", [0.0, 1.0], 3, ["n1", "n3"])]
    cache = spark.createDataFrame(rows, "key string, embedding array<double>, last_touch int, cited_nodes array<string>")
    assert [r.key for r in retrieval.cached_answer(cache, [1.0, 0.0]).collect()] == ["a"]
    assert sorted(r.key for r in retrieval.invalidated(cache, F.array(F.lit("n1"))).collect()) == ["b"]
    assert sorted(r.key for r in retrieval.evicted(cache, 2).collect()) == ["b", "c"]
    fitted = spark.createDataFrame([([3.0, 4.0, 9.0],), ([2.0],), ([0.0],)], "v array<double>").select(retrieval.fitted_vector(F.col("v"), 2).alias("v"))
    assert [[round(x, 6) for x in r.v] for r in fitted.collect()] == [[0.6, 0.8], [1.0, 0.0], [0.0, 0.0]]
    now = spark.createDataFrame([("S1", "January 2020"), ("S2", "2021"), ("S3", "1")], "standard string, revision string")
    before = spark.createDataFrame([("S1", "Jan-2020"), ("S2", "2020")], "standard string, revision string")
    assert sorted((r.standard, r.baseline, r.moved) for r in retrieval.moved_standards(now, before).collect()) == [("S1", False, False), ("S2", False, True), ("S3", True, False)]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text("﻿a,b\n1,\n,\n\"2\n3\",y\n")
    assert sorted(map(tuple, files.csv_rows(spark, str(tmp_path / "t")).collect()), key=str) == [("1", None), ("2\n3", "y")]
    one = files.from_config(spark, [{"format": "folder", "path": str(tmp_path / "t")}, {"format": "folder"}, {"path": "x"}])
    assert [r.path.rsplit("/", 1)[1] for r in one.collect()] == ["x.csv"]
    assert files.from_config(spark, []) is None
    spark.createDataFrame([("1",), ("2",)], "a string").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("a string").parquet(f"{tmp_path}/in")
        assert files.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
