"""The committed writer against a plain version, with a killed and replayed batch, and the answers that follow it."""

import hashlib
import json

import pytest

from millrace.streaming.answers import AnswerCache
from millrace.streaming.writer import GraphWriter


def node(kind, surface, key, **props):
    return {"type": kind, "surface_form": surface, "resolved_id": key, "props": props}


def edge(src, kind, dst, doc, page=1, **props):
    return {"type": kind, "src": src, "dst": dst, "props": props, "provenance": {"doc_id": doc, "page": page, "span": None, "bbox": None, "extractor_version": "v1", "confidence": 0.9, "source": "document"}}


def graph_of(doc, nodes, edges):
    return json.dumps({"doc_id": doc, "nodes": nodes, "edges": edges})


P1, P2, SEAL = node("Equipment", "P-101A", "equip:P-101A", unit="100"), node("Equipment", "P-101B", "equip:P-101B"), node("FailureMode", "SEAL-LEAK", "fm:seal-leak")
BATCHES = [
    [
        graph_of("d1", [P1, SEAL], [edge("P-101A", "HAS_FAILURE", "SEAL-LEAK", "d1", cause="wear")]),
        graph_of("d2", [node("Equipment", "P-101A", "equip:P-101A", unit="200", area=None, tags=["a", "b"])], [edge("P-101A", "CONNECTED_TO", "equip:gone", "d2")]),
        "no json",
        json.dumps({"nodes": []}),
        graph_of("d3", [{"type": "Equipment", "surface_form": "X-1", "resolved_id": None, "props": {}}], []),
    ],
    [graph_of("d4", [P2, SEAL], [edge("P-101B", "HAS_FAILURE", "SEAL-LEAK", "d4"), edge("equip:P-101A", "CONNECTED_TO", "P-101B", "d4")]), graph_of("d4", [P2], [edge("P-101B", "SUCKS", "P-101B", "d4")])],
    ["nothing good"],
    [graph_of("d5", [P1], [edge("P-101A", "HAS_FAILURE", "fm:seal-leak", "d5"), edge("P-101A", "HAS_FAILURE", "fm:seal-leak", "d5")])],
]


def feed(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame([(r,) for r in rows], "raw string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema("raw string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def state(writer):
    nodes = sorted((r.id, r.label, r.surface_form, tuple(sorted(r.props.items())), r.created_version, r.updated_version) for r in writer.nodes().collect())
    edges = sorted((r.src, r.type, r.dst, r.prov_hash, r.doc_id, tuple(sorted(r.props.items())), r.version) for r in writer.edges().collect())
    return nodes, edges, sorted(map(tuple, writer.deltas().collect())), sorted(tuple(r)[1:] for r in writer.tables.read("parked").collect())


def prov(doc):
    return hashlib.sha1(f"{doc}|1||||v1".encode()).hexdigest()[:16]


def test_commits(spark, tmp_path):
    writer = GraphWriter(spark, f"{tmp_path}/graph")
    assert writer.start(feed(spark, tmp_path), f"{tmp_path}/ck").awaitTermination(600)
    nodes, edges, deltas, parked = state(writer)
    assert nodes == [
        ("equip:P-101A", "Equipment", "P-101A", (("tags", '["a","b"]'), ("unit", "100")), 1, 3),
        ("equip:P-101B", "Equipment", "P-101B", (), 2, 2),
        ("fm:seal-leak", "FailureMode", "SEAL-LEAK", (), 1, 2),
    ]
    assert [(e[0], e[1], e[2], e[4], e[6]) for e in edges] == [
        ("equip:P-101A", "CONNECTED_TO", "equip:P-101B", "d4", 2),
        ("equip:P-101A", "HAS_FAILURE", "fm:seal-leak", "d1", 1),
        ("equip:P-101A", "HAS_FAILURE", "fm:seal-leak", "d5", 3),
        ("equip:P-101B", "HAS_FAILURE", "fm:seal-leak", "d4", 2),
    ]
    assert edges[1][5] == (("cause", "wear"),) and len({e[3] for e in edges}) == 3
    assert [d for d in deltas if d[0] == 1] == sorted([(1, "document", "d1"), (1, "document", "d2"), (1, "edge_type", "CONNECTED_TO"), (1, "edge_type", "HAS_FAILURE"), (1, "node", "equip:P-101A"), (1, "node", "fm:seal-leak")])
    assert {d[0] for d in deltas} == {1, 2, 3} and sorted(r for _, r in parked) == ["not a subgraph"] * 3 + ["unknown edge type", "unresolved node"]


@pytest.mark.parametrize("where", ["deltas", "ledger"])
def test_killed_and_replayed(spark, tmp_path, where, monkeypatch):
    """A batch that dies before its delta or before its commit, and is run again, gives the same tables and one delta."""
    whole = GraphWriter(spark, f"{tmp_path}/whole")
    assert whole.start(feed(spark, tmp_path), f"{tmp_path}/ck1").awaitTermination(600)
    writer = GraphWriter(spark, f"{tmp_path}/graph")
    write, commit, killed = writer.tables.write, writer.tables.commit, []

    def dying_write(name, rows):
        if name == where and writer.tables.last()[0] == 0 and not killed:
            killed.append(1)
            raise RuntimeError("killed")
        write(name, rows)

    def dying_commit(version):
        if where == "ledger" and version == 2 and not killed:
            killed.append(1)
            raise RuntimeError("killed")
        commit(version)

    monkeypatch.setattr(writer.tables, "write", dying_write)
    monkeypatch.setattr(writer.tables, "commit", dying_commit)
    stream = spark.readStream.schema("raw string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with pytest.raises(Exception, match="killed"):
        writer.start(stream, f"{tmp_path}/ck2").awaitTermination(600)
    assert killed and {d.version for d in writer.deltas().collect()} == {1}
    assert writer.start(stream, f"{tmp_path}/ck2").awaitTermination(600)
    assert state(writer) == state(whole)
    assert writer.commit(spark.createDataFrame([("again",)], "raw string"), 1) == 2 and state(writer) == state(whole)


def test_answers_follow(spark, tmp_path):
    """Two rounds: answers on touched nodes go, failures are claimed once, and their answers go stale in turn."""
    graph, cache = GraphWriter(spark, f"{tmp_path}/graph"), AnswerCache(spark, f"{tmp_path}/cache")
    asked = [("What feeds P-101A?", "a", ["equip:P-101A"]), ("Who wrote d9?", "b", ["doc:d9"]), ("Nothing cited", "c", [])]
    cache.put(spark.createDataFrame(asked, "question string, answer string, cited array<string>"), 0)
    graph.commit(spark.createDataFrame([(r,) for r in BATCHES[0]], "raw string"), 0)
    assert cache.start(graph, f"{tmp_path}/ck").awaitTermination(600)
    assert sorted(r.question for r in cache.answers().collect()) == ["Nothing cited", "Who wrote d9?"]
    assert cache.alerts().count() == 0  # a first failure without siblings
    graph.commit(spark.createDataFrame([(r,) for r in BATCHES[1]], "raw string"), 1)
    graph.commit(spark.createDataFrame([(r,) for r in BATCHES[3]], "raw string"), 2)
    assert cache.start(graph, f"{tmp_path}/ck").awaitTermination(600)
    alerts = sorted((r.claim, tuple(r.siblings), r.version) for r in cache.alerts().collect())
    assert alerts == [("failure:P-101A:SEAL-LEAK:2", ("P-101B",), 3), ("failure:P-101B:SEAL-LEAK:1", ("P-101A",), 3)]
    found = {r.question: r for r in cache.answers().collect()}
    assert len(found) == 8 and found["P-101B failure history and recommendation"].cited == ["equip:P-101B", "equip:P-101A"]
    before = sorted(map(str, cache.answers().collect()))
    cache.follow(graph.deltas(), graph, 3)  # a replay
    assert sorted(map(str, cache.answers().collect())) == before and cache.alerts().count() == 2
    graph.commit(spark.createDataFrame([(graph_of("d6", [P2], []),)], "raw string"), 3)
    cache.follow(graph.deltas(), graph, 4)
    assert sorted(r.question for r in cache.answers().collect()) == ["Nothing cited", "Who wrote d9?"]
