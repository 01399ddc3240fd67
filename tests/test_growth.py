"""Steps that grow with their tables: what they join, scan and write, on small inputs."""

import datetime as dt
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import alerts, answers, graph, lanes, paths, reads, retrieval
from millrace.plans import registry
from millrace.streaming import watchers, writer
from tests import test_paths



def hits(n=3000):
    pick = random.Random(7)
    return [(pick.choice("abcdef"), float(pick.randrange(20_000))) for _ in range(n)]


def test_rates_of_many_sessions_take_no_group_each(spark):
    """against a plain loop; the rows go through sorted tasks and not through a Python group for each session."""
    rows, wanted, open_ = hits(), [], {}
    for bucket, ts in sorted(rows):
        start, n = open_.get(bucket, (float("-inf"), 0))
        start, n = (ts, 0) if ts - start >= 60 else (start, n)
        open_[bucket] = start, n + 1
        wanted.append((bucket, ts, n < 3))
    found = watchers.rate_limited(spark.createDataFrame(rows, "bucket string, ts double").repartition(5), 3)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_claims_of_many_sessions_take_no_group_each(spark):
    """claims and episodes against a plain loop."""
    rows, wanted, last = hits(), [], {}
    for key, ts in sorted(rows):
        if key not in last or ts - last[key] >= 40:
            last[key] = ts
            wanted.append((key, ts))
    table = spark.createDataFrame(rows, "fingerprint string, ts double").repartition(5)
    for found in (watchers.once_per(table, 40), watchers.armed_episodes(table.withColumnRenamed("fingerprint", "slot"), 15, 25)):
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_claims_outlast_batches(spark):
    """keys of more rows than an Arrow batch, nearly each a session of its own, in a time that takes no call for each."""
    pick, at, rows, wanted, last = random.Random(11), 0.0, [], [], {}
    for i in range(40_000):
        at += pick.choice([9.0, 30.0, 70.0])
        rows.append(("ab"[i > 12_345], at))
        if rows[-1][0] not in last or at - last[rows[-1][0]] >= 40:
            last[rows[-1][0]] = at
            wanted.append(rows[-1])
    pick.shuffle(rows)
    started = time.monotonic()
    found = watchers.once_per(spark.createDataFrame(rows, "fingerprint string, ts double").repartition(5), 40).collect()
    assert sorted(map(tuple, found)) == wanted
    assert time.monotonic() - started < 30  # a group for each of 13,000 sessions took longer


def test_one_long_session_has_no_rounds(spark):
    """runs of one unit, so that many alerts in one session wait in vain; one pass, nothing written between rounds."""
    pick, rows, at = random.Random(3), [], dt.datetime(2024, 1, 1)
    for i in range(4000):
        at += dt.timedelta(seconds=pick.choice([0, 1, 9]))
        rows.append((i, at, "reactor" if (i // 40) % 2 else "column"))
    started = time.monotonic()
    found = alerts.incidents(spark.createDataFrame(rows, "alert_id bigint, ts timestamp_ntz, unit string").repartition(4), 30).collect()
    used, wanted, ordered = set(), set(), sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    for i, (a, t, unit) in enumerate(ordered):
        if a not in used:
            partner = None
            for b, s, other in ordered[i + 1 :]:
                if (t - s).total_seconds() > 30:
                    break
                if b not in used and other != unit:
                    partner = b
                    break
            used |= {a, partner}
            wanted.add((*((a, partner) if unit == "reactor" else (partner, a)), a))
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted
    assert time.monotonic() - started < 30  # rounds, one for each run, took minutes


def test_hours_go_by_microseconds(spark):
    """half a second less than an hour ago is this hour."""
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 29, 23, 0, 0, 500_000),), (dt.datetime(2024, 1, 29, 23),), (dt.datetime(2024, 1, 29, 12, 0, 0, 1),)], "ts timestamp_ntz")
    found = dict(map(tuple, retrieval.hourly(rows, "2024-01-30 00:00:00").where("n > 0").collect()))
    assert found == {0: 1, 1: 1, 11: 1}


def test_terms_find_every_node(spark):
    """nodes of every label, and more than twenty."""
    nodes = spark.createDataFrame([(f"n{i}", "Equipment" if i % 2 else "Line", f"United {i}") for i in range(50)] + [("x", "Line", "other")], "id string, label string, surface_form string")
    assert reads.named_by_any(nodes, ["uniTED"]).count() == 50
    assert reads.named_by_any(nodes, []).count() == 0


def test_order_details_join_names_first(spark):
    """equipment one and two mentions away, without a shuffle for distinct pairs."""
    orders = spark.createDataFrame([("o1", "d"), ("o2", "d"), ("o3", "d")], "id string, date string")
    edges = spark.createDataFrame([("1", "e1", "MENTIONED_IN", "o1"), ("2", "o1", "MENTIONED_IN", "o2"), ("3", "e2", "MENTIONED_IN", "o2"), ("4", "e2", "MENTIONED_IN", "o2")], "edge_id string, src string, type string, dst string")
    found = answers.order_details(orders, edges, spark.createDataFrame([("e1", "A"), ("e2", "B")], "id string, name string"))
    assert sorted(map(tuple, found.collect())) == [("o1", "d", "A,B"), ("o2", "d", "A,B"), ("o3", "d", "")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == plan.count("Aggregate [id#")
    assert not any("Aggregate [id#" in line and "other#" in line for line in plan.splitlines())

def test_corrections_meet_modes_as_lists(spark, monkeypatch):
    """one row of lists for each document, and none for each correction, meets the modes."""
    seen, write = {}, lanes.written
    monkeypatch.setattr(lanes, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    edges = spark.createDataFrame([("e1", "a", "HAS_FAILURE", "m", "d1", "x", "document"), ("e2", "a", "HAS_FAILURE", "m", "d2", "", "human"), ("e3", "a", "HAS_FAILURE", "m", None, None, "human")], "edge_id string, src string, type string, dst string, doc_id string, cause string, source string")
    nodes = spark.createDataFrame([("a", "Equipment", "P-1"), ("m", "FailureMode", "leak")], "id string, label string, surface_form string")
    said = spark.createDataFrame([(f"d{i % 2 + 1}", f"c{i:03}", f"n{i % 3}" if i % 4 else None, "not so") for i in range(100)], "doc_id string, id string, author string, text string")
    (row,) = lanes.failures_with_corrections(edges, nodes, said).collect()
    assert tuple(row) == ("P-1", "leak", 3, ["x"], ["d1", "d2"], ["document", "human"], ["n0", "n1", "n2"], ["not so"], [f"c{i:03}" for i in range(100)])
    assert seen["corrections"].count() == 2


def test_a_piece_in_very_many_orders(spark):
    """orders that mention one piece do not meet each other."""
    orders = spark.range(30_000).selectExpr("concat('wo:', id) AS id")
    edges = orders.selectExpr("concat('m', id) AS edge_id", "'equip:1' AS src", "'MENTIONED_IN' AS type", "id AS dst").unionAll(spark.createDataFrame([("x", "equip:1", "FIXED_BY", "proc:1")], "edge_id string, src string, type string, dst string"))
    nodes = spark.createDataFrame([("equip:1", "Equipment")], "id string, label string")
    procedures = spark.createDataFrame([("proc:1", "p", ["one", "two"])], "id string, name string, steps array<string>")
    started = time.monotonic()
    assert lanes.steps(orders, edges, nodes, procedures).distinct().count() == 60_000
    assert time.monotonic() - started < 60  # the pairs of orders are 900 million


def test_commits_write_each_text_and_edge_once(spark, tmp_path, monkeypatch):
    """F8, F10: a good subgraph's text is not written beside its parts, and edges are not written before the graph's own table."""
    seen, write = {}, writer.written
    monkeypatch.setattr(writer, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    node, edge = '{"type": "Equipment", "surface_form": "%s", "resolved_id": "%s"}', '{"type": "FEEDS", "src": "%s", "dst": "%s"}'
    good = '{"doc_id": "d", "nodes": [%s, %s], "edges": [%s, %s]}' % (node % ("P", "p"), node % ("Q", "q"), edge % ("P", "Q"), edge % ("P", "nowhere"))
    tables = writer.GraphWriter(spark, str(tmp_path / "graph"))
    assert tables.commit(spark.createDataFrame([(good,), ("[]",)], "raw string"), 0) == 1
    assert [r.raw for r in seen["subgraphs"].collect() if r.reason is None] == [None]
    assert "edges" not in seen and [r.id for r in seen["missing"].collect()] == ["nowhere"]
    assert [(r.src, r.dst) for r in tables.edges().collect()] == [("p", "q")]
    assert [r.raw for r in tables.tables.read("parked").collect()] == ["[]"]


def hub_graph(seed):
    """Three hubs of many edges, among nodes with a few."""
    pick = random.Random(seed)
    edges = [(f"h{i}", f"n{i}", f"hub{pick.randrange(3)}", "FIXED_BY", 1.0) for i in range(40)] + [(f"g{i}", f"n{i}", f"goal{i % 3}", "HAS_FAILURE", 1.0) for i in range(0, 40, 2)]
    return edges + [(f"c{i}", f"n{pick.randrange(40)}", f"n{pick.randrange(40)}", "CONNECTED_TO", 0.5) for i in range(30)] + [(f"d{i}", f"n{i}", f"hub{i % 3}", "FIXED_BY", 1.0) for i in range(0, 40, 5)]


def test_hubs_are_not_grown_through(spark, monkeypatch):
    """trails of up to four edges by hubs, with either way to join the middle, against a plain search; the cut of outward trails too."""
    edges, types = hub_graph(2), ["FIXED_BY", "HAS_FAILURE", "CONNECTED_TO"]
    table = spark.createDataFrame(edges, test_paths.EDGES)
    half = []
    monkeypatch.setattr(paths, "half_trails", lambda *a: half.append(a))
    pairs = [("n0", "n1"), ("n2", "n15"), ("n5", "n5"), ("hub0", "n3")]
    plain = {s: test_paths.plain_trails(edges, s, types, 4) for s in ("n0", "n2", "n5", "hub0")}
    for many, limit in ((2, 100_000), (256, 7)):
        monkeypatch.setattr(paths, "MANY", many)
        found = paths.paths_between(table, spark.createDataFrame(pairs, "start string, end string"), types, 4, limit)
        wanted = [(s, e, len(p), p, n, st) for s, e in pairs for _, _, p, n, st in sorted((len(p), ">".join(p), p, n, st) for at, p, n, st in plain[s] if at == e)[:limit]]
        assert test_paths.rows_of(found) == sorted(wanted)
    nodes = spark.createDataFrame([(f"goal{i}", "FailureMode") for i in range(3)] + [("hub1", "Procedure"), ("hub2", "Procedure")], "id string, label string")
    goals = {"goal0", "goal1", "goal2", "hub1", "hub2"}
    for limit in (1, 5, 60):
        found = paths.paths_outward(table, nodes, spark.createDataFrame([("n0",), ("n2",), ("hub0",), ("nowhere",)], "id string"), ["FailureMode", "Procedure"], types, 4, limit)
        wanted = [(s, at, len(p), p, n, st) for s in ("n0", "n2", "hub0") for _, _, p, n, st, at in sorted((len(p), ">".join(p), p, n, st, at) for at, p, n, st in plain[s] if at in goals)[:limit]]
        assert test_paths.rows_of(found) == sorted(wanted)
    assert not half


def test_choice_writes_nothing_between_rounds(spark, monkeypatch):
    """a chain of overlapping paths is chosen in one fold."""
    monkeypatch.setattr(paths, "written", None)
    rows = [("q", f"p{i:02}", 1.0 - i / 100, [("T", f"a{i}", f"b{i}", 1.0), ("T", f"a{i + 1}", f"b{i + 1}", 1.0), ("T", f"b{i}", f"a{i}", 1.0)]) for i in range(40)]
    table = spark.createDataFrame(rows, "question string, path_id string, score double, steps array<struct<type:string,src:string,dst:string,confidence:double>>")
    for overlap, step in ((0.3, 2), (0.5, 1)):
        assert [r.path_id for r in paths.choose_paths(table, 100, overlap).orderBy("nth").collect()] == [f"p{i:02}" for i in range(0, 40, step)]


def test_two_hubs_give_what_a_pair_takes(spark, monkeypatch):
    """of the common neighbours of two hubs, only those meet the pairs that may be among their first paths."""
    edges = [(f"{kind}{i}{more}", f"n{i}", f"{hub}{i % 2 if hub == 'p' else 0}", "FIXED_BY", 1.0) for i in range(120) for kind, hub in (("f", "m"), ("x", "p")) for more in ("", "b")[: 2 if i % 40 == 3 else 1]]
    edges += [("l", "m0", "m0", "FIXED_BY", 1.0), ("c", "n1", "n2", "CONNECTED_TO", 0.5), ("d", "p0", "m0", "CONNECTED_TO", 0.5)]
    seen, write = {}, paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: seen.setdefault(name, write(df, name)) if name == "middles" else write(df, name))
    monkeypatch.setattr(paths, "MANY", 8)
    types, pairs, table = ["FIXED_BY", "CONNECTED_TO"], [("n1", "n2"), ("n3", "n8"), ("n3", "n43"), ("n8", "n3"), ("m0", "n5"), ("n5", "n5")], spark.createDataFrame(edges, test_paths.EDGES)
    for limit in (1, 5, 60):
        seen.clear()
        found = paths.paths_between(table, spark.createDataFrame(pairs, "start string, end string"), types, 4, limit)
        wanted = [(s, e, len(p), p, n, st) for s, e in pairs for _, _, p, n, st in sorted((len(p), ">".join(p), p, n, st) for at, p, n, st in test_paths.plain_trails(edges, s, types, 4) if at == e)[:limit]]
        assert test_paths.rows_of(found) == sorted(wanted)
        # two parallel edges of a neighbour are four middles
        assert max(r["count"] for r in seen["middles"].groupBy("a", "b").count().collect()) <= limit + 4 + 3 * 3 + 3


def test_lists_of_modes_are_neither_sorted_nor_joined(spark):
    """modes get their lists where they are returned, in more than one batch; against plain sets."""
    pick = random.Random(5)
    said = [(None if i % 97 == 0 else f"d{i % 40}", f"c{pick.randrange(2500)}", pick.choice([None, "é", "z", "Z", f"n{i}"]), pick.choice(["not so", "no", ""])) for i in range(4000)]
    edges = [(f"e{i % 5900}", f"s{i % 30}", "HAS_FAILURE", f"m{i % 7}", pick.choice([None, "d99", *(f"d{k}" for k in range(40))]), pick.choice(["x", "", None]), "human") for i in range(6000)]
    nodes = [(f"s{i}", "Equipment", f"P-{i // 2}") for i in range(30)] + [(f"m{i}", "FailureMode", f"mode {i}") for i in range(7)]
    tables = (spark.createDataFrame(edges, "edge_id string, src string, type string, dst string, doc_id string, cause string, source string"), spark.createDataFrame(nodes, "id string, label string, surface_form string"), spark.createDataFrame(said, "doc_id string, id string, author string, text string"))
    found, wanted = lanes.failures_with_corrections(*tables), []
    for tag, mode in sorted({(f"P-{int(e[1][1:]) // 2}", f"mode {e[3][1:]}") for e in edges}):
        own = [e for e in edges if (f"P-{int(e[1][1:]) // 2}", f"mode {e[3][1:]}") == (tag, mode)]
        docs = {e[4] for e in own} - {None}
        listed = lambda values: sorted({v for v in values if v is not None}, key=str.encode)
        lists = [listed(c[k] for c in said if c[0] in docs) for k in (2, 3, 1)]
        wanted.append((tag, mode, len({e[0] for e in own}), listed(e[5] for e in own if e[5]), listed(docs), ["human"], *lists))
    assert sum(len(x) for row in wanted for x in row[6:]) > 2 * spark.sparkContext.defaultParallelism * 1000
    assert sorted(map(tuple, found.collect())) == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    glued = {(r.tag, r.mode): (r.corrected_by, r.corrections, r.correction_ids) for r in lanes.failures_with_corrections(*tables, "|").collect()}
    assert glued == {row[:2]: tuple("|".join(x) for x in row[6:]) for row in wanted}
    assert all(tuple(r[6:]) == ([], [], []) for r in lanes.failures_with_corrections(*tables[:2], tables[2].limit(0)).collect())


def test_lists_come_in_batches():
    """a batch of modes is given back in parts, none of which holds many more values than LISTED."""
    docs = pa.array([["a"]] * 5 + [[], ["b", "a", "nowhere"]])
    modes = pa.record_batch([pa.nulls(7, pa.string()), *(pa.nulls(7, pa.list_(pa.string())) for _ in lanes.LISTS), docs], ["doc_id", *lanes.LISTS, "docs"])
    ids = [[f"{i:06}" for i in range(200_000)], ["000007", "x"]]
    said = pa.record_batch([pa.array(["a", "b"]), pa.array([[], ["é"]], pa.list_(pa.string())), pa.array([["no"], ["no"]]), pa.array(ids), pa.nulls(2, pa.list_(pa.string()))], ["doc_id", *lanes.LISTS, "docs"])
    out = list(lanes._told(["docs"], None)(iter([said, modes])))
    assert [len(b) for b in out] == [2, 2, 3]
    assert [len(x) for b in out for x in b.column("correction_ids").to_pylist()] == [200_000] * 5 + [0, 200_001]
    assert out[-1].column("corrected_by").to_pylist() == [[], [], ["é"]] and out[-1].column("correction_ids")[2].as_py() == [*ids[0], "x"]


def test_scores_go_along_with_paths(spark, small, monkeypatch):
    """weights of edges reach the paths in their steps and give the scores that joins of the paths with degrees gave."""
    kinds = {"weight": paths.CAUSAL_TYPES, "compliance_weight": paths.COMPLIANCE_TYPES + paths.CAUSAL_TYPES}
    pick = random.Random(4)
    types = ["CONNECTED_TO", "HAS_FAILURE", "FIXED_BY", "GOVERNED_BY", "PART_OF"]
    edges = spark.createDataFrame([(f"e{i}", f"n{pick.randrange(12)}", f"n{pick.randrange(12)}", pick.choice(types), pick.choice([None, 0.1, 0.7])) for i in range(40)], "edge_id string, src string, dst string, type string, confidence double")
    nodes = spark.createDataFrame([(f"n{i}", ["Equipment", "FailureMode", "Procedure"][i % 3]) for i in range(12)], "id string, label string")
    asked = spark.createDataFrame([("q", "why"), ("r", "which standard"), ("s", "why"), ("t", "which standard")], "question string, text string")
    seeds = spark.createDataFrame([("q", 0, "n0"), ("q", 1, "n3"), ("r", 0, "n0"), ("r", 1, "n3"), ("s", 0, "n6"), ("t", 0, "n6")], "question string, nth int, id string")
    found = paths.find_paths(graph.weighted(edges, **kinds), nodes, asked, seeds, 4, 30)
    for name, own in kinds.items():
        mine = found.where(F.col("question").isin(*("qs" if name == "weight" else "rt"))).withColumn("carried", F.aggregate("steps", F.lit(1.0), lambda p, s: p * s[name]))  # noqa: B023
        rows = graph.scored_paths(mine, graph.degrees(edges, own)).collect()
        assert {r.hops for r in rows} >= {1, 2} and all(r.carried == r.score for r in rows)
    monkeypatch.setattr(graph, "scored_paths", None)
    assert registry.queries()["gr07_pruned"](spark, small).count() > 0
