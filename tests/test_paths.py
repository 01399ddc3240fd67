"""Two-ended paths, the choice in rounds and one-to-one incidents, against plain searches and loops."""

import datetime as dt
import random

import pytest

from millrace.operators import alerts, paths

EDGES = "edge_id string, src string, dst string, type string, confidence double"


def random_graph(seed, n=14, m=26):
    pick = random.Random(seed)
    return [(f"e{i}", f"n{pick.randrange(n)}", f"n{pick.randrange(n)}", pick.choice(["CONNECTED_TO", "HAS_FAILURE", "PART_OF"]), pick.random()) for i in range(m)]


def plain_trails(edges, start, types, most):
    """All undirected trails from a node: (end, path, nodes, stored steps)."""
    out, todo = [], [(start, (), (start,), ())]
    while todo:
        at, path, nodes, steps = todo.pop()
        if path:
            out.append((at, path, nodes, steps))
        if len(path) < most:
            for e, src, dst, kind, conf in edges:
                if kind in types and e not in path:
                    for a, b in {(src, dst), (dst, src)}:
                        if a == at:
                            todo.append((b, (*path, e), (*nodes, b), (*steps, (kind, src, dst, conf))))
    return out


def rows_of(found):
    return sorted((r.start, r.end, r.hops, tuple(r.path), tuple(r.nodes), tuple(tuple(s) for s in r.steps)) for r in found.collect())


@pytest.mark.parametrize(("seed", "hops", "limit"), [(1, 4, 1000), (2, 5, 1000), (3, 3, 2), (4, 1, 1000), (5, 4, 3)])
def test_paths_between(spark, seed, hops, limit):
    edges, types = random_graph(seed), ["CONNECTED_TO", "HAS_FAILURE"]
    pairs = [(f"n{i}", f"n{(i * 5 + 2) % 14}") for i in range(14)] + [("n1", "n1"), ("n0", "nowhere"), ("n0", "n2")]
    found = paths.paths_between(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "start string, end string"), types, hops, limit)
    wanted = []
    for start, end in sorted(set(pairs)):
        own = sorted(((len(p), ">".join(p), p, n, s) for at, p, n, s in plain_trails(edges, start, types, hops) if at == end))[:limit]
        wanted += [(start, end, h, p, n, s) for h, _, p, n, s in own]
    assert rows_of(found) == sorted(wanted)


def test_paths_outward(spark):
    edges, types = random_graph(9), ["CONNECTED_TO", "PART_OF"]
    nodes = [(f"n{i}", ["Equipment", "FailureMode", "Line"][i % 3]) for i in range(14)]
    seeds = ["n0", "n3", "n3", "n13", "nowhere"]
    found = paths.paths_outward(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, "id string, label string"), spark.createDataFrame([(s,) for s in seeds], "id string"), ["FailureMode", "Line"], types, 3, 20)
    goals, wanted = {i for i, label in nodes if label != "Equipment"}, []
    for start in set(seeds):
        own = sorted(((len(p), ">".join(p), p, n, s, at) for at, p, n, s in plain_trails(edges, start, types, 3) if at in goals))[:20]
        wanted += [(start, at, h, p, n, s) for h, _, p, n, s, at in own]
    assert rows_of(found) == sorted(wanted)


def test_only_half_of_the_hops_grow(spark, monkeypatch):
    grown = []
    half = paths.half_trails
    monkeypatch.setattr(paths, "half_trails", lambda hops, ids, most: grown.append(most) or half(hops, ids, most))
    paths.paths_between(spark.createDataFrame(random_graph(1), EDGES), spark.createDataFrame([("n1", "n2")], "start string, end string"), ["CONNECTED_TO"], 5)
    assert grown == [3, 2]


def plain_choice(rows, keep, overlap):
    taken = []
    for path_id, _, edges in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(taken) < keep and edges and all(len(edges & k) / min(len(edges), len(k)) <= overlap for _, k in taken):
            taken.append((path_id, edges))
    return [p for p, _ in taken]


@pytest.mark.parametrize(("seed", "keep"), [(1, 15), (2, 3), (3, 1000)])
def test_choice_equals_greedy_loop(spark, seed, keep):
    """Many questions; one has most of the paths, all over the same few edges."""
    pick, rows, plain = random.Random(seed), [], {}
    for q in range(12):
        n, pool = (400, 9) if q == 0 else (pick.randrange(1, 25), 8)
        for i in range(n):
            steps = [("T", *pick.sample(["a", "b", "c", "d", "e"][: 3 + pool % 3], 2), 1.0) for _ in range(pick.randrange(0, 6))]
            score = round(pick.random(), 1)
            rows.append((f"q{q}", f"p{i:03}", score, steps))
            plain.setdefault(f"q{q}", []).append((f"p{i:03}", score, frozenset((t, frozenset((a, b))) for t, a, b, _ in steps)))
    table = spark.createDataFrame(rows, "question string, path_id string, score double, steps array<struct<type:string,src:string,dst:string,confidence:double>>")
    found = {}
    for r in paths.choose_paths(table.repartition(5), keep).orderBy("question", "nth").collect():
        found.setdefault(r.question, []).append(r.path_id)
    assert found == {q: w for q, own in plain.items() if (w := plain_choice(own, keep, 0.7))}


def plain_incidents(rows, seconds):
    """The sequential loop: each alert takes the first later free one of the other unit within the seconds."""
    rows, used, out = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])), set(), []
    for i, (a, t, unit) in enumerate(rows):
        if a in used:
            continue
        used.add(a)
        partner = next((b for b, s, other in rows[i + 1 :] if b not in used and other != unit and abs((t - s).total_seconds()) <= seconds), None)
        used.add(partner)
        pair = (a, partner) if unit == "reactor" else (partner, a)
        out.append((*pair, a))
    return sorted(map(str, out))


@pytest.mark.parametrize(("seed", "span", "n"), [(1, 400, 120), (2, 5000, 150), (3, 60, 80), (4, 30, 60), (5, 900, 1)])
def test_incidents_equal_the_loop(spark, seed, span, n):
    """Sparse and dense times, shared partners, ties, and runs of one unit."""
    pick, rows = random.Random(seed), []
    for i in range(n):
        run = pick.choice(["reactor", "column"]) if i % 7 == 0 or pick.random() < 0.5 else rows[-1][2]
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=pick.randrange(span), milliseconds=pick.choice([0, 0, 1])), run))
    found = alerts.incidents(spark.createDataFrame(rows, "alert_id bigint, ts timestamp_ntz, unit string").repartition(4), 30)
    assert sorted(str((r.reactor_id, r.column_id, r.first_id)) for r in found.collect()) == plain_incidents(rows, 30)


def test_incidents_of_nothing(spark):
    empty = spark.createDataFrame([], "alert_id bigint, ts timestamp_ntz, unit string")
    assert alerts.incidents(empty).count() == 0
