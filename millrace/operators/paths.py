"""Paths for many questions at once: half-trails from both ends that meet in the middle, and a greedy choice in rounds (GR-1, GR-2, GR-5, GR-7, SET-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions.lineage import written
from millrace.operators.graph import KEPT_PATHS, OVERLAP, both_ways, of_types, ranked

# Edges of causal and of compliance questions, words of the latter, labels that paths lead to, hops and seeds.
CAUSAL_TYPES = ["CONNECTED_TO", "HAS_FAILURE", "FIXED_BY"]
COMPLIANCE_TYPES = ["GOVERNED_BY", "MENTIONED_IN"]
COMPLIANCE_WORDS = ["standard", "regulation", "compliance", "overdue", "inspection", "governed", "oisd", "ibr", "statutory"]
EVIDENCE_LABELS = ["FailureMode", "Procedure", "RegulationClause"]
PROCESS_TYPES, PROCESS_LABELS = ["CONNECTED_TO"], ["Equipment", "Instrument"]
MAX_HOPS, PATHS, PROCESS_HOPS, PROCESS_SEEDS = 4, 100, 2, 4
MANY = 256  # edges of a node that no trail grows through
WEIGHTS = ["weight", "compliance_weight"]  # what the flow score takes of an edge, for either kind of question



def _hops(edges: DataFrame, types: list[str]) -> DataFrame:
    """(edge_id, step, node, other): the edges of the types from either end; weights of ``edges`` go along in the steps."""
    step = F.struct("type", "src", "dst", "confidence", *(c for c in WEIGHTS if c in edges.columns)).alias("step")
    return both_ways(of_types(edges, types).select("edge_id", step, "src", "dst"))


def _longer(trails: DataFrame, hops: DataFrame) -> DataFrame:
    """Trails(start, at, path, nodes, steps) with one more edge that they do not have yet."""
    more = trails.join(hops, trails["at"] == hops["node"]).where(~F.array_contains("path", F.col("edge_id")))
    return more.select("start", F.col("other").alias("at"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("steps", F.array("step")).alias("steps"))


def _seeded(ids: DataFrame, hops: DataFrame) -> DataFrame:
    """Trails without an edge, from ids(id)."""
    empty = lambda kind: F.array().cast(ArrayType(kind))
    return ids.distinct().select(F.col("id").alias("start"), F.col("id").alias("at"), empty(StringType()).alias("path"), F.array("id").alias("nodes"), empty(hops.schema["step"].dataType).alias("steps"))


def half_trails(hops: DataFrame, ids: DataFrame, most: int) -> list[DataFrame]:
    """Trails of 0, 1, ... ``most`` edges from ids(id), each level written before the next grows from it."""
    levels = [_seeded(ids, hops)]
    for _ in range(most):
        levels.append(written(_longer(levels[-1], hops), "trails"))
    return levels


def paths_between(edges: DataFrame, pairs: DataFrame, types: list[str], max_hops: int = MAX_HOPS, limit: int = PATHS) -> DataFrame:
    """GR-1, GR-5: undirected trails (no edge twice) of up to ``max_hops`` edges between the ends of each of pairs(start, end).

    Half-trails grow from both ends and meet: a trail of n edges is ceil(n / 2) edges from its start and
    the rest from its end, so none grows beyond half the hops, and each end's half-trails serve all its
    pairs. Up to four hops only one edge grows from each end, and ``_met`` finds what joins them. The ``limit`` shortest of a pair are given, in order of path. Columns: start, end, hops, path
    (edge ids), nodes, steps (the stored edges). Repeated pairs count once; pairs of a node without edges have no path. Edge ids hold no '>'.
    """
    pairs, hops = written(pairs.select("start", "end").distinct(), "pairs"), written(_hops(edges, types), "hops")
    if max_hops <= 4:
        return _stored(_shortest(_met(pairs, hops, max_hops, limit), limit), hops)
    there = half_trails(hops, pairs.select(F.col("start").alias("id")), (max_hops + 1) // 2)
    back = half_trails(hops, pairs.select(F.col("end").alias("id")), max_hops // 2)
    found = None
    for n in range(1, max_hops + 1):
        head = there[(n + 1) // 2].join(pairs, "start")
        tail = back[n // 2].select(F.col("start").alias("end"), "at", *(F.reverse(c).alias(f"tail_{c}") for c in ("path", "nodes", "steps")))
        met = head.join(tail, ["end", "at"]).where(~F.arrays_overlap("path", "tail_path"))
        level = met.select("start", "end", F.lit(n).alias("hops"), F.concat("path", "tail_path").alias("path"), F.concat("nodes", F.slice("tail_nodes", 2, max_hops)).alias("nodes"), F.concat("steps", "tail_steps").alias("steps"))
        found = level if found is None else found.union(level)
    return _shortest(found, limit)


def _met(pairs: DataFrame, hops: DataFrame, max_hops: int, limit: int) -> DataFrame:
    """Trails of up to four edges between pairs(start, end), the shortest ``limit`` of each and some more.

    They have the edges at both ends, and none, one or two between them. No end grows through a node of many edges:
    two edges between a and b are looked for by ``_light_middles``, and where both have many by ``_leading_middles``.
    Instead of steps they have kinds, which do not repeat the nodes.
    """
    kind = F.struct("step.type", (F.col("step.src") == F.col("node")).alias("forward"), *(f"step.{c}" for c in _rest(hops)))
    step = lambda node, other, k: hops.select(F.col("node").alias(node), F.col("other").alias(other), F.col("edge_id").alias(f"e{k}"), kind.alias(f"k{k}"))

    def level(rows: DataFrame, between: list[str], ks: list[int]) -> DataFrame:
        path = F.array(*(f"e{k}" for k in ks))
        rows = rows.where(F.size(F.array_distinct(path)) == len(ks))
        return rows.select("start", "end", F.lit(len(ks)).alias("hops"), path.alias("path"), F.array("start", *between, "end").alias("nodes"), F.array(*(f"k{k}" for k in ks)).alias("kinds"))

    headed = written(pairs.join(step("start", "a", 1), "start"), "headed")
    found = level(headed.where(F.col("a") == F.col("end")), [], [1])
    last = step("end", "b", 4).withColumn("k4", _turned(F.col("k4")))
    if max_hops == 2:
        found = found.union(level(headed.join(last.withColumnRenamed("b", "a"), ["end", "a"]), ["a"], [1, 4]))
    if max_hops >= 3:
        ends = written(headed.join(last, "end").where("e1 <> e4"), "ends")
        found = found.union(level(ends.where("a = b"), ["a"], [1, 4]))
        found = found.union(level(ends.join(step("a", "b", 2), ["a", "b"]), ["a", "b"], [1, 2, 4]))
    if max_hops == 4:
        count = lambda c: hops.groupBy(F.col("node").alias(c)).agg(F.count("*").alias(f"n_{c}"))
        sized = written(ends.select("a", "b").distinct().join(count("a"), "a").join(count("b"), "b"), "wanted")
        light = F.least("n_a", "n_b") <= MANY
        middles = written(_leading_middles(sized.where(~light), step("a", "m", 2), step("b", "m", 3), limit), "middles")
        for few in (ends.join(_light_middles(sized.where(light), step("near", "m", 2), step("far", "m", 3)), ["a", "b"]), _leading_ends(ends, middles, limit).join(middles, ["a", "b"])):
            found = found.union(level(few, ["a", "m", "b"], [1, 2, 3, 4]))
    return found


def _turned(kind: Column) -> Column:
    """The kind of an edge that is gone the other way."""
    return kind.withField("forward", ~kind["forward"])


def _light_middles(wanted: DataFrame, there: DataFrame, back: DataFrame) -> DataFrame:
    """Two different edges from a over m to b, for each of wanted(a, b, n_a, n_b), from the end of fewer edges, here called near."""
    by_a = F.col("n_a") <= F.col("n_b")
    rows = wanted.select(F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("near"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("far"), by_a.alias("by_a"))
    met = rows.join(there, "near").join(back, ["far", "m"]).where("e2 <> e3")
    of = lambda x, y: F.when(F.col("by_a"), F.col(x)).otherwise(F.col(y))
    return met.select(of("near", "far").alias("a"), of("far", "near").alias("b"), "m", of("e2", "e3").alias("e2"), of("k2", "k3").alias("k2"), of("e3", "e2").alias("e3"), _turned(of("k3", "k2")).alias("k3"))


def _leading_middles(wanted: DataFrame, there: DataFrame, back: DataFrame, limit: int) -> DataFrame:
    """Two different edges from a over m to b, for each of wanted(a, b), by the neighbours in common, as many as any pair takes.

    Between given first and last edges the order of path is that of the two edges. An edge at an end is one of the
    two only where m is a, b or an end of the pair, so those after ``limit`` and four other m are in no answer.
    """
    ends = lambda rows, c: rows.join(wanted.select(c).distinct(), c, "left_semi")
    rows = ends(there, "a").join(ends(back, "b"), "m").where("e2 <> e3").join(wanted.select("a", "b"), ["a", "b"], "left_semi")
    key = F.concat("e2", F.lit(">"), "e3", F.lit(">"))
    first = (F.row_number().over(Window.partitionBy("a", "b", "m").orderBy(key)) == 1).cast("int")
    before = F.sum("first").over(Window.partitionBy("a", "b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("first")
    rows = rows.repartition("a", "b").withColumn("first", first).withColumn("before", before)
    return rows.where(F.col("before") < limit + 4).drop("first", "before").withColumn("k3", _turned(F.col("k3")))


def _leading_ends(ends: DataFrame, middles: DataFrame, limit: int) -> DataFrame:
    """Of ends(start, end, a, b, e1, e4), those that have middles(a, b, m) and before whose first edge there are not ``limit`` paths of the pair."""
    sizes = middles.groupBy("a", "b").agg((F.countDistinct("m") - 4).alias("gives"))
    rows = ends.join(sizes, ["a", "b"]).repartition("start", "end").withColumn("gives", F.greatest("gives", F.lit(0)))
    key = F.concat("e1", F.lit(">"))
    upto = F.sum("gives").over(Window.partitionBy("start", "end").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("gives").over(Window.partitionBy("start", "end", key))
    return rows.withColumn("own", own).withColumn("before", upto - F.col("own")).where(F.col("before") < limit).drop("gives", "own", "before")


def _rest(hops: DataFrame) -> list[str]:
    """What a step has beside its type and ends."""
    return hops.schema["step"].dataType.names[3:]


def _stored(found: DataFrame, hops: DataFrame) -> DataFrame:
    """Paths with their steps, from their kinds and nodes."""
    at = lambda i, ahead: F.get("nodes", i + ahead.cast("int"))
    step = lambda k, i: F.struct(k["type"].alias("type"), at(i, ~k["forward"]).alias("src"), at(i, k["forward"]).alias("dst"), *(k[c].alias(c) for c in _rest(hops)))
    return found.withColumn("steps", F.transform("kinds", step)).drop("kinds")


def paths_outward(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, labels: list[str], types: list[str], max_hops: int = MAX_HOPS, limit: int = PATHS) -> DataFrame:
    """GR-2: undirected trails from seeds(id) to nodes(id, label) of the labels, as ``paths_between`` gives them.

    The other end is open, so trails grow from the seeds, but only from those with less than ``limit`` shorter ones, and
    the last hop but one takes of each node's edges the first that give enough (``_leading``). Edge ids hold no '>'.
    """
    hops, goals = written(_hops(edges, types), "hops"), written(nodes.where(F.col("label").isin(labels)).select("id").distinct(), "goals")
    last = written(hops.join(goals.withColumnRenamed("id", "other"), "other", "left_semi").select(*hops.columns), "last")
    level, found, open_ = _seeded(seeds, hops), None, None
    for n in range(1, max_hops + 1):
        if n > 2:  # the full trails of n - 2 edges, of open seeds
            level = written(_longer(level.join(open_, "start", "left_semi"), hops), "trails")
        some = level if open_ is None else level.join(open_, "start", "left_semi")
        if n > 1:
            reached = hops.join(some.select(F.col("at").alias("node")).distinct(), "node", "left_semi").select(*hops.columns)
            some = _longer(some, written(_leading(reached, last, goals, limit + 6 * (n - 2)), "leading"))
        some = _longer(some, last)
        more = written(_shortest(some.select("start", F.col("at").alias("end"), F.lit(n).alias("hops"), "path", "nodes", "steps"), limit, "start"), "found")
        found = more if found is None else found.union(more)
        full = found.groupBy("start").count().where(F.col("count") >= limit)
        open_ = seeds.select(F.col("id").alias("start")).distinct().join(full, "start", "left_anti")
    return _shortest(found, limit, "start")


def _leading(hops: DataFrame, last: DataFrame, goals: DataFrame, enough: int) -> DataFrame:
    """Of each node's hops, in order of edge, those before which there are not yet ``enough`` ways on to a goal.

    A hop counts four ways at most, and only the first to each node. An edge that a trail has already takes those of
    one hop and one of two others, so six for each edge are asked for beyond the limit.
    """
    ways = last.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("ways"))
    # the way straight back over the same edge is none
    rows = hops.join(ways, "other").join(goals.select(F.col("id").alias("node"), F.lit(1).alias("back")), "node", "left")
    key = F.concat("edge_id", F.lit(">"))
    first = F.row_number().over(Window.partitionBy("node", "other").orderBy(key)) == 1
    gives = F.when(F.col("first"), F.least(F.col("ways") - F.coalesce("back", F.lit(0)), F.lit(4))).otherwise(0)
    before = F.sum("gives").over(Window.partitionBy("node").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", first).withColumn("gives", gives).withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.where(F.col("before") < enough).select(*hops.columns)


def _shortest(found: DataFrame, limit: int, *by: str) -> DataFrame:
    key = F.array_join("path", ">")
    return ranked(found.withColumn("key", key), list(by) or ["start", "end"], ["hops", "key"], limit).drop("key", "nth")


def is_compliance(text: Column) -> Column:
    """STR-14: whether a question asks for standards and inspections."""
    found = F.lit(False)
    for word in COMPLIANCE_WORDS:
        found = found | F.contains(F.lower(text), F.lit(word))
    return F.coalesce(found, F.lit(False))


def find_paths(edges: DataFrame, nodes: DataFrame, questions: DataFrame, seeds: DataFrame, max_hops: int = MAX_HOPS, limit: int = PATHS) -> DataFrame:
    """GR-5: the candidate paths of questions(question, text) with seeds(question, nth, id), all questions in one plan.

    Two seeds or more: paths between each two, in the order of the seeds. One: paths outward to failure
    modes, procedures and clauses. The first four seeds also give their process neighbourhood of two hops.
    Edge types depend on the words of the question. Columns: question, then those of ``paths_between``; equal paths count once.
    """
    kinds = questions.select("question", is_compliance(F.col("text")).alias("compliance"))
    # a seed that is named twice counts once, at its first place
    seeds = seeds.groupBy("question", "id").agg(F.min("nth").alias("nth")).join(kinds, "question")
    order = Window.partitionBy("question").orderBy("nth", "id")
    seeds = written(seeds.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("question"))}), "seeds")
    first = seeds.select("question", "compliance", F.col("id").alias("start"), F.col("place").alias("p"))
    second = seeds.select("question", F.col("id").alias("end"), F.col("place").alias("q"))
    pairs = first.join(second, "question").where("p < q").select("question", "compliance", "start", "end")
    alone = seeds.where("n = 1").select("question", "compliance", F.col("id").alias("start"))
    near = seeds.where(F.col("place") <= PROCESS_SEEDS).select("question", F.col("id").alias("start"))
    parts = [near.join(paths_outward(edges, nodes, near.select(F.col("start").alias("id")), PROCESS_LABELS, PROCESS_TYPES, min(PROCESS_HOPS, max_hops), limit), "start")]
    for compliance in (False, True):
        types = (COMPLIANCE_TYPES if compliance else []) + CAUSAL_TYPES
        mine, own = pairs.where(F.col("compliance") == compliance), alone.where(F.col("compliance") == compliance)
        parts.append(mine.join(paths_between(edges, mine, types, max_hops, limit), ["start", "end"]).drop("compliance"))
        parts.append(own.join(paths_outward(edges, nodes, own.select(F.col("start").alias("id")), EVIDENCE_LABELS, types, max_hops, limit), "start").drop("compliance"))
    out = None
    for part in parts:
        part = part.select("question", "start", "end", "hops", "path", "nodes", "steps")
        out = part if out is None else out.unionByName(part)
    # by question, as all that follows takes them
    return out.repartition("question").dropDuplicates(["question", "start", "path"])


def choose_paths(paths: DataFrame, keep: int = KEPT_PATHS, overlap: float = OVERLAP) -> DataFrame:
    """GR-7, SET-3: for each of paths(question, path_id, score, steps), whether the greedy choice keeps it: up to ``keep`` a question.

    The choice takes paths by score, then path_id, and leaves out each that shares more than ``overlap`` of
    the smaller's undirected edges with one that it took. A question's candidates, a hundred for a pair or a seed at
    most, are one sorted list, which one fold goes through. Paths without edges are never kept.
    Columns: question, path_id, nth (from 1).
    """
    edge = F.transform("steps", lambda s: F.concat_ws("\x1f", s["type"], F.least(s["src"], s["dst"]), F.greatest(s["src"], s["dst"])))
    rows = paths.select("question", "path_id", "score", F.array_distinct(edge).alias("edges")).where(F.size("edges") > 0)
    best = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "path_id"))
    listed = rows.withColumn("nth", best).groupBy("question").agg(F.sort_array(F.collect_list(F.struct("nth", "path_id", "edges"))).alias("rows"))

    def take(kept: Column, row: Column) -> Column:
        shared = lambda k: F.size(F.array_intersect(k["edges"], row["edges"])) / F.least(F.size(k["edges"]), F.size(row["edges"])) > overlap
        return F.when((F.size(kept) < keep) & ~F.exists(kept, shared), F.concat(kept, F.array(row))).otherwise(kept)

    kept = listed.select("question", F.posexplode(F.aggregate("rows", F.slice("rows", 1, 0), take)).alias("nth", "row"))
    return kept.select("question", F.col("row.path_id").alias("path_id"), (F.col("nth") + 1).cast("bigint").alias("nth"))
