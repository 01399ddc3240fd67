"""Merkle manifest of a dataset: superblocks of fanout^k nodes collapse k levels at a time.

Each value of a column (``lang``) has a tree of its own, whose leaves ascend by doc_id; the roots of
these trees, in order, are the leaves of the upper tree. A node is the hex SHA-256 of the concatenated
hex digests of up to FANOUT nodes. A proof lists, level by level, the digests before and after a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import materialize

#: Nodes of a run, and the levels that one group collapses: a bucket has at most 8^3 nodes.
FANOUT, LEVELS = 8, 3
BUCKET = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "path array<struct<before: string, after: string>>"
_NODE = "tree string, i bigint, n bigint, digest string"
_PROVED = f"tree string, i bigint, subroot string, root string, {_PATH}"
_AUDIT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else their count of UTF-8 bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def layers(digests: list[str], n: int) -> list[list[str]]:
    """A bucket's digests and those of the levels over them: LEVELS at most, fewer where a tree of ``n`` nodes ends."""
    out = [digests]
    while n > 1 and len(out) <= LEVELS:
        last = out[-1]
        out.append([_sha("".join(last[j : j + FANOUT])) for j in range(0, len(last), FANOUT)])
        n = -(-n // FANOUT)
    return out


def paths(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level, the digests before and after it in its runs, level by level."""
    out = []
    for i in range(len(levels[0])):
        own, at = [], i
        for level in levels[:-1]:
            begin = at - at % FANOUT
            own.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + FANOUT])))
            at //= FANOUT
        out.append(own)
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for before, after in path:
        leaf = _sha(before + leaf + after)
    return leaf


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with i (place in its tree) and n (size of the tree): sorted by ranges, then counts of (tree, partition)."""
    keys, own = ["tree", *order, "row"], nodes.columns
    # the last key spreads rows that are equal in the others
    ranged = nodes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.select(*own, F.monotonically_increasing_id().alias("at")), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(runs, ["tree", "part"]).select(*own, (F.col("at") + F.col("shift")).alias("i"), "n")


def _collapsed(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    n = int(nodes["n"].iloc[0])
    top = layers(nodes.sort_values("i")["digest"].tolist(), n)[-1]
    return pd.DataFrame({"tree": [key[0]], "i": [key[1]], "n": [-(-n // BUCKET)], "digest": top})


def _bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"i div {BUCKET}"))


def _stages(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, i, n, digest)`` and the tables of bucket roots over them, up to one node a tree."""
    found = [nodes]
    while len(found) == 1 or (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        dealt = _bucketed(found[-1]).select("tree", "bucket", "i", "n", "digest")
        found.append(materialize(dealt.groupBy("tree", "bucket").applyInPandas(_collapsed, _NODE), "nodes"))
    return found


def _own_path(path) -> list[tuple[str, str]]:
    return [(step["before"], step["after"]) for step in path]


def _proved(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    nodes, over = nodes.sort_values("i"), above.iloc[0]
    lower, upper = paths(layers(nodes["digest"].tolist(), int(nodes["n"].iloc[0]))), _own_path(over["path"])
    steps = [[{"before": b, "after": a} for b, a in own + upper] for own in lower]
    return pd.DataFrame({"tree": key[0], "i": nodes["i"], "subroot": over["subroot"], "root": over["root"], "path": steps})


def _audited(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    nodes, over = nodes.sort_values("i"), above.iloc[0]
    lower, upper = paths(layers(nodes["digest"].tolist(), int(nodes["n"].iloc[0]))), _own_path(over["path"])
    upper_text = "".join(b + a for b, a in upper)
    folded = [fold(given, own + upper) for given, own in zip(nodes["given"], lower, strict=True)]
    proofs = [_sha("".join(b + a for b, a in own) + upper_text) for own in lower]
    return pd.DataFrame({"doc_id": nodes["doc_id"].astype("Int64"), "leaf": nodes["digest"], "subroot": over["subroot"], "root": over["root"], "proof_sha256": proofs, "folded_root": folded, "verified": [f == over["root"] for f in folded]})


def _descended(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """Proofs of the nodes of ``stages[0]``, from those of ``stages[-1]``: lower proofs first, then those above."""
    for nodes in reversed(stages[:-1]):
        over = above.withColumnRenamed("i", "bucket").groupBy("tree", "bucket")
        above = materialize(_bucketed(nodes).groupBy("tree", "bucket").cogroup(over).applyInPandas(_proved, _PROVED), "proofs")
    return above


class Manifest:
    """A dataset's tree: ``leaves`` (doc_id, tree, i, n, digest, given), ``stages`` of bucket roots and ``roots`` (tree, subroot, root)."""

    def __init__(self, leaves: DataFrame, stages: list[DataFrame], top: DataFrame):
        self.leaves, self.stages, self._top = leaves, stages, top
        self.roots = top.select("tree", "subroot", "root")

    def _above(self) -> DataFrame:
        return _descended(self.stages[1:], self._top)

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, path) of every row; path holds each level's digests before and after the node."""
        found = _descended(self.stages, self._top)
        return self.leaves.select("tree", "i", "doc_id", F.col("digest").alias("leaf")).join(found, ["tree", "i"]).select("doc_id", "leaf", "subroot", "root", "path")

    def audit(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the root that each row's given version leads to."""
        over = self._above().withColumnRenamed("i", "bucket").groupBy("tree", "bucket")
        own = _bucketed(self.leaves).select("tree", "bucket", "i", "n", "digest", "given", "doc_id")
        return own.groupBy("tree", "bucket").cogroup(over).applyInPandas(_audited, _AUDIT)


def build(docs: DataFrame, given: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``.

    ``given`` names columns whose values to be verified differ from those of the manifest (a later
    copy, or tampering); without it rows are verified as they are. Nulls are fields of their own, in
    any column; a null lang is a tree of its own, the first; a null doc_id comes before all others.
    Rows with one doc_id stand in the order of their leaves, repeated rows are leaves each. A tree of one
    leaf has that leaf as root. An empty table has neither roots nor proofs.

    Texts are hashed where they are read; digests alone are sorted and grouped. A group is one bucket of
    at most BUCKET nodes of one tree, so a language of all rows is many groups; each stage has
    1 / BUCKET of the rows of the one before, and proofs come down the same buckets without being shuffled.
    """
    now = [F.col(f) for f in FIELDS]
    then = [(given or {}).get(f, F.col(f)) for f in FIELDS]
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))  # null comes before the empty string
    leaves = _placed(docs.select("doc_id", tree.alias("tree"), leaf_digest(now).alias("digest"), leaf_digest(then).alias("given")), "doc_id", "digest")
    stages = _stages(materialize(leaves, "leaves"))
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = materialize(_placed(subroots, "name"), "subroots")
    upper = _stages(tops.select("tree", "i", "n", "digest"))
    root = upper[-1].select("tree", "i", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_PATH.removeprefix("path ")).alias("path"))
    proved = _descended(upper, root)
    top = tops.select("i", F.col("name"), "digest").join(proved.select("i", "root", "path"), "i")
    return Manifest(stages[0], stages, materialize(top.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("i"), F.col("digest").alias("subroot"), "root", "path"), "roots"))
