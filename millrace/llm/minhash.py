"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shared import materialize
from millrace.llm.textblocks import LOWER, NOT_SPACE, gram_hashes, mix, row_bounds, span_hashes, text_blocks, word_spans

#: Coordinates of a sketch, and how many of them make a band. A pair at similarity 0.8 shares none
#: of the 24 bands with probability (1 - 0.8**4)**24 = 3e-6.
COORDINATES, BAND = 96, 4
_ROUND_SALTS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def similarity_sketch(items: np.ndarray) -> np.ndarray:
    """The fast similarity sketch (Dahlgaard, Knudsen, Thorup 2017) of a non-empty set of 64-bit hashes.

    Round i of the first t throws each element into a hashed bin with value i + fraction; round i of
    the last t throws all elements into bin i - t. Bins keep their least value, and rounds end once
    every bin is filled, so each coordinate always fills; large sets need one or two rounds.
    Equal coordinates of two sets estimate their Jaccard similarity with concentration bounds.
    """
    t = COORDINATES
    sketch = np.full(t, _EMPTY)
    at, step = 0, int(np.clip(2048 // len(items), 1, 48))
    while at < 2 * t:
        rounds = np.arange(at, min(2 * t, at + step))
        h = mix(items[None, :] ^ _ROUND_SALTS[rounds][:, None])
        bins = np.where((rounds < t)[:, None], (h & np.uint64(0xFFFFFFFF)) % np.uint64(t), (rounds % t).astype(np.uint64)[:, None]).astype(np.int64)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(56)) | (h >> np.uint64(8))
        np.minimum.at(sketch, bins.ravel(), value.ravel())
        at += step
        if (sketch != _EMPTY).all():
            break
    # Later rounds of the last block never undercut an earlier round, so blocks of rounds change nothing.
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of consecutive coordinates."""
    return mix(gram_hashes(mix(sketch), BAND)[::BAND] + np.arange(COORDINATES // BAND, dtype=np.uint64))


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """For each block of rows, the sorted distinct hashes of each text's ``width``-word shingles."""
    for rows, data, offsets in text_blocks(batch, "text"):
        low = LOWER[data]
        starts, ends, at = word_spans(low, offsets, NOT_SPACE)
        words = span_hashes(low, starts, ends)
        grams, bounds, sets = gram_hashes(words, width), row_bounds(at, rows.num_rows), []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= width:
                sets.append(np.unique(grams[lo : hi - width + 1]))
            else:
                sets.append(gram_hashes(words[lo:hi], int(hi - lo)) if hi > lo else words[:0])
        yield rows, sets


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in shingle_sets(batch, width):
                seen: dict[bytes, tuple[np.ndarray, bytes]] = {}
                digests, keys, short = [], [], []
                for s in sets:
                    d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    digests.append(d)
                    if d is not None and d not in seen:
                        sketch = similarity_sketch(s)
                        seen[d] = band_keys(sketch).astype(np.int64), mix(sketch).astype(np.uint16).tobytes()
                    keys.append(seen[d][0] if d is not None else None)
                    short.append(seen[d][1] if d is not None else None)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"],
                )

    return run


def _sets_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "items"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


class _Verifier:
    """Confirms candidate pairs of nodes on their full shingle sets."""

    def __init__(self, docs: DataFrame, owners: DataFrame, width: int, percent: int):
        self.docs, self.owners, self.width, self.percent = docs, owners, width, percent

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of ``nodes(node)``. Only texts are shuffled, once."""
        wanted = self.owners.join(nodes, "node").select(F.col("owner.doc_key").alias("k"), F.col("owner.text_key").alias("t"))
        texts = self.docs.join(wanted.hint("shuffle_hash"), (_doc_key() == F.col("k")) & (F.col("text_key") == F.col("t"))).select("text")
        return materialize(texts.mapInArrow(_sets_of(self.width), "node binary, items array<bigint>").dropDuplicates(["node"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that reach the similarity."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified(self.percent), "a binary, b binary")

    def rest(self, open_members: DataFrame, own: DataFrame) -> DataFrame | None:
        """Links that join components within the buckets of ``open_members(band, key, node, root)``; None if there can be none."""
        payload = open_members.join(own.select("node", "sketch", "n_shingles"), "node")
        blocks = _block_pairs(payload, ["band", "key"], SKETCH_BLOCK).select("band", "key", "i", "j", "block", "node", "root", "n_shingles", "sketch")
        forest = blocks.groupBy("band", "key", "i", "j").applyInArrow(_possible(self.percent), "a binary, b binary").distinct()
        clusters = materialize(connected_components(forest), "clusters")
        if clusters.isEmpty():
            return None
        sets = self.sets(clusters.select("node"))
        rooted = clusters.select("node", F.col("root").alias("cluster")).join(open_members.select("node", "root").distinct(), "node").join(own.select("node", "sketch", "n_shingles"), "node").join(sets, "node")
        blocks = _block_pairs(rooted, ["cluster"], SET_BLOCK).select("cluster", "i", "j", "block", "node", "root", "n_shingles", "sketch", "items")
        return materialize(blocks.groupBy("cluster", "i", "j").applyInArrow(_joining(self.percent), "a binary, b binary"), "verified")


#: Members in a block, where sketches and where full sets are compared.
SKETCH_BLOCK, SET_BLOCK = 384, 128


def _block_pairs(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """Rows dealt to pairs (i <= j) of blocks of their group, so that rows of different roots meet.

    Rows of one root need not meet. The root with the most rows of a group has blocks of its own
    ("mains", numbered after the "others"), which are paired with the others' blocks only: its rows,
    which are most of a large group, are copied once for each block of the others. Only groups of more
    than one block have a row in ``large``, which is written, so Spark knows its size before it joins.
    """
    counts = rows.groupBy(*group, "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("total"), F.max(F.struct("n", "root")).alias("main")).where(F.col("total") > size)
    blocks = lambda n: F.greatest(F.ceil(n / size).cast("int"), F.lit(1))
    large = materialize(sizes.select(*group, F.col("main.root").alias("main"), blocks(F.col("total") - F.col("main.n")).alias("others"), blocks(F.col("main.n")).alias("mains")), "large")
    dealt = rows.join(large, group, "left").withColumns({"main": F.coalesce(F.col("root") == F.col("main"), F.lit(False)), "others": F.coalesce("others", F.lit(1)), "mains": F.coalesce("mains", F.lit(0))})
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("main"), F.col("others") + place(F.col("mains"))).otherwise(place(F.col("others"))))
    last = F.when(F.col("main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return paired.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def _may_link(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(sketch agreements, whether two rows of different roots and fitting blocks may be linked).

    A pair at the similarity has at least so many equal coordinates but for four standard deviations.
    """
    p = percent / 100
    least = COORDINATES * (p - 4 * (p * (1 - p) / COORDINATES) ** 0.5)
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, COORDINATES)
    agree = np.zeros((len(sketch), len(sketch)), np.uint8)
    for c in sketch.T:
        agree += c[:, None] == c[None, :]
    n = table["n_shingles"].to_numpy()
    root, block = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1], table["block"].to_numpy()
    may = (agree >= least) & (root[:, None] != root[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    if table["i"][0].as_py() != table["j"][0].as_py():
        may &= block[:, None] != block[None, :]
    return agree, may


def _edges(a: list[bytes], b: list[bytes]) -> pa.Table:
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _possible(percent: int):
    def run(table: pa.Table) -> pa.Table:
        _, may = _may_link(table, percent)
        nodes, seen, a, b = table["node"].to_pylist(), np.zeros(table.num_rows, bool), [], []
        for start in np.flatnonzero(may.any(axis=1)):
            stack = [] if seen[start] else [start]
            seen[start] = True
            while stack:  # a spanning tree of what may be linked
                x = stack.pop()
                new = np.flatnonzero(may[x] & ~seen)
                seen[new] = True
                stack.extend(new)
                a.extend([nodes[x]] * len(new))
                b.extend(nodes[y] for y in new)
        return _edges(a, b)

    return run


def _joining(percent: int):
    def run(table: pa.Table) -> pa.Table:
        agree, may = _may_link(table, percent)
        nodes, roots, items = table["node"].to_pylist(), table["root"].to_pylist(), table["items"]
        sets = [items[i].values.to_numpy(zero_copy_only=False) for i in range(len(nodes))]
        parent = {r: r for r in roots}

        def find(r: bytes) -> bytes:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        x, y = np.nonzero(np.triu(may))
        a, b = [], []
        for k in np.argsort(-agree[x, y].astype(int), kind="stable"):
            i, j = int(x[k]), int(y[k])
            if (ri := find(roots[i])) == (rj := find(roots[j])):
                continue
            both = len(sets[i]) + len(sets[j]) - len(np.unique(np.concatenate((sets[i], sets[j]))))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[ri] = rj
                a.append(nodes[i])
                b.append(nodes[j])
        return _edges(a, b)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, with_root: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, text_key, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; the set is the distinct ``width``-word
    shingles, or the whole sequence if there are fewer words. Rows whose sets have
    100 * intersection >= percent * union are linked. Steps: equal sets become one node (grouped by a
    128-bit digest, so copies never meet as pairs); nodes get sketches and 24 band keys; in each
    bucket of a band the members are compared with one centre, drawn afresh in each band, and links
    are confirmed on full sets; components follow. For buckets that still hold several components
    the rest is exact: blocks of members compare sketches and keep a spanning forest of those pairs
    that may reach the similarity; in each cluster of that forest, blocks of full sets are compared
    and a link is emitted wherever it joins two components. No pair is emitted for its own sake, and
    a group of any size is spread over blocks of bounded size. Bucket-wise results are written before
    they are joined to members, so that Spark sees their size and can split a large bucket's rows.

    Null or empty text: an empty set (n_shingles 0), linked with nothing, component_id its own doc_id
    and kept. A null doc_id takes part with its text; component_id is the least non-null doc_id of
    the component, or null. Repeated rows: equal rows of one doc_id are one row's copies; the
    contract's kept (doc_id = component_id) holds for each of them, and ``keep_one`` keeps one.
    Extra columns are left out. An empty table gives an empty result.

    ``with_root`` adds root: the least node of the component (null for an empty set). It tells
    components apart where doc_ids cannot, as they are null or shared by different texts.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sketched = materialize(docs.mapInArrow(_sketches(width), "doc_id bigint, text_key bigint, n_shingles bigint, node binary, bands array<bigint>, sketch binary"), "sketches")
    owners = sketched.where("node is not null").groupBy("node").agg(F.min(F.struct(_doc_key().alias("doc_key"), "text_key")).alias("owner"), F.min("doc_id").alias("least"))
    # bands of one node are equal: the owner's row carries them
    own = sketched.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    members = materialize(own.select("node", F.posexplode("bands").alias("band", "key")), "members")
    verifier = _Verifier(docs, owners, width, percent)

    order = F.struct(F.xxhash64("node", "band").alias("o"), F.col("node").alias("n"))
    centre = members.groupBy("band", "key").agg(F.min(order).alias("c"), F.count("*").alias("size")).where("size > 1").select("band", "key", F.col("c.n").alias("centre"))
    # most buckets hold one member, which is then done with
    crowded = materialize(members.join(centre, ["band", "key"]), "crowded")
    pairs = crowded.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    found = materialize(verifier.links(materialize(pairs, "pairs")), "verified")
    roots = materialize(connected_components(found), "roots")
    rest = verifier.rest(_unresolved(crowded.select("node", "band", "key"), roots), own)
    if rest is not None:
        roots = materialize(connected_components(found.union(rest)), "roots")
    # labels are written before they are joined to their members, so that Spark can split a large group's rows
    named = materialize(roots.join(owners.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("label")), "labels")
    root = [F.coalesce("root", "node").alias("root")] if with_root else []
    of_node = owners.select("node", "least").join(roots.join(named, "root").select("node", "label", "root"), "node", "left")
    labels = materialize(of_node.select("node", F.coalesce("label", "least").alias("label"), *root), "labels")
    out = sketched.select("doc_id", "text_key", "n_shingles", "node").join(labels, "node", "left")
    root = ["root"] if with_root else []
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.col("node").isNull().alias("blank"), *root)


def _unresolved(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with roots, of the buckets that hold more than one component."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = materialize(rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key"), "mixed")
    return rooted.join(mixed, ["band", "key"])


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the least doc_id.

    Documents without words stay. All columns are kept as they are. Of repeated rows (same doc_id
    and text) one stays, and groups whose doc_ids are all null keep their least text key. Groups are
    told apart by their roots, so different texts with a null or the same doc_id all stay.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
    found = near_duplicates(docs.select(F.col("doc_id"), F.col("text")), width, percent, with_root=True)
    leaders = found.where("not blank and (kept or component_id is null)").groupBy("root").agg(F.min(F.struct(_doc_key().alias("k"), "text_key")).alias("m"))
    chosen = leaders.select(F.col("m.k").alias("k"), F.col("m.text_key").alias("t"), F.lit(True).alias("chosen"))
    blanks = found.where("blank").select(_doc_key().alias("k"), F.col("text_key").alias("t"), F.lit(False).alias("chosen")).distinct()
    keyed = inner.withColumns({"k": F.coalesce(F.col(at["doc_id"]), F.lit(-(1 << 63))), "t": F.xxhash64(at["text"])})
    kept = keyed.join(chosen.union(blanks).hint("shuffle_hash"), ["k", "t"])
    once = kept.withColumn("copy", F.when(F.col("chosen"), F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return once.dropDuplicates(["k", "t", "copy"]).select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
