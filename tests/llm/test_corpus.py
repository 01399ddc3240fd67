"""Exact copies, Merkle manifests and collocations against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import plain

from millrace.llm import collocations, exact, merkle, queries

DOCS = "doc_id bigint, text string"


def plain_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), i == 0, plain.sha(text)) for i, d in enumerate(ids)]
    return sorted(map(str, out))


def found_copies(docs, counters=exact.COUNTERS):
    return sorted(str(tuple(r)) for r in exact.find_copies(docs, counters).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("counters", [1, 3, exact.COUNTERS])
def test_copies_equal_plain_version(spark, odd, odd_rows, counters):
    """With few counters most groups go by the shuffle, with many all go by the broadcast."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a  b", "a\tb", "a b ", "c", "", None, "d\x85e", f"own {i % 97}"])) for i in range(900)] + [(None, "c"), (5, "a b"), (5, "a b"), (None, "only"), (None, "only")]
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    assert found_copies(docs, counters) == plain_copies(rows)
    assert found_copies(odd, counters) == plain_copies(odd_rows)
    kept = exact.drop_copies(odd, counters)
    assert kept.columns == odd.columns and kept.count() == sum("True" in r for r in plain_copies(odd_rows))


def test_copies_of_tables(spark, small, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found_copies(docs) == plain_copies([(r.doc_id, r.text) for r in docs.collect()])
    assert exact.find_copies(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_frequent_digests_are_found(spark):
    """Every value of more than 1 / (counters + 1) of the rows, over many partitions and merges."""
    rng = random.Random(8)
    values = [b"hot"] * 700 + [b"warm"] * 400 + [b"%d" % rng.randrange(900) for _ in range(900)]
    rng.shuffle(values)
    table = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(150)
    for counters in (2, 4, 40):
        found = [bytes(r.digest) for r in exact.frequent(table, counters).collect()]
        assert len(found) <= counters and {v for v, n in Counter(values).items() if n > len(values) / (counters + 1)} <= set(found)


def plain_tree(digests):
    """(root, siblings of each leaf by level): all levels, 8 nodes a run."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([plain.sha("".join(levels[-1][j : j + 8])) for j in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(digests)):
        own = []
        for level in levels[:-1]:
            own.append((level[i - i % 8 : i], level[i + 1 : i - i % 8 + 8]))
            i //= 8
        proofs.append(own)
    return levels[-1][0], proofs


def plain_leaf(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return plain.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_manifest(rows):
    trees, out = defaultdict(list), []
    for r in rows:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
        trees[r.lang].append((r.doc_id, plain_leaf(r, r.text), plain_leaf(r, plain.low(r.text) if changed else r.text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {name: plain_tree([leaf for _, leaf, _ in trees[name]]) for name in names}
    root, tops = plain_tree([built[name][0] for name in names])
    for name, top in zip(names, tops, strict=True):
        for (doc_id, leaf, given), own in zip(trees[name], built[name][1], strict=True):
            h = given
            for before, after in own + top:
                h = plain.sha("".join([*before, h, *after]))
            out.append(str((doc_id, leaf, built[name][0], root, plain.sha("".join("".join(b + a) for b, a in own + top)), h, h == root)))
    return sorted(out)


def found_manifest(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect())


def test_manifest_equals_plain_tree(spark, tmp_path):
    """Trees of 1, 8, 9, 512, 513 and more leaves, over 8 languages, nulls in all columns and repeated rows."""
    sizes = {None: 1, "": 8, "a": 9, "b": 512, "c": 513, "é": 70, "\U0001f600": 3, "zz": 600, "￿": 64}
    rows = [(i * 7 % 4001, f"Text {i} ÀB", lang, None if i % 5 == 0 else f"s{i}", i) for lang, n in sizes.items() for i in range(n)]
    rows += [(None, None, None, None, None), (None, "X", "a", None, None), (3, "Same", "a", "s", 1), (3, "Same", "a", "s", 1), (3, "Other", "a", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found_manifest(spark, docs.repartition(5), tmp_path) == plain_manifest(docs.collect())


def test_manifest_of_tables(spark, small, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found_manifest(spark, docs, tmp_path / "small") == plain_manifest(docs.collect())
    named = odd.withColumn("source", F.lit("x"))
    assert found_manifest(spark, named, tmp_path / "odd") == plain_manifest(named.collect())
    assert found_manifest(spark, docs.limit(1), tmp_path / "one")[0].endswith("True)")
    assert found_manifest(spark, empty, tmp_path / "empty") == [] and merkle.build(empty).proofs().count() == 0


def test_proofs_lead_to_the_root(spark, small):
    manifest = merkle.build(spark.read.parquet(f"{small}/documents.parquet"))
    rows = manifest.proofs().collect()
    assert len(rows) == 200 and all(merkle.fold(r.leaf, [(s.before, s.after) for s in r.path]) == r.root for r in rows)
    assert {r.subroot for r in rows} == {r.subroot for r in manifest.roots.collect()}


def endpos(pieces, depth):
    """{phrase: its end positions} by direct search."""
    found, at = defaultdict(set), 0
    for p in pieces:
        for i in range(len(p)):
            for d in range(1, min(depth, len(p) - i) + 1):
                found[tuple(p[i : i + d])].add(at + i + d - 1)
        at += len(p)
    return found


@pytest.mark.parametrize("seed", range(8))
def test_states_are_endpos_classes(seed):
    rng = random.Random(seed)
    pieces = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 9))]
    depth = rng.randrange(1, 6)
    symbols = np.array([s for p in pieces for s in p])
    ends = np.repeat(np.cumsum([len(p) for p in pieces]), [len(p) for p in pieces])
    a, found = collocations.suffix_automaton(symbols, ends, depth), endpos(pieces, depth)
    classes = defaultdict(list)
    for phrase, places in found.items():
        classes[frozenset(places)].append(phrase)
    words = lambda s: tuple(symbols[a.start[s] : a.start[s] + a.longest[s]].tolist())
    assert sorted((words(s), int(a.shortest[s]), int(a.count[s])) for s in range(len(a.longest))) == sorted((max(c, key=len), len(min(c, key=len)), len(p)) for p, c in classes.items())
    for s in range(len(a.longest)):
        suffix = words(s)[len(words(s)) - int(a.shortest[s]) + 1 :]
        assert (a.link[s] == -1) == (suffix == ()) and (not suffix or suffix == words(a.link[s]))


def plain_collocations(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, counts in f.items():
        found = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        inner = {p[i:j] for p in found for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and counts[p] >= counts[p[i:j]]}
        best = []
        for p in found:
            if p not in inner:
                score, k = min((1000 * counts[p] * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -counts[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, b[2].decode(), -b[1], b[3], b[4], n[lang], -b[0]) for i, b in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "top"), [(5, 3, 2000), (5, 5, 20), (2, 4, 50), (3, 2, 10_000)])
def test_collocations_equal_plain_version(spark, longest, least, top):
    rng = random.Random(longest * 100 + least)
    vocabulary = ["One", "two", "été", "日本", "x y", "-", "four"]
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!"]) for _ in range(rng.randrange(40)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), make()) for _ in range(300)] + [("en", "once upon a time " * 50), ("en", None), (None, "")]
    rows += [("de", rows[0][1])] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    found = sorted(tuple(r) for r in collocations.mine(docs, longest, least, top).collect())
    assert found == plain_collocations(rows, longest, least, top)


def test_collocations_of_tables(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for table, least in ((docs, 20), (odd, 2)):
        rows = [(r.lang, r.text) for r in table.collect()]
        assert sorted(tuple(r) for r in collocations.mine(table, 5, least).collect()) == plain_collocations(rows, 5, least, 2000)
    assert collocations.mine(empty).count() == 0


def test_scores_are_exact_past_64_bits(spark, monkeypatch):
    """Counts of an imagined corpus; the products pass 64 bits."""
    big = 9 * 10**14
    table = spark.createDataFrame([("en", "", 10 * big), ("en", "a", 3 * big + 1), ("en", "b", 2 * big + 7), ("en", "a b", big + 3)], "lang string, phrase string, f bigint")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: table)
    (row,) = collocations.mine(None).collect()
    assert row.score == 1000 * (big + 3) * 10 * big // ((3 * big + 1) * (2 * big + 7)) and (row.l, row.r) == (3 * big + 1, 2 * big + 7)
