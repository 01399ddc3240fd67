"""Near-duplicates, winnowing and chunk dedup against all pairs, all windows and planted repeats."""

import pytest
from tests.llm import plain

from millrace.llm import chunks, minhash, winnow


def near_copy(text: str, every: int) -> str:
    return " ".join(f"changed{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def assert_components(docs, rows, width):
    found = minhash.near_duplicates(docs, width, 80).collect()
    wanted = plain.components(rows, width)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted((d, len(plain.shingles(t, width)), wanted[d], wanted[d] == d) for d, t in rows)


@pytest.mark.parametrize("width", [4, 5])
def test_small_table(spark, small, width):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert_components(docs, [(r.doc_id, r.text) for r in docs.collect()], width)


def test_chains_borders_and_hot_groups(spark, prose):
    """Pairs just over and under the limit, chains of links, and a group of copies that holds most rows."""
    rows, at = [], 0
    for seed in range(12):
        base = prose(200, seed).split()
        for cut in range(0, 40, 4):  # sliding windows: neighbours are linked, ends are not
            rows.append((at := at + 1, " ".join(base[cut : cut + 150])))
    for size in (8, 9, 10, 11, 12, 16, 20):  # one new word at the end
        text = prose(size, 1000 + size)
        rows += [(at := at + 1, text), (at := at + 1, text + " extra")]
    rows += [(at := at + 1, prose(120, 77)) for _ in range(150)]
    rows += [(at := at + 1, near_copy(prose(400, 78), 50 + i)) for i in range(40)]
    assert_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows, 4)


def test_odd_rows(odd):
    found = minhash.near_duplicates(odd, 4, 80).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].component_id == 1 and by[1][0].kept and not by[2][0].kept
    assert all(by[i][0].n_shingles == 0 and by[i][0].kept for i in (3, 4, 5))
    assert by[7][0].component_id == 6 and len(by[13]) == 2
    assert sorted(r.n_shingles for r in by[None]) == [0, 7] and all(r.component_id is None and not r.kept for r in by[None])
    kept = minhash.keep_one(odd, 4, 80)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted((d is None, d or 0) for d in [1, 3, 4, 5, 6, None, None, 8, 9, 10, 11, 12, 13, 14, -5])


def test_one_of_each_group_without_ids_of_its_own(spark, prose):
    """Different texts with a null id, or one id, are groups of their own; a near copy goes."""
    a, b, c, d, e = (prose(60, 600 + i) for i in range(5))
    rows = [(None, a), (None, b), (None, near_copy(b, 60)), (None, c), (4, c), (5, d), (5, e), (5, e), (None, " ")]
    kept = sorted((r.doc_id or 0, r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect())
    assert len(kept) == 6 and {(0, a), (4, c), (5, d), (5, e), (0, " ")} < set(kept)
    assert len({(0, b), (0, near_copy(b, 60))} & set(kept)) == 1


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        s = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (minhash.similarity_sketch(s) != minhash._EMPTY).all()
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate((a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)))
    assert abs((minhash.similarity_sketch(a) == minhash.similarity_sketch(b)).mean() - 2400 / 3600) < 0.2


BENCH = [("b1", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("b2", "only five words in here"), ("b3", None), (None, "a b c d e f g h i j"), ("b4", ""), ("b2", "only five words in here")]
TEXTS = [(1, "so ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda mu ends"), (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (3, "Only five-words in here and only FIVE words in here"), (4, "beta gamma delta epsilon zeta eta theta iota kappa"), (5, None), (6, ""), (None, "x a b c d e f g h i j a b c d e f g h i j")]


@pytest.mark.parametrize("index_bytes", [winnow.INDEX_BYTES, -1])
def test_winnowing_equals_all_windows(spark, small, index_bytes, odd, empty):
    """By the broadcast index, and by the shuffled fingerprints."""
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    tables = [(spark.createDataFrame(TEXTS, "doc_id bigint, text string"), bench), (spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")), (odd, bench)]
    for docs, items in tables:
        known = [(str(r.item_id) if r.item_id is not None else "", r.text) for r in items.collect()]
        found = winnow.contamination(docs, items, index_bytes).collect()
        wanted = []
        for r in docs.select("doc_id", "text").collect():
            n, hit, ids = plain.contamination(r.text, known)
            wanted.append((str(r.doc_id), n, hit, len(ids), plain.sha(",".join(ids)), hit > 0))
        assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(wanted)
        clean = winnow.drop_contaminated(docs, items, index_bytes)
        assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in wanted)
    assert winnow.contamination(empty, bench, index_bytes).count() == 0
    assert not winnow.contamination(tables[0][0], bench.limit(0), index_bytes).where("contaminated").count()


def test_chunks_resist_shifts(spark, prose, odd, odd_rows, empty):
    """A passage of over 50 words goes from all documents but the first, wherever it stands; the rest stays."""
    passage = prose(60, 5)
    own = [prose(80, 100 + i) for i in range(12)]
    rows = [(i, f"{own[i][: 37 * i]} {passage} {own[i][37 * i :]}") for i in range(12)] + [(50, prose(300, 900)), (51, None), (52, "")]
    found = {r.doc_id: r for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[0].n_runs == 0 and found[0].text == rows[0][1] and found[51].text is None and found[52].text == "" and found[50].n_runs == 0
    for i in range(1, 12):
        middle = passage[80:-80]
        assert found[i].n_runs >= 1 and middle not in found[i].text and found[i].first_doc_ids == [0]
        assert own[i][: 37 * i][:-60] in found[i].text and own[i][37 * i :][60:] in found[i].text
    copies = chunks.dedup_substrings(odd).collect()
    assert len(copies) == len(odd_rows) and chunks.dedup_substrings(empty).count() == 0


def test_chunk_cuts_cover_texts_at_characters(odd_rows):
    import numpy as np

    for text in [t for _, t in odd_rows if t] + ["é" * 5000, "\U0001f600" * 900]:
        data = np.frombuffer(text.encode(), np.uint8)
        ends, _ = chunks.cut_points(data, np.array([0, len(data)]))
        parts = [data.tobytes()[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert "".join(parts) == text and max(len(p.encode()) for p in parts) <= chunks.LONGEST + 4


def plain_dedup(rows):
    """doc_id -> (n_runs, n_own_runs, n_removed, first_doc_ids, text), chunk by chunk in plain Python."""
    import numpy as np

    docs = sorted({(-(1 << 63) if d is None else d, t) for d, t in rows if t}, key=lambda x: x[0])
    cut, owners = {}, {}
    for d, t in docs:
        raw = t.encode()
        ends = chunks.cut_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        cut[d, t] = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i, c in enumerate(cut[d, t]):
            owners.setdefault(c, (d, t, i))
    out = {}
    for d, t in docs:
        runs, kept = [], []
        for i, c in enumerate(cut[d, t]):
            if owners[c] == (d, t, i):
                kept.append((None, c))
            else:
                if not kept or kept[-1][0] is None:
                    runs.append([])
                    kept.append((len(runs) - 1, b""))
                runs[-1].append(c)
        text, n, own, first = b"", 0, 0, set()
        for run, c in kept:
            if run is None:
                text += c
            elif sum(map(len, runs[run])) < chunks.LEAST_RUN:
                text += b"".join(runs[run])
            else:
                others = {owners[c][0] for c in runs[run] if owners[c][:2] != (d, t)}
                n, own, first = n + bool(others), own + (not others), first | others
        out[d, t] = (n, own, len(t) - len(text.decode()), sorted(first - {-(1 << 63)}), text.decode())
    return [(d, *((0, 0, 0, [], t) if not t else out[-(1 << 63) if d is None else d, t])) for d, t in rows]


def test_chunk_dedup_equals_plain_version(spark, small, odd, prose):
    """Also with repeated rows, repeats within a document, and a null id. Ids tell these texts' order."""
    a, b = prose(90, 41), prose(90, 42)
    rows = [(1, f"{a} {b}"), (1, f"{a} {b}"), (2, f"{b} {a}"), (3, " ".join([prose(70, 43)] * 30)), (None, a), (4, None), (5, ""), (6, "short"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for table in (docs, odd, spark.read.parquet(f"{small}/documents.parquet")):
        own = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        found = [tuple(r) for r in chunks.dedup_substrings(table).collect()]
        assert sorted(map(str, found)) == sorted(map(str, plain_dedup(own)))
    found = {r.doc_id: r for r in chunks.dedup_substrings(docs).collect()}
    assert found[3].n_own_runs >= 1 and len(found[3].text) < len(rows[3][1]) / 5 and found[1].n_runs >= 1 and found[None].n_runs == 0
