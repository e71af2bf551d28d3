"""Neighbour search and shared spans against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphmill.llm.neighbors import Cells, mutual_pairs, outline, search_shard, similar_vectors, unit_rows
from graphmill.llm.spans import Fenwick, aligned_passages, Rolling, chain_segments, documents_with_shared_spans, edits, minimizers, points, shared_passages, shared_report


def brute_neighbors(rows, k, floor):
    """Exact neighbour lists of ``(id, vector)`` rows, repeated rows once."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    out = {}
    s = np.round(x @ x.T, 6)
    for q in range(len(ids)):
        c = [j for j in range(len(ids)) if ids[j] != ids[q] and s[q, j] >= floor]
        out[int(ids[q])] = [int(ids[j]) for j in sorted(c, key=lambda j: (-s[q, j], ids[j]))[:k]]
    return out


def clustered(n, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dims))
    return [(int(i), (centres[rng.integers(len(centres))] + rng.normal(size=dims) * 0.3).tolist()) for i in range(n)]


def test_similar_vectors_with_awkward_rows(spark):
    rows = clustered(300)
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, [3 * v for v in rows[1][1]]) for i in range(3)] + rows[:5]
    bad = [(6000 + i, v) for i in range(3) for v in ([0.0] * 64, [float("nan")] + [1.0] * 63)]
    bad += [(5000, None), (5001, []), (5002, [0.0] * 64), (5003, [float("nan")] + [1.0] * 63), (5004, [1.0] * 63), (5005, [float("inf")] + [1.0] * 63), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "chunk_id bigint, embedding array<double>, shard string, h1 int")
    got = similar_vectors(df, "chunk_id", "embedding", k=5, min_sim=0.85, relax=1.0, trees=1)
    lists = {}
    for r in got.orderBy("id", "rank").collect():
        lists.setdefault(r.id, []).append(r.neighbor)
    want = {i: n for i, n in brute_neighbors(rows, 5, 0.85).items() if n}
    assert lists == want
    pairs = {tuple(r) for r in mutual_pairs(got).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, n in want.items() for b in n}


def test_relaxed_search_recalls_over_shards(spark):
    rows = clustered(3000, seed=2)
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    got = similar_vectors(df, "chunk_id", "embedding", k=5, min_sim=0.85, shard_rows=800, sample_rows=1000)
    have = {(r.id, r.neighbor) for r in got.collect()}
    want = {(a, b) for a, n in brute_neighbors(rows, 5, 0.85).items() for b in n}
    assert len(have & want) >= 0.98 * len(want)


def test_recall_and_copies_over_many_shards():
    x = np.array([v for _, v in clustered(6000, seed=4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    near = np.argsort(-s, axis=1, kind="stable")[:, :5]
    q, r = np.nonzero(np.take_along_axis(s, near, 1) >= 0.85)
    for cells in (4, 64, 256):
        row, cell = Cells(x, cells).route(x, 3, 0.1)
        assert np.bincount(row).max() <= 3 and set(row.tolist()) == set(range(len(x)))
        own = [set() for _ in x]
        for i, c in zip(row.tolist(), cell.tolist()):
            own[i].add(c)
        assert np.mean([bool(own[a] & own[near[a, b]]) for a, b in zip(q, r)]) >= 0.98


def test_found_pairs_equal_brute_force_on_a_whole_table(spark):
    from graphmill.llm.q_vectors import p2_found

    sf = "/root/testdata/sf0.01"
    rows = [(r.chunk_id, r.embedding) for r in spark.read.parquet(f"{sf}/chunks.parquet").collect()]
    ok, _ = unit_rows(pa.array([v for _, v in rows]), 64)
    want = {(min(a, b), max(a, b)) for a, near in brute_neighbors([rows[i] for i in ok], 5, 0.85).items() for b in near}
    assert {tuple(r) for r in p2_found(spark, sf).collect()} == want


def test_factor_one_is_exact_over_many_blocks(spark):
    rows = clustered(2500, seed=8)
    rows += [(3000 + i, rows[i % 3][1]) for i in range(500)] + rows[:50]  # copies in several blocks
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>").repartition(7)
    got = {}
    for r in similar_vectors(df, "chunk_id", "embedding", k=5, min_sim=0.85, relax=1.0, shard_rows=150).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == {i: n for i, n in brute_neighbors(rows, 5, 0.85).items() if n}


def test_outlines_bound_cosines():
    x = np.random.default_rng(6).normal(size=(300, 64)) * np.linspace(3, 0.1, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (outline(x) @ outline(x).T >= x @ x.T - 1e-5).all()


def test_few_distinct_vectors_in_many_shards(spark):
    v = clustered(8)
    rows = [(i, v[i % 5][1]) for i in range(400)]
    got = similar_vectors(spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>"), "chunk_id", "embedding", k=5, min_sim=0.85, shard_rows=10)
    assert {r.id: r.neighbor for r in got.where("rank = 5").collect()} == {i: (i % 5) + (25 if i // 5 <= 4 else 20) for i in range(400)}


def test_factor_one_is_exact_without_a_floor():
    x = np.random.default_rng(5).normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, _ = search_shard(x, 4, None, 1.0, 1, leaf=20)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    want = {(q, int(j)) for q in range(400) for j in np.lexsort((np.arange(400), -s[q]))[:4]}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_unit_rows_of_extreme_values():
    ok, x = unit_rows(pa.array([[1e300, 1e300], [1e-300, 0.0], [0.0, 0.0], None, [1.0]]), 2)
    assert ok.tolist() == [0, 1] and np.allclose(np.linalg.norm(x, axis=1), 1)


def test_similar_vectors_empty(spark):
    df = spark.createDataFrame([], "chunk_id bigint, embedding array<double>")
    assert similar_vectors(df, "chunk_id", "embedding").count() == 0


WORDS = [f"w{i}" for i in range(4000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_found(rows, n=200):
    seen = {}
    for d, t in {(d, t) for d, t in rows if d is not None and t}:
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], set()).add(d)
    return {d for s in seen.values() if len(s) > 1 for d in s}


def spans_fixture():
    rng = random.Random(4)
    rows = []
    for d in range(60):
        rows.append((d, text(rng, rng.randrange(60, 160))))
    for k, n in enumerate((199, 200, 201, 205, 216, 217, 230, 333, 400, 600)):  # spans around the bound, at each kind of place
        span = (text(rng, 200) + "é☃😀")[-n:] if k % 2 else text(rng, 200)[:n]
        a, b = text(rng, 70), text(rng, 70)
        rows += [(100 + 2 * k, [a + "§" + span + "§" + b, span + "¤" + a, a + "¤" + span][k % 3]), (101 + 2 * k, [b + "¶" + span + "¶" + a, b + "¶" + span, span + "¶" + b][k % 3])]
    boiler = text(rng, 60)
    rows += [(200 + i, boiler + " " + text(rng, 40)) for i in range(30)]
    same = text(rng, 50)
    rows += [(300, same), (301, same), (302, same), (302, same)]
    rows += [(400, "a" * 5000), (401, text(rng, 30) + "a" * 199), (402, "b" * 700 + "c"), (403, text(rng, 30) + "b" * 200), (404, ("xy" * 150) + text(rng, 100) + ("xy" * 150))]
    rows += [(500, None), (501, ""), (502, "short"), (None, same), (503, text(rng, 40000))]
    return rows


def test_found_equals_all_windows(spark):
    rows = spans_fixture()
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id bigint, text string, tid string, key int").repartition(5)
    assert {r.doc_id for r in documents_with_shared_spans(df).collect()} == brute_found(rows)


def test_report_covers_exactly_the_shared_characters(spark):
    rng = random.Random(9)
    span, a, b = text(rng, 60)[:300], text(rng, 50), text(rng, 50)
    rows = [(1, a + "§" + span + "§" + a[::-1]), (2, b + "¶" + span + "¶"), (3, text(rng, 80)), (4, None), (5, "")]
    got = {r.doc_id: r for r in shared_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].shared_chars for i in (1, 2, 3, 4, 5)] == [300, 300, 0, 0, 0]
    assert got[1].shared_share == round(300 / len(rows[0][1]), 6) and got[4].shared_share == 0
    p, _ = shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    r = p.collect()
    assert len(r) == 2 and all(x.exact == 300 and x.segments == 1 for x in r)


def test_fuzzy_passage_chains_over_a_gap(spark):
    rng = random.Random(11)
    s1, s2 = text(rng, 60)[:300], text(rng, 60)[:300]
    rows = [(1, text(rng, 20) + "§" + s1 + " one small change " + s2), (2, s1 + " another edit here " + s2 + "¶" + text(rng, 20))]
    p, _ = shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = p.collect()
    assert len(got) == 2 and all(x.segments == 2 and 600 <= x.exact <= 604 for x in got)


def test_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert documents_with_shared_spans(df).count() == 0 and shared_report(df).count() == 0


def test_minimizers_and_hashes():
    rng = random.Random(1)
    t = "".join(rng.choice("abcd") for _ in range(900))
    roll = Rolling(points(t))
    h, m = minimizers(roll, len(t), 64, 200)
    low = (1 << 22) - 1
    keys = [(int(x) & ~low) | i for i, x in enumerate(h)]
    assert len(m) == len(t) - 199 and all(m[i] == min(range(i, i + 137), key=lambda j: keys[j]) for i in range(0, len(m), 37))
    at = roll.at(np.array([0, 5, 700]), 184)
    again = Rolling(points("zz" + t)).at(np.array([2, 7, 702]), 184)
    assert (at == again).all() and len(set(at.tolist())) == 3


def test_fenwick_chain_equals_quadratic():
    rng = random.Random(2)
    f, best = Fenwick(50), [(-1e18, -1)] * 50
    for k in range(300):
        i, v = rng.randrange(50), (rng.random(), k)
        if k % 3 == 2:
            v = Fenwick.NONE
        f.put(i, v)
        best[i] = v
        lo, hi = sorted((rng.randrange(50), rng.randrange(50)))
        assert f.get(lo, hi) == max(best[lo : hi + 1]) and f.get(hi + 1, hi) == Fenwick.NONE
    segs = [(x, x + 10, x + 5) for x in range(0, 100, 20)] + [(15, 25, 500)]
    assert [segs[i] for i in chain_segments(segs, 0.1, 400)[0]] == segs[:5]
    # A long far segment does not hide a near one.
    assert chain_segments([(0, 9000, 0), (9450, 9700, 9450), (9720, 10000, 9720)], 0.1, 400)[1] == [1, 2]


def test_edits():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if (old := row) else row
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(12))) for _ in range(2))
        assert edits(a, b) == slow(a, b)


def test_fuzzy_passages_are_aligned(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    a, b = word(400), word(300)
    docs = spark.createDataFrame([(1, a + "MIDDLE" + b), (2, word(50) + a + "MIDxLEs" + b), (3, word(500)), (2, word(50))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in aligned_passages(docs).collect()}
    assert set(got) == {1, 2} and got[1].edits == 2 and got[1].segments == 2 and got[1].exact == 703 and abs(got[2].identity - (1 - 2 / 707)) < 1e-6


@pytest.mark.parametrize("k,n", [(60, 200), (64, 70)])
def test_span_parameters(spark, k, n):
    with pytest.raises(ValueError):
        shared_passages(spark.createDataFrame([], "doc_id bigint, text string"), n, k)


def test_queries_need_no_other_columns(spark):
    df = spark.createDataFrame([(1, "x" * 300)], "doc_id bigint, text string").withColumn("h", F.lit(1))
    assert documents_with_shared_spans(df).count() == 0


def test_neighbors_have_no_floor(spark):
    from graphmill.llm.q_vectors import p2_neighbors

    sf = "/root/testdata/sf0.001"
    rows = [(r.chunk_id, r.embedding) for r in spark.read.parquet(f"{sf}/chunks.parquet").collect()]
    ok, _ = unit_rows(pa.array([v for _, v in rows]), 64)
    rows = [rows[i] for i in ok]
    got = {(r.chunk_id, r.neighbor_id) for r in p2_neighbors(spark, sf).collect()}
    assert got == {(a, b) for a, n in brute_neighbors(rows, 5, -2).items() for b in n}


def test_cells_recall_without_a_floor(spark):
    rows = clustered(3000, seed=2)
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    got = similar_vectors(df, "chunk_id", "embedding", k=5, cell_rows=300)
    have = {(r.id, r.neighbor) for r in got.collect()}
    want = {(a, b) for a, n in brute_neighbors(rows, 5, -2).items() for b in n}
    assert len(have & want) >= 0.9 * len(want)
