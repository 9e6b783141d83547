"""The operators on vectors against plain numpy."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import clustering, negatives, neighbours, oracle, queries, vectors

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vec double, cluster string, rank int, score double, v int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1.0, "c", 9, 0.5, 3) for i, v, y in rows], SCHEMA)


def random_rows(count, dims, seed=3, labels=4, spread=1.0):
    """Vectors in single precision around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    found = (centres[rng.integers(0, 5, count)] + spread * rng.normal(size=(count, dims))).astype(np.float32)
    found[count // 2 : count // 2 + count // 6] = found[0]
    return [(int(k), [float(x) for x in v], int(rng.integers(0, labels))) for k, v in enumerate(found)]


def odd_rows(dims):
    base = random_rows(40, dims, seed=8)
    bad = [
        (1000, None, 1), (1001, [], 1), (1002, [0.5] * (dims - 1), 1), (1003, [0.5] * (dims - 1) + [NAN], 1),
        (1004, [INF] + [0.5] * (dims - 1), 1), (1005, [None] + [0.5] * (dims - 1), 1), (1100, [0.0] * dims, 1),
        (1200, [0.25] * dims, None), (None, [0.25] * dims, 1), (None, None, None),
    ]
    return base + bad + [base[0], base[3], base[20]]


def whole(vectors_, dims):
    return [(i, v, y) for i, v, y in vectors_ if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def clustered(rows, clusters, dims, scale, rounds, seed):
    own = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in whole(rows, dims)]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    centres = [v for _, v in sorted((digest(f"{seed}:{i}"), v) for i, v in own if i is not None)[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in own:
            of[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(of[k]) for x in zip(*of[k], strict=True)] if k in of else c for k, c in enumerate(centres)]
    last = [(i, *nearest(v)) for i, v in own]
    inertia = Counter()
    for _, d, k in last:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest(",".join(map(str, centres[k])))) for i, d, k in last)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_clusters_equal_plain_python(llm_spark):
    rows = random_rows(300, 6)
    for clusters, rounds in ((4, 3), (1, 1), (9, 5)):
        got = clustering.clustered(table_of(llm_spark, rows), clusters, 6, 64, rounds)
        assert found(got) == clustered(rows, clusters, 6, 64, rounds, 1)


def test_clusters_of_odd_rows(llm_spark):
    rows = odd_rows(6)
    got = clustering.clustered(table_of(llm_spark, rows), 5, 6, 64, 3)
    assert found(got) == clustered(rows, 5, 6, 64, 3, 1)
    few = rows[:2]
    assert found(clustering.clustered(table_of(llm_spark, few), 16, 6)) == clustered(few, 16, 6, 64, 3, 1)
    assert found(clustering.clustered(table_of(llm_spark, []), 16, 6)) == Counter()
    nameless = [(None, [0.5] * 6, 1)]
    assert found(clustering.clustered(table_of(llm_spark, nameless), 16, 6)) == Counter([(None,) * 6])
    with pytest.raises(Exception, match="too large"):
        clustering.clustered(table_of(llm_spark, [(1, [1e30] * 6, 1)]), 16, 6).count()


def test_empty_clusters_stay(llm_spark):
    rows = [(k, [1.0, 1.0], 0) for k in range(5)] + [(9, [8.0, 1.0], 0)]
    got = found(clustering.clustered(table_of(llm_spark, rows), 6, 2, 64, 3))
    assert got == clustered(rows, 6, 2, 64, 3, 1)
    assert len({k for _, k, *_ in got}) == 2


def test_statements_of_vectors(llm_spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    for name in ("op11_clustering", "op13_negatives"):
        df = queries.QUERIES[name](llm_spark, SMALL)
        said = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.STATEMENTS[name]})").fetchall()
        assert found(df) == Counter(said) and said


def nearest(rows, asks, k):
    own = sorted((i, v) for i, v, _ in rows if i is not None and any(v))
    result = {}
    for q, a in dict(reversed(own)).items():
        if asks(q):
            scores = [(-float((np.float64(a) * np.float64(b)).sum()), i) for i, b in own if i != q]
            result[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return result


def by_query(df):
    lists = defaultdict(list)
    for r in sorted(df.collect()):
        lists[r.query_id].append((r["rank"], r.vec_id, r.score))
    return dict(lists)


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    for bits, count in ((64, 3000), (40, 50), (7, 9), (1, 3)):
        codes = rng.integers(0, 1 << min(bits, 62), count).astype(np.uint64)
        near = codes[: min(40, count)] ^ (np.uint64(1) << rng.integers(0, bits, min(40, count)).astype(np.uint64))
        codes = np.r_[codes, near]
        index = neighbours.Index(codes, bits)
        asked = codes[::7]
        apart = np.bitwise_count(asked[:, None] ^ codes[None, :])
        for radius in {0, 1, 2, 5, 11, 30, bits}:
            if radius > bits:
                continue
            query, row = index.within(asked, radius)
            got = list(zip(query.tolist(), row.tolist(), strict=True))
            assert len(got) == len(set(got))
            assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius)), strict=True))


def test_best_keeps_the_first_by_score_and_id():
    rng = np.random.default_rng(5)
    for kind in (np.float64, np.int64):
        best, entries = vectors.Best(6, 4, kind), defaultdict(list)
        for _ in range(12):
            query, ids = rng.integers(0, 6, 30), rng.permutation(10_000)[:30]
            scores = rng.integers(-9, 9, 30).astype(kind)
            best.offer(query, ids, scores, ids * 2)
            for q, i, s in zip(query.tolist(), ids.tolist(), scores.tolist(), strict=True):
                entries[q].append((-s, i))
        query, ids, scores, notes = best.entries()
        assert (notes == ids * 2).all()
        got = defaultdict(list)
        for q, i, s in zip(query.tolist(), ids.tolist(), scores.tolist(), strict=True):
            got[q].append((-s, i))
        assert got == {q: sorted(e)[:4] for q, e in entries.items()}


def test_all_codes_give_the_true_neighbours(llm_spark):
    """With every true neighbour in the radius the result is exact, ties and copies included."""
    rows = random_rows(400, 8)
    got = by_query(neighbours.nearest(table_of(llm_spark, rows), F.col("vec_id") % 20 == 0, 10, aim=1.1))
    want = nearest(rows, lambda q: q % 20 == 0, 10)
    assert {q: [(r, i) for r, i, _ in e] for q, e in got.items()} == {q: [(r, i) for r, i, _ in e] for q, e in want.items()}
    assert all(s == t for q in got for (_, _, s), (_, _, t) in zip(got[q], want[q], strict=True))


def test_neighbours_of_odd_rows(llm_spark):
    rows = odd_rows(6)
    for asks in (lambda q: q % 20 == 0, lambda q: q % 3 == 0):
        got = by_query(neighbours.nearest(table_of(llm_spark, rows), asks(F.col("vec_id")), 20, aim=1.1))
        assert got == nearest(whole(rows, 6), asks, 20)
    few = rows[:3]
    assert by_query(neighbours.nearest(table_of(llm_spark, few), F.lit(True), 20)) == nearest(few, lambda q: True, 20)
    for rest in ([], rows[:1], [(0, None, 1)]):
        assert neighbours.nearest(table_of(llm_spark, rest), F.lit(True), 20).collect() == []


def test_lengths_that_differ_and_norms_that_differ(llm_spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=8) * 10.0 ** rng.integers(-3, 4))], 0) for k in range(300)]
    got = by_query(neighbours.nearest(table_of(llm_spark, rows + [(5000, [1.0] * 3, 0)]), F.col("vec_id") % 20 == 0, 10))
    want = nearest(rows, lambda q: q % 20 == 0, 10)
    assert got.keys() == want.keys() and all(len(e) == 10 for e in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.1"])
def test_recall_of_the_query(llm_spark, sf_dir):
    table = llm_spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = nearest([(r.vec_id, r.embedding, 0) for r in table], lambda q: q % 20 == 0, 20)
    got = by_query(queries.op12_neighbours(llm_spark, sf_dir))
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_recursive_product_is_exact():
    rng = np.random.default_rng(7)
    for m, k, n in ((1, 1, 1), (3, 5, 7), (17, 33, 65), (64, 64, 64), (130, 64, 301), (40, 100, 19)):
        a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        for leaf in (1, 4, 16):
            assert (negatives.product(a, b, leaf) == a @ b).all()
    big = np.full((40, 40), 2**28)
    assert (negatives.product(big, -big) == -(2**56) * 40).all()


def mined(rows, anchors, dims, label=lambda i, y: y, positives=5, count=3):
    own = [(i, label(i, y), [math.floor(256 * x) for x in v]) for i, v, y in whole(rows, dims) if i is not None and y is not None]
    result = Counter()
    for a, y, v in {i: (i, y, v) for i, y, v in sorted(own, reverse=True) if anchors(i)}.values():
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, z, w in own if i != a)
        for s, p, _ in [x for x in scores if x[2] == y][:positives]:
            fits = [(t, n) for t, n, z in scores if z != y and 50 * -s <= 100 * -t <= 95 * -s]
            for rank, (t, n) in enumerate(fits[:count]):
                result[a, p, rank + 1, n, -s, -t] += 1
    return result


def test_negatives_equal_plain_python(llm_spark):
    rows = random_rows(260, 6, spread=0.5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = mined(rows, lambda i: i % 10 == 0, 6, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert want and found(negatives.mined(table_of(llm_spark, rows), lambda i: i % 10 == 0, label)) == want


def test_negatives_of_odd_rows(llm_spark):
    rows = odd_rows(6)
    for every in (10, 1):
        got = found(negatives.mined(table_of(llm_spark, rows), lambda i: i % every == 0, F.col("label")))  # noqa: B023
        assert got == mined(rows, lambda i: i % every == 0, 6)  # noqa: B023
    for rest in ([], rows[:1], [(0, None, 1)], [(0, [0.5] * 6, None)]):
        assert negatives.mined(table_of(llm_spark, rest), lambda i: i % 10 == 0, F.col("label")).collect() == []


def test_blocks_and_shares_do_not_change_results(llm_spark, monkeypatch):
    rows = random_rows(500, 6, spread=0.5)
    table = table_of(llm_spark, rows)
    plain = found(negatives.mined(table, lambda i: i % 5 == 0, F.col("label")))
    near = found(neighbours.nearest(table, F.col("vec_id") % 5 == 0, 10, aim=1.1))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROWS_PER_SHARE", 9)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 11)
    assert found(negatives.mined(table, lambda i: i % 5 == 0, F.col("label"))) == plain
    assert found(neighbours.nearest(table, F.col("vec_id") % 5 == 0, 10, aim=1.1)) == near
