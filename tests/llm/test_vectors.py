import numpy as np
import pytest

from aeolis.llm import kdtree, registry, rpforest, vectors
from aeolis.llm.common import table


def frame(spark, ids, matrix):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def brute(ids, matrix, queries, k, measure):
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        scores = measure(matrix, matrix[at])
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out[q] = [(r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(order)]
    return out


def recall(ids, matrix, asked, got):
    """Part of the true five nearest that was found."""
    scores = rpforest.unit(matrix[asked]) @ rpforest.unit(matrix).T
    scores[np.arange(len(asked)), asked] = -2
    want = np.argsort(-scores, axis=1)[:, :5]
    return np.mean([len({v for _, v, _ in got[ids[q]]} & set(ids[row].tolist())) / 5 for q, row in zip(asked, want, strict=True)])


def test_registered_nearest(spark):
    """op9_nearest on a whole table, against brute force."""
    data = "/root/testdata/sf0.1"
    rows = table(spark, data, "embeddings").orderBy("vec_id").toPandas()
    ids, matrix = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float)
    df = registry.op9_nearest(spark, data)
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "double"]
    got, asked = found(df), np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist()) and recall(ids, matrix, asked, got) >= 0.9
    place = {v: i for i, v in enumerate(ids.tolist())}
    for q, near in got.items():
        assert [r for r, _, _ in near] == [1, 2, 3, 4, 5]
        pairs = [(matrix[place[q]], matrix[place[v]], s) for _, v, s in near]
        assert all(abs(a @ b / np.linalg.norm(a) / np.linalg.norm(b) - s) < 1e-12 for a, b, s in pairs)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, float(r.score)))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BYTES", block * 8 * 6)
    monkeypatch.setattr(vectors, "SHARD", 200)
    rng = np.random.default_rng(1)
    matrix = np.vstack([rng.normal(0, 0.3, (700, 6)), np.tile(rng.normal(0, 0.3, (1, 6)), (90, 1))])
    ids = rng.permutation(len(matrix))
    df = frame(spark, ids, matrix)
    got = found(kdtree.exact_top_k(df, df.where("vec_id % 50 = 0"), 5))
    want = brute(ids, np.floor(256 * matrix), [q for q in ids if q % 50 == 0], 5, lambda m, q: m @ q)
    assert got == want


def test_large_values_stay_exact(spark):
    df = spark.createDataFrame([(0, [2.0**21, 1.0]), (1, [2.0**21, 1.0]), (2, [2.0**21, 2.0])], "vec_id long, embedding array<double>")
    got = found(kdtree.exact_top_k(df, df.where("vec_id = 0"), 5))
    assert [v for _, v, _ in got[0]] == [2, 1]


def test_wide_components(spark):
    """Products beyond doubles and longs: exact order, the nearest long as score."""
    rows = [(0, [1e306, 1.0]), (1, [1e306, -1.0]), (2, [1.5, 1.0]), (3, [-1e306, 0.0]), (4, [2.0, 1.0]), (5, [2.0**40, 3.0]), (50, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(kdtree.exact_top_k(df, df.where("vec_id % 50 = 0"), 5))
    most, whole = (1 << 63) - 1, lambda v: [kdtree.whole_number(x) for x in v]
    for q in (0, 50):
        query = whole(dict(rows)[q])
        scores = [(min(most, max(-most - 1, sum(map(int.__mul__, query, whole(v))))), -i) for i, v in rows if i != q]
        want = sorted(scores, reverse=True)[:5]
        assert got[q] == [(r + 1, -i, float(s)) for r, (s, i) in enumerate(want)]


def test_cosines_at_any_scale(spark):
    rows = [(0, [1.0, 2.0]), (1, [2e200, 4e200]), (2, [2e-170, 4e-170]), (3, [5e-324, 0.0]), (4, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {v: s for _, v, s in found(rpforest.nearest(df, df.where("vec_id = 0"), 5))[0]}
    assert got == {1: pytest.approx(1), 2: pytest.approx(1), 3: pytest.approx(5**-0.5), 4: pytest.approx(10**-0.5)}


def test_few_leaves_where_neighbours_are_near(monkeypatch):
    """On clustered vectors a small part of a shard is compared, at the recall asked for."""
    rng = np.random.default_rng(3)
    matrix = np.repeat(rng.normal(size=(400, 48)), 30, axis=0) + rng.normal(0, 0.25, (12_000, 48))
    ids, asked = np.arange(len(matrix)), np.arange(0, len(matrix), 60)
    compared, plain = [], rpforest.Forest.open

    def counted(forest, *args):
        leaves = plain(forest, *args)
        compared.append(len(np.unique(np.concatenate([forest.leaves[i] for i in leaves]))) / len(forest.points))
        return leaves

    monkeypatch.setattr(rpforest.Forest, "open", counted)
    best = vectors.Best(5, rpforest.first_bounds((ids[::6], matrix[::6]), (ids[asked], matrix[asked]), 5), sure=False)
    rpforest.visit((ids, matrix), (ids[asked], matrix[asked]), best)
    scores = rpforest.unit(matrix[asked]) @ rpforest.unit(matrix).T
    scores[np.arange(len(asked)), asked] = -2
    want = np.argsort(-scores, axis=1)[:, :5]
    hits = sum(len(set(best.ids[best.at == q].tolist()) & set(row.tolist())) for q, row in enumerate(want))
    assert hits / want.size >= 0.9 and np.mean(compared) < 0.3


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    matrix, ids = rng.normal(size=(3000, 32)), np.arange(3000)
    df = frame(spark, ids, matrix)
    got = found(rpforest.nearest(df, df.where("vec_id % 50 = 0"), 5))

    def cosine(m, q):
        return m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q)

    want = brute(ids, matrix, range(0, 3000, 50), 5, cosine)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        for _, v, s in rows:
            assert abs(s - cosine(matrix[v : v + 1], matrix[q])[0]) < 1e-12


def test_equal_vectors_by_id(spark):
    df = frame(spark, range(400), np.ones((400, 3)))
    assert [v for _, v, _ in found(rpforest.nearest(df, df.where("vec_id = 100"), 5))[100]] == [0, 1, 2, 3, 4]
    assert [v for _, v, _ in found(kdtree.exact_top_k(df, df.where("vec_id = 0"), 5))[0]] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("operator", [kdtree.exact_top_k, rpforest.nearest])
def test_unusable_vectors(spark, operator):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (50, [2.0, 2.0]), (50, [2.0, 2.0]), (8, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = found(operator(df, df.where("vec_id % 50 = 0"), 5))
    assert {q: sorted(v for _, v, _ in r) for q, r in got.items()} == {0: [8, 50, 50], 50: [0, 8]}
    assert operator(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_own_ids_dont_crowd_out_equal_vectors(spark, k):
    """A query's id on more than k rows of the vector that its neighbour has too."""
    same, rng = [1.0, 2.0, 3.0, 4.0], np.random.default_rng(k)
    rows = [(50, same)] * 8 + [(51, same), (52, same), (49, same)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.vec_id, round(r.score, 9)) for r in rpforest.nearest(df, df.where("vec_id = 50"), k).orderBy("rank").collect()]
    assert got[:3] == [(49, 1.0), (51, 1.0), (52, 1.0)][:k] and len(got) == k
