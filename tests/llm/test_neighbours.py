import numpy as np
import pytest

from tidemark.llm import neighbours
from tidemark.llm.queries import op3_neighbours


def exact(ids, vectors, asked):
    """(vec_id, score) of the five nearest of each query, by comparing with every row."""
    lengths = np.sqrt((vectors * vectors).sum(1))
    found = {}
    for q in asked:
        score = (vectors * vectors[q]).sum(1) / (lengths * lengths[q])
        others = [i for i in range(len(ids)) if ids[i] != ids[q]]
        found[ids[q]] = [(ids[i], score[i]) for i in sorted(others, key=lambda i: (-score[i], ids[i]))[:5]]
    return found


def answers(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def recall(found, truth):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in t}) / max(len(t), 1) for q, t in truth.items()])


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors)],
        "vec_id long, embedding array<float>, label int",
    )


def test_query_recall_and_scores(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    truth = exact(ids, vectors, [i for i, n in enumerate(ids) if n % 50 == 0])
    result = op3_neighbours(spark, folder)
    assert result.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = answers(result.collect())
    assert set(found) == set(truth) and all(len(v) == 5 for v in found.values())
    assert recall(found, truth) >= 0.9
    place = {n: i for i, n in enumerate(ids)}
    for q, near in found.items():
        for n, score in near:
            a, b = vectors[place[q]], vectors[place[n]]
            assert score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_recall_with_small_blocks_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "_SEARCHES", 50)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    vectors = np.concatenate([
        centres[rng.integers(0, 30, 1500)] + 0.1 * rng.standard_normal((1500, 16)),
        centres[0] + 0.001 * rng.standard_normal((700, 16)),
        rng.standard_normal((300, 16)),
    ]).astype(np.float32)
    truth = exact(list(range(2500)), vectors.astype(float), range(0, 2500, 50))
    found = answers(neighbours.nearest(frame(spark, vectors)).collect())
    assert recall(found, truth) >= 0.9


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(6)
    vectors = np.concatenate([np.tile([1.0, 2.0, 3.0], (400, 1)), rng.standard_normal((100, 3))])
    found = answers(neighbours.nearest(frame(spark, vectors)).collect())
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in found[50]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1, abs=1e-12) for _, s in found[50])


def test_depth_falls_with_the_distance():
    depths = [neighbours.depth(c) for c in (1.0, 0.999, 0.9, 0.5, 0.1, -0.5, -1.0, None)]
    assert depths[0] == neighbours.BITS and depths == sorted(depths, reverse=True) and depths[-1] == 0
    for cosine in (0.9, 0.5, 0.2):
        same = 1 - np.arccos(cosine) / np.pi
        assert 1 - (1 - same ** neighbours.depth(cosine)) ** neighbours.TREES >= neighbours.RECALL


def test_unusable_vectors_take_no_part(spark):
    good = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    rows = [(0, good[0]), (1, good[1]), (2, good[2]), (2, good[2]), (50, None), (100, [0.0, -0.0]), (150, [1.0, None]),
            (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, []), (350, [1.0]), (None, good[0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "rank")
    found = answers(neighbours.nearest(table).collect())
    assert {q: [i for i, _ in v] for q, v in found.items()} == {0: [1, 2]}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, rank string")
    assert neighbours.nearest(empty).collect() == []


@pytest.mark.parametrize("noise", [1e-2, 1e-4, 1e-5])
def test_order_in_a_large_group_of_near_copies(spark, noise):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    vectors = (centre + noise * rng.standard_normal((1000, 64))).astype(np.float32)
    truth = exact(list(range(1000)), vectors.astype(float), range(0, 1000, 50))
    found = answers(neighbours.nearest(frame(spark, vectors)).collect())
    assert recall(found, truth) >= 0.9


def test_ties_among_parallel_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(9)
    # Powers of two, so that all cosines in the group are the same number.
    group = np.array([3.0, -1.0, 2.0, 5.0]) * 2.0 ** rng.permutation(np.arange(-100, 20))[:, None]
    vectors = np.concatenate([group, rng.standard_normal((80, 4))]).astype(np.float32)
    found = answers(neighbours.nearest(frame(spark, vectors)).collect())
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in found[50]] == [i for i, _ in found[100]] == [0, 1, 2, 3, 4]


def test_components_of_any_size_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((41, 8))
    shape = "vec_id long, embedding array<double>, cid string, asked string, members string"

    def asked(scales, ids):
        rows = [(int(i), [float(x * s) for x in v], "c", "a", "m") for i, v, s in zip(ids, vectors, scales)]
        return neighbours.nearest(spark.createDataFrame(rows, shape)).collect()

    plain = answers(asked([1.0] * 41, range(41)))
    assert len(plain[0]) == 5
    powers = [2.0 ** int(e) for e in rng.integers(-1000, 1000, 41)]
    for scales in ([2.0**660] * 41, [2.0**-1060 if i % 2 else 1.0 for i in range(41)], powers):
        found = answers(asked(scales, range(41)))
        assert [n for n, _ in found[0]] == [n for n, _ in plain[0]]
        assert all(abs(a - b) < 1e-9 or 2.0**-1060 in scales for (_, a), (_, b) in zip(found[0], plain[0]))
    # Id 0 stands on two vectors: both are queries, and each may be near the other.
    vectors[7] = vectors[0] + 0.01
    rows = asked([1.0] * 41, [0 if i == 7 else i for i in range(41)])
    assert len(rows) == 10 and sorted(r["rank"] for r in rows) == sorted([1, 2, 3, 4, 5] * 2)
    assert [r.vec_id for r in rows if r["rank"] == 1] == [0, 0]
