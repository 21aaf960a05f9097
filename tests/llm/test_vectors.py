from collections import Counter

import numpy as np
import pytest

from flowweft.llm import cosine_cells as C
from flowweft.llm import vp_trees as V

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, v string, cell int, rank string, score string"
N = 700


@pytest.fixture(scope="module")
def vectors(text_spark):
    """Random vectors, near copies at several distances, equal ones, and rows that cannot take part."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, 16)).astype("float32")
    for i in range(150):
        x[i] = x[rng.integers(N)] * 2 + rng.choice([0.05, 0.2, 0.3, 0.5]) * rng.normal(size=16)
    x[300:360], x[400:430] = x[17], x[18] + 0.02 * rng.normal(size=(30, 16))
    x[5] = 0
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows[7], rows[8], rows[9] = (7, None), (8, [None] * 16), (9, [float("nan")] * 16)
    rows[10], rows[11], rows[13] = (10, [1.0]), (None, rows[12][1]), (13, [float("inf")] + [0.0] * 15)
    rows += [(20, rows[20][1]), (50, rows[50][1]), (14, [])]
    table = text_spark.createDataFrame([(*r, 0, 1, "x", 2, "y", "z") for r in rows], SCHEMA).repartition(5)
    return rows, table


def sound(row):
    return row[0] is not None and row[1] is not None and len(row[1]) == 16 and all(v is not None and np.isfinite(v) for v in row[1]) and any(row[1])


def brute_links(rows, least):
    ids = np.array([r[0] for r in rows if sound(r)])
    x = np.array([r[1] for r in rows if sound(r)], "float32").astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        new = np.array([min(new[ids == i]) for i in ids])  # rows of one id
        if (new == label).all():
            return Counter(zip(ids.tolist(), near.sum(axis=1).tolist(), label.tolist(), strict=True)), near
        label = new


@pytest.mark.parametrize("sizes", [{"cell_rows": 100, "block_rows": 64}, {}])
def test_links_and_components(vectors, sizes):
    rows, table = vectors
    want, _ = brute_links(rows, 0.95)
    got = C.near_vectors(table, 0.95, **sizes).collect()
    assert len(got) == len(rows)
    alone = Counter((r[0], 0, r[0]) for r in rows if not sound(r))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want + alone
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_every_partner_is_visited():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(9, 6))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = rng.normal(size=(400, 6))
    x = np.concatenate([x, x + 0.25 * rng.normal(size=x.shape)])
    import pandas as pd

    placed = next(C.homes_and_visits(centre, 0.9, 1.0)([pd.DataFrame({"v": list(x)})]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True):
        a, b = placed.home[i], placed.home[j]
        assert a == b or (b in placed.visits[i] if b > a else a in placed.visits[j])


def brute_nearest(rows, every, k):
    kept = sorted({(r[0], tuple(np.array(r[1], "float32").astype(float).tolist())) for r in rows if sound(r)})
    ids = np.array([r[0] for r in kept])
    x = np.array([r[1] for r in kept])
    size = lambda v: np.sqrt((v * v).sum(axis=-1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.clip((x[i] * x).sum(axis=1) / (size(x[i]) * size(x)), -1, 1)
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -score[others]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in best]
    return out


@pytest.mark.parametrize("sizes", [{"shard_rows": 150, "query_rows": 4, "leaf": 16}, {}])
def test_nearest_is_exact_with_factor_one(vectors, sizes):
    rows, table = vectors
    got = V.nearest(table, every=10, k=5, **sizes).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert found == brute_nearest(rows, 10, 5)


def test_a_smaller_factor_still_finds_most(vectors):
    rows, table = vectors
    want = brute_nearest(rows, 10, 5)
    got = V.nearest(table, every=10, k=5, factor=0.85, leaf=16).collect()
    hits = sum(any(r.vec_id == v for v, _ in want[r.query_id]) for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_or_no_vectors(text_spark, vectors):
    _, table = vectors
    none = table.filter("vec_id < -1")
    assert C.near_vectors(none).count() == 0 and V.nearest(none).count() == 0
    two = text_spark.createDataFrame([(50, [1.0, 0.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = V.nearest(two).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 3)] and got[0].score == pytest.approx(2 / 5**0.5)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in C.near_vectors(two).collect()} == {(50, 0, 50, True), (3, 0, 3, True)}


@pytest.fixture(scope="module")
def mixed(text_spark):
    """Two lengths that are equally common and a rare one; ids that stand for different vectors, or for two lengths."""
    rng = np.random.default_rng(11)
    rows = []
    for dim, start in ((8, 0), (12, 1000), (3, 2000)):
        n = 260 if dim > 3 else 6
        x = rng.normal(size=(n, dim)).astype("float32")
        for i in range(n // 3):
            x[i] = x[rng.integers(n)] + 0.2 * rng.normal(size=dim)
        x[n - 2] = x[n - 1]
        rows += [(start + i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(5, rows[100][1]), (5, rows[400][1]), (1005, rows[101][1]), (50, [1.0, 2.0, 3.0]), (50, rows[7][1])]
    return rows, text_spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def row_links(rows, least):
    """Links and components row by row: only vectors of one length, whatever the ids."""
    unit = [np.array(v, "float32").astype(float) / np.linalg.norm(np.array(v, "float32").astype(float)) for _, v in rows]
    linked = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in linked[i]:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least_id = {g: min(r[0] for r, other in zip(rows, group, strict=True) if other == g) for g in set(group)}
    return Counter((r[0], len(x), least_id[g]) for r, x, g in zip(rows, linked, group, strict=True))


@pytest.mark.parametrize("sizes", [{"cell_rows": 60, "block_rows": 32}, {}])
def test_lengths_do_not_meet_and_ids_may_repeat(mixed, sizes):
    rows, table = mixed
    got = C.near_vectors(table, 0.95, **sizes).collect()
    want = row_links(rows, 0.95)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert any(links and vec_id >= 2000 for vec_id, links, _ in want), "the rare length has links"


def test_one_id_on_two_vectors_keeps_their_links_apart(text_spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [2.0, 0.0]), (7, [0.0, 3.0])]
    got = C.near_vectors(text_spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


@pytest.mark.parametrize("sizes", [{"shard_rows": 40, "query_rows": 3, "leaf": 16}, {}])
def test_nearest_within_each_length(mixed, text_spark, sizes):
    rows, _ = mixed
    rows = rows[:526]  # one vector an id
    table = text_spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in V.nearest(table, every=10, k=5, **sizes).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    unit = {i: np.array(v, "float32").astype(float) / np.linalg.norm(np.array(v, "float32").astype(float)) for i, v in rows}
    for q, x in unit.items():
        if q % 10 == 0:
            near = sorted((-round(float(x @ y), 12), i) for i, y in unit.items() if i != q and len(y) == len(x))
            assert found[q] == [i for _, i in near[:5]]
    assert set(found) == {q for q in unit if q % 10 == 0} and len(found[2000]) == 5
