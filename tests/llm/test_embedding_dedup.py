import numpy as np
import pytest
from wavelark.llm import embedding_dedup as E


def slow(rows, cosine=E.COSINE):
    """{row: (links, component)} and pairs, by comparing all vectors of a label."""
    good = []
    for i, (_, v, label) in enumerate(rows):
        ok = label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, dtype=float) / np.linalg.norm(v) if ok else None)
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(good):
        for j in range(i) if a is not None else ():
            b = good[j]
            if b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                near[i].add(j)
                near[j].add(i)
    return near


def components(near, ids):
    out = {}
    for i in near:
        if i not in out:
            group, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - group
                group |= new
                todo += new
            known = [ids[g] for g in group if ids[g] is not None]
            out.update(dict.fromkeys(group, min(known) if known else None))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, cell int, n string"


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(docs, **more).collect()), key=str)


def wanted(rows):
    near = slow(rows)
    part = components(near, [r[0] for r in rows])
    return sorted(((r[0], len(near[i]), part[i], r[0] == part[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [7, 1024])
def test_against_all_pairs(spark, monkeypatch, tile):
    """With full recall asked for and clear pairs, links and components are those of all pairs."""
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows, i = [], 0
    for _ in range(25):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((i, (centre + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), int(rng.integers(2))))
            i += 1
    rows += [(i + k, rows[0][1], rows[0][2]) for k in range(9)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1)]
    rows += [(504, rows[0][1], None), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (507, [2.0, 4.0], 1)]
    rows += [(None, rows[0][1], rows[0][2]), (508, [1e38] * 16, 0), (509, [1e-38] * 16, 0), (510, [float("inf")] + [1.0] * 15, 1)]
    assert run(spark, rows, recall=1.0) == wanted(rows)


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.select("vec_id", "embedding", "label").collect()]
    want = {r[0]: r[1:] for r in wanted(rows)}
    got = {r.vec_id: r for r in E.embedding_dedup(vectors).collect()}
    assert set(got) == set(want)
    found, there = sum(r.n_links for r in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.97 * there and all(got[i].n_links <= want[i][0] for i in want)


def test_traversal_order():
    rng = np.random.default_rng(1)
    unit = E._unit(rng.normal(size=(200, 12)))
    grid = E.fit_grid(unit, 6)
    grid.margin = 0.3
    one, other = grid.halves(unit[:20])
    for row, cells in enumerate(grid.visited(unit[:20])):
        cost = (one[row][:, None] + other[row][None, :]).ravel()
        assert sorted(cells) == np.flatnonzero(cost <= cost.min() + 0.3).tolist()
        assert (np.diff(cost[cells]) >= 0).all() and cells[0] == grid.cells(unit[row : row + 1])[0]


def test_empty_table(spark):
    assert run(spark, []) == []
