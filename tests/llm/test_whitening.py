import numpy as np
import pytest
from wavelark.llm import whitening as W


def slow(vectors, components=W.COMPONENTS):
    """(x, S, e, components) by definition, in exact whole numbers and double precision."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return x, sums, centred, values[order], parts[:, order], values.sum()


SCHEMA = "vec_id long, embedding array<float>, label int, n string, x int, component double"


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "clash", 2, 3.0) for r in rows], SCHEMA).repartition(3)
    return W.whiten(docs, **more).collect()


@pytest.mark.parametrize("dim", [1, 5, 40])
def test_against_definition(spark, dim):
    rng = np.random.default_rng(dim)
    mix = rng.normal(size=(dim, dim)) * np.linspace(3, 0.5, dim)
    vectors = (rng.normal(size=(300, dim)) @ mix).astype(np.float32)
    vectors[7] = vectors[8]
    x, sums, centred, values, parts, trace = slow(vectors)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    k = min(dim, 32)
    assert len(got) == 300 * k and {r.component for r in got} == set(range(1, k + 1))
    want = centred @ parts / np.sqrt(values)
    table = np.zeros((300, k))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 300 and r.deviation == ((300 * x[r.vec_id] - sums) ** 2).sum()
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-10 and r.identity_error < 1e-9
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-8


def test_defined_cases(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(3, [0.5, 1.0, -2.0, 0.25])] * 2 + [(None, [1.0] * 4)]
    bad = [(90, None), (91, []), (92, [None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 4), (94, [float("-inf")] + [1.0] * 3), (95, [1.0] * 3)]
    got = run(spark, good + bad)
    assert len(got) == 33 * 4 and {r.n for r in got} == {33}
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 3 for r in got) == 12
    assert {r.vec_id for r in got}.isdisjoint(range(90, 96))
    flat = run(spark, [(i, [float(i), 2.0, float(i)]) for i in range(9)])
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], bad[:2]):
        assert run(spark, rows) == []
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    empty = W.whiten(spark.createDataFrame([], SCHEMA))
    full = W.whiten(spark.createDataFrame([(i, [float(i), 1.0], 1, "", 1, 1.0) for i in range(3)], SCHEMA))
    assert empty.columns == names and empty.dtypes == full.dtypes


def test_huge_values_stay_exact(spark):
    rows = [(i, [2.0**40 * i, -3e38 if i == 2 else 0.25]) for i in range(4)]
    x = [[(1 << 46) * i + 10**6, (-W.LIMIT if i == 2 else 16) + 10**6] for i in range(4)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    model = W.Whitening(4, np.array(sums, dtype=object), np.eye(2), np.ones(2), np.ones(2))
    for row in x:
        want = sum((4 * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        assert W._deviation(np.array([row]), 4, model.sums) == [want]
    assert [r.x for r in W.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").orderBy("vec_id").collect()] == x


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-9, 1e-6])
def test_clustered_eigenvalues(gap):
    """Equal and nearly equal eigenvalues: orthogonal vectors that solve the equation."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    values = np.concatenate([5 + gap * np.arange(6), [3, 2, 2, 2 + gap], np.linspace(0.1, 1, 14)])
    a = (basis * values) @ basis.T
    a = (a + a.T) / 2
    found, vectors = W.eigenvectors(a)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * found).max() < 1e-13


def test_float32_start_is_corrected():
    """Vectors agree with those of a double-precision solver to double precision, which float32 ones don't."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32)) * np.linspace(4, 1, 32)
    a = x.T @ x / 2000
    _, vectors = W.eigenvectors(a)
    exact = np.linalg.eigh(a)[1][:, ::-1]
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]

    def off(v):
        return np.abs(np.abs((v * exact).sum(axis=0)) - 1).max(), np.abs(v * np.sign((v * exact).sum(axis=0)) - exact).max()

    assert off(vectors)[1] < 1e-12 < 1e-7 < off(rough)[1]


def test_on_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [r.embedding for r in vectors.orderBy("vec_id").collect()]
    x, sums, centred, values, parts, trace = slow(data)
    ids = [r.vec_id for r in vectors.orderBy("vec_id").collect()]
    got = {(r.vec_id, r.component): r for r in W.whiten(vectors).collect()}
    table = np.array([[got[i, k + 1].whitened for k in range(32)] for i in ids])
    want = centred @ parts / np.sqrt(values)
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-8
    first = next(iter(got.values()))
    assert first.identity_error < 1e-10 and np.abs(np.cov(table.T, bias=True) - np.eye(32)).max() < 1e-10
