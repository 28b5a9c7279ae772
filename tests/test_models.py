"""Models against brute force and planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.ml import anomalies as N
from wavelark.ml import classify as C
from wavelark.ml import clusters as K
from wavelark.ml import knn, metrics, projection, scale, vote
from wavelark.ml.dbscan import connected_components, dbscan
from wavelark.sources.sinks import latest_model, load_features, save_features, save_model

SCHEMA = "recording_id string, class_name string, features array<double>"


def table(spark, x, labels=None):
    labels = ["c"] * len(x) if labels is None else labels
    rows = [(f"r{i:05d}", str(c), [float(v) for v in row]) for i, (row, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def blobs(n=60, k=3, dim=4, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=4, size=(k, dim))
    labels = np.repeat(np.arange(k), n)
    return centres[labels] + rng.normal(scale=spread, size=(n * k, dim)), labels


def test_scaler_uses_population_deviation(spark):
    x = np.column_stack([[1.0, 2, 4, 9], [5.0] * 4])
    out = np.array([r.features for r in scale.standardise(table(spark, x)).orderBy("recording_id").collect()])
    assert np.allclose(out[:, 0], (x[:, 0] - 4) / np.std(x[:, 0])) and not out[:, 1].any()


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    train = np.vstack([rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(1, 3)), 150, axis=0)])
    test = rng.normal(size=(80, 3)) * 1.5
    a, b = table(spark, train), table(spark, test)
    found = knn.neighbours(a, b, 5).collect()
    assert len(found) == 400
    distance = np.linalg.norm(test[:, None] - train[None], axis=2)
    for r in found:
        i = int(r.recording_id[1:])
        order = sorted(range(len(train)), key=lambda j: (round(distance[i, j], 9), j))
        assert np.isclose(r.distance, distance[i, order[r["rank"] - 1]], atol=1e-6)


def test_tiles_split_a_cell(spark):
    from wavelark.ml.tiles import compare, distances, matrix
    import pandas as pd

    x = np.random.default_rng(2).normal(size=(90, 2))
    rows = table(spark, x).withColumn("cell", F.lit(1))

    def count(a, b):
        near = (distances(matrix(a["features"]), matrix(b["features"])) < 1).sum(axis=1)
        assert len(a) < 60 and len(b) < 60
        return pd.DataFrame({"recording_id": a["recording_id"], "n": near})

    out = compare(rows, rows, count, "recording_id string, n long", side=20).groupBy("recording_id").agg(F.sum("n").alias("n"))
    expected = (np.linalg.norm(x[:, None] - x[None], axis=2) < 1).sum(axis=1)
    assert {r.recording_id: r.n for r in out.collect()} == {f"r{i:05d}": int(v) for i, v in enumerate(expected)}


def brute_dbscan(x, eps, least):
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    current = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = current
        while stack:
            j = stack.pop()
            for m in np.flatnonzero(near[j]):
                if label[m] < 0:
                    label[m] = current
                    if core[m]:
                        stack.append(m)
        current += 1
    return label


@pytest.mark.parametrize("eps,least", [(0.35, 5), (0.6, 4)])
def test_dbscan_matches_brute_force(spark, eps, least):
    rng = np.random.default_rng(3)
    x, _ = blobs(50, 4, 3, seed=3, spread=0.4)
    x = np.vstack([x, rng.uniform(-8, 8, size=(40, 3)), np.repeat([[20.0, 20, 20]], 30, axis=0), [[50.0, 0, 0]] * 3])
    out = {r.recording_id: r.cluster for r in dbscan(table(spark, x), eps, least).collect()}
    assert [out[f"r{i:05d}"] for i in range(len(x))] == brute_dbscan(x, eps, least).tolist()


@pytest.mark.parametrize("few", [0, 3])
def test_dbscan_compares_dense_points_with_few(spark, monkeypatch, few):
    """Points meet a share of the table each; clusters, borders and noise are those of brute force."""
    from wavelark.ml import dbscan as D

    monkeypatch.setattr(D, "PROBE", 30)
    monkeypatch.setattr(D, "FEW", few)
    asked, plain = [], D.compare
    monkeypatch.setattr(D, "compare", lambda a, b, *args, **kw: (asked.append(a.count() * b.select("recording_id").distinct().count()), plain(a, b, *args, **kw))[1])
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(scale=0.3, size=(1500, 2)), np.column_stack([np.arange(60) * 0.45 + 2, np.zeros(60)]),
                   rng.normal(scale=0.1, size=(40, 2)) + 30, rng.uniform(-40, 40, size=(20, 2))])
    out = {r.recording_id: r.cluster for r in D.dbscan(table(spark, x), 0.5, 3).collect()}
    assert [out[f"r{i:05d}"] for i in range(len(x))] == brute_dbscan(x, 0.5, 3).tolist()
    assert sum(asked) < len(x) ** 2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(200) if i != 120], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:04d}",) for i in range(202)], "id string")
    roots = {r.id: r.root for r in connected_components(edges, nodes).collect()}
    assert set(roots.values()) == {"0000", "0121", "0201"} and roots["0120"] == "0000" and roots["0200"] == "0121"


def test_kmeans_fixed_point_and_ward(spark):
    x, labels = blobs()
    df = table(spark, x, labels)
    for clustered in (K.kmeans(df, 3, restarts=3), K.micro_cluster_ward(df, 3, micro=20), K.bisecting(df, 3)):
        rows = clustered.collect()
        assert len({(r.class_name, r.cluster) for r in rows}) == 3
    rows = K.kmeans(df, 3, restarts=2).collect()
    points = np.array([r.features for r in rows])
    got = np.array([r.cluster for r in rows])
    centres = np.array([points[got == c].mean(axis=0) for c in range(3)])
    nearest = np.linalg.norm(points[:, None] - centres[None], axis=2).argmin(axis=1)
    assert (nearest == got).all()
    assert K.clusters_found(clustered).first().n_clusters == 3


@pytest.mark.parametrize("side", [7, 4096])
def test_euclidean_silhouette_matches_pairs(spark, monkeypatch, side):
    from wavelark.ml import silhouettes as S
    from wavelark.ml import tiles

    monkeypatch.setattr(tiles.compare, "__defaults__", ("recording_id", side))
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 4)) * 6
    x = np.concatenate([c + rng.normal(size=(n, 4)) for c, n in zip(centres, [1, 2, 5, 9, 14, 3, 8, 20, 4, 6, 7, 11])] + [np.repeat(centres[:1], 3, axis=0) + 9])
    cluster = np.concatenate([np.repeat(np.arange(12), [1, 2, 5, 9, 14, 3, 8, 20, 4, 6, 7, 11]), [-1, -1, -1]])
    rows = [(str(i), [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, cluster))]
    df = spark.createDataFrame(rows, "recording_id string, features array<double>, cluster int").repartition(3)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for i, c in enumerate(cluster):
        own = (cluster == c) & (np.arange(len(x)) != i)
        a = apart[i, own].mean() if own.any() else 0.0
        b = min(apart[i, cluster == o].mean() for o in set(cluster) if o != c)
        want[str(i)] = (b - a) / max(a, b) if own.any() else 0.0
    got = {r.recording_id: r.silhouette for r in S.silhouette_euclidean(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)
    assert {r.silhouette for r in S.silhouette_euclidean(df.withColumn("cluster", F.lit(1))).collect()} == {0.0}
    plain = df.select(F.monotonically_increasing_id().alias("_id"), "cluster", "features").cache()
    kept = S.nearest_candidates(plain, S._moments(plain)).count()
    assert kept < 0.5 * len(x) * 12  # most clusters are excluded by their bounds


def test_silhouette_matches_pairs(spark):
    x, labels = blobs(20, 3, spread=1.5)
    df = table(spark, x).withColumn("cluster", (F.substring("recording_id", 2, 5).cast("int") / 20).cast("int"))
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    expected = []
    for i, c in enumerate(labels):
        inside = square[i, labels == c].sum() / 19
        outside = min(square[i, labels == o].mean() for o in set(labels) - {c})
        expected.append((outside - inside) / max(inside, outside))
    got = {r.recording_id: r.silhouette for r in K.silhouette(df).collect()}
    assert np.allclose([got[f"r{i:05d}"] for i in range(60)], expected)
    assert K.silhouette_score(df).first().silhouette == pytest.approx(np.mean(expected))
    assert K.silhouette_score(df.withColumn("cluster", F.lit(0))).first().silhouette == -1


@pytest.mark.parametrize("method", ["isolation_forest", "one_class_svm"])
def test_planted_outliers_rank_first(spark, method):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(285, 4)), rng.choice([-9, 9], size=(15, 4)) + rng.normal(size=(15, 4))])
    out = N.detect_anomalies(table(spark, x), method, 0.1)
    rows = sorted(out.collect(), key=lambda r: r.score)
    planted = {f"r{i:05d}" for i in range(285, 300)}
    hits = len({r.recording_id for r in rows[:15]} & planted)
    assert hits >= 14
    stats = N.anomaly_stats(out).first()
    assert stats.total_samples == 300 and 20 <= stats.anomaly_count <= 40


def test_threshold_and_unknown_method(spark):
    x = np.random.default_rng(5).normal(size=(100, 3))
    df = table(spark, x)
    scored = N.isolation_scores(df, N.fit_isolation_forest(df, trees=20))
    strict = N.label_scores(scored, threshold=-0.9)
    assert strict.filter("label = -1").count() == 0
    with pytest.raises(ValueError):
        N.detect_anomalies(df, "autoencoder")


@pytest.mark.parametrize("kind", ["random_forest", "svm", "linear_svm"])
def test_training(spark, kind, tmp_path):
    x, labels = blobs(40, 3, 4)
    df = table(spark, x, labels)
    model, predicted = C.train(df, kind)
    assert metrics.accuracy(predicted).first().accuracy > 0.9
    rows = predicted.collect()
    assert len(rows) == 24 and all(abs(sum(r.probabilities.values()) - 1) < 1e-6 for r in rows)
    assert all(r.confidence == max(r.probabilities.values()) for r in rows)
    model.save(str(tmp_path / kind))
    again = C.Classifier.load(spark, str(tmp_path / kind)).classify(predicted.drop("prediction", "confidence"))
    assert sorted((r.recording_id, r.prediction) for r in again.collect()) == sorted((r.recording_id, r.prediction) for r in rows)
    if kind == "random_forest":
        ranked = projection.feature_importance(spark, model.pipeline.stages[-1]).collect()
        assert [r["rank"] for r in ranked][0] == 1 and abs(sum(r.importance for r in ranked) - 1) < 1e-6


def test_knn_evaluation_and_reports(spark):
    x, labels = blobs(30, 3, 4)
    predicted = C.evaluate_knn(table(spark, x, labels))
    reports = C.report(predicted)
    assert reports["accuracy"].first().accuracy > 0.9
    assert reports["averages"].first().support == 18
    wide = metrics.confusion_matrix(predicted, ["0", "1", "2"])
    assert sum(r["0"] + r["1"] + r["2"] for r in wide.collect()) == 18


def test_report_values(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "class_name string, prediction string")
    rows = {r.label: r for r in metrics.class_report(df).collect()}
    assert (rows["a"].precision, rows["a"].recall, rows["a"].support) == (0.5, 0.5, 2)
    assert rows["b"].f1 == pytest.approx(0.8) and rows["c"].f1 == 0
    average = metrics.average_report(metrics.class_report(df)).first()
    assert average.macro_precision == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_votes(spark):
    schema = "recording_id string, class_name string, p double"
    a = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.1)], schema)
    b = spark.createDataFrame([("x", "a", 0.2), ("x", "b", 0.8)], schema)
    mixed = vote.soft_vote([a, b])
    assert vote.best_class(mixed).first().prediction == "a"
    assert vote.threshold_labels(mixed, 0.45).count() == 2
    assert vote.threshold_labels(mixed, 0.45, multi=False).count() == 1


def test_projections(spark):
    x, labels = blobs(40, 3, 5)
    df = table(spark, x, labels)
    rows, variance, parts = projection.pca(df, 2)
    assert len(variance) == 2 and variance[0] >= variance[1] and len(parts[0]) == 5
    assert len(rows.first().projected) == 2
    flat, axes = projection.lda(df, 2)
    z = np.array([r.projected for r in flat.collect()])
    names = np.array([r.class_name for r in flat.collect()])
    inside = np.mean([z[names == c].var(axis=0).sum() for c in "012"])
    assert z.var(axis=0).sum() > 10 * inside and len(axes) == 2
    # The axes solve the eigenproblem: between = power * within along each of them.
    means = np.array([x[np.array(labels) == c].mean(axis=0) for c in sorted(set(labels))])
    count = np.array([np.sum(np.array(labels) == c) for c in sorted(set(labels))], dtype=float)
    within = x.T @ x - (means * count[:, None]).T @ means
    apart = means - x.mean(axis=0)
    between = (apart * count[:, None]).T @ apart
    for axis in np.array(axes):
        power = axis @ between @ axis / (axis @ within @ axis)
        assert np.allclose(between @ axis, power * (within @ axis), atol=1e-6 * np.abs(between @ axis).max())


def test_feature_table_and_model_registry(spark, tmp_path):
    x, labels = blobs(5, 3, 2)
    df = table(spark, x, labels)
    path = str(tmp_path / "features")
    save_features(df.filter("class_name <> '2'"), path)
    save_features(df, path)
    save_features(df, path)
    assert load_features(spark, path).count() == 15
    only = load_features(spark, path, ["1"])
    assert only.count() == 5 and "PartitionFilters: [cast(class_name" not in only._jdf.queryExecution().toString()
    model, _ = C.train(table(spark, *blobs(20, 2, 3)), "random_forest")
    folder = str(tmp_path / "models")
    save_model(spark, model.pipeline, folder, "m1", {"accuracy": 0.5})
    save_model(spark, model.pipeline, folder, "m0", {"accuracy": 0.6})
    assert latest_model(spark.read.parquet(folder + "/models")).first().model_id == "m0"


def test_neighbours_far_from_the_origin(spark):
    """Near copies around 1000 keep their order, and a row is at distance 0 from itself."""
    rng = np.random.default_rng(0)
    base = 1000 + rng.normal(size=(30, 64))
    rows = [(f"r{i:02d}_{k}", "c", (v + k * 1e-6).tolist()) for i, v in enumerate(base) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA.replace("string, class", "string, class"))
    got = knn.neighbours(df, df.select("recording_id", "features"), 3).collect()
    for r in got:
        home, k = r.recording_id.split("_")
        assert r.neighbour.split("_")[0] == home
        assert r.distance == pytest.approx(8e-6 * abs(int(k) - int(r.neighbour.split("_")[1])), abs=1e-9)
        if r["rank"] == 1:
            assert r.neighbour == r.recording_id and r.distance == 0


@pytest.mark.parametrize("method", ["isolation_forest", "one_class_svm"])
def test_saved_anomaly_model_scores_new_rows(spark, tmp_path, method):
    rng = np.random.default_rng(1)
    make = lambda n, at, name: [(f"{name}{i}", (at + rng.normal(size=4)).tolist()) for i in range(n)]
    schema = "recording_id string, features array<double>"
    model = N.fit_anomalies(spark.createDataFrame(make(300, 5.0, "a"), schema), method, 0.05)
    model.save(str(tmp_path / "m"))
    loaded = N.AnomalyModel.load(spark, str(tmp_path / "m"))
    new = spark.createDataFrame(make(20, 5.0, "n") + make(20, 25.0, "x"), schema)
    a, b = ({r.recording_id: (r.score, r.label) for r in m.score(new).collect()} for m in (model, loaded))
    assert a == b
    assert all(b[f"x{i}"][1] == -1 for i in range(20)) and sum(b[f"n{i}"][1] == 1 for i in range(20)) >= 15


def test_ensemble_of_fitted_models(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", f"c{i % 3}", (3.0 * (i % 3) + rng.normal(size=5)).tolist()) for i in range(150)]
    model, predicted = C.train_ensemble(spark.createDataFrame(rows, SCHEMA), max_depth=5, kinds=("random_forest",))
    hits = [r.prediction == r.class_name for r in predicted.collect()]
    assert len(hits) >= 27 and sum(hits) / len(hits) > 0.9
    sums = model.votes(predicted).groupBy("recording_id").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in sums)


def _replay(x, merges):
    """Cheapest and paid cost of each merge, replayed one by one over all pairs."""
    at = {name: (1, p) for name, p in x.items()}
    for m in merges:
        names = list(at)
        n = np.array([at[c][0] for c in names], dtype=float)
        c = np.array([at[c][1] for c in names])
        cost = ((c[:, None] - c[None]) ** 2).sum(axis=2) * n[:, None] * n[None] / (n[:, None] + n[None])
        np.fill_diagonal(cost, np.inf)
        yield cost.min(), cost[names.index(m.left), names.index(m.right)]
        (a, p), (b, q) = at[m.left], at.pop(m.right)
        at[m.left] = (a + b, (a * p + b * q) / (a + b))
    assert len(at) == min(len(x), 1)


@pytest.mark.parametrize("finish, side", [(8, 40), (60, 4096)])
def test_ward_merges_are_the_cheapest_ones_with_ties_and_copies(spark, finish, side):
    from wavelark.ml.hierarchy import ward_merges

    grid = np.array([(i, j) for i in range(9) for j in range(9)], dtype=float)
    x = np.vstack([grid, np.repeat(grid[:1], 20, axis=0), np.random.default_rng(3).normal(5, 3, size=(30, 2))])
    df = table(spark, x)
    merges = sorted(ward_merges(df, finish, side).collect(), key=lambda m: (m.height, m.step, m.left, m.right))
    assert len(merges) == len(x) - 1 and len({m.right for m in merges}) == len(merges)
    points = {r.recording_id: np.array(r.features) for r in df.collect()}
    for least, paid in _replay(points, merges):
        assert paid <= least + 1e-9
    assert sum(m.cost for m in merges) == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e6, 1e-3), (0.0, 1e25)])
def test_ward_clusters_meet_once_for_both(monkeypatch, shift, scale):
    """One meeting of two tables gives every row of both its cheapest partner, also where single precision can't tell."""
    import pandas as pd

    from wavelark.ml import hierarchy as H

    monkeypatch.setattr(H, "STRIP", 16)
    rng = np.random.default_rng(4)
    x, n = shift + scale * rng.integers(0, 9, size=(150, 3)) + scale * 1e-3 * rng.normal(size=(150, 3)), rng.integers(1, 5, 150)
    rows = pd.DataFrame({"id": [f"r{i:03d}" for i in range(150)], "h": rng.integers(-(2**62), 2**62, 150), "n": n, "centre": list(x)})
    cost = ((x[:, None] - x[None]) ** 2).sum(axis=2) * np.outer(n, n) / np.add.outer(n, n)
    np.fill_diagonal(cost, np.inf)
    parted = cost.copy()
    parted[:60, :60] = parted[60:, 60:] = np.inf
    for found, want in ((H.nearest(rows, side=40), cost), (H.nearest(rows[:60].reset_index(drop=True), rows[60:].reset_index(drop=True), 40), parted)):
        assert sorted(found["id"]) == rows["id"].tolist()
        for r in found.itertuples():
            i, j = int(r.id[1:]), int(r.other[1:])
            assert want[i, j] == pytest.approx(want[i].min(), rel=1e-12) and r.cost == pytest.approx(want[i].min(), rel=1e-12)


def test_later_ward_rounds_meet_what_a_merge_touched(spark, monkeypatch):
    from wavelark.ml import hierarchy as H

    asked, plain = [], H._near
    monkeypatch.setattr(H, "_near", lambda state, known, n, m, side: (asked.append((n, m)), plain(state, known, n, m, side))[1])
    x = np.random.default_rng(9).normal(size=(300, 8))
    assert H.ward_merges(table(spark, x), 100, 90).count() == 299
    assert asked[0] == (300, 0) and len(asked) > 1 and all(m > 0 for _, m in asked[1:])


def test_ward_partition_equals_brute_force(spark):
    from wavelark.ml.hierarchy import ward_clusters, ward_merges

    x = np.random.default_rng(8).normal(size=(500, 6))
    df = table(spark, x)
    for k, finish in ((2, 2048), (20, 150)):
        got = {r.recording_id: r.cluster for r in ward_clusters(df, k, finish, 200).collect()}
        want = K.ward(x, np.ones(len(x)), k)
        assert len(set(got.values())) == k
        assert len({(got[f"r{i:05d}"], w) for i, w in enumerate(want)}) == k
    one = table(spark, x[:1])
    assert ward_merges(one).count() == 0 and ward_merges(one.limit(0)).count() == 0
    assert [r.cluster for r in ward_clusters(one, 3).collect()] == [0]
    assert ward_clusters(one.limit(0), 3).count() == 0


def test_one_class_fit_ends_by_its_gap_and_agrees_with_an_exact_solver(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(380, 3)), rng.normal(scale=4, size=(20, 3))])
    nu = 0.1
    model = N.fit_one_class_svm(table(spark, x), nu=nu, tolerance=1e-4)
    assert model["gap"] <= 1e-4
    z = N._fourier(x, model)
    gram, cap = z @ z.T, 1 / (nu * len(x))
    a = np.full(len(x), 1 / len(x))
    for _ in range(200000):  # moves of weight between the two worst placed rows
        m = gram @ a if _ % 1000 == 0 else m
        i = np.where(a < cap - 1e-15, m, np.inf).argmin()
        j = np.where(a > 1e-15, m, -np.inf).argmax()
        if m[j] - m[i] < 1e-9:
            break
        step = min((m[j] - m[i]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12), cap - a[i], a[j])
        a[i], a[j] = a[i] + step, a[j] - step
        m = m + step * (gram[:, i] - gram[:, j])
    exact = a @ gram @ a
    length = model["weights"] @ model["weights"]
    assert exact <= length * (1 + 1e-9) and length - exact <= 1.1e-4 * length
    ours = z @ model["weights"] < model["rho"]
    margin = gram @ a
    free = (a > 1e-9) & (a < cap - 1e-9)  # these lie on the boundary itself, on neither side
    theirs = margin < margin[free].mean()
    assert not ((ours != theirs) & ~free).any()
