"""Models on the embedding vectors and evaluation of given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelark.ml import anomalies as N
from wavelark.ml import classify as C
from wavelark.ml import clusters as K
from wavelark.ml import knn, metrics, projection, scale, vote
from wavelark.ml.dbscan import dbscan
from wavelark.operators.dataset import train_test
from wavelark.plans.registry import query, rounded
from wavelark.sources import adapters as A

VEC = """vec AS (SELECT vec_id::VARCHAR AS id, 'class_' || label AS class_name, embedding::DOUBLE[] AS e FROM embeddings),
flat AS (SELECT id, class_name, i, e[i + 1] AS x FROM vec, range(64) t(i))"""
STD = VEC + """, st AS (SELECT id, class_name, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM flat)"""
TYPES = ("click", "error", "purchase", "signup", "view")


def _features(spark, folder):
    return A.features_from_embeddings(spark, folder)


@query("standardised_features", f"WITH {STD} SELECT id AS recording_id, i::INTEGER AS pos, round(z, 6) + 0.0 AS value FROM st")
def standardised(spark, folder):
    rows = scale.standardise(_features(spark, folder))
    return rows.select("recording_id", F.posexplode("features").alias("pos", "value")).select(
        "recording_id", "pos", rounded("value").alias("value")
    )


PRED = """pr AS (SELECT event_type AS class_name, list_extract(['click', 'error', 'purchase', 'signup', 'view'],
  1 + ((props::JSON ->> '$.k')::BIGINT % 5)::INTEGER) AS prediction FROM events)"""
REPORT = PRED + """,
lab AS (SELECT DISTINCT class_name AS label FROM pr UNION SELECT DISTINCT prediction FROM pr),
rep AS (SELECT label, coalesce(count(*) FILTER (WHERE class_name = label AND prediction = label)
    / nullif(count(*) FILTER (WHERE prediction = label), 0), 0) AS p,
  coalesce(count(*) FILTER (WHERE class_name = label AND prediction = label)
    / nullif(count(*) FILTER (WHERE class_name = label), 0), 0) AS r, count(*) FILTER (WHERE class_name = label) AS support
  FROM pr, lab GROUP BY label),
full_rep AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rep)"""


def _predicted(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    names = F.array(*[F.lit(t) for t in TYPES])
    return A.table(spark, folder, "events").select(
        F.col("event_type").alias("class_name"), F.get(names, k).alias("prediction")
    )


@query("confusion_counts", f"WITH {PRED} SELECT class_name, prediction, count(*) AS n FROM pr GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(_predicted(spark, folder))


@query(
    "confusion_matrix",
    f"WITH {PRED} SELECT class_name, "
    + ", ".join(f"count(*) FILTER (WHERE prediction = '{t}') AS \"{t}\"" for t in TYPES)
    + " FROM pr GROUP BY 1",
)
def confusion_wide(spark, folder):
    return metrics.confusion_matrix(_predicted(spark, folder), list(TYPES))


@query(
    "accuracy",
    f"WITH {PRED} SELECT count(*) AS n, round(avg((class_name = prediction)::INTEGER), 6) AS accuracy FROM pr",
)
def accuracy(spark, folder):
    return metrics.accuracy(_predicted(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "class_report",
    f"""WITH {REPORT} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM full_rep""",
)
def report(spark, folder):
    rows = metrics.class_report(_predicted(spark, folder))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "report_averages",
    f"""WITH {REPORT} SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
  round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall,
  round(sum(f * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM full_rep""",
)
def averages(spark, folder):
    rows = metrics.average_report(metrics.class_report(_predicted(spark, folder)))
    return rows.select(*[F.round(c, 6).alias(c) if c != "support" else F.col(c) for c in rows.columns])


KNN = VEC + """,
rk AS (SELECT id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || id)) - 1 AS r,
  count(*) OVER (PARTITION BY class_name) AS n FROM vec),
part AS (SELECT id, class_name, r < ceil(0.2 * n) AS test FROM rk),
d AS (SELECT a.id, b.id AS neighbour, pb.class_name, sqrt(sum(pow(a.x - b.x, 2))) AS distance
  FROM flat a JOIN part pa ON pa.id = a.id AND pa.test JOIN flat b ON b.i = a.i JOIN part pb ON pb.id = b.id AND NOT pb.test
  GROUP BY ALL),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 5),
votes AS (SELECT id, class_name, count(*) / 5.0::DOUBLE AS p FROM nn GROUP BY ALL)"""


def _split(spark, folder):
    split = train_test(_features(spark, folder))
    return tuple(split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))


@query(
    "nearest_neighbours",
    f"WITH {KNN} SELECT id AS recording_id, rank, neighbour, class_name, round(distance, 5) AS distance FROM nn",
)
def neighbours(spark, folder):
    rows = knn.neighbours(*_split(spark, folder), 5)
    return rows.select(
        "recording_id", F.col("rank").cast("long").alias("rank"), "neighbour", "class_name", F.round("distance", 5).alias("distance")
    )


@query("neighbour_votes", f"WITH {KNN} SELECT id AS recording_id, class_name, p FROM votes")
def votes(spark, folder):
    return knn.knn_votes(*_split(spark, folder), 5)


@query(
    "knn_classification",
    f"""WITH {KNN} SELECT id AS recording_id, class_name AS prediction, p AS confidence FROM votes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, class_name) = 1""",
)
def knn_labels(spark, folder):
    return knn.knn_classify(*_split(spark, folder), 5)


PROB = VEC + """,
m AS (SELECT id, i // 16 AS model, 'class_' || (i % 16) AS class_name, abs(x) AS w FROM flat),
p AS (SELECT id, model, class_name, w / sum(w) OVER (PARTITION BY id, model) AS p FROM m),
mean AS (SELECT id, class_name, sum(p) / 4 AS p FROM p GROUP BY ALL)"""


def _probabilities(spark, folder):
    """Four models: shares of the absolute values, sixteen at a time."""
    rows = _features(spark, folder)
    models = []
    for m in range(4):
        part = F.transform(F.slice("features", 16 * m + 1, 16), lambda x: F.abs(x))
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
        shares = rows.select("recording_id", F.posexplode(F.transform(part, lambda x: x / total)).alias("c", "p"))
        models.append(
            shares.select("recording_id", F.concat(F.lit("class_"), F.col("c").cast("string")).alias("class_name"), "p")
        )
    return models


@query("soft_vote", f"WITH {PROB} SELECT id AS recording_id, class_name, round(p, 6) AS p FROM mean")
def soft(spark, folder):
    return vote.soft_vote(_probabilities(spark, folder)).withColumn("p", F.round("p", 6))


@query(
    "ensemble_class",
    f"""WITH {PROB} SELECT id AS recording_id, class_name AS prediction, round(p, 6) AS confidence FROM mean
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, class_name) = 1""",
)
def ensemble(spark, folder):
    best = vote.best_class(vote.soft_vote(_probabilities(spark, folder)))
    return best.withColumn("confidence", F.round("confidence", 6))


@query(
    "threshold_labels",
    f"WITH {PROB} SELECT id AS recording_id, class_name, round(p, 6) AS p FROM mean WHERE p >= 0.11",
)
def thresholded(spark, folder):
    rows = vote.threshold_labels(vote.soft_vote(_probabilities(spark, folder)), 0.11)
    return rows.withColumn("p", F.round("p", 6))


@query(
    "anomaly_stats",
    """WITH s AS (SELECT 0.9 - value / 100 AS score FROM events)
  SELECT count(*) AS total_samples, count(*) FILTER (WHERE score < 0) AS anomaly_count,
    round(count(*) FILTER (WHERE score < 0) / greatest(count(*), 1), 6) AS anomaly_ratio,
    round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score FROM s""",
)
def anomaly_totals(spark, folder):
    events = A.table(spark, folder, "events").withColumn("score", 0.9 - F.col("value") / 100)
    rows = N.anomaly_stats(events.withColumn("label", F.when(F.col("score") < 0, -1).otherwise(1)))
    names = ("anomaly_ratio", "mean_score", "min_score")
    return rows.withColumns({n: F.round(n, 6) for n in names})


@query(
    "contamination_cut",
    """WITH q AS (SELECT quantile_cont(-value, 0.1) AS cut FROM events)
  SELECT event_id, round(-value - cut, 6) + 0.0 AS score, CASE WHEN -value - cut < 0 THEN -1 ELSE 1 END AS label FROM events, q""",
)
def contamination(spark, folder):
    scored = A.table(spark, folder, "events").withColumn("raw_score", -F.col("value"))
    return N.label_scores(scored, 0.1).select("event_id", rounded("score").alias("score"), "label")


def _clustered(spark, folder):
    return A.table(spark, folder, "events").select((F.floor(F.col("value") / 25) - 1).alias("cluster"))


@query("cluster_sizes", "SELECT floor(value / 25)::BIGINT - 1 AS cluster, count(*) AS n FROM events GROUP BY 1")
def sizes(spark, folder):
    return K.cluster_sizes(_clustered(spark, folder))


@query("clusters_found", "SELECT count(DISTINCT floor(value / 25)) FILTER (WHERE floor(value / 25) <> 0) AS n_clusters FROM events")
def found(spark, folder):
    return K.clusters_found(_clustered(spark, folder))


@query(
    "silhouette_squared",
    f"""WITH {VEC}, d AS (SELECT a.id, a.class_name AS own, b.class_name AS other, b.id AS bid, sum(pow(a.x - b.x, 2)) AS d
    FROM flat a JOIN flat b ON a.i = b.i AND a.id <> b.id GROUP BY ALL),
  m AS (SELECT id, own, other, avg(d) AS d FROM d GROUP BY ALL),
  s AS (SELECT id, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM m GROUP BY id)
  SELECT id AS recording_id, round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM s""",
)
def silhouette(spark, folder):
    rows = _features(spark, folder).withColumn("cluster", F.substring("class_name", 7, 4).cast("int"))
    return K.silhouette(rows).select("recording_id", rounded("silhouette").alias("silhouette"))


@query(
    "silhouette_euclidean",
    f"""WITH {VEC}, d AS (SELECT a.id, a.class_name AS own, b.class_name AS other, b.id AS bid, sqrt(sum(pow(a.x - b.x, 2))) AS d
    FROM flat a JOIN flat b ON a.i = b.i AND a.id <> b.id GROUP BY ALL),
  m AS (SELECT id, own, other, avg(d) AS d FROM d GROUP BY ALL),
  s AS (SELECT id, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM m GROUP BY id)
  SELECT id AS recording_id, round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM s""",
)
def silhouette_plain(spark, folder):
    from wavelark.ml.silhouettes import silhouette_euclidean

    rows = _features(spark, folder).withColumn("cluster", F.substring("class_name", 7, 4).cast("int"))
    return silhouette_euclidean(rows).select("recording_id", rounded("silhouette").alias("silhouette"))


EPS, LEAST = 1.15, 4


@query(
    "dbscan_clusters",
    f"""WITH RECURSIVE {VEC}, pair AS (SELECT a.id AS a, b.id AS b FROM flat a JOIN flat b ON a.i = b.i
    GROUP BY a.id, b.id HAVING sqrt(sum(pow(a.x - b.x, 2))) <= {EPS}),
  core AS (SELECT a FROM pair GROUP BY a HAVING count(*) >= {LEAST}),
  edge AS (SELECT p.a, p.b FROM pair p JOIN core ca ON ca.a = p.a JOIN core cb ON cb.a = p.b),
  reach AS (SELECT a, a AS root FROM core UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.a),
  root AS (SELECT a, min(root) AS root FROM reach GROUP BY a),
  num AS (SELECT a, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
  border AS (SELECT p.a, min(n.cluster) AS cluster FROM pair p JOIN num n ON n.a = p.b
    WHERE p.a NOT IN (SELECT a FROM core) GROUP BY p.a)
  SELECT v.id AS recording_id, coalesce(n.cluster, b.cluster, -1) AS cluster, n.a IS NOT NULL AS core
  FROM vec v LEFT JOIN num n ON n.a = v.id LEFT JOIN border b ON b.a = v.id""",
)
def density(spark, folder):
    return dbscan(_features(spark, folder), EPS, LEAST).select("recording_id", "cluster", "core")


@query("kmeans_clusters")
def kmeans(spark, folder):
    return K.kmeans(scale.standardise(_features(spark, folder)), 5).select("recording_id", "cluster")


@query("hierarchical_clusters")
def hierarchical(spark, folder):
    rows = K.micro_cluster_ward(scale.standardise(_features(spark, folder)), 5, micro=128)
    return rows.select("recording_id", "cluster", F.round("lost", 4).alias("lost"))


@query("ward_clusters")
def ward_exact(spark, folder):
    from wavelark.ml.hierarchy import ward_clusters

    return ward_clusters(scale.standardise(_features(spark, folder)), 5).select("recording_id", "cluster")


@query(
    "ward_merge_totals",
    f"""WITH {VEC}, near AS (SELECT a.id, min(d) AS d FROM (SELECT a.id, b.id AS other, sum(pow(a.x - b.x, 2)) / 2 AS d
    FROM flat a JOIN flat b ON a.i = b.i AND a.id < b.id GROUP BY ALL) a GROUP BY a.id)
  SELECT (SELECT count(*) - 1 FROM vec) AS merges, (SELECT round(min(d), 6) FROM near) AS least,
    (SELECT round(sum(s), 6) FROM (SELECT var_pop(x) * count(*) AS s FROM flat GROUP BY i)) AS total""",
)
def ward_totals(spark, folder):
    """All merges together cost the whole sum of squares; the cheapest joins the two nearest rows."""
    from wavelark.ml.hierarchy import ward_merges

    return ward_merges(_features(spark, folder)).agg(
        F.count(F.lit(1)).alias("merges"), F.round(F.min("cost"), 6).alias("least"), F.round(F.sum("cost"), 6).alias("total")
    )


@query("bisecting_clusters")
def bisecting(spark, folder):
    rows = K.bisecting(scale.standardise(_features(spark, folder)), 5)
    return rows.select("recording_id", "cluster")


def _classified(spark, folder, kind):
    _, predicted = C.train(_features(spark, folder), kind)
    return predicted.select("recording_id", "class_name", "prediction", "confidence")


@query("random_forest_predictions")
def forest(spark, folder):
    return _classified(spark, folder, "random_forest")


@query("svm_predictions")
def svm(spark, folder):
    return _classified(spark, folder, "svm")


@query("linear_svm_predictions")
def linear_svm(spark, folder):
    return _classified(spark, folder, "linear_svm")


@query(
    "kmeans_nearest_centre",
    f"WITH {VEC} SELECT id AS recording_id, true AS nearest FROM vec",
)
def kmeans_nearest(spark, folder):
    """Each row's cluster is the one with the nearest mean of its rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = K.kmeans(scale.standardise(_features(spark, folder)), 5).select("recording_id", "cluster", "features")
    mean = vector_to_array(Summarizer.mean(array_to_vector("features")))
    found = rows.groupBy("cluster").agg(mean.alias("mean")).collect()  # five
    means = F.array(*[F.struct(F.lit(r.cluster).alias("cluster"), F.array(*map(F.lit, r["mean"])).alias("mean")) for r in found])
    square = lambda m: F.aggregate(
        F.zip_with("features", m["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    off = F.transform(means, lambda m: F.struct(square(m).alias("d"), m["cluster"].alias("cluster")))
    own = F.filter(off, lambda m: m["cluster"] == F.col("cluster"))[0]["d"]
    # A centre moves by less than the tolerance of the fit in its last step.
    return rows.select("recording_id", (own <= F.array_min(off)["d"] + 1e-2).alias("nearest"))


@query(
    "pca_variances",
    "SELECT i::INTEGER AS a, j::INTEGER AS b, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS correlation FROM range(5) t(i), range(5) u(j)",
)
def pca_variances(spark, folder):
    """Projected components are uncorrelated."""
    rows, _, _ = projection.pca(scale.standardise(_features(spark, folder)), 5)
    one = rows.select("recording_id", F.posexplode("projected").alias("a", "x"))
    other = rows.select("recording_id", F.posexplode("projected").alias("b", "y"))
    return one.join(other, "recording_id").groupBy("a", "b").agg(
        (F.round(F.corr("x", "y"), 6) + 0.0).alias("correlation")
    )


@query(
    "isolation_labelled_share",
    "SELECT true AS close, count(*) AS n FROM embeddings",
)
def isolation_share(spark, folder):
    """The labelled share is the contamination, up to rows that tie at the cut."""
    rows = N.detect_anomalies(_features(spark, folder))
    share = F.avg((F.col("label") == -1).cast("double"))
    return rows.agg((F.abs(share - 0.1) <= 0.01).alias("close"), F.count(F.lit(1)).alias("n"))


@query("class_probabilities")
def probabilities(spark, folder):
    _, predicted = C.train(_features(spark, folder), "random_forest")
    return predicted.select("recording_id", F.explode("probabilities").alias("class_name", "p"))


@query("feature_importance")
def importance(spark, folder):
    model, _ = C.train(_features(spark, folder), "random_forest")
    return projection.feature_importance(spark, model.pipeline.stages[-1])


@query("isolation_forest_scores")
def isolation(spark, folder):
    return N.detect_anomalies(_features(spark, folder)).select("recording_id", "score", "label")


@query("one_class_svm_scores")
def one_class(spark, folder):
    return N.detect_anomalies(_features(spark, folder), "one_class_svm").select("recording_id", "score", "label")


@query("pca_projection")
def pca(spark, folder):
    rows, _, _ = projection.pca(scale.standardise(_features(spark, folder)), 5)
    return rows.select("recording_id", F.posexplode("projected").alias("pos", "value"))


@query("lda_projection")
def lda(spark, folder):
    rows, _ = projection.lda(_features(spark, folder), 5)
    return rows.select("recording_id", F.posexplode("projected").alias("pos", "value"))
