"""Experiments, executions, files, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelark.operators import runs as R
from wavelark.plans.registry import query
from wavelark.sources import adapters as A
from wavelark.sources.sinks import latest_model

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRESET_OF = dict(zip(SEGMENTS, [*R.PRESETS, None]))
DEFAULTS = R.PRESETS["Urban Noise Detection"] | {"operator_note": "none"}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x) + "'" for x in row) + ")" for row in rows)


PRESET_ROWS = _values(
    (segment, key, value) for segment, name in PRESET_OF.items() if name for key, value in R.PRESETS[name].items()
)
DEFAULT_ROWS = _values(DEFAULTS.items())


@query("experiments_newest_first", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS score FROM customer")
def experiments(spark, folder):
    return R.newest_first(A.experiments_from_customers(spark, folder), "score").select("id", "name", "score")


@query("experiment_by_id", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS status FROM customer WHERE c_custkey = 11")
def experiment(spark, folder):
    return R.by_id(A.experiments_from_customers(spark, folder), 11).select("id", "name", "status")


LOG = """log AS (SELECT o_custkey AS id, o_orderkey AS version, nullif(o_orderstatus, 'F') AS status,
  CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS config, o_totalprice < 1100 AS deleted FROM orders)"""


def _log(spark, folder):
    return A.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"),
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("config"),
        (F.col("o_totalprice") < 1100).alias("deleted"),
    )


@query(
    "experiment_latest_state",
    f"""WITH {LOG} SELECT id, max_by(status, version) FILTER (WHERE status IS NOT NULL) AS status,
  max_by(config, version) FILTER (WHERE config IS NOT NULL) AS config FROM log GROUP BY id HAVING NOT bool_or(deleted)""",
)
def latest_state(spark, folder):
    return R.latest_values(_log(spark, folder), ["status", "config"])


@query(
    "executions_after_cascade_delete",
    """SELECT o_orderkey AS id, o_custkey AS experiment_id FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def cascade(spark, folder):
    gone = A.experiments_from_customers(spark, folder).filter(F.col("score") < 0)
    return R.without_deleted(A.executions_from_orders(spark, folder), gone, "experiment_id").select("id", "experiment_id")


@query("executions_of_experiment", "SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders WHERE o_custkey = 11")
def executions_of(spark, folder):
    return R.executions_of(A.executions_from_orders(spark, folder), 11).select("id", "started_at")


@query(
    "latest_execution",
    """SELECT o_custkey AS experiment_id, o_orderkey AS id, o_orderdate AS started_at, o_orderstatus AS status FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_run(spark, folder):
    return R.latest_execution(A.executions_from_orders(spark, folder))


@query(
    "latest_model",
    """SELECT o_orderkey::VARCHAR AS model_id, o_orderdate AS created_at FROM orders
  QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC) = 1""",
)
def newest_model(spark, folder):
    models = A.executions_from_orders(spark, folder).select(
        F.col("id").cast("string").alias("model_id"), F.col("started_at").alias("created_at")
    )
    return latest_model(models)


@query(
    "execution_metrics",
    "SELECT o_orderkey AS id, o_totalprice AS cost, o_orderpriority AS priority FROM orders",
)
def metrics(spark, folder):
    runs = A.executions_from_orders(spark, folder)
    return runs.select(
        "id", R.json_number("metrics", "cost").alias("cost"), R.parse_config("metrics")["priority"].alias("priority")
    )


@query("event_properties", "SELECT event_id, (props::JSON ->> '$.k')::DOUBLE AS k FROM events")
def properties(spark, folder):
    return A.table(spark, folder, "events").select("event_id", R.json_number("props", "k").alias("k"))


@query(
    "run_summary",
    """WITH f AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS b FROM lineitem GROUP BY 1),
  e AS (SELECT o_custkey, count(*) AS n_executions, sum(coalesce(n, 0))::BIGINT AS n_files, sum(coalesce(b, 0))::BIGINT AS bytes
    FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT c_custkey AS id, c_name AS name, coalesce(n_executions, 0) AS n_executions, coalesce(n_files, 0) AS n_files,
    coalesce(bytes, 0) AS bytes FROM customer LEFT JOIN e ON o_custkey = c_custkey""",
)
def summary(spark, folder):
    rows = R.run_summary(
        A.experiments_from_customers(spark, folder),
        A.executions_from_orders(spark, folder),
        A.files_from_lineitem(spark, folder),
    )
    return rows.select("id", "name", "n_executions", "n_files", "bytes")


@query(
    "execution_files",
    """SELECT o_orderkey AS execution_id, o_custkey AS experiment_id, l_partkey || '_' || l_linenumber AS file_name,
  l_quantity::BIGINT AS file_size FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
)
def execution_files(spark, folder):
    runs = A.executions_from_orders(spark, folder).select(F.col("id").alias("execution_id"), "experiment_id")
    files = A.files_from_lineitem(spark, folder)
    return files.join(runs, "execution_id").select("execution_id", "experiment_id", "file_name", "file_size")


@query(
    "stage_inventory",
    """SELECT l_returnflag || '/' || l_linestatus AS module_stage, count(*) AS n_files,
  sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY 1""",
)
def inventory(spark, folder):
    return R.stage_inventory(A.files_from_lineitem(spark, folder))


@query(
    "parameter_presets",
    f"""WITH d AS (SELECT * FROM (VALUES {DEFAULT_ROWS}) v(key, value)),
  p AS (SELECT * FROM (VALUES {PRESET_ROWS}) v(segment, key, value))
  SELECT c_custkey AS id, d.key, coalesce(p.value, d.value) AS value FROM customer CROSS JOIN d
  LEFT JOIN p ON p.segment = c_mktsegment AND p.key = d.key""",
)
def presets(spark, folder):
    preset = F.create_map().cast("map<string,string>")
    for segment, name in PRESET_OF.items():
        if name:
            preset = F.when(F.col("status") == segment, R.literal_map(R.PRESETS[name])).otherwise(preset)
    values = R.apply_preset(R.literal_map(DEFAULTS), preset)
    return A.experiments_from_customers(spark, folder).select("id", F.explode(values).alias("key", "value"))
