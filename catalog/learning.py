"""Feature, metric, training, registry and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ALL_INTAKE, ORACLES, RAW, jobs, query, raw_jobs, table
from catalog.risk import _SIMILAR
from jobsight.functions import status
from jobsight.operators import features, metrics, profile, registry, score, train
from jobsight.operators.train import TrainConfig
from jobsight.plans import workflows
from jobsight.session import scratch_path
from jobsight.sources import testdata
from jobsight.streaming import intake as streaming
from jobsight.streaming.state import HistoryState

_GROUP = """CASE WHEN regexp_matches(lower(status), 'cancel|postponed') THEN 'cancelled'
              WHEN regexp_matches(lower(status), 'down|completed|complete|closed|handed over') THEN 'completed'
              WHEN regexp_matches(lower(status), 'booked|planned|awaiting|rts|request|sent') THEN 'active' ELSE 'other' END"""

_LONG = RAW + """, texts AS (
  SELECT COLUMNS(*)::VARCHAR FROM raw
), long AS (
  SELECT "column", value FROM texts UNPIVOT INCLUDE NULLS (value FOR "column" IN (COLUMNS(*)))
), hist AS (
  SELECT "column", value, count(*) AS n FROM long GROUP BY ALL
), sizes AS (
  SELECT "column", CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls,
         count(value) AS unique_count FROM hist GROUP BY "column"
)"""

_NUMERIC = "('budget_revenue', 'budget_cost', 'actual_revenue', 'actual_cost', 'c_riddorreportable')"


# --- features ----------------------------------------------------------------------------------

@query(
    "f15_date_columns",
    _LONG + f""", cells AS (
      SELECT "column", value, regexp_matches("column", 'date|time|created|updated|due|completed') AS named,
        CASE WHEN "column" IN {_NUMERIC} THEN NULL
             ELSE coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%d/%m/%Y')) END AS parsed FROM long)
      SELECT "column", count(*) AS rows, count(value) AS filled, count(parsed) AS dated,
        (bool_or(named) OR (count(*) FILTER (WHERE regexp_matches(value, '[0-9]')) >= 0.7 * count(value)
          AND count(parsed) >= 0.7 * count(value) AND count(value) > 0)) AND count(parsed) >= 0.5 * count(*) AS is_date
      FROM cells GROUP BY "column" """,
)
def date_columns(spark, sf):
    raw = raw_jobs(spark, sf)
    return features.date_tests(raw, raw.columns).select("column", "rows", "filled", "dated", "is_date")


@query(
    "f15_date_parts",
    RAW + """, parsed AS (
      SELECT project_no, date, coalesce(try_strptime(raw_date_text, '%Y-%m-%d'), try_strptime(raw_date_text, '%d/%m/%Y')) AS raw_at FROM raw)
      SELECT project_no, CAST(year(date) AS DOUBLE) AS date_year, CAST(month(date) AS DOUBLE) AS date_month,
        CAST(day(date) AS DOUBLE) AS date_day, CAST(isodow(date) - 1 AS DOUBLE) AS date_weekday,
        CAST(year(raw_at) AS DOUBLE) AS raw_date_text_year, CAST(month(raw_at) AS DOUBLE) AS raw_date_text_month,
        CAST(day(raw_at) AS DOUBLE) AS raw_date_text_day, CAST(isodow(raw_at) - 1 AS DOUBLE) AS raw_date_text_weekday FROM parsed""",
)
def date_parts(spark, sf):
    rows = raw_jobs(spark, sf).select("project_no", "date", "raw_date_text")
    return features.expand_dates(rows, ["date", "raw_date_text"])


@query(
    "p10_dropped_columns",
    _LONG + f""" SELECT "column", CASE WHEN nulls >= 0.98 * rows THEN 'sparse'
      WHEN "column" NOT IN {_NUMERIC} AND unique_count >= 5000 THEN 'high_cardinality' END AS drop_reason FROM sizes""",
)
def dropped_columns(spark, sf):
    raw = raw_jobs(spark, sf)
    return features.droppable(raw)


@query(
    "m1_feature_columns",
    _LONG + f""", kept AS (
      SELECT "column" FROM sizes WHERE "column" NOT IN ('status', 'date', 'due_date', 'completed_date', 'raw_date_text')
        AND nulls < 0.98 * rows AND NOT ("column" NOT IN {_NUMERIC} AND unique_count >= 5000))
      SELECT "column" AS feature, CASE WHEN "column" IN {_NUMERIC} THEN 'numeric' ELSE 'categorical' END AS kind FROM kept
      UNION ALL SELECT c || '_' || p, 'numeric' FROM (VALUES ('date'), ('due_date'), ('completed_date'), ('raw_date_text')) a(c),
        (VALUES ('year'), ('month'), ('day'), ('weekday')) b(p)""",
)
def feature_columns(spark, sf):
    plan = features.plan_features(raw_jobs(spark, sf), "status")
    kinds = [(c, "numeric") for c in plan.numeric] + [(c, "categorical") for c in plan.categorical]
    return spark.createDataFrame(kinds, "feature string, kind string")


_CATEGORIES = ["budget_type", "c_scaffoldpurpose", "c_locationofscaffold", "c_damagestatus", "c_homeownerpostcode"]


@query(
    "m2_median_imputation",
    RAW + f""", m AS (SELECT median(CAST(actual_revenue AS DOUBLE)) AS r, median(CAST(actual_cost AS DOUBLE)) AS c FROM raw)
      SELECT project_no, round(coalesce(CAST(actual_revenue AS DOUBLE), r), 4) AS num__actual_revenue,
        round(coalesce(CAST(actual_cost AS DOUBLE), c), 4) AS num__actual_cost FROM raw, m""",
)
def median_imputation(spark, sf):
    rows = raw_jobs(spark, sf)
    plan = features.fit_imputation(rows, features.FeaturePlan(numeric=["actual_revenue", "actual_cost"]))
    return features.imputed(rows, plan, ["project_no"]).withColumns({
        c: F.round(c, 4) for c in ("num__actual_revenue", "num__actual_cost")
    })


_CATEGORY_SQL = _LONG + f""", placed AS (
  SELECT h."column", value, n, nulls, rows, row_number() OVER (PARTITION BY h."column" ORDER BY n DESC, value) AS place
  FROM hist h JOIN sizes s ON h."column" = s."column" WHERE value IS NOT NULL AND h."column" IN {tuple(_CATEGORIES)}
), categories AS (
  SELECT "column", value, CAST(n + CASE WHEN place = 1 THEN nulls ELSE 0 END AS BIGINT) AS n, place,
         n + CASE WHEN place = 1 THEN nulls ELSE 0 END < 0.01 * rows AS is_rare FROM placed
)"""


def categories(spark, sf):
    return features.category_plan(profile.value_histogram(raw_jobs(spark, sf), _CATEGORIES))


@query("m3_modes", _CATEGORY_SQL + ' SELECT "column", value AS mode, n FROM categories WHERE place = 1')
def modes(spark, sf):
    return categories(spark, sf).where("is_mode").select("column", F.col("value").alias("mode"), "n")


@query(
    "m4_rare_folding",
    _CATEGORY_SQL + """, kinds AS (SELECT value, is_rare FROM categories WHERE "column" = 'c_homeownerpostcode')
      SELECT project_no, CASE WHEN is_rare THEN '__rare__' ELSE c_homeownerpostcode END AS cat__c_homeownerpostcode,
        coalesce(c_damagestatus, 'Open') AS cat__c_damagestatus
      FROM raw LEFT JOIN kinds ON c_homeownerpostcode = value""",
)
def rare_folding(spark, sf):
    rows = raw_jobs(spark, sf)
    plan = features.fit_imputation(
        rows, features.FeaturePlan(categorical=["c_homeownerpostcode", "c_damagestatus"])
    )
    return features.imputed(rows, plan, ["project_no"])


_FOLDED = ", ".join(
    f"""CASE WHEN coalesce({c}, (SELECT value FROM categories WHERE "column" = '{c}' AND place = 1))
        IN (SELECT value FROM categories WHERE "column" = '{c}' AND NOT is_rare)
        THEN coalesce({c}, (SELECT value FROM categories WHERE "column" = '{c}' AND place = 1)) ELSE '__rare__' END AS {c}"""
    for c in _CATEGORIES
)
_SLOTS = " || ".join(
    f"""array_to_string(list_transform((SELECT labels FROM label_sets WHERE "column" = '{c}'),
        lambda x: CASE WHEN x = {c} THEN '1' ELSE '0' END), '')""" for c in _CATEGORIES
)


@query(
    "m5_assembled_features",
    _CATEGORY_SQL + f""", m AS (
      SELECT median(CAST(budget_revenue AS DOUBLE)) AS r, median(CAST(actual_cost AS DOUBLE)) AS c FROM raw
    ), label_sets AS (
      SELECT "column", list_concat(coalesce(list(value ORDER BY value) FILTER (NOT is_rare), []),
        CASE WHEN bool_or(is_rare) THEN ['__rare__'] ELSE [] END) AS labels FROM categories GROUP BY "column"
    ), folded AS (SELECT project_no, budget_revenue, actual_cost, {_FOLDED} FROM raw)
    SELECT project_no, round(coalesce(CAST(budget_revenue AS DOUBLE), r), 4) AS budget_revenue,
      round(coalesce(CAST(actual_cost AS DOUBLE), c), 4) AS actual_cost, {_SLOTS} AS slots FROM folded, m""",
)
def assembled(spark, sf):
    """The assembled vector: two numbers, then one digit for every slot of the one-hot parts."""
    from pyspark.ml.functions import vector_to_array

    rows = raw_jobs(spark, sf)
    plan = features.FeaturePlan(numeric=["budget_revenue", "actual_cost"], categorical=list(_CATEGORIES))
    plan = features.fit_imputation(rows, plan)
    ready = features.imputed(rows, plan, ["project_no"])
    vector = features.assembler(ready, plan).transform(ready).select("project_no", vector_to_array("features").alias("v"))
    slots = F.transform(F.slice("v", 3, F.size("v") - 2), lambda x: x.cast("int").cast("string"))
    return vector.select(
        "project_no", F.round(F.get("v", F.lit(0)), 4).alias("budget_revenue"),
        F.round(F.get("v", F.lit(1)), 4).alias("actual_cost"), F.array_join(slots, "").alias("slots"),
    )


# --- metrics -----------------------------------------------------------------------------------

def grouped(spark, sf):
    return raw_jobs(spark, sf).withColumn("status_group", status.status_group(F.col("status")))


@query("a16_class_distribution", RAW + f" SELECT {_GROUP} AS status_group, count(*) AS n FROM raw GROUP BY 1")
def class_distribution(spark, sf):
    return metrics.class_counts(grouped(spark, sf), "status_group")


@query(
    "a17_classification_metrics",
    RAW + f""", p AS (SELECT {_GROUP} AS t, CASE budget_type WHEN '1-URGENT' THEN 'completed' WHEN '5-LOW' THEN 'cancelled'
        WHEN '4-NOT SPECIFIED' THEN 'cancelled' ELSE 'active' END AS g FROM raw),
      per AS (SELECT c, (SELECT count(*) FROM p WHERE t = c) AS actual, (SELECT count(*) FROM p WHERE g = c) AS guessed,
        (SELECT count(*) FROM p WHERE t = c AND g = c) AS hit FROM (SELECT t AS c FROM p UNION SELECT g FROM p))
      SELECT round(sum(hit) / sum(actual), 10) AS accuracy,
        round(sum(CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END * actual) / sum(actual), 10) AS precision_weighted,
        round(sum(CASE WHEN actual > 0 THEN hit / actual ELSE 0 END * actual) / sum(actual), 10) AS recall_weighted,
        round(sum(CASE WHEN actual + guessed > 0 THEN 2 * hit / (actual + guessed) ELSE 0 END * actual) / sum(actual), 10) AS f1_weighted
      FROM per""",
)
def classification_metrics(spark, sf):
    guess = (
        F.when(F.col("budget_type") == "1-URGENT", "completed")
        .when(F.col("budget_type").isin("5-LOW", "4-NOT SPECIFIED"), "cancelled").otherwise("active")
    )
    found = metrics.classification_metrics(grouped(spark, sf).withColumn("guess", guess), "status_group", "guess")
    return found.select([F.round(c, 10).alias(c) for c in found.columns])


@query(
    "a17_roc_auc",
    RAW + f""", p AS (SELECT {_GROUP} = 'completed' AS pos, round(CAST(budget_revenue AS DOUBLE) / 10000) AS score FROM raw),
      r AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rnk FROM p)
      SELECT round((sum(rnk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2)
        / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 10) AS roc_auc FROM r""",
)
def roc_auc(spark, sf):
    rated = grouped(spark, sf).select(
        (F.col("status_group") == "completed").alias("positive"),
        F.round(F.col("budget_revenue").cast("double") / 10000).alias("score"),
    )
    return metrics.roc_auc(rated, "positive", "score").select(F.round("roc_auc", 10).alias("roc_auc"))


@query(
    "a18_regression_metrics",
    RAW + """, p AS (SELECT CAST(actual_revenue AS DOUBLE) AS y, CAST(budget_revenue AS DOUBLE) AS g FROM raw WHERE actual_revenue IS NOT NULL)
      SELECT round(sqrt(avg((y - g) * (y - g))), 4) AS rmse, round(avg(abs(y - g)), 4) AS mae,
        round(1 - sum((y - g) * (y - g)) / (var_pop(y) * count(*)), 8) AS r2 FROM p""",
)
def regression_metrics(spark, sf):
    rows = raw_jobs(spark, sf).where("actual_revenue is not null").select(
        F.col("actual_revenue").cast("double").alias("y"), F.col("budget_revenue").cast("double").alias("g")
    )
    return metrics.regression_metrics(rows, "y", "g").select(
        F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2")
    )


_SPLIT = RAW + f""", g AS (SELECT project_no, {_GROUP} AS y, md5('42|' || project_no) AS ord FROM raw
), total AS (SELECT count(*) AS n_all, ceil(count(*) * 0.2::DOUBLE) AS wanted FROM g
), c AS (SELECT y, count(*) AS n, floor(count(*) * wanted / n_all) AS base, count(*) * wanted / n_all - floor(count(*) * wanted / n_all) AS rest
  FROM g, total GROUP BY y, wanted, n_all
), q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, y) <= (SELECT wanted FROM total) - sum(base) OVER ()
  THEN 1 ELSE 0 END AS quota FROM c)"""


@query(
    "w7_stratified_split",
    _SPLIT + """ SELECT project_no, y, row_number() OVER (PARTITION BY y ORDER BY ord) <= quota AS is_test FROM g JOIN q USING (y)""",
)
def stratified_split(spark, sf):
    rows = grouped(spark, sf).select("project_no", F.col("status_group").alias("y"))
    return metrics.split_rows(rows, "y", ["project_no"], 0.2, 42, True, rows.count())


@query(
    "w7_plain_split",
    _SPLIT + " SELECT project_no, row_number() OVER (ORDER BY ord) <= (SELECT wanted FROM total) AS is_test FROM g",
)
def plain_split(spark, sf):
    rows = raw_jobs(spark, sf).select("project_no")
    return metrics.split_rows(rows, "project_no", ["project_no"], 0.2, 42, False, rows.count())


# --- training ----------------------------------------------------------------------------------
# All four candidates are trained on all rows and columns of the jobs table at the library's own
# sizes (300 trees, 100 rounds, 500 iterations), once per application.

_RUNS: dict = {}


def once(spark, sf, name, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _RUNS:
        _RUNS[key] = build()
    return _RUNS[key]


def damage_rows(spark, sf):
    outcome = F.when(F.col("c_damagestatus").isNull(), "clear").otherwise("damaged")
    rows = raw_jobs(spark, sf)
    return rows.select(*[c for c in rows.columns if not c.startswith("c_damage")], outcome.alias("outcome"))


def cost_rows(spark, sf):
    return raw_jobs(spark, sf)


def classifier(spark, sf):
    def build():
        store = registry.Registry(spark, scratch_path(spark, "registry"))
        done = workflows.train_model(
            damage_rows(spark, sf), "Outcome", store, config=TrainConfig("classification"), row_key=["project_no"]
        )
        return store, done

    return once(spark, sf, "classifier", build)


def regressor(spark, sf):
    def build():
        store = registry.Registry(spark, scratch_path(spark, "registry"))
        done = workflows.train_model(
            cost_rows(spark, sf), "actual_cost", store, "regression",
            config=TrainConfig("regression"), row_key=["project_no"],
        )
        return store, done

    return once(spark, sf, "regressor", build)


@query("m6_m8_train_classification")
def train_classification(spark, sf):
    return train.results_table(spark, classifier(spark, sf)[1]["result"].results)


@query("m7_m8_train_regression")
def train_regression(spark, sf):
    return train.results_table(spark, regressor(spark, sf)[1]["result"].results)


@query("m9_feature_importance")
def feature_importance(spark, sf):
    importance = regressor(spark, sf)[1]["result"].importance + classifier(spark, sf)[1]["result"].importance
    return spark.createDataFrame([(r["feature"], r["importance"]) for r in importance], "feature string, importance double")


@query("m10_m11_registered_experiments")
def registered(spark, sf):
    return registry.experiment_summary(classifier(spark, sf)[0].list())


@query("m12_m15_predict_records")
def predict_records(spark, sf):
    store, _ = classifier(spark, sf)
    return workflows.predict_records(store, store.active(), testdata.as_intake(raw_jobs(spark, sf)))


@query("m16_batch_predict")
def batch_predict(spark, sf):
    store, done = classifier(spark, sf)
    return workflows.predict_records(store, done["experiment"]["id"], damage_rows(spark, sf).drop("outcome"))


@query("m16_batch_predict_regression")
def batch_predict_regression(spark, sf):
    store, done = regressor(spark, sf)
    return workflows.predict_records(store, done["experiment"]["id"], cost_rows(spark, sf).drop("actual_cost"))


@query("e3_drift_check")
def drift_check(spark, sf):
    store, done = classifier(spark, sf)
    return workflows.drift_check(store, done["experiment"]["id"], damage_rows(spark, sf))


@query("r8_intake_template")
def intake_template(spark, sf):
    store, done = classifier(spark, sf)
    return workflows.intake_template(store, done["experiment"]["id"], raw_jobs(spark, sf))


@query(
    "r8_intake_suggestions",
    _LONG + f""", fields AS (
      SELECT * FROM (VALUES (0, 'project_name', 'text'), (1, 'contact_name', 'text'), (2, 'related_contacts', 'text'),
        (3, 'project_manager', 'text'), (4, 'date', 'date'), (5, 'due_date', 'date'), (6, 'budget_type', 'text'),
        (7, 'budget_revenue', 'number'), (8, 'budget_cost', 'number'), (9, 'actual_revenue', 'number'), (10, 'actual_cost', 'number'),
        (11, 'status', 'text'), (12, 'c_homeownerpostcode', 'text'), (13, 'c_scaffoldpurpose', 'text'), (14, 'completed_date', 'date'),
        (15, 'c_locationofscaffold', 'text')) t(position, field, kind)
    ), ranked AS (
      SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM hist WHERE value IS NOT NULL
    ), tops AS (
      SELECT "column", array_to_string(list(value ORDER BY place), ';') AS suggested_values, first(value ORDER BY place) AS top
      FROM ranked WHERE place <= 8 GROUP BY "column"
    ), means AS (
      SELECT "column", avg(CAST(value AS DOUBLE)) AS mean FROM long WHERE "column" IN {_NUMERIC} AND value IS NOT NULL GROUP BY "column")
    SELECT position, field, CASE WHEN kind = 'text' AND unique_count BETWEEN 2 AND 50 THEN 'category' ELSE kind END AS type,
      CASE WHEN kind = 'number' THEN round(mean, 2) END AS default_number, CASE WHEN kind = 'text' THEN top END AS default_text,
      CASE WHEN kind = 'text' THEN suggested_values ELSE '' END AS suggested_values,
      field IN ('contact_name', 'project_manager', 'date', 'due_date') AS required
    FROM fields JOIN sizes ON field = sizes."column" LEFT JOIN tops ON field = tops."column" LEFT JOIN means ON field = means."column" """,
)
def intake_suggestions(spark, sf):
    return score.intake_suggestions(
        raw_jobs(spark, sf), ["completed_date_year", "completed_date_month", "c_locationofscaffold"]
    ).withColumns({
        "default_number": F.round("default_number", 2), "suggested_values": F.array_join("suggested_values", ";"),
    })


# --- registry tables: one experiment per customer, one pointer event per order ---------------

_REGISTRY = """WITH experiments AS (
  SELECT c_name AS id, TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 7919 % 100003) AS created_at, 'jobs' AS dataset_path,
         c_mktsegment AS target_column, 'regression' AS task_type, c_nationkey AS total_rows, 25 AS total_columns,
         'elastic_net' AS best_model_name, 'r2' AS metric_name, c_acctbal AS metric_value FROM customer
), pointers AS (
  SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS experiment_id,
         o_orderdate + to_seconds(o_orderkey % 86400) AS set_at, o_orderkey FROM orders
), last AS (SELECT arg_max(experiment_id, set_at) AS id FROM pointers
), newest AS (SELECT id FROM experiments ORDER BY created_at DESC, id DESC LIMIT 1
), active AS (
  SELECT coalesce((SELECT id FROM experiments WHERE id = (SELECT id FROM last)), (SELECT id FROM newest)) AS id
)"""


def experiments(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(mins=(F.col("c_custkey") * 7919 % 100003).cast("int"))
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("id"), at.alias("created_at"), F.lit("jobs").alias("dataset_path"),
        F.col("c_mktsegment").alias("target_column"), F.lit("regression").alias("task_type"),
        F.col("c_nationkey").alias("total_rows"), F.lit(25).alias("total_columns"),
        F.lit("elastic_net").alias("best_model_name"), F.lit("r2").alias("metric_name"),
        F.col("c_acctbal").alias("metric_value"),
    )


def pointers(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("experiment_id"),
        (F.col("o_orderdate") + F.make_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))).alias("set_at"),
    )


@query("t5_newest_experiments", _REGISTRY + " SELECT id, created_at FROM experiments ORDER BY created_at DESC, id DESC LIMIT 100")
def newest_experiments(spark, sf):
    return registry.newest_experiments(experiments(spark, sf)).select("id", "created_at")


@query("m13_active_model", _REGISTRY + " SELECT id AS active_experiment_id FROM active")
def active_model(spark, sf):
    return registry.resolve_active(experiments(spark, sf), pointers(spark, sf))


@query("m13_active_fallback", _REGISTRY + " SELECT id AS active_experiment_id FROM newest")
def active_fallback(spark, sf):
    gone = pointers(spark, sf).withColumn("experiment_id", F.concat(F.lit("deleted "), "experiment_id"))
    return registry.resolve_active(experiments(spark, sf), gone)


@query("m14_experiment_summary", _REGISTRY + " SELECT * FROM experiments")
def experiment_summary(spark, sf):
    return registry.experiment_summary(experiments(spark, sf).withColumn("metadata", F.lit("{}")))


@query(
    "m14_overview",
    _REGISTRY + """ SELECT (SELECT count(*) FROM experiments) AS experiments, (SELECT max(created_at) FROM experiments) AS last_created_at,
      e.target_column AS active_target_column, e.metric_name AS active_metric_name, e.metric_value AS active_metric_value
      FROM experiments e JOIN active USING (id)""",
)
def overview(spark, sf):
    return registry.overview(experiments(spark, sf), pointers(spark, sf))


# --- streaming -----------------------------------------------------------------------------------

def stream_output(spark, sf):
    """All jobs arrive as files and become history in four batches; then all jobs arrive as intake
    rows and are scored in three batches, which read the kept state alone."""
    def build():
        history, asked = scratch_path(spark, "arriving-jobs"), scratch_path(spark, "arriving-intake")
        raw_jobs(spark, sf).repartition(4).write.parquet(history)
        testdata.as_intake(raw_jobs(spark, sf)).repartition(3).write.parquet(asked)
        arriving = lambda path: streaming.read_intake_files(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
        state, output = HistoryState(spark, scratch_path(spark, "history-state")), scratch_path(spark, "stream-output")
        streaming.keep_history(arriving(history), state, scratch_path(spark, "history-checkpoint"), compact_after=3).awaitTermination()
        streaming.score_stream(arriving(asked), state, output, scratch_path(spark, "stream-checkpoint")).awaitTermination()
        return output

    return once(spark, sf, "stream", build)


@query(
    "st1_stream_scores",
    ALL_INTAKE + _SIMILAR + """ SELECT job_id, name, score_pct, level, detail, array_to_string(texts, ' ') AS recommendations
      FROM signals JOIN advised USING (job_id)""",
)
def stream_scores(spark, sf):
    return spark.read.parquet(f"{stream_output(spark, sf)}/scores").drop("batch")


@query("st1_stream_errors", ORACLES["j4_intake_errors"])
def stream_errors(spark, sf):
    return spark.read.parquet(f"{stream_output(spark, sf)}/errors").drop("batch")
