"""Features for training and scoring.

Every decision taken on the training data (date columns, dropped columns, medians, modes,
rare categories) is kept in a ``FeaturePlan`` and applied unchanged when scoring. The plan
holds a bounded number of values per column: columns with 5000 or more categories are dropped.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from jobsight import fixed_values as fv
from jobsight.functions import dates, numbers
from jobsight.functions.optional import column_or_null
from jobsight.operators.ordered import exact_quantiles
from jobsight.operators.profile import column_counts, numeric_cells, value_histogram

PARTS = ["year", "month", "day", "weekday"]
RARE = "__rare__"
#: Hashes of a distinct-value sketch, as a power of two: more than the limit of 5000, so that it is exact there.
SKETCH = 13


@dataclass
class FeaturePlan:
    date_columns: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    frequent: dict[str, list[str]] = field(default_factory=dict)
    rare: dict[str, list[str]] = field(default_factory=dict)

    @property
    def expanded(self) -> list[str]:
        return [f"{c}_{p}" for c in self.date_columns for p in PARTS]

    @property
    def feature_columns(self) -> list[str]:
        return self.numeric + self.categorical

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FeaturePlan":
        return FeaturePlan(**json.loads(text))


def usable_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows with a target; a regression target must also read as a number and becomes one."""
    filled = df.where(F.col(target).isNotNull())
    if task != "regression":
        return filled
    return filled.withColumn(target, numbers.number_of(df, target, loose=False)).where(F.col(target).isNotNull())


def date_tests(df: DataFrame, columns: list[str]) -> DataFrame:
    """per column whether it is expanded as a date, from one pass over all rows.

    A column qualifies by a date word in its name, by its type, or because at least 70
    percent of its filled cells hold a digit and at least 70 percent read as a date. It is
    expanded if half of all rows read as a date. Typed numbers are never dates.
    """
    cells = []
    for name in columns:
        dtype = df.schema[name].dataType
        named = any(w in name.lower() for w in fv.DATE_FEATURE_WORDS) and not numbers.is_numeric(dtype)
        kind = "number" if numbers.is_numeric(dtype) else "date" if dates.is_datetime(dtype) else "text"
        cells.append(
            F.struct(
                F.lit(name).alias("column"), F.lit(kind).alias("kind"),
                F.lit(named or kind == "date").alias("named"), F.col(name).cast("string").alias("value"),
            )
        )
    # Cells become rows of one text column first, so the parse is compiled once, not once per column.
    kind, value = F.col("kind"), F.col("value")
    dated = F.when(kind == "text", dates.parse_datetime(value).isNotNull()).otherwise((kind == "date") & value.isNotNull())
    counts = df.select(F.inline(F.array(*cells))).groupBy("column", "named").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled"),
        F.count_if((kind == "text") & value.rlike(r"\d")).alias("with_digit"), F.count_if(dated).alias("dated"),
    )
    c = F.col
    looks = (c("filled") > 0) & (c("with_digit") >= 0.7 * c("filled")) & (c("dated") >= 0.7 * c("filled"))
    return counts.withColumn("is_date", (c("named") | looks) & (c("dated") >= 0.5 * c("rows")))


def expand_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each date column by year, month, day and weekday (Monday is 0)."""
    kept = [c for c in df.columns if c not in columns]
    at = {c: dates.datetime_of(df, c) if c in df.columns else F.lit(None).cast("timestamp_ntz") for c in columns}
    # A step of its own, so that a cell is parsed once for its four parts.
    parsed = df.select(*kept, *[ts.alias(f"{c}__at") for c, ts in at.items()])
    parts = [
        fn(F.col(f"{c}__at")).cast("double").alias(f"{c}_{part}")
        for c in columns for part, fn in zip(PARTS, (F.year, F.month, F.dayofmonth, F.weekday))
    ]
    return parsed.select(*kept, *parts)


def distinct_bounds(df: DataFrame, columns: list[str], sketch: int = SKETCH) -> DataFrame:
    """Per column its rows, filled rows and bounds of its number of distinct values; numeric
    columns are not counted.

    One shuffle of mergeable sketches. A sketch keeps up to 2^``sketch`` hashes: below that the
    count is exact, above it the bounds are five standard errors wide.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("filled"),
                 (F.lit(None) if numbers.is_numeric(df.schema[c].dataType) else F.concat(F.lit("="), F.col(c).cast("string"))).cast("string").alias("value"))
        for c in columns
    ])
    size, estimate = 2.0**sketch, F.col("estimate")
    width = F.when(estimate < size, 0.0).otherwise(5 / size**0.5)
    return (
        df.select(F.inline(cells)).groupBy("column")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("filled").alias("non_null_rows"),
             F.theta_sketch_estimate(F.theta_sketch_agg("value", sketch)).alias("estimate"))
        .select("column", "rows", "non_null_rows", F.floor(estimate * (1 - width)).alias("at_least"), F.ceil(estimate * (1 + width)).alias("at_most"))
    )


def droppable(df: DataFrame, columns: list[str] | None = None, limit: int = fv.HIGH_CARDINALITY, sketch: int = SKETCH) -> DataFrame:
    """P10: columns at least 98 percent empty, and non-numeric columns with ``limit`` or more values.

    Only columns whose bounds enclose the limit are counted exactly. The result is one row per
    column, known when the function returns.
    """
    names = list(dict.fromkeys(columns or df.columns))
    found = distinct_bounds(df, names, sketch).collect() if names else []
    near = [r["column"] for r in found if r["at_least"] < limit <= r["at_most"]]
    exact = {}
    if near:
        exact = {r["column"]: r["unique_count"] for r in column_counts(value_histogram(df, near)).collect()}
    rows = []
    for r in found:
        sparse = r["rows"] - r["non_null_rows"] >= fv.SPARSE_SHARE * r["rows"]
        wide = exact.get(r["column"], r["at_least"]) >= limit
        rows.append((r["column"], "sparse" if sparse else "high_cardinality" if wide else None))
    return df.sparkSession.createDataFrame(rows, "column string, drop_reason string")


def category_plan(histogram: DataFrame) -> DataFrame:
    """M3, M4: per (column, value) its count, whether it is the mode (ties by value) and whether
    it holds under one percent of the rows once nulls take the mode. No column is ever sorted."""
    filled = F.col("value").isNotNull()
    best_first = F.when(filled, F.struct((-F.col("n")).alias("order"), "value"))
    totals = histogram.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("nulls"),
        F.min_by("value", best_first).alias("mode"),
    )
    is_mode = F.col("value") == F.col("mode")
    counted = histogram.where(filled).join(totals, "column").select(
        "column", "value", "rows", is_mode.alias("is_mode"),
        (F.col("n") + F.when(is_mode, F.col("nulls")).otherwise(0)).alias("n"),
    )
    return counted.select("column", "value", "n", "is_mode", (F.col("n") < fv.RARE_SHARE * F.col("rows")).alias("is_rare"))


def plan_features(df: DataFrame, target: str) -> FeaturePlan:
    """M1: decide all features from the training rows; the target is never a feature."""
    columns = list(dict.fromkeys(c for c in df.columns if c != target))
    inputs = df.select(*columns)
    plan = FeaturePlan()
    is_date = {r.column for r in date_tests(inputs, columns).where("is_date").collect()}
    plan.date_columns = [c for c in columns if c in is_date]
    expanded = expand_dates(inputs, plan.date_columns)
    others = [c for c in expanded.columns if c not in plan.expanded]
    dropped = {r.column for r in droppable(expanded, others).where("drop_reason is not null").collect()} if others else set()
    kept = [f for f in expanded.schema.fields if f.name not in dropped]
    plan.dropped = [c for c in expanded.columns if c in dropped]
    plan.numeric = [f.name for f in kept if numbers.is_numeric(f.dataType)]
    plan.categorical = [f.name for f in kept if not numbers.is_numeric(f.dataType)]
    return plan


def fit_imputation(train: DataFrame, plan: FeaturePlan) -> FeaturePlan:
    """M2-M4: medians, modes and rare categories of the training rows (already expanded)."""
    if plan.numeric:
        medians = exact_quantiles(numeric_cells(train, plan.numeric), ["column"], "number", {"median": 0.5})
        plan.medians = {r.column: r.median for r in medians.collect()}
        plan.numeric = [c for c in plan.numeric if c in plan.medians]
    if plan.categorical:
        found = category_plan(value_histogram(train, plan.categorical)).orderBy("column", "value").collect()
        for name in plan.categorical:
            rows = [r for r in found if r.column == name]
            plan.modes[name] = next((r.value for r in rows if r.is_mode), "")
            plan.frequent[name] = [r.value for r in rows if not r.is_rare]
            plan.rare[name] = [r.value for r in rows if r.is_rare]
        plan.categorical = [c for c in plan.categorical if plan.modes[c] != ""]
    return plan


def fold_rare(c: Column, frequent: list[str], rare: list[str]) -> Column:
    """M4: a frequent value stays, a rare one becomes one shared value, an unknown one is null."""
    return F.when(c.isin(frequent), c).when(c.isin(rare), RARE)


def imputed(df: DataFrame, plan: FeaturePlan, keep: list[str] = ()) -> DataFrame:
    """Feature columns in model order, imputed and folded; ``keep`` columns pass through.

    Dates are expanded by the plan's decision, missing columns are null and then imputed.
    """
    expanded = expand_dates(df, plan.date_columns) if not set(plan.expanded) <= set(df.columns) else df

    def number(name: str) -> Column:
        value = numbers.number_of(expanded, name, loose=False) if name in expanded.columns else F.lit(None).cast("double")
        return F.coalesce(value, F.lit(float(plan.medians[name])))

    def category(name: str) -> Column:
        value = F.coalesce(column_or_null(expanded, name).cast("string"), F.lit(plan.modes[name]))
        return fold_rare(value, plan.frequent[name], plan.rare[name])

    return expanded.select(
        *keep,
        *[number(c).alias(f"num__{c}") for c in plan.numeric],
        *[category(c).alias(f"cat__{c}") for c in plan.categorical],
    )


def assembler(df: DataFrame, plan: FeaturePlan) -> PipelineModel:
    """M5: one-hot encode and assemble; labels come from the plan, so nothing is fitted on data.

    Unknown categories take the encoder's dropped slot and so become all zeros.
    """
    stages, sample = [], df.limit(0)
    for c in plan.categorical:
        labels = plan.frequent[c] + ([RARE] if plan.rare[c] else [])
        stages.append(StringIndexerModel.from_labels(labels, f"cat__{c}", f"cat__{c}__index", handleInvalid="keep"))
        sample = stages[-1].transform(sample)
    if plan.categorical:
        encoder = OneHotEncoder(
            inputCols=[f"cat__{c}__index" for c in plan.categorical],
            outputCols=[f"cat__{c}__vector" for c in plan.categorical], dropLast=True,
        )
        stages.append(encoder.fit(sample))
    inputs = [f"num__{c}" for c in plan.numeric] + [f"cat__{c}__vector" for c in plan.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages)


def slot_names(plan: FeaturePlan) -> list[str]:
    """The name of every position of the assembled vector."""
    names = [f"num__{c}" for c in plan.numeric]
    for c in plan.categorical:
        names += [f"cat__{c}_{v}" for v in plan.frequent[c] + ([RARE] if plan.rare[c] else [])]
    return names
