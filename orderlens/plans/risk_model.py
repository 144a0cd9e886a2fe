"""Training, evaluation and batch use of the late-delivery model."""

from __future__ import annotations

import statistics
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.ranks import rank_sums, running_totals, value_counts
from orderlens.plans.risk_features import CATEGORICAL, KEYS, LABEL, NUMERIC, SEED, stratified_folds
from orderlens.sources.scratch import materialize, new_path

LR, RF = "Logistic Regression", "Random Forest"
FOLDS = 5

# Model settings, defaults of the batch scorer, risk tiers (in percent) and
# driver thresholds.
FOREST = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 5}
# How the forest is computed: candidate splits per number, and node ids kept per row
# (checkpointed every ten levels) instead of walking every tree anew.  The memory for node
# statistics decides which nodes are split together, and so the features drawn for them: it is fixed.
FOREST_TUNING = {"maxBins": 64, "cacheNodeIds": True, "maxMemoryInMB": 256}
# Rows of a partition that a model is fitted on.  Every partition adds up node statistics of its own,
# whose size does not depend on its rows: many small partitions cost far more than they save.
FIT_ROWS = 50_000
LR_ITERATIONS = 1000
SCORING_DEFAULTS = {
    "payment_installments": 1.0, "product_volume_cm3": 5000.0, "product_photos_qty": 1.0,
    "day_of_week": 2.0, "is_weekend": 0.0,
}
HIGH_OVER, MODERATE_OVER = 50.0, 20.0
DRIVERS = (
    ("Seller History", "seller_late_rate", 0.15),
    ("Long Estimate", "estimated_delivery_days", 30.0),
    ("Geography", "state_late_rate", 0.15),
)
SEASON = ("Seasonality", (11, 12))
NO_DRIVER = "standard"


# --- design matrix -------------------------------------------------------------------------


def _indexed(name: str) -> str:
    return f"{name}_index"


def encoder_stages() -> list:
    """One-hot levels without the alphabetically first one, then numerics and levels in a vector.

    Descending label order gives the first level the last index, the one that is dropped.
    """
    indexed = [_indexed(c) for c in CATEGORICAL]
    encoded = [f"{c}_levels" for c in CATEGORICAL]
    return [
        StringIndexer(
            inputCols=list(CATEGORICAL), outputCols=indexed, stringOrderType="alphabetDesc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=[*NUMERIC, *encoded], outputCol="features"),
    ]


def fill_levels(rows: DataFrame) -> DataFrame:
    """Missing categories take the first level, which is encoded as all zeros."""
    first = rows.agg(*[F.min(c).alias(c) for c in CATEGORICAL]).first()
    return rows.fillna({c: first[c] for c in CATEGORICAL if first[c] is not None})


def levels(model: PipelineModel) -> dict[str, list[str]]:
    """Levels per categorical input, the dropped one last."""
    indexer = model.stages[0]
    return dict(zip(indexer.getInputCols(), indexer.labelsArray))


def feature_names(model: PipelineModel) -> list[str]:
    by_input = levels(model)
    return [*NUMERIC] + [f"{c}_{level}" for c in CATEGORICAL for level in by_input[c][:-1]]


def fit_encoder(rows: DataFrame) -> PipelineModel:
    """Levels are taken from all rows, so that no later part of them holds an unknown level."""
    return Pipeline(stages=encoder_stages()).fit(rows)


def design(encoder: PipelineModel, rows: DataFrame) -> DataFrame:
    return encoder.transform(rows).select(*KEYS, LABEL, "features")


# --- training ------------------------------------------------------------------------------


def weighted(train: DataFrame) -> tuple[DataFrame, int]:
    """Balance the classes: each label carries half of the total weight."""
    sizes = {r[LABEL]: r["count"] for r in train.groupBy(LABEL).count().collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for label, size in sizes.items():
        weight = F.when(F.col(LABEL) == label, total / (len(sizes) * size)).otherwise(weight)
    return train.withColumn("weight", weight), total


def logistic(total: int) -> Pipeline:
    """Ridge-penalised logistic regression on standardised features.

    Features are scaled but not centred, so that the levels stay sparse in what the fit keeps of every
    row.  The fit centres them by itself; the intercept bears no penalty, so coefficients and scores are
    those of centred features.
    """
    return Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="scaled_features"),
            LogisticRegression(
                featuresCol="scaled_features", labelCol=LABEL, weightCol="weight",
                regParam=1.0 / total, elasticNetParam=0.0, standardization=False,
                maxIter=LR_ITERATIONS,
            ),
        ]
    )


def forest(**settings) -> Pipeline:
    return Pipeline(
        stages=[
            RandomForestClassifier(
                featuresCol="features", labelCol=LABEL, weightCol="weight",
                featureSubsetStrategy="sqrt", seed=SEED,
                **{**FOREST, **FOREST_TUNING, **settings},
            ),
        ]
    )


def spread(rows: DataFrame, partitions: int) -> DataFrame:
    """A layout that depends on the rows alone: bagging follows partitions and their order."""
    return rows.repartition(partitions, *KEYS).sortWithinPartitions(*KEYS)


def fit_partitions(rows: int) -> int:
    return max(1, -(-rows // FIT_ROWS))


def fit(name: str, train: DataFrame, partitions: int | None = None, **settings) -> PipelineModel:
    """Fit one model to rows of the design (key, label, features).

    For a forest, rows are laid out by their key, in one partition for `FIT_ROWS` of them, so that the
    model does not depend on the machine or on how the rows were stored.  The logistic model draws
    nothing; its sums are the same in any order but for rounding, so it reads the rows where they lie.

    The model is written and read back.  A freshly fitted one holds on to its training summary
    and through it to the session, which cannot be sent to executors once the session has been
    used to observe row counts.
    """
    path = new_path(train.sparkSession, "model")  # also names the folder of checkpoints
    rows, total = weighted(train)
    if name == LR:
        pipeline = logistic(total)
    else:
        pipeline, rows = forest(**settings), spread(rows, partitions or fit_partitions(total))
    pipeline.fit(rows).write().save(path)
    return PipelineModel.load(path)


def with_encoder(encoder: PipelineModel, model: PipelineModel) -> PipelineModel:
    """One pipeline from feature rows to scores, fit to be saved."""
    return PipelineModel([*encoder.stages, *model.stages])


def scored(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """Keys, label, probability of lateness and predicted label."""
    return model.transform(rows).select(
        F.lit(name).alias("model"),
        *KEYS,
        LABEL,
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def cross_validate(
    name: str, train: DataFrame, folds: int = FOLDS, at_once: int | None = None, **settings
) -> DataFrame:
    """Mean and deviation of the area under the ROC curve over stratified folds of exact size.

    The folds are written once.  Fits are independent; as many run at once as leave each of them a
    core for every partition (or `at_once`), so that small ones fill the cores and large ones wait.
    """
    columns = [*KEYS, LABEL, "features"]
    rows = materialize(stratified_folds(train.select(*columns), folds).hint("rebalance"), "folds")
    if at_once is None:
        cores = train.sparkSession.sparkContext.defaultParallelism
        at_once = min(folds, max(1, cores // fit_partitions(rows.count())))

    def area(held_out: int) -> float:
        model = fit(name, rows.where(F.col("fold") != held_out), **settings)
        part = scored(model, rows.where(F.col("fold") == held_out), name)
        return roc_auc(part).first()["roc_auc"]

    with ThreadPoolExecutor(at_once) as pool:
        areas = list(pool.map(area, range(folds)))
    return train.sparkSession.createDataFrame(
        [(name, statistics.fmean(areas), statistics.pstdev(areas))],
        "model string, mean_auc double, sd_auc double",
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Write the fitted pipeline, creating the folder and replacing an earlier model."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved pipeline, or nothing when no model has been saved at `path`."""
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return PipelineModel.load(path)


# --- evaluation ----------------------------------------------------------------------------


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        "model", F.col(LABEL).alias("actual"), F.col("prediction").alias("predicted")
    ).agg(F.count("*").alias("count"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Exact area per single-model frame, from the rank sum of the late rows.

    Counts per score are written first: the scores themselves are read once.
    """
    counts = materialize(value_counts(rows, LABEL, "probability"), "score_counts")
    n = F.col("n").cast("double")
    late = F.col(LABEL) == 1
    n1, n0, r1 = F.col("n1"), F.col("n0"), F.col("r1")
    return (
        rank_sums(counts, "probability", LABEL, width=None)
        .agg(
            F.sum(F.when(late, n)).alias("n1"),
            F.sum(F.when(~late, n)).alias("n0"),
            F.sum(F.when(late, F.col("rank_sum"))).alias("r1"),
        )
        .select(F.try_divide(r1 - n1 * (n1 + 1) / 2, n1 * n0).alias("roc_auc"))
    )


def roc_points(rows: DataFrame) -> DataFrame:
    """Rates at distinct scores taken as threshold (score >= threshold is late).

    The curve starts in the origin, where no score reaches the (empty) threshold.  Scores whose point
    lies on the line between its neighbours are left out: there the steps before and after it have
    the same direction.  The curve is the same without them.
    """
    late = F.col(LABEL)
    counts = rows.groupBy("probability").agg(
        F.sum(late).alias("positive"), F.sum(1 - late).alias("negative")
    )
    totals = counts.agg(
        F.struct(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    ).scalar()

    def rate(name: str, total: Column) -> Column:
        above = total - F.col(f"{name}_upto") + F.col(name)
        return F.try_divide(above.cast("double"), total)

    exact = lambda name: F.col(name).cast("decimal(19,0)")
    bends = F.col("positive_before").isNull() | (
        exact("positive") * exact("negative_before") != exact("negative") * exact("positive_before")
    )
    points = (
        running_totals(counts, "probability", ["positive", "negative"], width=None, before=True)
        .where(bends)
        .withColumn("totals", totals)
        .select(
            F.col("probability").alias("threshold"),
            rate("negative", F.col("totals.n")).alias("fpr"),
            rate("positive", F.col("totals.p")).alias("tpr"),
        )
    )
    origin = rows.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def _ratios(hits: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, zero where undefined."""
    precision = F.coalesce(F.try_divide(hits, predicted), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hits, actual), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return precision, recall, f1


def classification_metrics(rows: DataFrame) -> DataFrame:
    """(model, metric, value): accuracy, precision, recall, F1 and area under the ROC curve."""
    actual, predicted = F.col(LABEL) == 1, F.col("prediction") == 1
    counted = rows.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(actual == predicted).alias("right"),
        F.count_if(actual & predicted).cast("double").alias("hits"),
        F.count_if(predicted).alias("predicted"),
        F.count_if(actual).alias("actual"),
    )
    precision, recall, f1 = _ratios(F.col("hits"), F.col("predicted"), F.col("actual"))
    wide = counted.select(
        "model",
        F.try_divide(F.col("right").cast("double"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        roc_auc(rows).scalar().alias("roc_auc"),
    )
    metrics = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    return wide.unpivot("model", metrics, "metric", "value")


def class_report(rows: DataFrame) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support."""
    cells = rows.groupBy(LABEL, "prediction").agg(F.count("*").cast("double").alias("n"))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0.0))

    structs = []
    for label, name in ((0, "On-Time"), (1, "Late")):
        actual, predicted = F.col(LABEL) == label, F.col("prediction") == label
        p, r, f = _ratios(total(actual & predicted), total(predicted), total(actual))
        structs.append(
            F.struct(
                F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                f.alias("f1"), total(actual).alias("support"),
            ).alias(f"c{label}")
        )
    right = total(F.col(LABEL) == F.col("prediction"))
    both = cells.agg(*structs, right.alias("right"))
    support = F.col("c0.support") + F.col("c1.support")

    def average(name: str, measures: dict[str, Column]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[measures[m].alias(m) for m in ("precision", "recall", "f1")],
            support.alias("support"),
        )

    measures = ("precision", "recall", "f1")
    macro = {m: (F.col(f"c0.{m}") + F.col(f"c1.{m}")) / 2 for m in measures}
    by_support = {
        m: F.try_divide(
            F.col(f"c0.{m}") * F.col("c0.support") + F.col(f"c1.{m}") * F.col("c1.support"),
            support,
        )
        for m in measures
    }
    accuracy = F.try_divide(F.col("right"), support)
    listed = F.array(
        F.col("c0"),
        F.col("c1"),
        average("accuracy", dict.fromkeys(measures, accuracy)),
        average("macro avg", macro),
        average("weighted avg", by_support),
    )
    return both.select(F.inline(listed)).withColumn("support", F.col("support").cast("long"))


def best_model(metrics: DataFrame) -> DataFrame:
    return (
        metrics.where(F.col("metric") == "roc_auc")
        .orderBy(F.desc("value"), "model")
        .limit(1)
        .select("model", F.col("value").alias("roc_auc"))
    )


def _named(spark: SparkSession, names: list[str], values: list[float], column: str) -> DataFrame:
    # One number per model input, so the list is as short as the feature vector.
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], f"feature string, {column} double"
    )


def forest_importances(spark: SparkSession, model: PipelineModel, rows: int = 20) -> DataFrame:
    """Largest Gini importances of a full pipeline."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    named = _named(spark, feature_names(model), values, "importance")
    return named.orderBy(F.desc("importance"), "feature").limit(rows)


def logistic_coefficients(spark: SparkSession, model: PipelineModel, rows: int = 20) -> DataFrame:
    """Largest coefficients by size, with their sign, of a full pipeline."""
    values = model.stages[-1].coefficients.toArray().tolist()
    named = _named(spark, feature_names(model), values, "coefficient")
    return named.orderBy(F.desc(F.abs("coefficient")), "feature").limit(rows)


# --- batch scoring -------------------------------------------------------------------------


def score_orders(model: PipelineModel, orders: DataFrame) -> DataFrame:
    """Probability of lateness in percent for order attributes.

    Attributes that a caller does not know take the defaults; levels the model has not seen,
    and the two categorical inputs that are not asked for, are encoded as all zeros.  A row that
    lacks any other attribute has no probability.  Each row names its drivers.
    """
    known = levels(model)

    def level(name: str, source: Column | None) -> Column:
        base = F.lit(known[name][-1])
        if source is None:
            return base
        return F.coalesce(F.when(source.isin(known[name]), source), base)

    price, freight = F.col("price"), F.col("freight_value")
    total = price + freight

    def given(name: str) -> Column:
        default = F.lit(SCORING_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in orders.columns else default

    numeric = {
        "payment_installments": given("payment_installments"),
        "product_volume_cm3": given("product_volume_cm3"),
        "product_photos_qty": given("product_photos_qty"),
        "day_of_week": given("day_of_week"),
        "is_weekend": given("is_weekend"),
        "freight_ratio": freight / (total + F.lit(0.01)),
        "log_weight": F.log1p("product_weight_g"),
        "log_price": F.log1p(price),
        "quarter": F.floor((F.col("month") - 1) / 3) + 1,
    }
    numeric["log_volume"] = F.log1p(numeric["product_volume_cm3"])
    inputs = (
        orders.withColumns(numeric)
        .withColumns({c: F.col(c).cast("double") for c in NUMERIC})
        .withColumns(
            {
                "product_category_clean": level("product_category_clean", F.col("category")),
                "customer_state": level("customer_state", F.col("customer_state")),
                "payment_type": level("payment_type", None),
                "seller_state": level("seller_state", None),
            }
        )
    )
    # The vector of inputs takes no nulls.
    complete = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in NUMERIC])
    filled = inputs.withColumns({"complete": complete, "drivers": risk_drivers()}).na.fill(0.0, NUMERIC)
    late = F.when(F.col("complete"), vector_to_array("probability")[1] * F.lit(100.0))
    kept = [c for c in orders.columns if c in KEYS]
    return model.transform(filled).select(*kept, late.alias("prob_late_pct"), "drivers")


def risk_tier(percent: Column) -> Column:
    return (
        F.when(percent > HIGH_OVER, "HIGH")
        .when(percent > MODERATE_OVER, "MODERATE")
        .when(percent.isNotNull(), "LOW")
    )


def risk_drivers() -> Column:
    """Names of the factors above their threshold, or a remark that nothing stands out."""
    tests = [F.when(F.col(c) > limit, F.lit(name)) for name, c, limit in DRIVERS]
    tests.append(F.when(F.col("month").isin(*SEASON[1]), F.lit(SEASON[0])))
    found = F.array_compact(F.array(*tests))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_DRIVER)))


def seller_rule(features: DataFrame, late_over: float = 0.15) -> DataFrame:
    """The seller quality gate read as a classifier: score is the seller's late rate."""
    rate = F.round("seller_late_rate", 6)
    return features.select(
        F.lit("Seller quality gate").alias("model"),
        *KEYS,
        LABEL,
        rate.alias("probability"),
        (rate > late_over).cast("int").alias("prediction"),
    )


def all_metrics(scores: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [classification_metrics(s) for s in scores.values()])
