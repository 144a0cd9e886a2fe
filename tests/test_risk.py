import pytest
from conftest import rows
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from orderlens import registry
from orderlens.operators import ranks
from orderlens.plans import risk
from orderlens.plans import risk_features as features
from orderlens.plans import risk_model as models
from orderlens.session import SessionStar
from orderlens.sources.scratch import materialize

TREES = {"numTrees": 10, "maxDepth": 6}
SCORES = "model string, is_late int, probability double, prediction int"


@pytest.fixture(scope="module")
def forest(small_star):
    fitted = models.fit(models.RF, risk.train_rows(small_star), **TREES)
    return models.with_encoder(risk.encoder(small_star), fitted)


def test_split_is_exact_and_stable(small_star):
    rows_ = risk.ml_design(small_star)
    sizes = {r["is_late"]: r["count"] for r in rows_.groupBy("is_late").count().collect()}
    held = risk.test_rows(small_star).groupBy("is_late").count().collect()
    assert {r["is_late"]: r["count"] for r in held} == {k: round(v * 0.2) for k, v in sizes.items()}
    again = features.stratified_split(rows_).where("split = 'test'").select(*features.KEYS)
    assert again.exceptAll(risk.test_rows(small_star).select(*features.KEYS)).count() == 0


def test_design_drops_the_first_level(small_star):
    encoder = risk.encoder(small_star)
    names = models.feature_names(encoder)
    size = risk.ml_design(small_star).first()["features"].size
    assert len(names) == size == len(set(names))
    assert "payment_type_boleto" not in names and "payment_type_credit_card" in names


def test_the_logistic_model_keeps_levels_sparse(small_star, monkeypatch):
    """Its rows are neither laid out anew nor centred one by one; scores are those of centred features."""
    monkeypatch.setattr(models, "spread", lambda *_: pytest.fail("rows of the logistic model were shuffled"))
    train, test = risk.train_rows(small_star), risk.test_rows(small_star)
    fitted = models.fit(models.LR, train)
    sizes = F.udf(lambda v: len(v.indices) if hasattr(v, "indices") else v.size, "int")
    scaled = fitted.transform(train).select(sizes("scaled_features").alias("kept"), sizes("features").alias("given"))
    assert scaled.where("kept > given").count() == 0 and scaled.agg(F.max("kept")).first()[0] < len(models.feature_names(risk.encoder(small_star)))
    rows_, total = models.weighted(train)
    [scaler, regression] = models.logistic(total).getStages()
    centred = Pipeline(stages=[scaler.copy().setWithMean(True), regression]).fit(rows_)
    want = {tuple(r[k] for k in features.KEYS): r["probability"] for r in models.scored(centred, test, "m").collect()}
    found = {tuple(r[k] for k in features.KEYS): r["probability"] for r in models.scored(fitted, test, "m").collect()}
    assert found == pytest.approx(want, abs=1e-6) and len(found) > 100


def test_rows_are_written_once_for_the_model(small_star, monkeypatch):
    """What follows row by row from the features is not written: not the imputed rows, the design or the split."""
    written = []

    def noted(df, name):
        written.append(name)
        return materialize(df, name)

    monkeypatch.setattr(risk, "materialize", noted)
    star = SessionStar(small_star.raw)
    assert registry.REPORTS["lr_metrics"](star).count() == 5
    assert written == ["ml_rows", "ml_features", "scores"]
    written.clear()
    assert registry.REPORTS["lr_metrics_oof"](star).count() == 5
    assert written == ["ml_folds", "folded_features", "ml_features_oof", "scores_oof"]


def test_imputation_uses_the_median(small_star):
    holes = risk.ml_features(small_star)
    assert holes.where("product_photos_qty is null").count() > 0
    median = holes.agg(F.median("product_photos_qty")).first()[0]
    filled = risk.ml_imputed(small_star).join(
        holes.where("product_photos_qty is null").select(*features.KEYS), features.KEYS
    )
    assert {r[0] for r in filled.select("product_photos_qty").collect()} == {median}


def test_models_beat_chance(small_star, forest):
    lr = risk.scores(small_star, models.LR)
    rf = models.scored(forest, _feature_rows(small_star), models.RF)
    for scored in (lr, rf):
        metrics = {r["metric"]: r["value"] for r in models.classification_metrics(scored).collect()}
        assert metrics["roc_auc"] > 0.6
        assert 0 <= metrics["precision"] <= 1 and 0 <= metrics["recall"] <= 1
    best = models.best_model(models.all_metrics({"a": lr, "b": rf}))
    assert best.count() == 1


def _feature_rows(star):
    return models.fill_levels(risk.ml_imputed(star))


def test_area_equals_the_evaluator(small_star):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = risk.scores(small_star, models.LR)
    expected = BinaryClassificationEvaluator(
        labelCol="is_late", rawPredictionCol="probability", numBins=0
    ).evaluate(scored.withColumn("is_late", F.col("is_late").cast("double")))
    assert models.roc_auc(scored).first()[0] == pytest.approx(expected, abs=1e-9)


def test_cross_validation_does_not_depend_on_the_layout(small_star):
    train = risk.train_rows(small_star)
    found = {
        tuple(models.cross_validate(models.RF, train.repartition(n), folds=2, at_once=at_once, **TREES).first())
        for n, at_once in ((2, 1), (7, 2), (16, None))
    }
    [(_, mean, sd)] = found
    assert 0.5 < mean < 1 and sd >= 0


@pytest.mark.parametrize("folds", [2, 5, 7])
def test_folds_have_exact_sizes(spark, folds):
    table = spark.range(1003).select(
        F.col("id").cast("string").alias("order_id"), F.lit(1).alias("order_item_id"), (F.col("id") < 3).cast("int").alias("is_late")
    )
    found = features.stratified_folds(materialize(table, "rows"), folds)
    sizes = {(r["is_late"], r["fold"]): r["count"] for r in found.groupBy("is_late", "fold").count().collect()}
    for label, size in ((0, 1000), (1, 3)):
        want = [size * (k + 1) // folds - size * k // folds for k in range(folds)]
        assert [sizes.get((label, k), 0) for k in range(folds)] == want


def test_every_forest_query_with_a_small_forest(small_star, monkeypatch):
    for name, value in TREES.items():
        monkeypatch.setitem(models.FOREST, name, value)
    star = SessionStar(small_star.raw)
    from test_oracle import SLOW

    counts = {name: registry.REPORTS[name](star).count() for name in SLOW}
    assert counts["score_orders"] == risk.ml_features(star).count() and min(counts.values()) > 0
    assert counts["cv_auc"] == counts["cv_auc_forest"] == counts["best_model"] == 1
    held = risk.test_rows(star).count()
    for name in ("lr_confusion", "rf_confusion"):
        assert registry.REPORTS[name](star).agg(F.sum("count")).first()[0] == held
    for name in ("lr_class_report", "rf_class_report"):
        assert registry.REPORTS[name](star).where("class = 'accuracy'").first()["support"] == held


def crowded_scores(spark, rows_=4000):
    """Nine of ten scores lie within 1e-4."""
    place = F.when(F.col("id") % 10 > 0, 0.5 + F.floor(F.rand(1) * 700) * 1e-7).otherwise(F.floor(F.rand(2) * 50) / 50)
    late = (F.rand(3) < 0.3 + F.col("probability") / 3).cast("int")
    table = spark.range(rows_).select(F.lit("m").alias("model"), place.alias("probability"))
    return materialize(table.select("model", late.alias("is_late"), "probability", F.lit(0).alias("prediction")), "crowded")


@pytest.mark.parametrize("range_rows", [10, 100_000])
def test_crowded_scores(spark, monkeypatch, range_rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    monkeypatch.setattr(ranks, "RANGE_ROWS", range_rows)
    scored = crowded_scores(spark)
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", numBins=0)
    expected = evaluator.evaluate(scored.withColumn("label", F.col("is_late").cast("double")))
    assert models.roc_auc(scored).first()[0] == pytest.approx(expected, abs=1e-9)
    # The curve by hand: steps at falling scores, without points between steps of one direction.
    steps = {}
    for r in scored.collect():
        step = steps.setdefault(r["probability"], [0, 0])
        step[r["is_late"]] += 1
    order = sorted(steps, reverse=True)
    totals = [sum(s[k] for s in steps.values()) for k in (0, 1)]
    want, done = [(None, 0.0, 0.0)], [0, 0]
    for i, score in enumerate(order):
        done = [done[k] + steps[score][k] for k in (0, 1)]
        after = steps[order[i + 1]] if i + 1 < len(order) else None
        if after is None or steps[score][0] * after[1] != steps[score][1] * after[0]:
            want.append((score, done[0] / totals[0], done[1] / totals[1]))
    points = sorted(models.roc_points(scored).collect(), key=lambda r: -2 if r["threshold"] is None else -r["threshold"])
    assert [tuple(p) for p in points] == want and len(want) < len(order)


def test_ranges_are_small_where_values_crowd(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    counts = ranks.value_counts(crowded_scores(spark), "probability")
    ranged = ranks._in_ranges(counts, "probability")
    sizes = [r["count"] for r in ranged.groupBy("chunk").count().collect()]
    assert sum(sizes) == counts.count() and max(sizes) <= 4 * 50 and len(sizes) > 5


def test_out_of_fold_rates(spark):
    """A row's own fold has no part in its rates; a test row sees all training rows."""
    data = [
        ("a", 1, "s", "X", 1, 0), ("b", 1, "s", "X", 0, 1), ("c", 1, "s", "Y", 1, 1), ("d", 1, "t", "Y", 1, 0),
        ("e", 1, "s", "X", 0, None), ("f", 1, "u", "Z", 1, None), ("g", 1, None, None, 0, 1),
    ]
    schema = "order_id string, order_item_id int, seller_id string, customer_state string, is_late int, fold int"
    df = spark.createDataFrame(data, schema).withColumns({c: F.lit(-1.0) for c in ("seller_late_rate", "state_late_rate")})
    found = {r["order_id"]: (r["seller_late_rate"], r["state_late_rate"]) for r in features.out_of_fold(df, 2).collect()}
    assert found == {
        "a": (0.5, 0.0), "b": (1.0, 1.0), "c": (1.0, 1.0), "d": (1 / 3, 1.0), "e": (2 / 3, 0.5), "f": (0.6, 0.6), "g": (1.0, 1.0),
    }


def test_model_survives_saving(spark, small_star, forest, tmp_path):
    path = str(tmp_path / "models" / "late")
    assert models.load_model(spark, path) is None
    models.save_model(forest, path)
    models.save_model(forest, path)
    again = models.load_model(spark, path)
    orders = features.attributes(risk.ml_features(small_star)).limit(20)
    before = sorted(rows(models.score_orders(forest, orders)))
    assert before == sorted(rows(models.score_orders(again, orders)))


def test_scoring_accepts_unknown_levels_and_defaults(spark, forest):
    schema = (
        "order_id string, order_item_id int, price double, freight_value double, "
        "product_weight_g double, estimated_delivery_days double, month int, "
        "seller_late_rate double, seller_order_count long, same_state int, "
        "state_late_rate double, category string, customer_state string"
    )
    order = ("a", 1, 150.0, 20.0, 1500.0, 25.0, 11, 0.05, 100, 0, 0.1)
    df = spark.createDataFrame([(*order, "no such", "ZZ"), (*order, None, None)], schema)
    found = models.score_orders(forest, df).collect()
    scores = [r["prob_late_pct"] for r in found]
    assert scores[0] == scores[1] and 0 <= scores[0] <= 100
    assert found[0]["drivers"] == ["Seasonality"]


def test_a_row_without_an_attribute_has_no_score(small_star, forest):
    orders = features.attributes(risk.ml_features(small_star)).limit(4)
    gap = orders.withColumn("product_weight_g", F.when(F.col("order_item_id") < 0, 1.0))
    assert [r["prob_late_pct"] for r in models.score_orders(forest, gap).collect()] == [None] * 4


def test_the_forest_does_not_depend_on_the_layout(small_star):
    train, test = risk.train_rows(small_star), risk.test_rows(small_star)
    found = []
    for n in (2, 7, 16):
        fitted = models.fit(models.RF, train.repartition(n), **TREES)
        found.append(sorted(rows(models.scored(fitted, test, models.RF))))
    assert found[0] == found[1] == found[2]


def test_importances_and_coefficients(spark, small_star, forest):
    top = models.forest_importances(spark, forest).collect()
    assert len(top) == 20 and top[0]["importance"] >= top[-1]["importance"]
    coefficients = risk.logistic_coefficients(small_star).collect()
    sizes = [abs(r["coefficient"]) for r in coefficients]
    assert sizes == sorted(sizes, reverse=True)


def test_tiers_and_drivers(spark):
    df = spark.createDataFrame([(50.0,), (50.1,), (20.0,), (20.1,), (None,)], "p double")
    assert [r[0] for r in rows(df.select(models.risk_tier(F.col("p"))))] == [
        "MODERATE", "HIGH", "LOW", "MODERATE", None
    ]
    schema = "seller_late_rate double, estimated_delivery_days double, state_late_rate double, month int"
    df = spark.createDataFrame([(0.2, 31.0, 0.2, 11), (0.15, 30.0, 0.15, 10), (None, 40.0, None, 1)], schema)
    assert [r[0] for r in rows(df.select(models.risk_drivers()))] == [
        ["Seller History", "Long Estimate", "Geography", "Seasonality"], ["standard"], ["Long Estimate"]
    ]


def test_metrics_of_worked_scores(spark):
    data = [("m", 1, 0.9, 1), ("m", 0, 0.8, 1), ("m", 1, 0.4, 0), ("m", 0, 0.4, 0), ("m", 0, 0.1, 0)]
    df = spark.createDataFrame(data, SCORES)
    metrics = {r["metric"]: r["value"] for r in models.classification_metrics(df).collect()}
    # Pairs won by the late rows: 3 of 3, then 1 + 1/2 of 3.
    assert metrics == {
        "accuracy": 0.6, "precision": 0.5, "recall": 0.5, "f1": 0.5, "roc_auc": pytest.approx(4.5 / 6)
    }
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in models.roc_points(df).collect()}
    assert points == {
        None: (0.0, 0.0), 0.9: (0.0, 0.5), 0.8: (1 / 3, 0.5), 0.4: (2 / 3, 1.0), 0.1: (1.0, 1.0)
    }
    assert sum(r["count"] for r in models.confusion(df).collect()) == 5


def test_metrics_without_predictions_are_zero(spark):
    df = spark.createDataFrame([("m", 1, 0.2, 0), ("m", 0, 0.1, 0)], SCORES)
    metrics = {r["metric"]: r["value"] for r in models.classification_metrics(df).collect()}
    assert (metrics["precision"], metrics["recall"], metrics["f1"]) == (0.0, 0.0, 0.0)
    report = {r["class"]: r for r in models.class_report(df).collect()}
    assert report["Late"]["f1"] == 0.0 and report["weighted avg"]["support"] == 2


def test_leak_free_rates_know_training_rows_only(small_star):
    leak_free = risk.leak_free_features(small_star)
    rates = risk.ml_features(small_star).select(*features.KEYS, "seller_late_rate")
    changed = leak_free.select(*features.KEYS, F.col("seller_late_rate").alias("r")).join(
        rates, features.KEYS
    )
    assert changed.where("r <> seller_late_rate").count() > 0
