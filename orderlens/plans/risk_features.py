"""Features of the late-delivery model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.draws import seeded_draw
from orderlens.operators.order_stats import exact_medians, order_statistics
from orderlens.operators.skew import split_join
from orderlens.sources.scratch import materialize

KEYS = ["order_id", "order_item_id"]
LABEL = "is_late"

# Model inputs, and how many categories keep their own level.
NUMERIC = (
    "price", "freight_value", "estimated_delivery_days", "payment_installments",
    "product_weight_g", "product_volume_cm3", "product_photos_qty", "freight_ratio",
    "same_state", "seller_late_rate", "seller_order_count", "state_late_rate", "log_weight",
    "log_volume", "log_price", "month", "day_of_week", "is_weekend", "quarter",
)
CATEGORICAL = ("product_category_clean", "payment_type", "seller_state", "customer_state")
TOP_CATEGORIES = 20
OTHER = "other"
TEST_SHARE = 0.2
SEED = 42


def feature_rows(star) -> DataFrame:
    """Delivered items with both day counts, joined to all four dimensions."""
    fact = star.fact.where(
        (F.col("is_delivered") == 1)
        & F.col("delivery_days").isNotNull()
        & F.col("estimated_delivery_days").isNotNull()
    ).select(
        *KEYS, "seller_id", "product_id", "customer_unique_id", "order_date_key", "price",
        "freight_value", "total_item_value", "estimated_delivery_days", LABEL, "payment_type",
        "payment_installments",
    )
    products = star.products.select(
        "product_id", "product_category", "product_weight_g", "product_volume_cm3",
        "product_photos_qty",
    )
    dates = star.dates.select(
        F.col("date_key").alias("order_date_key"), "month", "day_of_week", "is_weekend", "quarter"
    )
    return (
        fact.join(dates, "order_date_key")
        .join(star.sellers.select("seller_id", "seller_state"), "seller_id")
        .join(products, "product_id")
        .join(star.customers.select("customer_unique_id", "customer_state"), "customer_unique_id")
        .select(
            *KEYS, "seller_id", "price", "freight_value", "total_item_value",
            "estimated_delivery_days", LABEL, "payment_type", "payment_installments",
            "product_category", "product_weight_g", "product_volume_cm3", "product_photos_qty",
            "seller_state", "customer_state", "month", "day_of_week", "is_weekend", "quarter",
        )
    )


def seller_history(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seller_id").agg(
        F.avg(LABEL).alias("seller_late_rate"),
        F.countDistinct("order_id").alias("seller_order_count"),
    )


def state_history(rows: DataFrame) -> DataFrame:
    return rows.groupBy("customer_state").agg(F.avg(LABEL).alias("state_late_rate"))


def engineer(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Add the derived features to (written) feature rows and drop rows lacking the essentials.

    Late rates come from `history`.  By default that is all rows, labels of later test rows
    included; pass training rows only for an evaluation free of that leak.
    """
    history = rows if history is None else history
    top = (
        rows.where(F.col("product_category").isNotNull())
        .groupBy("product_category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "product_category")
        .limit(TOP_CATEGORIES)
        .select("product_category", F.col("product_category").alias("kept"))
    )
    known = split_join(rows, seller_history(history), "seller_id", "left")
    # Written first, so that its true size decides whether it is broadcast: a shuffle of all
    # rows by state would leave most of them in a few tasks.
    states = materialize(state_history(history), "state_history")
    return (
        known.join(states, "customer_state", "left")
        .join(top, "product_category", "left")
        .withColumns(
            {
                "freight_ratio": F.col("freight_value") / (F.col("total_item_value") + 0.01),
                "same_state": F.coalesce(
                    (F.col("seller_state") == F.col("customer_state")).cast("int"), F.lit(0)
                ),
                "product_category_clean": F.coalesce("kept", F.lit(OTHER)),
                "log_weight": F.log1p(F.coalesce("product_weight_g", F.lit(0.0))),
                "log_volume": F.log1p(F.coalesce("product_volume_cm3", F.lit(0.0))),
                "log_price": F.log1p("price"),
            }
        )
        .dropna(subset=["estimated_delivery_days", "product_weight_g"])
        .select(
            *rows.columns, "freight_ratio", "same_state", "seller_late_rate",
            "seller_order_count", "state_late_rate", "product_category_clean", "log_weight",
            "log_volume", "log_price",
        )
    )


def impute(features: DataFrame) -> DataFrame:
    """Numeric nulls become the exact median of their column over all rows.

    One pass finds the columns that have nulls; medians are located for those only, all together.
    """
    nulls = features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in NUMERIC]).first()
    medians = exact_medians(features, [c for c in NUMERIC if nulls[c]], KEYS)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in NUMERIC
    }
    return features.withColumns(filled)


def stratified_split(rows: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add `split` ('train' or 'test'): the same share of each label, by a seeded hash of the key.

    Exact sizes need the hash standing at one position per label; that row is located without
    sorting, and the split is a comparison with it.  Expects written rows.
    """
    drawn = rows.withColumn("draw", seeded_draw(KEYS, seed))
    order = ["draw", *KEYS]
    sizes = {r[LABEL]: r["count"] for r in drawn.groupBy(LABEL).count().collect()}
    test = F.lit(False)
    for label, size in sizes.items():
        held_out = round(size * test_share)
        if not held_out:
            continue
        of_label = drawn.where(F.col(LABEL) == label)
        cut = order_statistics(of_label, order, [size - held_out + 1], size)[0]
        bound = F.struct(
            *[F.lit(v).cast(drawn.schema[c].dataType).alias(c) for c, v in zip(order, cut)]
        )
        test = test | ((F.col(LABEL) == label) & (F.struct(*order) >= bound))
    return drawn.withColumn("split", F.when(test, "test").otherwise("train")).drop("draw")


def stratified_folds(rows: DataFrame, folds: int, seed: int = SEED + 1) -> DataFrame:
    """Add `fold` (0 .. folds - 1): of each label every fold holds the same number of rows, or one more.

    The rows where a fold begins are located in the order of a seeded hash, label by label, without
    sorting; the fold is the number of such rows not after a row.  Expects written rows.
    """
    drawn = rows.withColumn("draw", seeded_draw(KEYS, seed))
    order = ["draw", *KEYS]
    sizes = {r[LABEL]: r["count"] for r in drawn.groupBy(LABEL).count().collect()}
    fold = F.lit(0)
    for label, size in sizes.items():
        starts = sorted({size * k // folds + 1 for k in range(1, folds) if size * k // folds < size})
        of_label = drawn.where(F.col(LABEL) == label)
        cuts = order_statistics(of_label, order, starts, size) if starts else []
        for cut, start in zip(cuts, starts, strict=True):
            bound = F.struct(*[F.lit(v).cast(drawn.schema[c].dataType).alias(c) for c, v in zip(order, cut)])
            # Several folds begin at one row where a label has fewer rows than folds.
            begins = sum(size * k // folds + 1 == start for k in range(1, folds))
            fold = fold + F.when((F.col(LABEL) == label) & (F.struct(*order) >= bound), begins).otherwise(0)
    return drawn.withColumn("fold", fold).drop("draw")


def _fold_totals(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """One row per key: late rows and rows of each fold, as arrays.  Rows without a fold do not count."""
    of = [F.col("fold") == k for k in range(folds)]
    return (
        rows.where(F.col("fold").isNotNull())
        .groupBy(key)
        .agg(
            F.array(*[F.coalesce(F.sum(F.when(test, F.col(LABEL))), F.lit(0)) for test in of]).alias(f"{key}_late"),
            F.array(*[F.count_if(test) for test in of]).alias(f"{key}_n"),
        )
    )


def _but_own(totals: str) -> Column:
    """The sum of an array of totals without that of the row's own fold, if it has one."""
    own = F.coalesce(F.get(totals, F.col("fold")), F.lit(0))
    return F.aggregate(totals, F.lit(0).cast("long"), lambda a, x: a + x) - own


def out_of_fold(rows: DataFrame, folds: int) -> DataFrame:
    """`rows` (written, with `fold`) with late rates that no row's own label has a part in.

    A training row's seller and state are rated over the training rows of the other folds, a row
    without a fold over all of them.  Each key's totals by fold come from one aggregation, and what a
    row must not see is subtracted.  A key that no other fold knows has the rate of all rows there.
    """
    everything = _fold_totals(rows.withColumn("all", F.lit(1)), "all", folds)
    states = materialize(_fold_totals(rows, "customer_state", folds), "state_folds")
    known = split_join(rows, _fold_totals(rows, "seller_id", folds), "seller_id", "left")
    known = known.join(states, "customer_state", "left")
    known = known.withColumn("of_all", everything.select(F.struct("all_late", "all_n")).scalar())
    known = known.withColumns({"all_late": F.col("of_all.all_late"), "all_n": F.col("of_all.all_n")})

    def rate(key: str) -> Column:
        return F.try_divide(_but_own(f"{key}_late"), _but_own(f"{key}_n"))

    return known.withColumns(
        {
            "seller_late_rate": F.coalesce(rate("seller_id"), rate("all")),
            "state_late_rate": F.coalesce(rate("customer_state"), rate("all")),
        }
    ).select(*rows.columns)


def attributes(features: DataFrame) -> DataFrame:
    """The order attributes a caller of the batch scorer supplies, taken from feature rows."""
    return features.select(
        *KEYS, "price", "freight_value", "product_weight_g", "estimated_delivery_days", "month",
        "seller_late_rate", "seller_order_count", "same_state", "state_late_rate",
        F.col("product_category_clean").alias("category"), "customer_state",
    )
