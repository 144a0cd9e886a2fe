"""A star schema that lives as long as the Spark session.

Reports read written tables, as they would in production: each star table is built from the
raw tables on first use, written to the shared scratch folder and read back from there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from orderlens.plans import star as plans
from orderlens.sources.raw_csv import RawTables
from orderlens.sources.scratch import materialize


class SessionStar:
    """Duck-typed `Star` whose tables are built and written one by one, when first read."""

    def __init__(self, raw: RawTables):
        self.raw = raw
        self.cleaned = plans.clean(raw)
        self.derived: dict[str, object] = {}

    def once(self, name: str, build):
        """Remember a written intermediate result (or a fitted model) under `name`."""
        if name not in self.derived:
            self.derived[name] = build()
        return self.derived[name]

    @cached_property
    def fact(self) -> DataFrame:
        return materialize(plans.build_fact(self.raw, self.cleaned), "fact_orders")

    @cached_property
    def customers(self) -> DataFrame:
        return materialize(plans.build_dim_customers(self.raw, self.cleaned), "dim_customers")

    @cached_property
    def products(self) -> DataFrame:
        return materialize(plans.build_dim_products(self.cleaned), "dim_products")

    @cached_property
    def sellers(self) -> DataFrame:
        return materialize(plans.build_dim_sellers(self.raw, self.cleaned), "dim_sellers")

    @cached_property
    def dates(self) -> DataFrame:
        return materialize(plans.build_dim_date(self.cleaned), "dim_date")

    def tables(self) -> dict[str, DataFrame]:
        return plans.Star(
            self.fact, self.customers, self.products, self.sellers, self.dates
        ).tables()


def build_session(master: str | None = None, name: str = "orderlens", **settings) -> SparkSession:
    """A session with the settings the jobs expect; `settings` use underscores for dots.

    Adaptive execution sizes shuffles and splits skewed joins; timestamps carry no zone.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
    }
    given = {key.replace("_", "."): str(value) for key, value in settings.items()}
    for key, value in {**defaults, **given}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
