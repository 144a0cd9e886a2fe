"""Tables written as files and read back, to check the file formats against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.plans import extracts as dash
from orderlens.plans.star import FACT_COLUMNS, ISO_SECONDS, Star, build_fact, clean, iso_text
from orderlens.sources import store
from orderlens.sources.raw_csv import RawTables, file_name, read_raw
from orderlens.sources.scratch import new_path


def _like(df: DataFrame, original: DataFrame) -> DataFrame:
    """Columns of `original` with its types: files hold every id as text."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in original.schema))


def raw_csv(raw: RawTables, fact: DataFrame) -> DataFrame:
    """The fact built from raw tables that were written as CSV."""
    path = new_path(fact.sparkSession, "raw_csv")
    frames = {"geolocation": fact.sparkSession.range(1), **raw.frames()}
    for name, df in frames.items():
        times = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")]
        text = df.withColumns({c: F.date_format(c, ISO_SECONDS) for c in times})
        text.write.option("header", True).option("escape", '"').csv(f"{path}/{file_name(name)}")
    loaded = read_raw(fact.sparkSession, path)
    return iso_text(_like(build_fact(loaded, clean(loaded)), fact))


def stored_star(star) -> Star:
    """The session's star, stored and read back once."""

    def build() -> Star:
        spark = star.fact.sparkSession
        path = new_path(spark, "stored_star")
        store.write_star(Star(star.fact, star.customers, star.products, star.sellers, star.dates), path)
        return store.read_star(spark, path)

    return star.once("stored_star", build)


def stored_fact(star) -> DataFrame:
    """The fact read back: its own columns, without the layout's."""
    back = stored_star(star).fact
    if set(back.columns) != set(FACT_COLUMNS):
        raise ValueError(f"stored fact has columns {back.columns}")
    return iso_text(_like(back, star.fact))


def stored_dimension(star, name: str) -> DataFrame:
    return iso_text(stored_star(star).tables()[name])


def star_csv(star, name: str) -> DataFrame:
    """A table of the star exported as (compressed) CSV with the others and read back with its types."""

    def build() -> str:
        path = new_path(star.fact.sparkSession, "star_csv")
        tables = Star(star.fact, star.customers, star.products, star.sellers, star.dates)
        store.export_star(tables, path, compression="gzip")
        return path

    original = {
        "fact_orders": star.fact, "dim_customers": star.customers, "dim_products": star.products,
        "dim_sellers": star.sellers, "dim_date": star.dates,
    }[name]
    reader = star.fact.sparkSession.read.option("header", True).option("escape", '"')
    return iso_text(_like(reader.csv(f"{star.once('star_csv', build)}/{name}"), original))


def exported_extract(star, name: str) -> DataFrame:
    """One dashboard extract, exported with the others as CSV and read back."""

    def build() -> dict[str, DataFrame]:
        spark = star.fact.sparkSession
        path = new_path(spark, "exported_extracts")
        store.export_extracts(dash.extracts(star), path)
        return store.read_extracts(spark, path)

    return star.once("exported_extracts", build)[name]
