"""Typed loading of the nine raw CSV files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}

# Raw tables, their file stems and the columns read from each file.
# Timestamps arrive as text and are parsed by the cleaning step, bad values becoming null.
RAW_TABLES = {
    "customers": (
        "customers_dataset",
        "customer_id string, customer_unique_id string, customer_city string, customer_state string",
    ),
    "orders": (
        "orders_dataset",
        "order_id string, customer_id string, order_status string, "
        "order_purchase_timestamp string, order_approved_at string, "
        "order_delivered_carrier_date string, order_delivered_customer_date string, "
        "order_estimated_delivery_date string",
    ),
    "order_items": (
        "order_items_dataset",
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "price double, freight_value double",
    ),
    "payments": (
        "order_payments_dataset",
        "order_id string, payment_type string, payment_installments int, payment_value double",
    ),
    "reviews": (
        "order_reviews_dataset",
        "review_id string, order_id string, review_score int, review_comment_message string, "
        "review_creation_date string",
    ),
    "products": (
        "products_dataset",
        "product_id string, product_category_name string, product_name_lenght int, "
        "product_description_lenght int, product_photos_qty int, product_weight_g double, "
        "product_length_cm double, product_height_cm double, product_width_cm double",
    ),
    "sellers": ("sellers_dataset", "seller_id string, seller_city string, seller_state string"),
    "geolocation": ("geolocation_dataset", ""),
    "category_translation": (
        "product_category_name_translation",
        "product_category_name string, product_category_name_english string",
    ),
}

# Texts that count as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class MissingInputs(Exception):
    """Raised once, naming every absent input file."""

    def __init__(self, directory: str, names: list[str]):
        self.names = names
        super().__init__(f"missing in {directory}: " + ", ".join(names))


@dataclass(frozen=True)
class RawTables:
    """The raw relations, as loaded from CSV or derived from other tables."""

    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    category_translation: DataFrame
    geolocation: DataFrame | None = None
    # Records of files that do not fit their table, by table: (record, reason).
    malformed: Mapping[str, DataFrame] = field(default_factory=dict)

    def frames(self) -> dict[str, DataFrame]:
        named = {name: getattr(self, name) for name in RAW_TABLES}
        return {name: df for name, df in named.items() if df is not None}


def _read(spark: SparkSession, path: str, declared: str, multi_line: bool) -> tuple[DataFrame, DataFrame | None]:
    """The table at `path`, and its malformed records as (record, reason).

    Types are applied by column name: the header line decides the position of each.  Every file of a
    folder must have the same header; one that differs ends the job with an error that names it,
    since its values would be read into wrong columns.  A record with too few or too many fields, or
    with something else where a number belongs, stays in the table with nulls there.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    header = reader.csv(path).columns
    if not declared:
        return reader.csv(path), None
    wanted = dict(part.split() for part in declared.split(", "))
    absent = [c for c in wanted if c not in header]
    if absent:
        raise ValueError(f"{path} lacks columns: {', '.join(absent)}")
    whole = next(name for name in (f"_record{i}" for i in range(len(header) + 1)) if name not in header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, whole]])
    text = (
        reader.schema(schema).option("columnNameOfCorruptRecord", whole)
        .option("multiLine", multi_line).option("enforceSchema", False).csv(path)
    )

    def given(name: str) -> Column:
        return F.when(~F.col(name).isin(*MISSING_TOKENS), F.col(name))

    def typed(name: str) -> Column:
        value = given(name)
        if wanted[name] == "string":
            return value
        number = F.trim(value).try_cast(_TYPES[wanted[name]])
        return F.when(~F.isnan(number), number) if wanted[name] == "double" else number

    numbers = [name for name in wanted if wanted[name] != "string"]
    wrong = F.array_compact(F.array(*[
        F.when(given(name).isNotNull() & F.trim(given(name)).try_cast(_TYPES[wanted[name]]).isNull(), F.lit(name)) for name in numbers
    ])) if numbers else F.array().cast("array<string>")
    # A scan must read some other column beside the whole record, also where records are only counted.
    fields = F.length(F.to_json(F.struct(*header))) >= 0
    reason = F.when(F.col(whole).isNotNull() & fields, "wrong number of fields").when(
        F.size("wrong") > 0, F.concat(F.lit("not a number: "), F.array_join("wrong", ", "))
    )
    record = F.coalesce(whole, F.to_json(F.struct(*header)))
    malformed = text.withColumn("wrong", wrong).select(record.alias("record"), reason.alias("reason")).where("reason is not null")
    return text.select(*[typed(name).alias(name) for name in wanted]), malformed


def file_name(table: str, prefix: str = "") -> str:
    stem = RAW_TABLES[table][0]
    return f"{prefix if stem.endswith('_dataset') else ''}{stem}.csv"


def read_raw(spark: SparkSession, directory: str, prefix: str = "") -> RawTables:
    """Read `{prefix}{stem}.csv` for every raw table (file or folder of part files).

    Only reviews hold line breaks inside a field; only they give up splitting within a file,
    so a large review export should arrive as several files.
    """
    frames, malformed, missing = {}, {}, []
    for table, (_, declared) in RAW_TABLES.items():
        name = file_name(table, prefix)
        try:
            frames[table], bad = _read(spark, f"{directory}/{name}", declared, table == "reviews")
            if bad is not None:
                malformed[table] = bad
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
    if missing:
        raise MissingInputs(directory, missing)
    return RawTables(**frames, malformed=malformed)


def load_profile(raw: RawTables) -> DataFrame:
    """Rows, columns and malformed records per input; costs a scan of each, two where records are checked."""
    profile = None
    for name, df in raw.frames().items():
        bad = raw.malformed[name].agg(F.count("*")).scalar() if name in raw.malformed else F.lit(0)
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("columns"), bad.cast("long").alias("malformed")
        )
        profile = row if profile is None else profile.unionByName(row)
    return profile


def quarantine(raw: RawTables) -> DataFrame | None:
    """(table_name, record, reason) of every malformed record, to be written and looked through."""
    parts = [df.select(F.lit(name).alias("table_name"), "record", "reason") for name, df in raw.malformed.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None
