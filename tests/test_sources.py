import os

import pytest
from conftest import rows
from pyspark.errors import AnalysisException

from orderlens.plans import cleaning, round_trips
from orderlens.plans import extracts as dash
from orderlens.plans.star import FACT_COLUMNS, build_star, check_keys, iso_text
from orderlens.session import SessionStar
from orderlens.sources import raw_csv, store
from orderlens.sources.scratch import materialize, shared_root

FILES = {
    "customers_dataset.csv": "customer_id,customer_unique_id,customer_zip,customer_city,customer_state\n"
    "k1,u1,00123,Town,AA\nk2,u1,00124,Other,BB\nk3,u2,00125,Third,NA\n",
    "orders_dataset.csv": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,k2,delivered,2018-02-01 10:00:00,2018-02-01 11:00:00,,2018-02-05 10:00:00,2018-02-04 00:00:00\n"
    "o2,k1,delivered,2018-01-01 10:00:00,not a date,,,2018-01-20 00:00:00\n"
    "o3,k3,shipped,2018-01-05 23:59:59,,,,2018-01-20 00:00:00\n",
    "order_items_dataset.csv": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    "o1,1,p1,s1,x,10.10,1.05\no1,2,p1,s1,x,10.10,1.05\no1,3,p2,s2,x,0.10,0.20\no2,1,p2,s1,x,5.00,NaN\n",
    "order_payments_dataset.csv": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,voucher,1,20.00\no1,2,boleto,3,2.60\no2,1,NA,1,6.00\n",
    "order_reviews_dataset.csv": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,2,,"late, and\nbroken ""box""",2018-02-07 00:00:00,x\nr2,o1,5,,fine,2018-02-06 00:00:00,x\n'
    "r3,o2,4,,,2018-01-02 00:00:00,x\n",
    "products_dataset.csv": "product_id,product_category_name,product_name_lenght,product_description_lenght,"
    "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
    "p1,moveis,10,20,1,500,2,3,4\np2,sem_nome,10,20,,100,2,,4\np3,,10,20,1,100,2,2,2\n",
    "sellers_dataset.csv": "seller_id,seller_zip,seller_city,seller_state\ns1,1,Port,AA\ns2,2,Hill,BB\n",
    "geolocation_dataset.csv": "zip,lat,lng\n1,2,3\n",
    "product_category_name_translation.csv": "product_category_name,product_category_name_english\nmoveis,furniture\n",
}


@pytest.fixture
def raw_dir(tmp_path):
    for name, text in FILES.items():
        prefix = "" if name.startswith("product_category") else "shop_"
        (tmp_path / f"{prefix}{name}").write_text(text)
    return tmp_path


@pytest.fixture
def raw(spark, raw_dir):
    return raw_csv.read_raw(spark, str(raw_dir), prefix="shop_")


def test_all_missing_files_are_named(spark, raw_dir):
    (raw_dir / "shop_orders_dataset.csv").rename(raw_dir / "elsewhere.csv")
    (raw_dir / "shop_sellers_dataset.csv").rename(raw_dir / "elsewhere2.csv")
    with pytest.raises(raw_csv.MissingInputs) as error:
        raw_csv.read_raw(spark, str(raw_dir), prefix="shop_")
    assert error.value.names == ["shop_orders_dataset.csv", "shop_sellers_dataset.csv"]


def test_missing_column_is_named(spark, raw_dir):
    (raw_dir / "shop_sellers_dataset.csv").write_text("seller_id,seller_city\ns1,Port\n")
    with pytest.raises(ValueError, match="seller_state"):
        raw_csv.read_raw(spark, str(raw_dir), prefix="shop_")


def test_files_with_other_column_orders_fail(spark, raw_dir):
    folder = raw_dir / "shop_sellers_dataset.csv"
    folder.unlink()
    folder.mkdir()
    (folder / "a.csv").write_text("seller_id,seller_city,seller_state\ns1,Port,AA\n")
    (folder / "b.csv").write_text("seller_id,seller_state,seller_city\ns2,BB,Hill\n")
    with pytest.raises(Exception, match="header"):
        raw_csv.read_raw(spark, str(raw_dir), prefix="shop_").sellers.collect()


def test_csv_types_quotes_and_missing_tokens(raw):
    assert raw.reviews.count() == 3
    messages = {r["review_id"]: r["review_comment_message"] for r in raw.reviews.collect()}
    assert messages == {"r1": 'late, and\nbroken "box"', "r2": "fine", "r3": None}
    assert rows(raw.customers.where("customer_id = 'k3'").select("customer_state")) == [(None,)]
    assert rows(raw.payments.where("order_id = 'o2'").select("payment_type")) == [(None,)]
    assert rows(raw.order_items.where("order_id = 'o2'").select("freight_value")) == [(None,)]


def test_load_profile(raw):
    profile = {r["table_name"]: tuple(r)[1:] for r in raw_csv.load_profile(raw).collect()}
    assert profile["orders"] == (3, 8, 0) and profile["reviews"] == (3, 5, 0)
    assert profile["geolocation"] == (1, 3, 0) and len(profile) == 9


def test_malformed_records_are_counted_and_kept_apart(spark, raw_dir):
    payments = raw_dir / "shop_order_payments_dataset.csv"
    good = payments.read_text().rstrip("\n")
    header = good.splitlines()[0].split(",")
    values = {"order_id": "x", "payment_type": "boleto", "payment_installments": "1", "payment_value": "2.5"}
    line = lambda **other: ",".join({**values, **other}.get(c, "0") for c in header)
    bad = [line(payment_value="much", payment_installments="?"), line() + ",9,9", line(payment_value=" NaN"), line(payment_value="NA")]
    payments.write_text("\n".join([good, *bad]) + "\n")
    (raw_dir / "shop_sellers_dataset.csv").write_text("seller_id,seller_city,seller_state\ns1,Port,AA\ns2,Hill\n")
    raw = raw_csv.read_raw(spark, str(raw_dir), prefix="shop_")
    before = len(good.splitlines()) - 1
    profile = {r["table_name"]: (r["row_count"], r["malformed"]) for r in raw_csv.load_profile(raw).collect()}
    assert profile["payments"] == (before + 4, 2) and profile["sellers"] == (2, 1) and profile["orders"][1] == 0
    found = {(r["table_name"], r["reason"]): r["record"] for r in raw_csv.quarantine(raw).collect()}
    assert set(found) == {
        ("payments", "not a number: payment_installments, payment_value"), ("payments", "wrong number of fields"),
        ("sellers", "wrong number of fields"),
    }
    assert found["sellers", "wrong number of fields"] == "s2,Hill" and raw_csv.quarantine(raw).count() == 3
    kept = raw.payments.where("order_id = 'x'").collect()
    assert len(kept) == 4 and sum(r["payment_value"] is None for r in kept) == 3


def test_cleaning(raw):
    orders = cleaning.clean_orders(raw.orders)
    found = orders.where("order_id = 'o2'").select("order_approved_at", "order_date_key").first()
    assert found[0] is None and str(found[1]) == "2018-01-01"
    assert orders.count() == 3
    products = {
        r["product_id"]: (r["product_category"], r["product_category_original"], r["product_volume_cm3"])
        for r in cleaning.clean_products(raw.products, raw.category_translation).collect()
    }
    assert products == {
        "p1": ("furniture", "moveis", 24.0),
        "p2": ("unknown", "sem_nome", 0.0),
        "p3": ("unknown", "unknown", 8.0),
    }
    assert sorted(rows(cleaning.clean_reviews(raw.reviews))) == [("o1", 5, 4), ("o2", 4, 0)]
    # A two-way tie goes to the alphabetically first type, no type at all to 'unknown'.
    assert sorted(rows(cleaning.aggregate_payments(raw.payments))) == [
        ("o1", 22.6, 3, "boleto"), ("o2", 6.0, 1, "unknown")
    ]


def test_payment_mode_with_a_winner(spark):
    df = spark.createDataFrame(
        [("o", t, 1, 1.0) for t in ("voucher", "voucher", "boleto", None)],
        "order_id string, payment_type string, payment_installments int, payment_value double",
    )
    assert rows(cleaning.aggregate_payments(df)) == [("o", 4.0, 1, "voucher")]


def test_undated_review_comes_last(spark):
    df = spark.createDataFrame(
        [("r1", "o", 1, None, None), ("r2", "o", 4, "ab", "2018-01-01")],
        "review_id string, order_id string, review_score int, review_comment_message string, "
        "review_creation_date string",
    )
    assert rows(cleaning.clean_reviews(df)) == [("o", 4, 2)]


def test_star_from_csv(raw):
    star = build_star(raw)
    fact = {(r["order_id"], r["order_item_id"]): r for r in star.fact.collect()}
    assert len(fact) == 4
    late = fact["o1", 1]
    assert (late["delivery_days"], late["delivery_delay_days"], late["is_late"]) == (4.0, 1.42, 1)
    assert (late["total_item_value"], late["customer_unique_id"]) == (11.15, "u1")
    assert fact["o1", 3]["total_item_value"] == 0.3
    undated = fact["o2", 1]
    assert (undated["delivery_days"], undated["is_late"], undated["is_delivered"]) == (None, 0, 1)
    people = {r["customer_unique_id"]: r for r in star.customers.collect()}
    # The earliest order decides the address; a person without items has no totals.
    assert people["u1"]["customer_city"] == "Town"
    assert (people["u1"]["total_orders"], people["u1"]["total_spent"]) == (2, 25.3)
    assert str(people["u1"]["first_order_date"]) == "2018-01-01"
    assert (people["u2"]["total_orders"], people["u2"]["total_spent"]) == (None, None)
    sellers = {r["seller_id"]: tuple(r)[3:] for r in star.sellers.collect()}
    assert sellers == {"s1": (3, 25.2, 4.67), "s2": (1, 0.1, 5.0)}
    assert star.dates.count() == 32
    assert {r["check_name"]: r["violations"] for r in check_keys(star).collect()} == dict.fromkeys(
        [
            "fact_orders_unique", "dim_customers_unique", "dim_products_unique",
            "dim_sellers_unique", "dim_date_unique", "fact_customer_known",
            "fact_product_known", "fact_seller_known", "fact_date_known", "order_one_payment_type",
        ],
        0,
    )


def test_key_checks_find_violations(make_star):
    types = [{"order_id": "c", "order_item_id": i, "payment_type": t} for i, t in ((1, "boleto"), (2, "voucher"))]
    star = make_star([{"order_id": "a"}, {"order_id": "a"}, {"order_id": "b", "product_id": "gone"}, *types])
    found = {r["check_name"]: r["violations"] for r in check_keys(star).collect()}
    assert found["fact_orders_unique"] == 1 and found["fact_product_known"] == 1
    assert found["order_one_payment_type"] == 1 and sum(found.values()) == 3


def test_calendar_without_dated_orders(spark, raw):
    from orderlens.plans.star import build_dim_date, clean

    cleaned = clean(raw)
    empty = build_dim_date(
        type(cleaned)(cleaned.orders.where("false"), cleaned.products, cleaned.reviews, cleaned.payments)
    )
    assert empty.count() == 366 + 365 + 365
    saturday = empty.where("date_key = '2016-01-02'").first()
    assert (saturday["day_of_week"], saturday["day_name"], saturday["is_weekend"]) == (5, "Saturday", 1)


@pytest.mark.parametrize("by_month", [True, False])
def test_store_round_trip(spark, raw, tmp_path, by_month):
    star = build_star(raw)
    counts = store.write_star(star, str(tmp_path / "store"), by_month)
    assert counts == {
        "fact_orders": 4, "dim_customers": 2, "dim_products": 3, "dim_sellers": 2, "dim_date": 32
    }
    again = store.read_star(spark, str(tmp_path / "store"))
    assert sorted(map(str, rows(again.fact.select(*star.fact.columns)))) == sorted(
        map(str, rows(star.fact))
    )
    store.write_star(star, str(tmp_path / "store"), by_month)
    assert store.read_star(spark, str(tmp_path / "store")).fact.count() == 4


def test_a_failed_refresh_leaves_the_former_star(spark, raw, tmp_path, monkeypatch):
    where = str(tmp_path / "store")
    star = build_star(raw)
    store.write_star(star, where)
    first = store.current_version(spark, where)
    written = store.write_table

    def fails_at_the_fourth(df, path, partition_by=None):
        rows_written = written(df.limit(1), path, partition_by)
        if path.endswith("dim_sellers"):
            raise store.CountMismatch(path)
        return rows_written

    monkeypatch.setattr(store, "write_table", fails_at_the_fourth)
    with pytest.raises(store.CountMismatch):
        store.write_star(star, where)
    assert store.current_version(spark, where) == first
    assert store.read_star(spark, where).fact.count() == 4
    assert store.read_star(spark, where).customers.count() == 2
    monkeypatch.setattr(store, "write_table", written)
    before = store.read_star(spark, where)
    store.write_star(star, where)
    assert store.current_version(spark, where) > first
    assert store.read_star(spark, where).sellers.count() == 2
    # Readers of the version before are not disturbed by the next one, older versions go.
    store.write_star(star, where)
    assert before.fact.inputFiles()[0].count(first) == 1
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "store").glob("[!.]*")) == ["CURRENT", "version", "version"]


def test_tables_without_a_pointer_are_read(spark, raw, tmp_path):
    for name, df in build_star(raw).tables().items():
        store.write_table(df, f"{tmp_path}/{name}")
    assert store.current_version(spark, str(tmp_path)) is None
    assert store.read_star(spark, str(tmp_path)).fact.count() == 4


def test_stored_star_exports_its_own_columns(spark, raw, tmp_path):
    store.write_star(build_star(raw), f"{tmp_path}/store")
    store.export_star(store.read_star(spark, f"{tmp_path}/store"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv/fact_orders", header=True).columns == list(FACT_COLUMNS)


def test_exports(spark, raw, tmp_path):
    star = build_star(raw)
    store.export_star(star, str(tmp_path / "csv"))
    text = spark.read.csv(str(tmp_path / "csv" / "fact_orders"), header=True)
    assert text.columns == star.fact.columns
    stamp = text.where("order_id = 'o3' or order_id = 'o1'").select("order_purchase_timestamp").first()
    assert stamp[0] == "2018-02-01 10:00:00"
    assert store.read_extracts(spark, str(tmp_path / "extracts")) is None
    store.export_extracts(dash.extracts(star), str(tmp_path / "extracts"))
    extracts = store.read_extracts(spark, str(tmp_path / "extracts"))
    for name, df in dash.extracts(star).items():
        assert rows(extracts[name]) == rows(df)


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([("t", 1.0)], "test string, statistic double")
    store.write_results(df, str(tmp_path / "results"))
    assert rows(spark.read.parquet(str(tmp_path / "results"))) == [("t", 1.0)]


def test_scratch_is_below_the_checkpoint_folder(spark):
    stored = materialize(spark.range(3), "three")
    assert stored.inputFiles()[0].removeprefix("file://").startswith(
        shared_root(spark).removeprefix("file:")
    )
    assert stored.count() == 3


def test_other_read_errors_are_not_hidden(spark):
    with pytest.raises(AnalysisException):
        spark.read.csv("/nowhere/at/all")


def test_the_star_goes_through_compressed_csv(raw):
    """As plain text, the fact of a large star would take several times the disk of its stored table."""
    star = SessionStar(raw)
    for name, table in star.tables().items():
        back = round_trips.star_csv(star, name)
        assert sorted(map(str, rows(back))) == sorted(map(str, rows(iso_text(table))))
        parts = [f for f in os.listdir(f"{star.derived['star_csv']}/{name}".removeprefix("file:")) if f.startswith("part-")]
        assert parts and all(f.endswith(".csv.gz") for f in parts)
