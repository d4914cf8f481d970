"""What the plans of fleet queries must and must not hold."""

import pytest

from axleyard.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
#: Read files, or scan the odometers of a mixed folder in order.
FILES = {"ingest_mixed_folder", "ingest_mixed_telematics", "ingest_mixed_fuel", "ingest_mixed_assets", "ingest_mixed_pending", "ingest_mixed_rejects", "read_raw_files", "read_oem_csv", "export_daily_csv", "stream_ingest", "stream_running_odometer"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - FILES - {"pooled_fit", "compare_models"}))
def test_no_products_and_no_python(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "Python" not in text and "InPandas" not in text and "InArrow" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.queries()["date_window_filter"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text.split("PushedFilters")[1]
    assert "props" not in text


def test_windows_of_an_asset_share_one_exchange(spark):
    from axleyard.operators.intervals import intervals_with_odometers
    from axleyard.plans.fixtures import Fleet

    f = Fleet(spark, SF)
    fills = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id vehicle_id", "cast(ts as date) purchase_date", "value litres", "value cost_nzd")
    tel = fills.selectExpr("vehicle_id asset_id", "purchase_date record_date", "litres odometer_km")
    text = plan(intervals_with_odometers(fills, tel))
    assert text.count("Exchange hashpartitioning(asset_id") <= 1 and f is not None


def test_intervals_exchange_reports_once_and_no_days(spark):
    from axleyard.operators import intervals as I
    from axleyard.plans.fixtures import Fleet

    f = Fleet(spark, SF)
    fills = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id vehicle_id", "cast(ts as date) purchase_date", "value litres", "value cost_nzd")
    tel = fills.selectExpr("vehicle_id asset_id", "purchase_date record_date", "litres odometer_km", "cost_nzd idle_hours")
    text = plan(I.merge_orphaned_litres(I.evaluate_intervals(fills, tel, f.holidays)))
    assert "Generate" not in text and "Join" not in text
    # fills are numbered by vehicle before they meet the reports
    assert text.count("Exchange hashpartitioning(") <= 2


def test_card_files_meet_one_exchange_and_one_detection(spark):
    text = plan(registry.queries()["rows_to_record"](spark, SF))
    assert text.count("Exchange ") == 1
    assert text.count("array_except([Transaction Date") == 1


def test_ingest_steps_are_columns(spark):
    """What an ingest stores of each row is read back by column."""
    text = plan(registry.queries()["ingest_mixed_rejects"](spark, SF))
    assert "ReadSchema: struct<import_id:bigint,reject_reason:string>" in text and "ExistingRDD" not in text


def test_card_matching_reads_one_exchange_of_the_rows(spark):
    text = plan(registry.queries()["clean_bp"](spark, SF))
    rows = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "l_suppkey" in line]
    assert rows and all("REPARTITION_BY_NUM" in line for line in rows)


def test_stub_assets_make_no_map_of_each_row(spark):
    text = plan(registry.queries()["new_stub_assets"](spark, SF))
    assert " AS rec#" not in text and "slice(concat" not in text


def test_files_are_made_by_more_tasks_of_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    f = fixtures.Fleet(spark, SF)
    rows = f.table("lineitem").count()
    assert f._tasks("lineitem") == -(-rows // 500) > f._tasks("supplier")
    assert f.card_rows.rdd.getNumPartitions() == f._tasks("lineitem")


def test_a_folder_deals_card_rows_once(spark):
    """Files of all three card formats are made in one pass over the rows, by compiled code."""
    from axleyard.plans import ingest

    text = plan(ingest._folder(fixtures.Fleet(spark, SF))[0])
    assert text.count("lineitem.parquet") == 1 and "collect_list(struct(n, concat_ws" not in text


def test_fuel_of_an_ingest_is_read_by_column(spark):
    assert "ExistingRDD" not in plan(registry.queries()["ingest_mixed_fuel"](spark, SF))


@pytest.mark.parametrize("name", ["rows_to_record", "read_mobil"])
def test_typed_rows_make_no_map(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "map_from_arrays" not in text and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
