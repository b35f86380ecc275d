import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from harborline.plans import marts
from harborline.plans.increments import MartStates, add_state
from harborline.plans.warehouse import RawTables, Warehouse
from harborline.sources import sinks
from harborline.sources.versions import read_version, versions, write_version
from harborline.streaming.decisions import log_deliveries


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_keep_the_old_version_until_the_new_one_is_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_version(spark, path) is None
    write_version(spark.range(3), path)
    begun = read_version(spark, path)
    broken = spark.range(9).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_version(broken, path)
    assert _ids(read_version(spark, path)) == [0, 1, 2]
    write_version(read_version(spark, path).unionByName(spark.range(5, 7)), path)
    assert _ids(begun) == [0, 1, 2]
    assert _ids(read_version(spark, path)) == [0, 1, 2, 5, 6]
    for _ in range(3):
        write_version(spark.range(1), path)
    assert [v.number for v in versions(spark, path)] == [3, 4]
    assert len(list((tmp_path / "t").glob("v*"))) == 2  # older ones and the broken one are gone


def test_a_batch_is_written_once_and_empty_rows_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_version(spark.range(0), path, batch=3)
    assert read_version(spark, path).columns == ["id"] and _ids(read_version(spark, path)) == []
    assert not write_version(spark.range(2), path, batch=3)
    assert not write_version(spark.range(2), path, batch=2)
    assert write_version(spark.range(1), path)  # a write without a number keeps the last one
    assert not write_version(spark.range(2), path, batch=3)
    assert write_version(spark.range(2), path, batch=4)
    assert _ids(read_version(spark, path)) == [0, 1]


def test_index_update_replaces_adds_and_removes(spark, tmp_path):
    path = str(tmp_path / "index")

    def docs(*pairs):
        empty = [F.lit(None).cast("string").alias(c) for c in sinks.INDEX_METADATA]
        return spark.createDataFrame(list(pairs), "doc_id string, text string").select("*", *empty)

    def rows():
        return {r.doc_id: r.text for r in sinks.read_index(spark, path).collect()}

    with pytest.raises(FileNotFoundError):
        rows()
    assert sinks.update_index(docs(("a", "1"), ("b", "1"), ("c", "1")), path)
    begun = sinks.read_index(spark, path)
    gone = spark.createDataFrame([("c",), ("x",)], "doc_id string")
    assert sinks.update_index(docs(("b", "2"), ("d", "2")), path, gone, batch=0)
    assert rows() == {"a": "1", "b": "2", "d": "2"}
    assert {r.doc_id for r in begun.collect()} == {"a", "b", "c"}
    assert not sinks.update_index(docs(("a", "9")), path, batch=0)
    assert rows()["a"] == "1"


def _booked(i):
    return {
        "booking_id": None if i == 40 else f"B{i}",
        "guest_id": None if i % 11 == 0 else f"G{i % 5}",
        "brand": ["Norwegian", "Oceania"][i % 2],
        "sail_date": None if i % 13 == 0 else dt.date(2024, 1 + i % 3, 5),
        "booking_date": None if i % 7 == 0 else dt.date(2023, 1, 1 + i % 28),
        "is_cancelled": [False, True, None][i % 3],
        "num_guests": None if i % 6 == 0 else i,
        "cabin_price_usd": None if i % 4 == 0 else Decimal(i),
        "booking_window_days": None if i % 5 == 0 else i,
    }


def test_deliveries_add_up_to_the_marts(spark, tmp_path, make_bookings, make_spend, make_guests, make_pricing):
    whole = [_booked(i) for i in range(90)]
    spend = make_spend(
        *[{"booking_id": f"B{i}", "total_onboard_spend_usd": Decimal(i)} for i in range(0, 90, 3)] * 2,
        {"booking_id": "gone"},
    )
    guests, pricing = make_guests(*[{"guest_id": f"G{i}"} for i in range(4)]), make_pricing({}, {"brand": "Oceania"})
    states = MartStates(spark, str(tmp_path / "states"))
    with pytest.raises(FileNotFoundError):
        states.occupancy()
    for batch, part in enumerate([whole[:40], [], whole[40:]]):
        for _ in range(2):  # every delivery is given twice
            states.add(make_bookings(*part), spend, batch)
    bookings = make_bookings(*whole)
    for got, want in [
        (states.occupancy(), marts.mart_occupancy(bookings)),
        (states.guest_ltv(guests), marts.mart_guest_ltv(bookings, spend, guests)),
        (states.pricing_summary(pricing), marts.mart_pricing_summary(pricing, bookings)),
    ]:
        assert got.dtypes == want.dtypes
        assert Counter(got.collect()) == Counter(want.collect())


def test_a_delivery_that_failed_half_way_is_completed(spark, tmp_path, make_bookings, make_spend):
    states = MartStates(spark, str(tmp_path / "states"))
    bookings, spend = make_bookings({"booking_id": "A"}, {"booking_id": "B"}), make_spend()
    state = marts.occupancy_state(bookings)
    add_state(state, f"{states.folder}/occupancy", marts.OCCUPANCY_KEYS, 0)  # the first mart had it
    states.add(bookings, spend, 0)
    assert states.occupancy().first().total_bookings == 2
    assert states.guest_ltv(spark.createDataFrame([], "guest_id string, first_name string, last_name string, "
        "country string, age_group string, loyalty_tier string")).first().total_bookings == 2  # fmt: skip


def test_an_append_done_again_replaces_its_first_try(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.range(2).write.parquet(log)  # files of a log from before
    sinks.append_log(spark.range(10, 12), log)
    for _ in range(3):
        sinks.append_log(spark.range(20, 22), log, "a")
    sinks.append_log(spark.range(30, 31), log, "b")
    assert _ids(sinks.read_log(spark, log)) == [0, 1, 10, 11, 20, 21, 30]


def test_bookings_arriving_as_a_stream(spark, tmp_path, make_bookings):
    inbox, state, offsets = (str(tmp_path / n) for n in ("inbox", "state", "offsets"))
    whole = [_booked(i) for i in range(30)]

    def arrive(rows):
        bookings = make_bookings(*rows)
        bookings.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(bookings.schema).parquet(inbox)
        log_deliveries(stream, state, offsets).awaitTermination(120)
        return Counter(marts.occupancy_of(read_version(spark, state)).collect())

    for some in (whole[:13], whole[13:]):
        got = arrive(some)
    assert got == Counter(marts.mart_occupancy(make_bookings(*whole)).collect())
    (tmp_path / "offsets" / "commits" / "1").unlink()
    (tmp_path / "offsets" / "commits" / ".1.crc").unlink(missing_ok=True)
    again = arrive([_booked(99)])  # batch 1 runs again, then the new booking
    assert again == Counter(marts.mart_occupancy(make_bookings(*whole, _booked(99))).collect())


def test_saved_tables_are_joined_without_a_shuffle(
    spark, make_bookings, make_spend, make_guests, make_pricing
):
    bookings = make_bookings(*[{"booking_id": f"B{i}", "guest_id": f"G{i % 7}"} for i in range(60)])
    spend = make_spend(*[{"booking_id": f"B{i}"} for i in range(0, 60, 2)])
    raw = RawTables(bookings, make_guests(*[{"guest_id": f"G{i}"} for i in range(6)]), spend, make_pricing())
    plain = Warehouse(raw, spend_is_unique=True)
    plain.saved("saved_views", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = plain.from_saved(spark, "saved_views")
        for name in ("mart_revenue", "mart_guest_ltv"):
            df = getattr(kept, name)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan
            assert Counter(df.collect()) == Counter(getattr(plain, name).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP SCHEMA saved_views CASCADE")
