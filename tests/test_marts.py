import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from harborline.plans import marts


def test_revenue_without_nights_and_without_spend(make_bookings, make_spend):
    bookings = make_bookings({"booking_id": "A", "nights": 0}, {"booking_id": "B"})
    got = {r.booking_id: r for r in marts.mart_revenue(bookings, make_spend({"booking_id": "B"})).collect()}
    assert got["A"].revenue_per_night_usd is None and got["A"].total_value_per_night_usd is None
    assert got["A"].total_onboard_spend_usd == 0 and got["A"].dining_spend == 0
    assert got["A"].total_guest_value_usd == Decimal("2000.00")
    assert got["B"].total_guest_value_usd == Decimal("2060.00")
    assert abs(got["B"].total_value_per_night_usd - 2060 / 7) < 1e-9


def test_revenue_fans_out_over_spend_rows_and_keeps_every_booking(make_bookings, make_spend):
    bookings = make_bookings(*[{"booking_id": f"B{i}"} for i in range(20)], {"booking_id": None})
    hot = [{"booking_id": "B0", "dining": Decimal(i)} for i in range(200)]
    spend = make_spend(*hot, {"booking_id": "B1"}, {"booking_id": None}, {"booking_id": "gone"})
    guarded = Counter(marts.mart_revenue(bookings, spend).collect())
    plain = Counter(marts.mart_revenue(bookings, spend, spend_is_unique=True).collect())
    assert guarded == plain
    assert sum(guarded.values()) == 200 + 19 + 1


def test_occupancy_ignores_null_flags_in_both_rates(make_bookings):
    row = marts.mart_occupancy(
        make_bookings(
            {"booking_id": "A"},
            {"booking_id": "B", "is_cancelled": True},
            {"booking_id": "C", "is_cancelled": None},
        )
    ).first()
    assert (row.total_bookings, row.confirmed_bookings, row.cancelled_bookings) == (3, 1, 1)
    assert row.occupancy_rate_pct == row.cancellation_rate_pct == 33.33
    assert row.total_guests == 2 and row.total_revenue_usd == Decimal("2000.00")
    assert (row.sail_month, row.sail_quarter, row.sail_year) == (7, 3, 2024)


def test_rates_of_known_flags_add_up(make_bookings):
    rows = [
        {"booking_id": str(i), "is_cancelled": i % 3 == 0, "ship_name": f"S{i % 4}"} for i in range(40)
    ]
    for r in marts.mart_occupancy(make_bookings(*rows)).collect():
        assert abs(r.occupancy_rate_pct + r.cancellation_rate_pct - 100) <= 0.011


def test_ltv_grain_nulls_and_missing_guest(make_bookings, make_spend, make_guests):
    bookings = make_bookings(
        {"booking_id": "A", "booking_date": dt.date(2024, 1, 1)},
        {"booking_id": "B", "booking_date": dt.date(2024, 1, 31), "is_cancelled": True},
        {"booking_id": "C", "brand": "Regent"},
        {"booking_id": "D", "guest_id": "G2", "is_cancelled": True},
    )
    spend = make_spend({"booking_id": "A"}, {"booking_id": "A"}, {"booking_id": "B"})
    got = {
        (r.guest_id, r.brand): r
        for r in marts.mart_guest_ltv(bookings, spend, make_guests({})).collect()
    }
    assert set(got) == {("G1", "Norwegian"), ("G1", "Regent"), ("G2", "Norwegian")}
    first = got["G1", "Norwegian"]
    # booking A counts twice, once per spend row
    assert (first.total_bookings, first.completed_voyages, first.cancelled_bookings) == (3, 2, 1)
    assert first.customer_tenure_days == 30
    assert first.total_cabin_revenue == 4000 and first.total_onboard_spend == 180
    assert first.total_lifetime_value == 4180 and first.first_name == "Ann"
    only_cancelled = got["G2", "Norwegian"]
    assert only_cancelled.avg_cabin_price is None and only_cancelled.total_lifetime_value == 0
    assert only_cancelled.ltv_segment == "Bronze" and only_cancelled.first_name is None


def test_ltv_segment_bounds_are_inclusive(make_bookings, make_spend, make_guests):
    values = ["4999.99", "5000.00", "20000.00", "50000.00"]
    bookings = make_bookings(
        *[
            {"booking_id": f"B{i}", "guest_id": f"G{i}", "total_revenue_usd": Decimal(v)}
            for i, v in enumerate(values)
        ]
    )
    got = marts.mart_guest_ltv(bookings, make_spend().limit(0), make_guests()).orderBy("guest_id")
    assert [r.ltv_segment for r in got.collect()] == ["Bronze", "Silver", "Gold", "Platinum"]


def test_pricing_positions(make_bookings, make_pricing):
    bookings = make_bookings(
        {"booking_id": "A", "cabin_category": "exact", "cabin_price_usd": Decimal("105.00")},
        {"booking_id": "B", "cabin_category": "low", "cabin_price_usd": Decimal("95.00")},
        {"booking_id": "C", "cabin_category": "above", "cabin_price_usd": Decimal("105.01")},
        {"booking_id": "D", "cabin_category": "below", "cabin_price_usd": Decimal("94.99")},
        {"booking_id": "E", "cabin_category": "lost", "is_cancelled": True},
    )
    cabins = ["exact", "low", "above", "below", "lost", "unseen"]
    pricing = make_pricing(
        *[{"price_log_id": c, "cabin_category": c, "price_usd": Decimal("100.00")} for c in cabins],
        {"price_log_id": "free", "cabin_category": "above", "price_usd": Decimal("0.00")},
    )
    rows = marts.mart_pricing_summary(pricing, bookings).collect()
    got = {(r.cabin_category, float(r.listed_price_usd)): r for r in rows}
    position = {k[0]: r.price_position for k, r in got.items() if k[1] == 100}
    assert position == {
        "exact": "At List",
        "low": "At List",
        "above": "Above List",
        "below": "Below List",
        "lost": "At List",
        "unseen": "At List",
    }
    assert got["above", 100.0].price_variance_pct == 5.01
    assert got["above", 0.0].price_variance_pct is None
    assert got["unseen", 100.0].avg_booked_price_usd is None
    assert got["above", 100.0].sail_month == dt.date(2024, 7, 1)


def test_pricing_with_one_hot_sailing_keeps_every_row(make_bookings, make_pricing):
    rows = [{"price_log_id": f"H{i}"} for i in range(300)]
    rows += [{"price_log_id": f"C{i}", "cabin_category": f"c{i}"} for i in range(50)]
    got = marts.mart_pricing_summary(make_pricing(*rows), make_bookings({}))
    assert got.count() == 350
    assert got.where(F.col("avg_booked_price_usd").isNotNull()).count() == 300
