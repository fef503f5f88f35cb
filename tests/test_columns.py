import datetime as dt

import pytest
from pyspark.sql import functions as F

from mercato.functions.columns import (
    cents,
    clock_text,
    days_between,
    export_bigint,
    export_int,
    export_money,
    export_timestamp,
    hundredths_rounded,
    months_between_starts,
    percent,
    round_away,
    says,
    week_of,
    without_apostrophe,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-07-04 13:52:26 -0400", dt.datetime(2026, 7, 4, 13, 52, 26)),
        ("2026-7-4 3:52:26", dt.datetime(2026, 7, 4, 3, 52, 26)),
        ("2026-02-30 13:52:26", None),
        ("2026-07-04 13:52", None),
        ("", None),
        (None, None),
    ],
)
def test_export_timestamp(spark, text, expected):
    assert one(spark, export_timestamp(F.lit(text).cast("string"))) == expected


def test_wall_clock_ignores_the_session_zone(spark):
    """02:30 on the day clocks go forward does not exist in New York."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        parsed = export_timestamp(F.lit("2026-03-08 02:30:00 -0500"))
        assert one(spark, parsed) == dt.datetime(2026, 3, 8, 2, 30)
        assert one(spark, clock_text(parsed)) == "2026-03-08 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12), (" 12 ", 12), ("12.6", 13), ("-12.5", -13), ("1e2", 100), ("1,200.00", None),
     ("", None), (None, None), ("99999999999", None)],
)
def test_export_int(spark, text, expected):
    assert one(spark, export_int(F.lit(text).cast("string"))) == expected


def test_export_bigint_keeps_all_digits(spark):
    assert one(spark, export_bigint(F.lit("9007199254740993"))) == 9007199254740993


def test_money_out_of_range_is_null(spark):
    assert one(spark, export_money(F.lit("99999999999.00"))) is None
    assert float(one(spark, export_money(F.lit("9999999999.99")))) == 9999999999.99


def test_one_apostrophe_is_stripped(spark):
    assert one(spark, without_apostrophe(F.lit("'11201"))) == "11201"
    assert one(spark, without_apostrophe(F.lit("''11201"))) == "'11201"


def test_flags(spark):
    assert one(spark, says(F.lit("yes"), "yes")) is True
    assert one(spark, says(F.lit("Yes"), "yes")) is False
    assert one(spark, says(F.lit(None).cast("string"), "yes")) is None


@pytest.mark.parametrize("x, digits, expected", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.25, 1, 0.3)])
def test_round_away(spark, x, digits, expected):
    assert one(spark, round_away(F.lit(x), digits)) == expected


def test_percent_of_nothing_is_null(spark):
    assert one(spark, percent(F.lit(1), F.lit(0))) is None


def test_days_are_midnights_crossed(spark):
    days = days_between(ntz("2026-01-01 23:00:00"), ntz("2026-01-02 01:00:00"))
    assert one(spark, days) == 1


def test_months_are_boundaries_crossed(spark):
    months = months_between_starts(F.lit(dt.date(2026, 1, 31)), F.lit(dt.date(2026, 2, 1)))
    assert one(spark, months) == 1


def test_week_starts_on_monday(spark):
    assert one(spark, week_of(ntz("2026-07-05 10:00:00"))) == dt.date(2026, 6, 29)


def test_cents_and_back(spark):
    assert one(spark, cents(F.lit("1.10").cast("decimal(12,2)"))) == 110
    assert one(spark, hundredths_rounded(F.lit(16750))) == 1.68
    assert one(spark, hundredths_rounded(F.lit(-16750))) == -1.68
