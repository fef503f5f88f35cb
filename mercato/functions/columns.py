"""Column helpers: rounding, rates, export parsing, calendar arithmetic.

All are plain ``Column`` expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"

# Reported customer and channel prefixes.
SUBSCRIPTION_PREFIX = "subscription"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers ---------------------------------------------------------------


def round_away(x: Column, digits: int) -> Column:
    """Round a double half away from zero.

    Spark's ``round`` goes through the shortest decimal text of the double, so
    ``round(1.005, 2)`` is 1.01; scaling and flooring gives 1.0, as the
    database this replaces does.
    """
    scale = float(10**digits)
    x = x.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / F.lit(scale)


def ratio(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` as a rounded double; NULL when ``den`` is zero."""
    return round_away(F.try_divide(num.cast("double"), den.cast("double")), digits)


def percent(num: Column, den: Column, digits: int = 1) -> Column:
    """``100 * num / den``, rounded; NULL when ``den`` is zero."""
    return round_away(F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double")), digits)


def whole_quotient(num: Column, den: Column) -> Column:
    """``num div den`` for whole numbers of at least zero, exact beyond a double's digits."""
    return F.call_function("div", num, den)


def cents(money: Column | str) -> Column:
    """A decimal(12,2) amount as a whole number of cents."""
    return (col(money) * 100).cast("bigint")


def dollars(amount_cents: Column) -> Column:
    return amount_cents.cast("double") / F.lit(100.0)


def hundredths_rounded(hundredths: Column) -> Column:
    """Whole number of hundredths of a cent, rounded to cents, as dollars."""
    whole = whole_quotient(F.abs(hundredths) + 50, F.lit(100))
    return dollars(F.signum(hundredths.cast("double")) * whole)


def money(total: Column | str) -> Column:
    """A money sum for output. The sum itself is exact (decimal)."""
    return col(total).cast("double")


def times(condition: Column) -> Column:
    """Number of rows where ``condition`` holds, as a bigint."""
    return F.count_if(condition).cast("bigint")


# --- calendar --------------------------------------------------------------


def month_of(ts: Column | str) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def week_of(ts: Column | str) -> Column:
    """The Monday that starts the week."""
    return F.trunc(F.to_date(col(ts)), "week")


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end`` (23:00 to 01:00 is one day)."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")


def months_between_starts(start: Column, end: Column) -> Column:
    """Month boundaries crossed (31 January to 1 February is one month)."""
    years = F.year(end) - F.year(start)
    return (years * 12 + F.month(end) - F.month(start)).cast("bigint")


# --- export text -----------------------------------------------------------


# Fixed value: the form of an export's date and time.
TIMESTAMP_FORM = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"


def export_timestamp(text: Column | str) -> Column:
    """Wall-clock time of ``2026-07-04 13:52:26 -0400``; the offset is dropped.

    Text that is not a date and time gives NULL. The time never passes through
    the session time zone, whose clock changes would shift it.
    """
    clock = F.substring(col(text), 1, 19)
    return F.when(clock.rlike(TIMESTAMP_FORM), clock.try_cast("timestamp_ntz"))


def clock_text(ts: Column | str) -> Column:
    """A zoneless timestamp as ``2026-07-04 13:52:26``."""
    return F.substring(col(ts).cast("string"), 1, 19)


def without_apostrophe(text: Column | str) -> Column:
    """Exports guard ids, zips and phones with one leading apostrophe."""
    return F.regexp_replace(col(text), "^'", "")


def export_money(text: Column | str) -> Column:
    return col(text).try_cast(MONEY)


def export_int(text: Column | str) -> Column:
    """``'12.6'`` is 13: fractions are rounded half away from zero."""
    return _rounded(col(text)).try_cast("int")


def export_bigint(text: Column | str) -> Column:
    """Whole-number text keeps all its digits; fractions are rounded."""
    c = col(text)
    return F.coalesce(c.try_cast("bigint"), _rounded(c).try_cast("bigint"))


def _rounded(text: Column) -> Column:
    return F.round(text.try_cast("decimal(38,6)"), 0)


def says(text: Column | str, word: str) -> Column:
    """Case-sensitive flag; NULL stays NULL, any other text is false."""
    return col(text) == F.lit(word)


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(col(text), F.lit(""))
