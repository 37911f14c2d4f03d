"""Calendar expressions: month and quarter ends, labels, horizons and as-of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(day: Column) -> Column:
    return F.last_day(day)


def quarter_end(day: Column) -> Column:
    """The last day of the quarter that holds the day."""
    return F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1)))


def quarter_label(day: Column) -> Column:
    """'YYYYQn'."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def short_label(label: Column) -> Column:
    """'YYQn' from 'YYYYQn'."""
    return F.substring(label, 3, 4)


def parse_quarter(label: Column, strict: bool = True) -> Column:
    """The quarter end of 'YYYYQn', in either case and with any spaces. Others raise, or are null if not strict."""
    clean = F.upper(F.replace(label, F.lit(" "), F.lit("")))
    ok = clean.rlike(r"^\d{4}Q[1-4]$")
    bad = F.raise_error(F.concat(F.lit("not a quarter label: "), label)).cast("date") if strict else F.lit(None).cast("date")
    end = F.last_day(F.make_date(F.substring(clean, 1, 4).cast("int"), F.substring(clean, 6, 1).cast("int") * 3, F.lit(1)))
    return F.when(label.isNull(), F.lit(None).cast("date")).when(ok, end).otherwise(bad)


def quarter_index(day: Column) -> Column:
    """Quarters since year 0; differences are quarters between."""
    return F.year(day) * 4 + F.quarter(day)


def year_month(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def as_of_day(text: Column, day: int = 15) -> Column:
    """A date from text: 'YYYY-MM' is that month's `day`, anything else is read as a date."""
    clean = F.trim(text)
    month = F.split(clean, "-")
    made = F.make_date(month[0].cast("int"), month[1].cast("int"), F.lit(day))
    return F.when(clean.rlike(r"^\d{4}-\d{1,2}$"), made).otherwise(F.to_date(clean))


def as_of_first(text: Column) -> Column:
    """The other reading of a bare month: its first day."""
    return as_of_day(text, 1)


def horizon(as_of: Column, target_end: Column) -> Column:
    """Months from the target quarter's first month to as_of, plus one."""
    first = F.add_months(target_end, -2)
    return (F.year(as_of) * 12 + F.month(as_of)) - (F.year(first) * 12 + F.month(first)) + 1


def last_complete_month(as_of: Column) -> Column:
    """The month end at or before as_of."""
    return F.when(as_of == F.last_day(as_of), as_of).otherwise(F.last_day(F.add_months(as_of, -1)))
