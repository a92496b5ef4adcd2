"""Dates kept as ISO strings: lenient parsing helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """Date from the first ten characters, null when they are not a date."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-M-d")


def days_before(text: Column, reference: Column) -> Column:
    return F.datediff(reference, iso_date(text))


def year_of(text: Column) -> Column:
    """Year of an ISO date, else the first four characters as a number, else null."""
    return F.coalesce(F.year(iso_date(text)), F.substring(text, 1, 4).try_cast("int"))


def month_start_before(reference: Column, months: int) -> Column:
    """ISO string of the first day of the month ``months`` before ``reference``."""
    return F.date_format(F.trunc(F.add_months(reference, -months), "month"), "yyyy-MM-dd")
