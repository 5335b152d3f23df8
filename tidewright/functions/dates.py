"""Date and duration functions. Days are inclusive and integral; "today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import once

# A month is 365.25 / 12 days, kept as integers so that thresholds are exact.
MONTH_NUM, MONTH_DEN = 36525, 1200


def inclusive_days(start: Column, end: Column) -> Column:
    """Days from start to end, both counted; 0 if reversed; null if either is null."""
    return F.greatest(F.date_diff(end, start) + 1, F.lit(0))


def ceil_threshold(months: Column, num: int = 1, den: int = 1) -> Column:
    """Smallest whole number of days that is at least num/den of so many months."""
    d = MONTH_DEN * den
    return F.floor((months.cast("long") * (MONTH_NUM * num) + (d - 1)) / F.lit(d)).cast("long")


def normalise_digits(text: Column) -> Column:
    """Kannada and Devanagari digits as ASCII ones; the length stays."""
    return F.translate(text, "೦೧೨೩೪೫೬೭೮೯०१२३४५६७८९", "01234567890123456789")


def pivot_year(year: Column, today: Column) -> Column:
    """A two-digit year becomes the latest year that isn't after today's; others stay."""
    return F.when(year >= 100, year).when(year + 2000 <= F.year(today), year + 2000).otherwise(year + 1900)


def parse_numeric_date(text: Column, today: Column) -> Column:
    """struct(value, confidence, alternative) of the first d/m/y in the text: day first, month first where that fails.

    Both readings possible and different: confidence 0.75 and the other reading as alternative. A future date is
    capped at 0.3. No date gives null fields.
    """
    digits = normalise_digits(text)
    parts = [F.nullif(F.regexp_extract(digits, r"(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?!\d)", k), F.lit("")).cast("int").alias(n) for k, n in enumerate("aby", 1)]

    def date(year: Column, month: Column, day: Column) -> Column:
        """Null, without an error that has to be caught, where there is no such day."""
        last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
        return F.when(month.between(1, 12) & (day >= 1), F.when(day <= last, F.make_date(year, month, day)))

    def read(d: Column) -> Column:
        dmy, mdy, value = d["dmy"], d["mdy"], F.coalesce(d["dmy"], d["mdy"])
        sure = F.when(dmy.isNull(), 0.70).when(mdy.isNotNull() & (mdy != dmy), 0.75).otherwise(0.95) - F.when(d["y"] < 100, 0.10).otherwise(0.0)
        sure = F.when(value > today, F.least(sure, F.lit(0.3))).otherwise(sure)
        return F.when(d["y"].isNotNull() & value.isNotNull(), F.struct(value.alias("value"), F.round(sure, 2).alias("confidence"), F.when(mdy != dmy, mdy).alias("alternative")))

    both = lambda p, year: F.struct(date(year, p["b"], p["a"]).alias("dmy"), date(year, p["a"], p["b"]).alias("mdy"), p["y"].alias("y"))
    return once(F.struct(*parts), lambda p: once(both(p, pivot_year(p["y"], today)), read))


def age_in_years(born: Column, on: Column) -> Column:
    return F.floor(F.date_diff(on, born) / 365.25).cast("int")
