"""Tenor labels, delivery periods and calendar arithmetic as Column expressions.

Month tenors are written Jan_26, quarters Q1_26, half-years SS_26 (April to
September) and WS_26 (October to March of the next year), years Y_26.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Month names in order (fixed values of the labels).
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Periods: first month, number of months.
PERIODS = {"Q1": (1, 3), "Q2": (4, 3), "Q3": (7, 3), "Q4": (10, 3), "SS": (4, 6), "WS": (10, 6), "Y": (1, 12)}
#: Delivery month codes of futures, January to December (fixed values of the market).
MONTH_CODES = "FGHJKMNQUVXZ"
#: Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy_MM_dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yy", "yyyy-MMM-dd", "dd-MMM-yyyy", "dd-MM-yy", "yyyy-MM-dd '00:00'", "yyyy-MM-dd '00:00:00'", "yyyy-MM-dd'T00:00:00'", "dd MMM yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MMM-yyyy")
DATETIME_FORMATS = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS")


def years_between(start: Column, end: Column) -> Column:
    """Days between dates over 365."""
    return F.datediff(end, start) / 365


def month_number(name: Column) -> Column:
    """1 to 12 for a three-letter month name, null otherwise."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.when(at > 0, at).cast("int")


def month_name(number: Column) -> Column:
    """The three-letter name of a month number, null outside 1 to 12."""
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), number - 1)


def is_month(tenor: Column) -> Column:
    return F.coalesce(F.substring(tenor, 1, 3).isin(*MONTHS), F.lit(False))


def tenor_period(tenor: Column) -> Column:
    """What stands before the year: a month name or a period."""
    return F.split_part(tenor, F.lit("_"), F.lit(1))


def tenor_year(tenor: Column) -> Column:
    """The two-digit year as a number; null if it isn't one."""
    return F.split_part(tenor, F.lit("_"), F.lit(2)).try_cast("int")


def tenor_date(tenor: Column) -> Column:
    """First day of a month tenor; null for other labels."""
    return F.when(is_month(tenor), F.make_date(2000 + tenor_year(tenor), month_number(tenor_period(tenor)), F.lit(1)))


def tenor_label(day: Column) -> Column:
    """The month tenor of a date."""
    return F.concat(month_name(F.month(day)), F.lit("_"), F.date_format(day, "yy"))


def parse_month(text: Column) -> Column:
    """First day of a month written like Jan-26."""
    return F.make_date(2000 + F.split_part(text, F.lit("-"), F.lit(2)).try_cast("int"), month_number(F.split_part(text, F.lit("-"), F.lit(1))), F.lit(1))


def valid_tenor(tenor: Column) -> Column:
    return F.coalesce(tenor.rlike(r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Q[1-4]|SS|WS|Y)_\d\d$"), F.lit(False))


def period_table(spark: SparkSession) -> DataFrame:
    """(period, k, month, year_shift): the months of each period, months being their own."""
    rows = [(m, 0, i, 0) for i, m in enumerate(MONTHS, 1)]
    for p, (first, n) in PERIODS.items():
        rows += [(p, k, (first - 1 + k) % 12 + 1, (first - 1 + k) // 12) for k in range(n)]
    return spark.createDataFrame(rows, "period string, k int, month int, year_shift int")


def monthly_strip(tenors: DataFrame, tenor: str = "tenor") -> DataFrame:
    """tenors with a row for each month: columns k (place in the period) and month_start. Unknown labels give no row."""
    periods = F.broadcast(period_table(tenors.sparkSession))
    joined = tenors.where(valid_tenor(F.col(tenor))).join(periods, tenor_period(F.col(tenor)) == F.col("period"))
    start = F.make_date(2000 + tenor_year(F.col(tenor)) + F.col("year_shift"), F.col("month"), F.lit(1))
    return joined.withColumn("month_start", start).drop("period", "month", "year_shift")


def relative_start(day: Column, k: Column, shift_days: int = 5) -> Column:
    """First day of the k-th month after the pricing date, which rolls shift_days before month end."""
    return F.add_months(F.trunc(F.date_add(day, shift_days), "MM"), k)


def relative_times(day: Column, k: Column, shift_days: int = 5) -> Column:
    """Struct of years to the start of the k-th relative month and its length in years."""
    start = relative_start(day, k, shift_days)
    return F.struct(years_between(day, start).alias("start"), years_between(start, F.add_months(start, 1)).alias("length"))


def contract_label(day: Column, k: Column, roll_days: int = 0) -> Column:
    """Month tenor of the k-th contract as seen on a date, k=1 the next month."""
    return tenor_label(F.add_months(F.trunc(F.date_add(day, roll_days), "MM"), k))


def contract_code(day: Column) -> Column:
    """Futures code of a month: its letter and the last digit of the year."""
    return F.concat(F.substring(F.lit(MONTH_CODES), F.month(day), F.lit(1)), F.substring(F.year(day).cast("string"), -1, 1))


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits, after a weekday's name if there is one; whole numbers are spreadsheet serials; null if none fits."""
    text = F.regexp_replace(F.trim(text), r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ", "")
    serial = F.when(text.rlike(r"^\d{5}$"), from_serial(text.try_cast("int")))
    return F.coalesce(serial, *[F.try_to_date(text, f) for f in formats])


def parse_datetime(text: Column, formats: tuple[str, ...] = DATETIME_FORMATS) -> Column:
    text = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def from_serial(serial: Column) -> Column:
    """Date of a spreadsheet serial (29221 is 1980-01-01)."""
    return F.date_add(F.lit("1980-01-01").cast("date"), (serial - 29221).cast("int"))


def to_serial(stamp: Column) -> Column:
    """Spreadsheet serial of a timestamp, with the time of day as a fraction."""
    return F.unix_micros(stamp.cast("timestamp")) / 86_400_000_000 + 25569


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def previous_weekday(day: Column) -> Column:
    """The last weekday before a date."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def next_weekday(day: Column) -> Column:
    """The first weekday after a date."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def this_or_next_weekday(day: Column) -> Column:
    return F.when(is_weekday(day), day).otherwise(next_weekday(day))


def this_or_previous_weekday(day: Column) -> Column:
    return F.when(is_weekday(day), day).otherwise(previous_weekday(day))


def _weekday_index(day: Column) -> Column:
    """Weekdays since Monday 1970-01-05, up to and with the date."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    week = F.floor(n / 7)
    return week * 5 + F.least(n - week * 7 + 1, F.lit(5))


def workdays(start: Column, end: Column) -> Column:
    """Weekdays from start to end, both counted, in closed form; 0 if end is before start."""
    return F.when(end < start, 0).otherwise(_weekday_index(end) - _weekday_index(F.date_sub(start, 1))).cast("long")


def add_workdays(day: Column, n: int) -> Column:
    """The date n weekdays later (weekends count as the Friday before)."""
    at = F.weekday(day)
    base = F.when(at > 4, F.date_sub(day, at - 4)).otherwise(day)
    k = F.least(at, F.lit(4)) + n
    return F.date_add(F.date_sub(base, F.least(at, F.lit(4))), (F.floor(k / 5) * 7 + F.pmod(k, F.lit(5))).cast("int"))


def nth_of_next_month(day: Column, n: Column) -> Column:
    return nth_of_month_ahead(day, n, F.lit(1))


def nth_of_month_ahead(day: Column, n: Column, months: Column) -> Column:
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), (n - 1).cast("int"))


def date_with_overflow(year: Column, month: Column, day: Column) -> Column:
    """A date whose month may lie beyond 12."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (month - 1).cast("int")), (day - 1).cast("int"))


def last_sunday(day: Column) -> Column:
    """Last Sunday of the date's month."""
    return F.next_day(F.date_sub(F.last_day(day), 7), "SUN")


def dst_start(year: Column) -> Column:
    return last_sunday(F.make_date(year, F.lit(3), F.lit(1)))


def dst_end(year: Column) -> Column:
    return last_sunday(F.make_date(year, F.lit(10), F.lit(1)))


def is_dst_start(day: Column) -> Column:
    return day == dst_start(F.year(day))


def is_dst_end(day: Column) -> Column:
    return day == dst_end(F.year(day))


def midnight(day: Column) -> Column:
    """The timestamp at which a date begins; a timestamp keeps its time."""
    return day.cast("timestamp")


def month_from_code(day: Column, code: Column) -> Column:
    """The day of the month that a code like M3 counts from a date; the last of a shorter month."""
    return F.add_months(day, F.regexp_extract(code, r"^M(\d+)$", 1).try_cast("int"))


def months_apart(a: Column, b: Column) -> Column:
    """Whole calendar months from a to b."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def two_digit_year(digit: Column) -> Column:
    """Year digit of a futures code: 0 to 5 in the thirties, 6 to 9 in the twenties."""
    return F.when(digit.between(0, 5), F.concat(F.lit("3"), digit.cast("string"))).when(digit.between(6, 9), F.concat(F.lit("2"), digit.cast("string")))


def compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def to_tick(price: Column, tick: float, up: bool) -> Column:
    """Price moved to the tick grid: offers up, bids down."""
    n = price / F.lit(tick)
    return (F.ceil(F.round(n, 9)) if up else F.floor(F.round(n, 9))) * F.lit(tick)


def within_days(a: Column, b: Column, n: int) -> Column:
    return F.abs(F.datediff(a, b)) <= n


def long_date(text: Column) -> Column:
    """Date of text like 'Friday, March 6, 2026'."""
    month = month_number(F.substring(F.regexp_extract(text, r",\s*([A-Za-z]+)\s+\d+", 1), 1, 3))
    return F.make_date(F.regexp_extract(text, r"(\d{4})\s*$", 1).try_cast("int"), month, F.regexp_extract(text, r"([0-9]+),\s*\d{4}\s*$", 1).try_cast("int"))
