"""Typed values from text cells and back, as Column expressions. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.tenor import parse_date

#: Short names of curves in exports (fixed values).
CURVES = {"Dutch TTF Natural Gas Futures Forward": "TTF", "ICE Brent Forward": "Brent"}


def boolean(text: Column) -> Column:
    return F.trim(text).try_cast("boolean")


def numbers(text: Column, separator: str = ";") -> Column:
    """The numbers of a delimited list; parts that aren't numbers are null, an empty text is an empty list."""
    parts = F.filter(F.transform(F.split(text, f"\\{separator}"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))


def listed(values: Column, separator: str = ";") -> Column:
    """A delimited list of values, without nulls."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)


def number(text: Column) -> Column:
    """A number, with inf and -inf in any case as endless ones."""
    low = F.lower(F.trim(text))
    return F.when(low == "inf", float("inf")).when(low == "-inf", float("-inf")).otherwise(F.trim(text).try_cast("double"))


def number_text(value: Column) -> Column:
    """A number as text; endless ones as inf and -inf."""
    return F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(value.cast("string"))


def member(text: Column, values: tuple[str, ...]) -> Column:
    """The one of some names that a text is, whatever its case; null if it is none."""
    found = F.create_map(*[x for v in values for x in (F.lit(v.lower()), F.lit(v))])
    return F.try_element_at(found, F.lower(F.trim(text)))


def tenor_text(text: Column) -> Column:
    """A tenor as text: a number that stands for no date as a whole number, all else trimmed."""
    value = F.trim(text).try_cast("double")
    return F.when(value.isNotNull() & ~value.between(10_000, 99_999), value.cast("bigint").cast("string")).otherwise(F.trim(text))


def date_text(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date in one form, whatever form it comes in; numbers and unreadable texts stay."""
    return F.when(F.trim(text).try_cast("double").isNotNull(), text).otherwise(F.coalesce(F.date_format(parse_date(text), pattern), text))


def curve_name(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CURVES.items() for x in pair]), name), name)


def cleaned(text: Column, *parts: str) -> Column:
    """text without some parts, trimmed."""
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(""))
    return F.trim(text)


def shaped_quotes(rows: DataFrame, by: list[str], shape: str, tenor: str, price: str, default: str = "BASE") -> DataFrame:
    """(by, quotes): a map from load shape to a map from tenor to price, without gaps; a missing shape is the default."""
    own = rows.where(F.col(price).isNotNull()).withColumn("_s", F.coalesce(F.nullif(F.trim(F.col(shape)), F.lit("")), F.lit(default)))
    each = own.groupBy(*by, "_s", F.col(tenor).alias("_t")).agg(F.max(price).alias("_p")).groupBy(*by, "_s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_t", "_p")))).alias("_m"))
    return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_m"))).alias("quotes"))


def without_blanks(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Cells (row, col, value) of a range without its rows and columns that are all blank (null or empty)."""
    filled = F.coalesce(F.trim(F.col(value).cast("string")), F.lit("")) != ""
    rows = cells.where(filled).select(row).distinct()
    left = cells.join(rows, row, "left_semi")
    cols = left.where(filled).select(col).distinct()
    return left.join(cols, col, "left_semi").select(*cells.columns)
