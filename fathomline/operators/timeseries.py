"""Returns, volatility, correlation, filling, rolling and bar statistics on long tables.

Series are told apart by `by` columns and ordered by a day column. Windows are one
shuffle on `by`; nothing is ordered globally.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators.bounds import if_small


#: Series whose full correlation matrix may be asked for.
MAX_SERIES = 2000


def series(by: list[str], day: str, descending: bool = False):
    return Window.partitionBy(*by).orderBy(F.desc(day) if descending else F.asc(day))


def log_return(value: Column, before: Column) -> Column:
    """ln(value / before); null where a price is missing or not positive."""
    return F.when((value > 0) & (before > 0), F.ln(value / before))


def lag_returns(rows: DataFrame, by: list[str], day: str, value: str, kind: str = "log", lead: bool = False) -> DataFrame:
    """rows with column ret against the row before (the one after if lead): log, relative or difference."""
    w = series(by, day)
    other = (F.lead if lead else F.lag)(value).over(w)
    ret = {"log": log_return(F.col(value), other), "relative": F.try_divide(F.col(value), other) - 1, "difference": F.col(value) - other}[kind]
    return rows.withColumn("ret", ret)


def calendar_returns(rows: DataFrame, by: list[str], day: str, value: str, days: int) -> DataFrame:
    """Log returns against the same series exactly `days` calendar days earlier, on days that have both."""
    before = rows.select(*by, F.date_add(day, days).alias(day), F.col(value).alias("_before"))
    return rows.join(before, [*by, day]).withColumn("ret", log_return(F.col(value), F.col("_before"))).drop("_before")


def filled(rows: DataFrame, by: list[str], day: str, value: str, backward: bool = False, descending: bool = False) -> DataFrame:
    """value with gaps taken from the row before (forward) or after (backward) in the given order of days."""
    w = series(by, day, descending)
    if backward:
        new = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        new = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(value, new)


def rolling_mean(rows: DataFrame, by: list[str], day: str, value: str, n: int, lag: int = 0) -> DataFrame:
    """Column mean: the mean of n rows that end `lag` rows ago; null until there are n values."""
    w = series(by, day).rowsBetween(-(n - 1) - lag, -lag)
    return rows.withColumn("mean", F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def rolling_corr(rows: DataFrame, by: list[str], day: str, x: str, y: str, n: int) -> DataFrame:
    """Column corr over the n rows before a row (itself left out), null until there are more than n."""
    w = series(by, day)
    frame = w.rowsBetween(-n, -1)
    return rows.withColumn("corr", F.when(F.row_number().over(w) > n + 1, F.corr(x, y).over(frame)))


def monthly_mean(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Means by month end, with a null for each month between the first and last that has no row."""
    months = rows.groupBy(*by, F.last_day(day).alias("month")).agg(F.avg(value).alias(value))
    span = months.groupBy(*by).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    starts = F.sequence(F.trunc("_a", "MM"), F.trunc("_b", "MM"), F.expr("INTERVAL 1 MONTH"))
    calendar = span.select(*by, F.explode(F.transform(starts, F.last_day)).alias("month"))
    return calendar.join(months, [*by, "month"], "left")


def true_range(rows: DataFrame, by: list[str], day: str) -> DataFrame:
    """Column tr: the largest of the bar's range and its distances from the close before; gaps don't count."""
    before = F.lag("close").over(series(by, day))
    return rows.withColumn("tr", F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def scanned(rows: DataFrame, by: list[str], day: str, uses: list[str], start, step, added: list[tuple[str, T.DataType]]) -> DataFrame:
    """rows with columns from a state that is carried along each series in order of days.

    start() gives the state before a series, step(state, *values of uses) the next
    state and the added values of a row. Series are sorted within partitions and read
    as a stream of Arrow batches, so that no series is ever held whole. Days of a
    series should differ; rows of the same day follow each other in any order.
    """
    import pyarrow as pa

    kinds = {"double": pa.float64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for b in batches:
            columns = {c: b.column(b.schema.names.index(c)).to_pylist() for c in {*by, *uses}}
            out: list[list] = [[] for _ in added]
            for i in range(b.num_rows):
                key = tuple(columns[c][i] for c in by)
                if state is None or key != before:
                    before, state = key, start()
                state, values = step(state, *(columns[c][i] for c in uses))
                for own, v in zip(out, values):
                    own.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, kinds[k.simpleString()]) for v, (_, k) in zip(out, added))], [*b.schema.names, *(c for c, _ in added)])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in added)])
    return rows.repartition(*by).sortWithinPartitions(*by, day).mapInArrow(run, schema)


def wilder_mean(rows: DataFrame, by: list[str], day: str, value: str, n: int) -> DataFrame:
    """Column rma: the recurrence m + (x - m) / n from the first value on; a missing value leaves the mean as it is, n below 2 gives the values."""

    def step(m, x):
        m = m if x is None else x if m is None or n < 2 else m + (x - m) / n
        return m, (m,)

    return scanned(rows, by, day, [value], lambda: None, step, [("rma", T.DoubleType())])


def waves(rows: DataFrame, by: list[str], day: str, box: str, volume: str = "volume", high: str = "close", low: str = "close", signed: bool = False, per_bar: bool = False) -> DataFrame:
    """Volume waves: a wave goes on until the price leaves the box around it on the other side.

    A bar whose high lies above wave close + box moves the wave close up to that high,
    else one whose low lies below wave close - box moves it down to that low (by
    default both are the close); else wave and direction stay. The volume, or the true
    range (column tr) where there is none, adds up while the direction stays. Adds
    wave_close, direction (1, -1; 0 before the first move), wave_bars (counted only if
    per_bar, else 1) and wave_volume: over the bars if per_bar, negative in falls if
    signed. A bar without box moves nothing.
    """

    def step(state, close, top, bottom, size, vol, tr):
        vol = (vol if vol is not None else tr) or 0.0
        if state is None:
            state = (close, 0, 1, vol)
        else:
            at, direction, bars, total = state
            now = top if size is not None and top > at + size else bottom if size is not None and bottom < at - size else at
            turn = 1 if now > at else -1 if now < at else direction
            state = (now, turn, bars + 1 if per_bar and turn == direction else 1, total + vol if turn == direction else vol)
        at, direction, bars, total = state
        shown = total / bars
        return state, (at, direction, bars, -shown if signed and direction < 0 else shown)

    rows = rows if "tr" in rows.columns else true_range(rows, by, day)
    added = [("wave_close", T.DoubleType()), ("direction", T.IntegerType()), ("wave_bars", T.IntegerType()), ("wave_volume", T.DoubleType())]
    return scanned(rows, by, day, ["close", high, low, box, volume, "tr"], lambda: None, step, added)


def annualised(ret: str, periods: int, population: bool = False) -> Column:
    """Aggregate: standard deviation of returns times the root of the periods in a year."""
    return (F.stddev_pop if population else F.stddev_samp)(ret) * F.sqrt(F.lit(float(periods)))


def pairwise_corr(returns: DataFrame, name: str, day: str, value: str = "ret", least: int = 2, clip: float = 1.0) -> DataFrame:
    """(a, b, n, corr) of all pairs of series, over the days that both have, clipped; pairs with fewer days go.

    Every day gives the square of its series: meant for the tens of series of a price
    panel, whose correlation matrix is the result; more than MAX_SERIES is an error.
    """
    n = returns.agg(F.count_distinct(name)).first()[0]
    if n > MAX_SERIES:
        raise ValueError(f"{n} series: a correlation matrix of at most {MAX_SERIES} can be asked for")
    x = returns.where(F.col(value).isNotNull()).select(F.col(name).alias("a"), F.col(day).alias("_d"), F.col(value).alias("_x"))
    y = x.select(F.col("a").alias("b"), "_d", F.col("_x").alias("_y"))
    out = x.join(y, "_d").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("corr"))
    return out.where(F.col("n") >= least).withColumn("corr", F.greatest(F.lit(-clip), F.least(F.lit(clip), "corr")))


def last_rows(rows: DataFrame, by: list[str], day: str, n: int) -> DataFrame:
    """The n latest rows of each series."""
    return rows.withColumn("_k", F.row_number().over(series(by, day, True))).where(F.col("_k") <= n).drop("_k")


def current_and_previous(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """The newest and the next older value of each series (null if there is none)."""
    k = F.row_number().over(series(by, day, True))
    return rows.withColumn("_k", k).where("_k <= 2").groupBy(*by).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("current"), F.max(F.when(F.col("_k") == 2, F.col(value))).alias("previous"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins between low and high, the last one closed; values outside don't count."""
    k = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return rows.where(F.col(value).between(low, high)).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def composite(months: DataFrame, members: DataFrame, by: list[str], month: str, value: str) -> DataFrame:
    """Period averages (by, period, value) where every month of the period has a value. members: (period, month, size)."""
    joined = months.where(F.col(value).isNotNull()).join(if_small(members), month)
    out = joined.groupBy(*by, "period").agg(F.avg(value).alias(value), F.count("*").alias("n"), F.first("size").alias("size"))
    return out.where("n = size").drop("n", "size")


def longest_dated(rows: DataFrame, by: list[str], day: str, order: Column, value: str, days: int) -> DataFrame:
    """Mean, over the last `days` days, of each day's value with the largest order."""
    tops = rows.groupBy(*by, day).agg(F.max_by(value, order).alias(value))
    return last_rows(tops, by, day, days).groupBy(*by).agg(F.avg(value).alias(value))


def coverage(rows: DataFrame, by: list[str], day: str, start: str, end: str, slack: int, share: float) -> DataFrame:
    """Whether each series begins and ends within `slack` days of a period and has at least `share` of its weekdays."""
    from fathomline.functions.tenor import is_weekday, workdays

    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = rows.where(F.col(day).between(a, b)).groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"), F.count_distinct(F.when(is_weekday(F.col(day)), F.col(day))).alias("_n"))
    return days.select(*by, (F.datediff("_a", a) <= slack).alias("starts"), (F.datediff(b, "_b") <= slack).alias("ends"), (F.col("_n") >= share * workdays(a, b)).alias("dense"))


def missing(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Numbers of rows and of missing values."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"))


def nearest_zero(rows: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Lowest, mean and highest value across names, and the name whose value is nearest to zero (ties: first name)."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"), F.min(F.struct(F.abs(value).alias("a"), F.col(name).alias("n")))["n"].alias("marginal"))
