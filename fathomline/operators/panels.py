"""Price panels: contracts seen from a day, windowed returns, hub spreads in one unit, current and previous quotes, ticker lists.

All tables are long: a row for each series, day and contract month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import tenor as tn

#: Megawatt hours in a therm, and million British thermal units in a megawatt hour (fixed values of the units).
THERM_MWH, MWH_MMBTU = 0.0293001, 3.412142
#: Below this a price is no quote.
ALMOST_ZERO = 1e-7
#: Contract codes of the first month of quarters and seasons, and the labels they get (fixed values of the market).
QUARTERS, SEASONS = {"J": "Q2", "N": "Q3", "V": "Q4", "F": "Q1"}, {"J": "SS", "V": "WS"}
#: Months ahead of the pillars of a currency's forwards after spot.
PILLARS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 18, 24)


def relative_tenors(rows: DataFrame, by: list[str], day: str, contract: str, value: str, first: int = 1, n: int = 24) -> DataFrame:
    """(by, day, m, value): contract months counted from each day.

    The contract `first` months after the day's month is number 1; on days on which a
    series lacks it, numbers move on by one month. Contracts beyond n have no row.
    """
    ahead = tn.months_apart(F.col(day), F.col(contract))
    w = Window.partitionBy(*by, day)
    there = F.max((ahead == first).cast("int")).over(w)
    m = (ahead - (first - 1) - (1 - there)).cast("int")
    return rows.withColumn("m", m).where(F.col("m").between(1, n)).select(*by, day, "m", value)


def bad_quotes(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is no price: below ALMOST_ZERO. Missing values are not bad."""
    return rows.where(F.col(value) < ALMOST_ZERO)


def quoted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows without those whose group by keys (a column or a row of the wide form) has no value at all."""
    known = rows.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n > 0").drop("_n")
    same = [rows[k].eqNullSafe(known[k]) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return rows.join(known, on, "left_semi")


def windowed_returns(rows: DataFrame, by: list[str], day: str, value: str, days: int, normal: bool = False) -> DataFrame:
    """Annualised returns over `days` calendar days on days that have both ends: sqrt(365 / days) times the difference of logs, or of values if normal.

    Values that are no price (see bad_quotes) have no log return.
    """
    x = F.col(value) if normal else F.when(F.col(value) >= ALMOST_ZERO, F.ln(value))
    own = rows.select(*by, day, x.alias("_x"))
    before = own.select(*by, F.date_add(day, days).alias(day), F.col("_x").alias("_before"))
    factor = (365 / days) ** 0.5
    return own.join(before, [*by, day]).select(*by, day, (factor * (F.col("_x") - F.col("_before"))).alias("ret")).where("ret is not null")


def relative_returns(returns: DataFrame, by: list[str], day: str, contract: str, n: int, roll_days: int = 0) -> DataFrame:
    """(by, day, k, ret): returns of the k-th contract as seen on each day, which rolls roll_days before month end; k up to n."""
    k = tn.months_apart(F.date_add(day, roll_days), F.col(contract)).cast("int")
    return returns.withColumn("k", k).where(F.col("k").between(1, n)).select(*by, day, "k", "ret")


def to_euro_mwh(pence_therm: Column, euro_pounds: Column) -> Column:
    """Pence a therm as euros a megawatt hour; euro_pounds: pounds for a euro."""
    return pence_therm * 0.01 / euro_pounds / THERM_MWH


def outright_rate(spot: Column, points: Column) -> Column:
    """Forward rate of a currency pair: spot plus points, which are quoted in ten-thousandths."""
    return spot + points / 10_000


def hub_spreads(curves: DataFrame, hub: str, reference: str, pence: list[str], fx: DataFrame) -> DataFrame:
    """(hub, start, value, spread, floor) of all hubs but the reference on months that both quote.

    curves (hub, start, price), a row for each hub and month; hubs in `pence` are
    converted with fx (start, rate), and have a floor: what a hub at 98.5 % of their
    value less 1.24 allows. The reference is spread over a month's rows by a window:
    curves are read once.
    """
    month = Window.partitionBy("start")
    there = F.max((F.col(hub) == reference).cast("int")).over(month)
    rows = curves.withColumns({"_ref": F.max(F.when(F.col(hub) == reference, F.col("price"))).over(month), "_there": there})
    rows = rows.where((F.col(hub) != reference) & (F.col("_there") == 1)).join(fx, "start", "left")
    in_pence = F.col(hub).isin(*pence)
    value = F.when(in_pence, to_euro_mwh(F.col("price"), F.col("rate"))).otherwise(F.col("price"))
    rows = rows.withColumn("value", value)
    return rows.select(hub, "start", "value", (F.col("_ref") - F.col("value")).alias("spread"), F.when(in_pence, F.col("value") * 0.985 - 1.24).alias("floor"))


def import_floor(curves: DataFrame, hub: str, british: str, continental: str, discount: str, fx: DataFrame) -> DataFrame:
    """(start, floor, landed) on months that all quote: 98.5 % of the British price less 0.45 $/MMBtu, and the continental price with its import discount, in euros a megawatt hour.

    curves (hub, start, price): the British hub in pence a therm, the continental one
    in euros a megawatt hour, the discount in $/MMBtu; fx (start, eurusd, gbpusd). The
    three are columns of one aggregation.
    """
    names = {"_b": british, "_c": continental, "_d": discount}
    own = [(F.col(hub) == h, c) for c, h in names.items()]
    rows = curves.where(F.col(hub).isin(*names.values())).groupBy("start").agg(
        *[F.max(F.when(is_it, F.col("price"))).alias(c) for is_it, c in own], F.countDistinct(hub).alias("_n")
    )
    rows = rows.where(F.col("_n") == len(names)).join(fx, "start")
    usd = MWH_MMBTU / F.col("eurusd")
    floor = to_euro_mwh(F.col("_b"), F.col("eurusd") / F.col("gbpusd")) * 0.985 - 0.45 * usd
    return rows.select("start", floor.alias("floor"), (F.col("_c") + F.col("_d") * usd).alias("landed"))


def first_tenors(curves: DataFrame, by: list[str], n: int = 24) -> DataFrame:
    """The first n months of each curve."""
    return curves.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("start"))).where(F.col("_k") <= n).drop("_k")


def oldest_pair(rows: DataFrame, by: list[str], month: str, day: str, value: str) -> DataFrame:
    """(by, month, previous, current): values on the oldest and the next oldest day of each series, 0 where a month has none on that day."""
    w = Window.partitionBy(*by).orderBy(day)
    old = rows.withColumn("_k", F.dense_rank().over(w))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("_k") == k, F.col(value))), F.lit(0.0))
    return old.groupBy(*by, month).agg(pick(1).alias("previous"), pick(2).alias("current"))


def newest_pair(rows: DataFrame, by: list[str], month: str, day: str, value: str, this_year: int) -> DataFrame:
    """(by, month, current, previous): the two newest values of each month; a single one is current for months beyond this year, else previous, the other 0."""
    w = Window.partitionBy(*by, month).orderBy(F.desc(day))
    new = rows.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    out = new.groupBy(*by, month).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("_1"), F.max(F.when(F.col("_k") == 2, F.col(value))).alias("_2"), F.count("*").alias("_n"))
    ahead = F.year(month) > this_year
    current = F.when(F.col("_n") == 2, F.col("_1")).when(ahead, F.col("_1")).otherwise(0.0)
    previous = F.when(F.col("_n") == 2, F.col("_2")).when(ahead, 0.0).otherwise(F.col("_1"))
    return out.select(*by, month, current.alias("current"), previous.alias("previous"))


def distribution(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """(by, n, low, lower, median, upper, high, last): quartiles of the values and the newest one."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high"), F.max_by(value, day).alias("last"))
    return out.select(*by, "n", "low", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("upper"), "high", "last")


def added(spreads: DataFrame, hub: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Outright prices: quotes against a hub plus the hub's, on keys that both have."""
    return spreads.join(hub.select(*keys, F.col(value).alias("_hub")), keys).select(*spreads.columns[:-1], (F.col(value) + F.col("_hub")).alias(value))


def synthetic_periods(months: DataFrame, by: list[str]) -> DataFrame:
    """(by, tenor, price): quarters, seasons and years whose months are all quoted, at their mean price. months: (by, start, price)."""
    members = F.broadcast(tn.period_table(months.sparkSession).where(F.col("period").isin(*tn.PERIODS)))  # 42 rows
    rows = months.where("price is not null").join(members, F.month("start") == F.col("month"))
    rows = rows.groupBy(*by, "period", (F.year("start") - F.col("year_shift")).alias("_y")).agg(F.avg("price").alias("price"), F.count("*").alias("_n"))
    size = F.create_map(*[x for p, (_, n) in tn.PERIODS.items() for x in (F.lit(p), F.lit(n))])
    return rows.where(F.col("_n") == size[F.col("period")]).select(*by, F.concat_ws("_", "period", F.lpad((F.col("_y") % 100).cast("string"), 2, "0")).alias("tenor"), "price")


def ticker_list(commodities: DataFrame, years: int) -> DataFrame:
    """(commodity, kind, position, ticker, label) of months, quarters, seasons and years, in that order.

    commodities: commodity, code (of months), quarter, season and year (codes, null if
    there are no such contracts), suffix (whether tickers end in their kind), start_year
    (as it stands in tickers). Labels have the year's last two digits.
    """
    kinds = [
        ("M", "code", dict(zip(tn.MONTH_CODES, tn.MONTHS))),
        ("Q", "quarter", QUARTERS),
        ("S", "season", SEASONS),
        ("Y", "year", {"F": "Y"}),
    ]
    parts = []
    def listed(kind: str, column: str, codes: dict[str, str]) -> Column:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")) for c, p in codes.items()])

        def one(y: Column, x: Column) -> Column:
            ticker = F.concat(F.col(column), x["c"], y.cast("string"), F.when(F.col("suffix"), F.lit(kind)).otherwise(F.lit("")))
            return F.struct(F.lit(kind).alias("kind"), ticker.alias("ticker"), F.concat(x["p"], F.lit("_"), F.lpad((y % 100).cast("string"), 2, "0")).alias("label"))

        return F.flatten(F.transform(F.sequence(F.col("start_year"), F.col("start_year") + years - 1), lambda y: F.transform(pairs, lambda x: one(y, x))))

    none = F.array().cast("array<struct<kind:string,ticker:string,label:string>>")
    for kind, column, codes in kinds:
        parts.append(F.when(F.col(column).isNotNull(), listed(kind, column, codes)).otherwise(none))
    return commodities.select("commodity", F.posexplode(F.concat(*parts)).alias("position", "x")).select("commodity", "x.kind", "position", "x.ticker", "x.label")


def currency_tickers(pairs: DataFrame, suffix: str, pillars: tuple[int, ...] = PILLARS) -> DataFrame:
    """(pair, position, ticker, label): spot and forward pillars of currency pairs seen from month `start` (a date); tickers end in the suffix."""
    ahead = F.array(F.lit(0), *[F.lit(m) for m in pillars])
    rows = pairs.select("pair", "start", F.posexplode(ahead).alias("position", "m"))
    code = F.when(F.col("m") == 0, F.col("pair")).otherwise(F.concat("pair", F.col("m").cast("string"), F.lit("M")))
    return rows.select("pair", "position", F.concat(code, F.lit(suffix)).alias("ticker"), tn.tenor_label(F.add_months(F.trunc("start", "MM"), F.col("m"))).alias("label"))


def generic_contracts(days: DataFrame, rolls: DataFrame, day: str, n: int) -> DataFrame:
    """(day, k, contract): the k-th contract on each day whose last trading day (rolls: contract, last) isn't past; k up to n.

    Contracts are at least a month apart, so that only those of the next n + 2 months can be meant; they are joined by month.
    """
    month = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n + 1)), lambda k: F.add_months(F.trunc(F.col(day), "MM"), k))).alias("contract")
    rows = days.select(day, month).join(rolls, "contract").where(F.col("last") >= F.col(day))
    k = F.row_number().over(Window.partitionBy(day).orderBy("contract"))
    return rows.select(day, k.alias("k"), "contract").where(F.col("k") <= n)
