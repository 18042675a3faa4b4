"""Order books from order events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.tenor import to_tick


def latest(events: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; order must be unique within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def without_states(orders: DataFrame, states: list[str], column: str = "state") -> DataFrame:
    """Orders in none of the states; an unknown state stays."""
    return orders.where(~F.coalesce(F.col(column).isin(*states), F.lit(False)))


def levels(orders: DataFrame, tick: float, keys: tuple[str, ...] = (), side: str = "side", price: str = "price", qty: str = "qty", maker: str = "maker") -> DataFrame:
    """Quantity by side, price level and maker (and more keys): bids fall to the tick, offers rise. Incomplete orders go."""
    known = orders.dropna(subset=[side, price, qty, maker])
    is_bid = F.lower(side).contains("bid")
    level = F.when(is_bid, to_tick(F.col(price), tick, False)).when(F.lower(side).contains("offer"), to_tick(F.col(price), tick, True))
    return known.withColumn("level", F.round(level, 6)).where("level is not null").groupBy(F.col(side).alias("side"), "level", F.col(maker).alias("maker"), *keys).agg(F.sum(qty).alias("qty"))


def top_levels(book: DataFrame, n: int) -> DataFrame:
    """The n highest bid and the n lowest offer levels."""
    best = F.when(F.lower("side").contains("bid"), -F.col("level")).otherwise(F.col("level"))
    w = Window.partitionBy("side").orderBy("_best")
    return book.withColumn("_best", best).withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= n).drop("_best", "_k")


def pivoted(book: DataFrame, makers: list[str]) -> DataFrame:
    """side x level rows with a column for each maker, 0 for none."""
    return book.groupBy("side", "level").pivot("maker", makers).agg(F.sum("qty")).fillna(0, subset=makers)


def stacked(book: DataFrame) -> DataFrame:
    """Where each maker's bar begins when the bars of a level are stacked by maker name."""
    w = Window.partitionBy("side", "level").orderBy("maker").rowsBetween(Window.unboundedPreceding, -1)
    return book.withColumn("begins", F.coalesce(F.sum("qty").over(w), F.lit(0)))


def traded(orders: DataFrame, state: str = "consummated") -> DataFrame:
    """Traded quantity by price."""
    return orders.where(F.col("state") == state).groupBy("price").agg(F.sum("qty").alias("qty"))
