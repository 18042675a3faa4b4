"""Bars and order books on Structured Streaming: the batch operators' results, kept up as events come.

Each function takes a streaming DataFrame and returns one; state is bounded by the
watermark (bars), or by that and the number of orders that have not ended (order_states).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(events: DataFrame, name: str, time: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(name, start, open, high, low, close, volume) of windows of time; a window is final once the watermark, `late` behind the newest event, passes it.

    Events later than that, and events without a time, don't count. Ties in time are
    settled by the value, so a replay gives the same bars.
    """
    at = F.struct(time, value)
    known = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    out = known.groupBy(name, F.window(time, size).alias("_w")).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("volume"))
    return out.select(name, F.col("_w.start").alias("start"), "open", "high", "low", "close", "volume")


def order_states(events: DataFrame, ended: tuple[str, ...] = ("withdrawn", "consummated"), late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """(order_id, ts, state, side, price, qty) whenever an order's newest state changes.

    events: order_id long, ts timestamp, state, side string, price, qty double. An
    event older than the newest one of its order changes nothing, whether the order
    has ended or not; of events at one time the last in the order of state and price
    counts. Events without a time, and those that come later than the watermark,
    `late` behind the newest event, don't count.

    An end stays in the state until the watermark has passed it: no older event can
    come after that, so the state may go. idle: how far the watermark must pass an
    order's newest event for it to be forgotten without an end; by default never.
    """
    columns = ["ts", "state", "side", "price", "qty"]
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def keep(state: GroupState, last: tuple) -> None:
        state.update(last)
        at = int(pd.Timestamp(last[0]).timestamp() * 1000)
        until = at + 1 if last[1] in ended else None if wait is None else at + wait
        if until is not None:  # a timeout may not lie behind the watermark
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "state", "price"])
        last = rows.iloc[-1]
        if before is not None and last["ts"] < before[0]:
            keep(state, before)  # a timeout has to be set again whenever an order is called
            return
        keep(state, (last["ts"].to_pydatetime(), last["state"], last["side"], None if pd.isna(last["price"]) else float(last["price"]), None if pd.isna(last["qty"]) else float(last["qty"])))
        yield pd.DataFrame([{"order_id": key[0], **{c: last[c] for c in columns}}])

    schema = "ts timestamp, state string, side string, price double, qty double"
    known = events.where("ts is not null").withWatermark("ts", late).select("order_id", *columns)
    return known.groupBy("order_id").applyInPandasWithState(step, f"order_id long, {schema}", schema, "append", GroupStateTimeout.EventTimeTimeout)
