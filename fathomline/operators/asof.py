"""As-of, bracket and override joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators.bounds import if_small


#: Stretches that the axis of keys is cut into: COARSE times as many as there are fine ones in each.
COARSE, FINE = 16, 16


def common_type(left: DataFrame, on: str, right: DataFrame, right_on: str) -> T.DataType:
    """The type that both keys are compared in: the wider one by Spark's rules (a date beside a time is its midnight). An error if one is a number and the other a time, or either is neither."""
    kinds = [left.schema[on].dataType, right.schema[right_on].dataType]
    times = [isinstance(k, T.DateType | T.TimestampType | T.TimestampNTZType) for k in kinds]
    if times[0] != times[1] or not times[0] and not all(isinstance(k, T.NumericType) for k in kinds):
        raise TypeError(f"{on} ({kinds[0].simpleString()}) and {right_on} ({kinds[1].simpleString()}) have no order in common")
    return left.select(F.col(on).alias("k")).union(right.select(F.col(right_on).alias("k"))).schema["k"].dataType


def _axis(key: Column, kind: T.DataType) -> Column:
    """A double that never falls where the key rises; keys that it can't tell apart are in one stretch and compared there as they are."""
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return (F.unix_date(key.cast("date")) * 24 + F.hour(key)).cast("double") * 3600 + F.minute(key) * 60 + F.second(key)
    return key.cast("double")


def _stretch(x: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are at or below x, found in two steps."""
    coarse = F.size(F.filter(F.array(*[F.get(bounds, F.lit(FINE * k - 1)) for k in range(1, COARSE)]), lambda b: b <= x))
    fine = F.size(F.filter(F.slice(bounds, coarse * FINE + 1, F.lit(FINE - 1)), lambda b: b <= x))
    return F.coalesce(coarse * FINE + fine, F.lit(0)).cast("int")


def asof(left: DataFrame, right: DataFrame, on: str, right_on: str, value: str, by: list[str] | None = None, forward: bool = False) -> DataFrame:
    """left with `value` and its key from the last row of right at or before `on` (the first at or after it if forward), per group.

    Both keys are cast to their common type (see common_type) and compared as they are.
    The axis is cut at quantiles of the keys of right, a subquery of the same job.
    Within a group's stretch the distinct keys of left and right are laid together and
    a window carries the last value on; what a stretch begins with comes from one row
    for each stretch of right before it. So no task has a whole group, and no pairs are
    made. Rows of left get what their key has found by an equality join, in which
    adaptive execution can split a crowded key.

    Ties in right take the largest value. Rows of right with a null key match nothing;
    rows of left without a match, or with a null key, keep nulls. NaN is above all other
    keys. A null in `by` is a group of its own. Whole numbers beside floating ones are
    compared as doubles.
    """
    by, kind = by or [], common_type(left, on, right, right_on)
    groups = [f"_g{k}" for k in range(len(by))]
    named = [F.col(c).alias(g) for c, g in zip(by, groups)]
    b = right.where(F.col(right_on).isNotNull()).groupBy(*named, F.col(right_on).cast(kind).alias("_k"))
    b = b.agg(F.max(F.struct(F.col(value).alias("v"), F.col(right_on).alias("k"))).alias("_v"))
    a = left.where(F.col(on).isNotNull()).select(*named, F.col(on).cast(kind).alias("_k")).distinct()
    x = _axis(F.col("_k"), kind)
    shares = F.array(*[F.lit(k / (COARSE * FINE)) for k in range(1, COARSE * FINE)])
    known = b.select(x.alias("x")).where(~F.isnan("x"))
    bounds = known.agg(F.percentile_approx("x", shares, F.lit(10 * COARSE * FINE))).scalar()
    a, b = (d.withColumn("_bounds", bounds).withColumn("_at", _stretch(x, F.col("_bounds"))).drop("_bounds") for d in (a, b))

    none = F.lit(None).cast(b.schema["_v"].dataType)
    both = a.select(*groups, "_at", "_k", none.alias("_v"), F.lit(1).alias("_mine")).unionByName(b.select(*groups, "_at", "_k", "_v", F.lit(0).alias("_mine")))
    w = Window.partitionBy(*groups, "_at").orderBy(F.desc("_k") if forward else F.asc("_k"), "_mine").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).where("_mine = 1").drop("_v", "_mine")

    # the nearest value of each stretch of right, and from these what later (earlier if forward) stretches begin with
    pick = F.min_by if forward else F.max_by
    ends = b.groupBy(*groups, "_at").agg(pick("_v", "_k").alias("_v"))
    if groups:
        order = Window.partitionBy(*groups).orderBy(F.desc("_at") if forward else F.asc("_at"))
        # a value holds from the stretch after its own to the next one that has values
        last = F.coalesce(F.lead("_at").over(order), F.lit(0 if forward else COARSE * FINE - 1))
        first = F.col("_at") + (-1 if forward else 1)
        spans = ends.withColumns({"_first": first, "_last": last}).where("_first >= _last" if forward else "_first <= _last")
        spans = spans.select(*[F.col(g).alias(f"_s{g}") for g in groups], F.explode(F.sequence("_first", "_last")).alias("_s_at"), F.col("_v").alias("_carried"))
        on_all = F.col("_at") == F.col("_s_at")
        for g in groups:
            on_all = on_all & F.col(g).eqNullSafe(F.col(f"_s{g}"))
        found = found.join(spans, on_all, "left").select(*groups, "_k", F.coalesce("_hit", "_carried").alias("_found"))
    else:
        steps = ends.agg(F.sort_array(F.collect_list(F.struct("_at", "_v")))).scalar()  # one entry for each stretch at most
        beyond = F.filter("_steps", (lambda e: e["_at"] > F.col("_at")) if forward else (lambda e: e["_at"] < F.col("_at")))
        carried = F.try_element_at(beyond, F.lit(1 if forward else -1))
        found = found.withColumn("_steps", steps).select("_k", F.coalesce("_hit", carried["_v"]).alias("_found"))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), *[F.col(c).alias(f"_l{g}") for c, g in zip(by, groups)], F.col(on).cast(kind).alias("_on"))
    same = F.col("_on") == F.col("_k")
    for g in groups:
        same = same & F.col(f"_l{g}").eqNullSafe(F.col(g))
    return rows.join(found, same, "left").select("_left.*", F.col("_found.k").alias(f"{right_on}_asof"), F.col("_found.v").alias(value))


def known_asof(asked: DataFrame, quotes: DataFrame, by: list[str], day: str, at: str, valid: str, known: str, value: str, within: int) -> DataFrame:
    """asked with what was known: the quote of the newest valid day that lies at most `within` days before `day` and of which anything was known by `at`, in the version known last by then.

    Two axes: quotes (by, valid, known, value) are of a day and become known, or are
    corrected, later. asked: by, day (a date), at (of the type of known). A corrected
    value that is null takes the quote of that day back; the day then has a null, and
    isn't passed over. Adds valid, known and value; nulls where nothing was known. Of
    versions known at one time the largest value counts.

    Each distinct question is asked of within + 1 days by an equality join on group and
    day with the time at which that day was first known; the version comes from asof()
    on the time of knowledge within group and day. No group meets in one task.
    """
    groups = [f"_g{k}" for k in range(len(by))]
    named = [F.col(c).alias(g) for c, g in zip(by, groups)]
    q = quotes.where(F.col(valid).isNotNull() & F.col(known).isNotNull()).select(*named, F.col(valid).cast("date").alias("_v"), F.col(known).alias("_k"), F.struct(F.col(value).alias("x")).alias("_x"))
    first = q.groupBy(*groups, "_v").agg(F.min("_k").alias("_first")).select(*[F.col(g).alias(f"_f{g}") for g in groups], F.col("_v").alias("_fv"), "_first")
    questions = asked.where(F.col(day).isNotNull() & F.col(at).isNotNull()).select(*named, F.col(day).cast("date").alias("_d"), F.col(at).alias("_at_")).distinct()
    each = questions.withColumn("_v", F.explode(F.sequence(F.date_sub("_d", within), F.col("_d"))))
    same = (F.col("_v") == F.col("_fv")) & (F.col("_first") <= F.col("_at_"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_f{g}"))
    newest = each.join(first, same).groupBy(*groups, "_d", "_at_").agg(F.max("_v").alias("_v"))
    found = asof(newest, q, "_at_", "_k", "_x", by=[*groups, "_v"])
    found = found.select(*[F.col(g).alias(f"_n{g}") for g in groups], F.col("_d").alias("_nd"), F.col("_at_").alias("_nat"), F.col("_v").alias("_nv"), F.col("_k_asof").alias("_nk"), F.col("_x.x").alias("_nx"))
    rows = asked.select(F.struct(*[F.col(f"`{c}`") for c in asked.columns]).alias("_row"), *named, F.col(day).cast("date").alias("_d"), F.col(at).alias("_at_"))
    on = (F.col("_d") == F.col("_nd")) & (F.col("_at_") == F.col("_nat"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_n{g}"))
    return rows.join(found, on, "left").select("_row.*", F.col("_nv").alias(valid), F.col("_nk").alias(known), F.col("_nx").alias(value))


def segments(points: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Neighbouring points as segments x0, y0, x1, y1 with the ends reaching out: low and high are null there."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(x)
    out = points.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lag(x).over(w).alias("_before"))
    out = out.where("x1 is not null")
    return out.withColumn("low", F.when(F.col("_before").isNotNull(), F.col("x0"))).withColumn("high", F.when(F.lead("x1").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("x0")).isNotNull(), F.col("x1"))).drop("_before")


def interpolate(queries: DataFrame, points: DataFrame, at: str, x: str, y: str, by: list[str] | None = None, flat: bool = False) -> DataFrame:
    """queries with `y` interpolated between the points of its group; beyond the ends along the end segments, or flat.

    A query takes the last segment that begins at or before it, by asof(), and the
    first of its group if there is none. A group of one point, or none, gives null, as
    does a null query. The points of a group (of all, without `by`) are ordered in one
    task: they are the quotes of a curve.
    """
    by = by or []
    parts = segments(points, x, y, by).select(*by, "x0", F.struct("x0", "y0", "x1", "y1").alias("_segment"), F.col("low").isNull().alias("_first"))
    found = asof(queries, parts, at, "x0", "_segment", by=by).drop("x0_asof")
    first = parts.where("_first").select(*by, F.col("_segment").alias("_start"))
    found = found.join(first, by, "left") if by else found.crossJoin(F.broadcast(first.agg(F.min("_start").alias("_start"))))  # one row
    s = F.when(F.col(at).isNotNull(), F.coalesce("_segment", "_start"))
    where = F.greatest(s["x0"], F.least(s["x1"], F.col(at))) if flat else F.col(at)
    value = s["y0"] + (s["y1"] - s["y0"]) * (where - s["x0"]) / (s["x1"] - s["x0"])
    return found.select(*queries.columns, value.alias(y))


def bilinear(queries: DataFrame, grid: DataFrame, strike: str, tenor: str, vol: str) -> DataFrame:
    """queries (strike, tenor) with the vol of a rectangular grid, clamped to its edges."""
    w_k, w_t = Window.orderBy("k"), Window.orderBy("t")
    ks = grid.select(F.col(strike).alias("k")).distinct().withColumn("k1", F.lead("k").over(w_k)).where("k1 is not null").withColumnRenamed("k", "k0")
    ts = grid.select(F.col(tenor).alias("t")).distinct().withColumn("t1", F.lead("t").over(w_t)).where("t1 is not null").withColumnRenamed("t", "t0")
    ends = grid.agg(F.min(strike).alias("kmin"), F.max(strike).alias("kmax"), F.min(tenor).alias("tmin"), F.max(tenor).alias("tmax"))
    q = queries.crossJoin(F.broadcast(ends))  # one row
    q = q.withColumn("_k", F.greatest("kmin", F.least("kmax", strike))).withColumn("_t", F.greatest("tmin", F.least("tmax", tenor)))
    q = q.join(if_small(ks), (F.col("_k") >= F.col("k0")) & ((F.col("_k") < F.col("k1")) | ((F.col("k1") == F.col("kmax")) & (F.col("_k") == F.col("kmax")))))
    q = q.join(if_small(ts), (F.col("_t") >= F.col("t0")) & ((F.col("_t") < F.col("t1")) | ((F.col("t1") == F.col("tmax")) & (F.col("_t") == F.col("tmax")))))
    for a in "01":
        for b in "01":
            corner = grid.select(F.col(strike).alias(f"k{a}"), F.col(tenor).alias(f"t{b}"), F.col(vol).alias(f"v{a}{b}"))
            q = q.join(corner, [f"k{a}", f"t{b}"], "left")
    u = (F.col("_k") - F.col("k0")) / (F.col("k1") - F.col("k0"))
    v = (F.col("_t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    value = (1 - u) * (1 - v) * F.col("v00") + u * (1 - v) * F.col("v10") + (1 - u) * v * F.col("v01") + u * v * F.col("v11")
    return q.select(*queries.columns, value.alias(vol))


def stitched(primary: DataFrame, older: DataFrame, day: str, by: list[str]) -> DataFrame:
    """primary with the rows of older from before its first day in each group."""
    first = primary.groupBy(*by).agg(F.min(day).alias("_first"))
    before = older.join(first, by, "left").where(F.col("_first").isNull() | (F.col(day) < F.col("_first"))).drop("_first")
    return before.unionByName(primary)


def overridden(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str, takes: Column) -> DataFrame:
    """primary with the value of secondary where `takes` holds, on the keys of primary."""
    other = secondary.select(*keys, F.col(value).alias("_other"))
    return primary.join(other, keys, "left").select(*keys, F.when(takes, F.col("_other")).otherwise(F.col(value)).alias(value))


def spread(a: DataFrame, b: DataFrame, keys: list[str], value: str, weight: float = 1.0) -> DataFrame:
    """a - weight * b on the keys that both have."""
    return a.join(b.withColumnRenamed(value, "_other"), keys).select(*keys, (F.col(value) - weight * F.col("_other")).alias(value))
