"""Quantiles of many groups in one pass, by mergeable sketches, and modelled distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.normal import norm_ppf
from fathomline.operators import montecarlo as mc

#: Size of a sketch: the larger, the more exact (8 to 65535).
SIZE = 1000


def rank_error(size: int = SIZE) -> float:
    """How far the rank of an estimated quantile is off, at most, in 99 of 100 cases: the published bound of KLL sketches for one quantile."""
    return 2.296 / size**0.9021


def sketched(rows: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """(by, sketch): a KLL sketch of the values of each group; nulls don't count, and a group without values has an empty sketch.

    Tasks make sketches of what they read and these are merged, so a group of any size
    costs a few kilobytes for each task, and no task has its values.
    """
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """(by, sketch) of sketches made apart: of other days, or of finer groups."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches with n and an array `quantiles` for the shares (0 to 1) in place of the sketch; null where there were no values."""
    n = F.kll_sketch_get_n_double("sketch")
    asked = F.array(*[F.lit(s) for s in shares])
    out = sketches.withColumn("n", n)
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked))
    return out.withColumn("quantiles", found).drop("sketch")


def modelled(models: DataFrame, by: list[str], x: str, n: int, seed: int | None = None) -> DataFrame:
    """(by, path, x): n draws of each model's distribution, a bounded normal with jumps.

    models: by, and for a name x: x_low, x_high, x_mean, x_sd, x_chance, x_jump,
    x_jump_sd. Every model has the same draws. A null in a model gives null draws.
    """
    c = F.col
    rows = mc.with_truncated(mc.deal_paths(mc.with_bounds(models, x), n, 3, seed), {x: "u0"})
    jump = F.when(c("u1") < c(f"{x}_chance"), c(f"{x}_jump") + c(f"{x}_jump_sd") * norm_ppf(c("u2"))).otherwise(0.0)
    return rows.withColumn("_jump", jump).select(*by, "path", (c(x) + c("_jump")).alias(x))


def shares(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, share): shares of values in equal bins from low to high; the last bin takes its upper end, values beyond are in none but count in the whole."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.when(F.col(value).between(low, high), at).alias("bin")).agg(F.count("*").alias("_n"))
    whole = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    return counted.join(whole, by).where("bin is not null").select(*by, "bin", (F.col("_n") / F.col("_all")).alias("share"))
