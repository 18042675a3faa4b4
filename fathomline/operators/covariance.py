"""Mean-reverting factor models as tables: covariances, shifts and numeraire changes.

Factor i of an underlying loads a forward of start T and length D, at time t, with
sigma_i exp(-alpha_i (T - t)) (1 - exp(-alpha_i D)) / (alpha_i D). A factor may
serve several underlyings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.bounds import if_small


def full_rho(upper: DataFrame) -> DataFrame:
    """All pairs (i, j, rho) from those above the diagonal."""
    other = upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "rho")
    names = upper.select("i").union(upper.select(F.col("j").alias("i"))).distinct()
    return upper.select("i", "j", "rho").unionByName(other).unionByName(names.select("i", F.col("i").alias("j"), F.lit(1.0).alias("rho")))


def integral(rho: Column, a: Column, t: Column) -> Column:
    """rho times the integral of exp(-a u) from 0 to t; its limits for small a and endless t."""
    return rho * F.when(a < 1e-12, t).when(t == float("inf"), 1 / a).otherwise(-F.expm1(-a * t) / a)


def loading(sigma: Column, alpha: Column, t: Column, start: Column, length: Column) -> Column:
    x = alpha * length
    return sigma * F.exp(-alpha * (start - t)) * F.when(F.abs(x) < 1e-12, 1.0).otherwise(-F.expm1(-x) / x)


@dataclass(frozen=True)
class Factors:
    """factors (idx, sigma, alpha), bridge (idx, lsu), rho (i, j, rho) for all pairs."""

    factors: DataFrame
    bridge: DataFrame
    rho: DataFrame

    def pairs(self) -> DataFrame:
        """(lsu1, lsu2, sigma1, alpha1, sigma2, alpha2, rho): one row for each pair of factors; small."""
        own = self.factors.join(self.bridge, "idx")
        a = own.select(F.col("idx").alias("i"), F.col("lsu").alias("lsu1"), F.col("sigma").alias("sigma1"), F.col("alpha").alias("alpha1"))
        b = own.select(F.col("idx").alias("j"), F.col("lsu").alias("lsu2"), F.col("sigma").alias("sigma2"), F.col("alpha").alias("alpha2"))
        return self.rho.join(a, "i").join(b, "j").drop("i", "j")

    def covariances(self, asked: DataFrame, instant: bool = False) -> DataFrame:
        """asked (lsu1, lsu2, t, t1, d1, t2, d2, …) with cov: over time t, or per unit of time now if instant."""
        t = F.lit(0.0) if instant else F.col("t")

        def part(p: Column) -> Column:
            weight = p["rho"] if instant else integral(p["rho"], p["alpha1"] + p["alpha2"], F.col("t"))
            return loading(p["sigma1"], p["alpha1"], t, F.col("t1"), F.col("d1")) * weight * loading(p["sigma2"], p["alpha2"], t, F.col("t2"), F.col("d2"))

        lists = self.pairs().groupBy("lsu1", "lsu2").agg(F.collect_list(F.struct("sigma1", "alpha1", "sigma2", "alpha2", "rho")).alias("_p"))
        total = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + part(p))
        return asked.join(lists, ["lsu1", "lsu2"], "left").select(*asked.columns, total.alias("cov"))

    def correlations(self, asked: DataFrame, instant: bool = False) -> DataFrame:
        """asked (columns as for covariances(), none starting with _) with cov, vol1, vol2 (yearly) and corr; equal rows stay rows of their own."""
        out = asked
        for kind, (x, y) in {"_12": ("1", "2"), "_11": ("1", "1"), "_22": ("2", "2")}.items():
            pair = {f"{c}{k}": F.col(f"{c}{own}") for c in ("lsu", "t", "d") for k, own in (("1", x), ("2", y))}
            own = out.select("*", F.struct(*[F.col(c) for c in asked.columns]).alias("_own")).withColumns(pair)
            own = self.covariances(own, instant)
            out = own.select("_own.*", *[c for c in out.columns if c.startswith("_")], F.col("cov").alias(kind))
        span = F.lit(1.0) if instant else F.col("t")
        corr = F.try_divide(F.col("_12"), F.sqrt(F.col("_11") * F.col("_22")))
        return out.select(*asked.columns, F.col("_12").alias("cov"), F.sqrt(F.col("_11") / span).alias("vol1"), F.sqrt(F.col("_22") / span).alias("vol2"), corr.alias("corr"))

    def scale_sigma(self, lsu: str, factor: float) -> Factors:
        own = self.bridge.where(F.col("lsu") == lsu).select("idx", F.lit(factor).alias("_x"))
        new = self.factors.join(if_small(own), "idx", "left").withColumn("sigma", F.col("sigma") * F.coalesce("_x", F.lit(1.0))).drop("_x")
        return replace(self, factors=new)

    def override_sigma(self, idx: int, sigma: float) -> Factors:
        return replace(self, factors=self.factors.withColumn("sigma", F.when(F.col("idx") == idx, sigma).otherwise(F.col("sigma"))))

    def _ordered(self) -> DataFrame:
        """(idx, lsu, k): place of a factor in its underlying, slowest first."""
        w = Window.partitionBy("lsu").orderBy("alpha", "idx")
        return self.factors.join(self.bridge, "idx").withColumn("k", F.row_number().over(w)).select("idx", "lsu", "k")

    def indices(self) -> DataFrame:
        return self._ordered()

    def factor_counts(self) -> DataFrame:
        return self.bridge.groupBy("lsu").agg(F.count("*").alias("n"))

    def shift_third(self, lsu: str, shift: float) -> Factors:
        """Add to the volatility of an underlying's third factor, if it has one."""
        own = self._ordered().where((F.col("lsu") == lsu) & (F.col("k") == 3)).select("idx", F.lit(shift).alias("_x"))
        return replace(self, factors=self.factors.join(if_small(own), "idx", "left").withColumn("sigma", F.col("sigma") + F.coalesce("_x", F.lit(0.0))).drop("_x"))

    def first_factors(self, n: int = 2) -> Factors:
        """The n slowest factors of each underlying only."""
        keep = self._ordered().where(F.col("k") <= n).select("idx").distinct()
        rho = self.rho.join(if_small(keep.withColumnRenamed("idx", "i")), "i", "left_semi").join(if_small(keep.withColumnRenamed("idx", "j")), "j", "left_semi").select("i", "j", "rho")
        return Factors(self.factors.join(if_small(keep), "idx", "left_semi"), self.bridge.join(if_small(keep), "idx", "left_semi"), rho)

    def shift_rho(self, lsu1: str, lsu2: str, shift: float, same: float = 0.9998) -> Factors:
        """Add to the correlations between the factors of two underlyings; factors correlated above `same` with one of these move with it."""
        def owned(lsu: str, name: str) -> DataFrame:
            own = self.bridge.where(F.col("lsu") == lsu).select(F.col("idx").alias("j"))
            alike = self.rho.where(F.col("rho") > same).join(own, "j").select(F.col("i").alias(name)).distinct()
            return alike.withColumn(f"_{name}{lsu}", F.lit(True))

        out = self.rho
        for name in ("i", "j"):
            for lsu in (lsu1, lsu2):
                out = out.join(if_small(owned(lsu, name)), name, "left")
        across = (F.col(f"_i{lsu1}") & F.col(f"_j{lsu2}")) | (F.col(f"_i{lsu2}") & F.col(f"_j{lsu1}"))
        moved = F.coalesce(across, F.lit(False)) & (F.col("rho") <= same)
        return replace(self, rho=out.select("i", "j", F.when(moved, F.col("rho") + shift).otherwise(F.col("rho")).alias("rho")))

    def pull_rho(self, shift: float) -> Factors:
        """All correlations towards 1 by a share."""
        return replace(self, rho=self.rho.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("rho")).otherwise(F.col("rho") * (1 - shift) + shift).alias("rho")))

    def inverted(self, idx: int) -> Factors:
        """A currency factor seen from the other currency: its correlations change sign."""
        turned = (F.col("i") == idx) != (F.col("j") == idx)
        return replace(self, rho=self.rho.select("i", "j", F.when(turned, -F.col("rho")).otherwise(F.col("rho")).alias("rho")))

    def problems(self) -> DataFrame:
        """What is wrong with the tables, one row each: bad diagonal, asymmetry, a correlation beyond 1, a factor that an underlying has twice."""
        a, b = self.rho, self.rho.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("rho").alias("_other"))
        bad = a.join(b, ["i", "j"], "left").select(
            F.when((F.col("i") == F.col("j")) & (F.abs(F.col("rho") - 1) > 1e-6), "diagonal").when(F.col("_other").isNull() | (F.abs(F.col("rho") - F.col("_other")) > 1e-6), "asymmetric").when(F.abs("rho") > 1 + 1e-6, "beyond one").alias("problem"), F.concat_ws("-", "i", "j").alias("at")
        )
        twice = self.bridge.groupBy("idx", "lsu").count().where("count > 1").select(F.lit("factor twice").alias("problem"), F.concat_ws("-", "idx", "lsu").alias("at"))
        return bad.where("problem is not null").unionByName(twice)


def triangulated(vol1: Column, vol2: Column, rho: Column) -> Column:
    """Volatility of the product of two exchange rates."""
    return F.sqrt(vol1 * vol1 + vol2 * vol2 + 2 * rho * vol1 * vol2)


def ratio_vol(vol1: Column, vol2: Column, rho: Column) -> Column:
    """Volatility of the ratio of two forwards."""
    return F.sqrt(F.greatest(F.lit(0.0), vol1 * vol1 + vol2 * vol2 - 2 * rho * vol1 * vol2))
