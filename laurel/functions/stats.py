"""Binomial bounds, correlations and smoothed trends as plain column algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binomial_quantiles(
    sizes: DataFrame, probs: Sequence[float], p: float = 0.2, column: str = "n"
) -> DataFrame:
    """Binomial(n, p) quantiles for every distinct n: columns ``q_<percent>``.

    The mass function is built relative to its first support point by the
    recurrence pmf(k) / pmf(k-1) = (n-k+1)/k * p/(1-p), in logarithms, on
    n*p +- 12 standard deviations (everything outside is below 1e-30), so the
    work per n grows with sqrt(n) only.
    """
    n, mean = F.col(column), F.col(column) * p
    spread = F.sqrt(F.col(column) * p * (1 - p)) * 12 + 12
    lo = F.greatest(F.floor(mean - spread), F.lit(0))
    hi = F.least(F.ceil(mean + spread), n)
    support = (
        sizes.select(F.col(column).cast("bigint").alias(column))
        .distinct()
        .select(column, lo.alias("lo"), F.explode(F.sequence(lo, hi)).alias("k"))
    )
    step = F.when(F.col("k") == F.col("lo"), F.lit(0.0)).otherwise(
        F.log((n - F.col("k") + 1) / F.greatest(F.col("k"), F.lit(1))) + F.log(F.lit(p / (1 - p)))
    )
    upto = Window.partitionBy(column).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(column)
    rel = support.withColumn("lw", F.sum(step).over(upto))
    rel = rel.withColumn("w", F.exp(F.col("lw") - F.max("lw").over(whole)))
    cdf = rel.withColumn("cdf", F.sum("w").over(upto) / F.sum("w").over(whole))
    return cdf.groupBy(column).agg(
        *[
            F.min(F.when(F.col("cdf") >= q, F.col("k"))).alias(quantile_name(q))
            for q in probs
        ]
    )


def quantile_name(q: float) -> str:
    return "q_" + f"{q * 100:g}".replace(".", "_")


def with_binomial_bounds(
    counts: DataFrame, column: str = "n", p: float = 0.2, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Add conf_low / conf_high: win-fraction bounds for a group of that size."""
    q = binomial_quantiles(counts, [low, high], p, column)
    size = F.col(column)
    return counts.join(q, column, "left").select(
        *counts.columns,
        F.round(F.col(quantile_name(low)) / size, 6).alias("conf_low"),
        F.round(F.col(quantile_name(high)) / size, 6).alias("conf_high"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; NULL where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    # Summation noise leaves a tiny spread on constant input: treat it as zero.
    return F.when(spread > 1e-12, F.covar_pop(a, b) / spread)


def correlation_by(df: DataFrame, keys: Sequence[Column | str], features: Sequence[str], target: str) -> DataFrame:
    cast = lambda c: F.col(c).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(pearson(cast(f), cast(target)), 6).alias(f"{f}_corr") for f in features],
    )


def _by_period(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, "period")
        .agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    )


def moving_mean(df: DataFrame, value: str, groups: Sequence[str], half_width: int) -> DataFrame:
    """Mean over the periods within ``half_width``, per group.

    Rows are reduced to sums per (group, period) before the range window.
    """
    around = (
        Window.partitionBy(*groups).orderBy("period").rangeBetween(-half_width, half_width)
    )
    return _by_period(df, value, groups).select(
        *groups,
        "period",
        F.round(F.sum("s").over(around) / F.sum("c").over(around), 6).alias("trend"),
    )


def local_linear(df: DataFrame, value: str, groups: Sequence[str], bandwidth: int) -> DataFrame:
    """Locally weighted straight-line fit (tricube weights) at every period of a group.

    Closed form from five weighted sums, over the (group, period) table only.
    """
    points = _by_period(df, value, groups)
    near = points.withColumn(
        "at", F.explode(F.sequence(F.col("period") - bandwidth + 1, F.col("period") + bandwidth - 1))
    )
    u = F.abs(F.col("period") - F.col("at")) / float(bandwidth)
    w = F.pow(1 - F.pow(u, 3), 3)
    dx = (F.col("period") - F.col("at")).cast("double")
    sums = near.groupBy(*groups, F.col("at").alias("period")).agg(
        F.sum(w * F.col("c")).alias("sw"),
        F.sum(w * F.col("c") * dx).alias("swx"),
        F.sum(w * F.col("c") * dx * dx).alias("swxx"),
        F.sum(w * F.col("s")).alias("swy"),
        F.sum(w * F.col("s") * dx).alias("swxy"),
    )
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    fit = (F.col("swxx") * F.col("swy") - F.col("swx") * F.col("swxy")) / det
    flat = F.col("swy") / F.col("sw")
    fitted = sums.select(
        *groups, "period", F.round(F.when(det > 1e-9, fit).otherwise(flat), 6).alias("trend")
    )
    return fitted.join(points.select(*groups, "period"), [*groups, "period"], "left_semi")
