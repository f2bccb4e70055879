"""p-values and q-values as column expressions, and the same sums as SQL text.

Two-sided p of Student's t for whole degrees of freedom is a finite sum of powers of a
cosine; of the normal law, a series of positive terms. Both run inside one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PI = 3.141592653589793


def _terms(count: Column, first: Column, ratio) -> Column:
    """first + first * ratio(1) + first * ratio(1) * ratio(2) + ..., ``count`` terms."""
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * ratio(k)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    # sequence(1, 0) would count down: an empty one is asked for plainly
    ks = F.when(count > 1, F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(count < 1, F.lit(0.0)).otherwise(F.aggregate(ks, start, step)["total"])


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of ``t`` with ``df`` degrees of freedom; 1 where df is not positive."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    sin, cos2 = F.sin(angle), F.cos(angle) * F.cos(angle)
    even = sin * _terms(F.floor(df / 2).cast("int"), F.lit(1.0), lambda k: cos2 * (2 * k - 1) / (2 * k))
    odd = 2 / _PI * (angle + sin * F.cos(angle) * _terms(F.floor((df - 1) / 2).cast("int"), F.lit(1.0), lambda k: cos2 * (2 * k) / (2 * k + 1)))
    return F.when(df <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 0, even).otherwise(odd)))


def student_p_sql(t: str, df: str) -> str:
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({angle}), 2 * k)))"
    odd = f"2 / pi() * ({angle} + coalesce(list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * sin({angle}) * pow(cos({angle}), 2 * k + 1))), 0))"
    return f"CASE WHEN {df} <= 0 THEN 1 ELSE greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END) END"


def normal_p(z: Column) -> Column:
    """Two-sided p of ``z``; 0 beyond eight, where it is under 1e-14."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    erf = 2 / F.sqrt(F.lit(_PI)) * F.exp(-x * x) * _terms(F.lit(200), x, lambda k: 2 * x * x / (2 * k + 1))
    return F.when(F.abs(z) > 8, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - erf))


def normal_p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    # x ** (2n+1) 2 ** n / (2n+1)!!, by logarithms
    term = f"exp(n * ln(2) + (2 * n + 1) * ln(greatest({x}, 1e-300)) - ((n + 1) * ln(2) + lgamma(n + 1.5) - ln(pi()) / 2))"
    return f"CASE WHEN abs({z}) > 8 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 200), lambda n: {term}))) END"


def correlation_p(r: Column, df: Column) -> Column:
    """p of a Pearson r under t with ``df`` degrees of freedom; 0 at |r| = 1."""
    t = r * F.sqrt(F.greatest(df, F.lit(0)) / (1 - r * r))
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(student_p(t, df))


def correlation_p_sql(r: str, df: str) -> str:
    return f"CASE WHEN abs({r}) >= 1 THEN 0 ELSE {student_p_sql(f'({r} * sqrt(greatest({df}, 0) / (1 - {r} * {r})))', df)} END"


def effective_n(n: Column, r1x: Column, r1y: Column) -> Column:
    """n (1 - r1x r1y) / (1 + r1x r1y) where the product is positive, held to [5, n]; else n."""
    product = r1x * r1y
    smaller = F.greatest(F.lit(5.0), F.least(n * (1 - product) / (1 + product), n.cast("double")))
    return F.when(product > 0, smaller).otherwise(n.cast("double"))


def with_q(df: DataFrame, family: list[str], tie: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q within each family of tests (a family is a handful of rows)."""
    up = Window.partitionBy(*family).orderBy(p, *tie)
    whole = Window.partitionBy(*family)
    ranked = df.withColumn("_raw", F.col(p) * F.count("*").over(whole) / F.row_number().over(up))
    down = Window.partitionBy(*family).orderBy(F.desc(p), *[F.desc(c) for c in tie])
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_raw")


def with_q_sql(source: str, family: str, tie: str) -> str:
    """SELECT that adds q to the rows of ``source``."""
    return f"""SELECT * EXCLUDE (raw), least(1, min(raw) OVER (PARTITION BY {family} ORDER BY p DESC, {tie} DESC ROWS UNBOUNDED PRECEDING)) AS q
FROM (SELECT *, p * count(*) OVER (PARTITION BY {family}) / row_number() OVER (PARTITION BY {family} ORDER BY p, {tie}) AS raw FROM {source})"""
