"""Models of the reference surface that need no library: centroid classifier, calibration, weighted average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_centroids(rows: DataFrame, features: list[str], label: str) -> dict[str, tuple[float, float, float, float]]:
    """feature -> (mean of class 1, mean of class 0, scale, 0): one aggregation; one row reaches the driver."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(F.when(F.col(label) == 1, x)).alias(f"{f}_1"), F.avg(F.when(F.col(label) == 0, x)).alias(f"{f}_0"), F.stddev_pop(x).alias(f"{f}_s")]
    r = rows.agg(*aggs).first()
    value = lambda n: float(r[n]) if r is not None and r[n] is not None else 0.0
    return {f: (value(f"{f}_1"), value(f"{f}_0"), value(f"{f}_s"), 0.0) for f in features}


def centroid_probability(model: dict[str, tuple[float, float, float, float]], columns: dict[str, Column] | None = None) -> Column:
    """Probability of class 1: a logistic of the projection on the line between the centroids, from their middle."""
    columns = columns or {f: F.col(f) for f in model}
    z = F.lit(0.0)
    for f, (a, b, s, _) in model.items():
        if s > 1e-9 * max(1.0, abs(a), abs(b)):
            x = F.coalesce(columns[f].cast("double"), F.lit((a + b) / 2))
            z = z + (a - b) / (s * s) * (x - (a + b) / 2)
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))
    return 1 / (1 + F.exp(-z))


def fit_platt(rows: DataFrame, p: str, label: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic on the logit of p, fitted by Spark's own solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    safe = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    data = rows.select(array_to_vector(F.array(F.log(safe / (1 - safe)))).alias("features"), F.col(label).cast("double").alias("label"))
    m = LogisticRegression(regParam=1e-4, maxIter=50).fit(data)
    return float(m.coefficients[0]), float(m.intercept)


def platt_probability(p: str, slope: float, intercept: float) -> Column:
    safe = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(slope * F.log(safe / (1 - safe)) + intercept)))


def fit_beta(rows: DataFrame, p: str, label: str) -> tuple[float, float, float]:
    """(a, b, c) of a logistic on log p and log (1 - p), fitted by Spark's own solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    safe = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    data = rows.select(array_to_vector(F.array(F.log(safe), F.log(1 - safe))).alias("features"), F.col(label).cast("double").alias("label"))
    m = LogisticRegression(regParam=1e-4, maxIter=50).fit(data)
    return float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept)


def beta_probability(p: str, a: float, b: float, c: float) -> Column:
    safe = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(a * F.log(safe) + b * F.log(1 - safe) + c)))


#: Fixed value: positives from which a beta calibration is fitted.
BETA_FROM = 200


def fit_calibration(rows: DataFrame, p: str, label: str) -> tuple[str, Column]:
    """(method, calibrated probability): platt below BETA_FROM positives, else beta."""
    positives = rows.agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()[0]
    if positives < BETA_FROM:
        return "platt", platt_probability(p, *fit_platt(rows, p, label))
    return "beta", beta_probability(p, *fit_beta(rows, p, label))


def weighted_average(parts: dict[str, float]) -> Column:
    """Average of probabilities by weights; their plain mean if the weights have no sum above zero."""
    total = sum(parts.values())
    if total <= 0:
        parts, total = dict.fromkeys(parts, 1.0), float(len(parts))
    out = F.lit(0.0)
    for name, w in parts.items():
        out = out + F.col(name) * (w / total)
    return out
