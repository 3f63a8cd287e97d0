"""Classifiers fitted by the engine's own library, alone, stacked and blended over horizons.

Fits are distributed; what reaches the driver are models and a few sums. Probabilities are columns, so a model is
applied where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzbar.operators.models import centroid_probability, fit_centroids

#: A fitted model: rows -> rows with a column of probabilities (of class 1, or an array by class).
Applied = Callable[[DataFrame, str], DataFrame]

# Trees and step of the boosted trees; shares of the rows, in order of time, that fit the base
# models and the model over them.
TREES, STEP = 80, 0.05
BASE_SHARE, META_SHARE = 0.6, 0.8
LEAST_ROWS = 200
#: Names that no column of the rows has.
_COLUMNS = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_hat"}


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as one vector; what is missing counts as 0."""
    clean = [F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(features)]
    wide = rows.select("*", *clean)
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(wide).drop(*(f"_f{i}" for i in range(len(features))))


def _applied(model, features: list[str], array: bool = False) -> Applied:
    def apply(rows: DataFrame, name: str) -> DataFrame:
        kept = rows.columns
        p = vector_to_array("_p")
        out = model.transform(_assembled(rows, features))
        return out.select(*kept, (p if array else F.get(p, F.lit(1))).alias(name))

    return apply


def fit_trees(rows: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = TREES, step: float = STEP, depth: int = 4) -> Applied:
    """Boosted trees for two classes."""
    data = _assembled(rows.where(F.col(label).isNotNull()), features).withColumn("_y", F.col(label).cast("double"))
    options = {"weightCol": weight} if weight else {}
    gbt = GBTClassifier(maxIter=trees, stepSize=step, maxDepth=depth, seed=7, **_COLUMNS, **options).setProbabilityCol("_p").setRawPredictionCol("_r")
    return _applied(gbt.fit(data), features)


def fit_logistic(rows: DataFrame, features: list[str], label: str, weight: str | None = None) -> Applied:
    data = _assembled(rows.where(F.col(label).isNotNull()), features).withColumn("_y", F.col(label).cast("double"))
    options = {"weightCol": weight} if weight else {}
    return _applied(LogisticRegression(probabilityCol="_p", rawPredictionCol="_r", **_COLUMNS, regParam=1e-3, **options).fit(data), features)


def fit_classes(rows: DataFrame, features: list[str], label: str, classes: list[str]) -> Applied:
    """Multinomial regression; the probabilities stand in the order of ``classes``, whatever order the rows come in."""
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    data = _assembled(rows.where(F.col(label).isin(*classes)), features).withColumn("_y", place.cast("double"))
    # Classes without a row have a probability, too.
    padded = LogisticRegression(probabilityCol="_p", rawPredictionCol="_r", **_COLUMNS, family="multinomial", regParam=1e-3).fit(data)
    missing = len(classes) - padded.numClasses
    apply = _applied(padded, features, array=True)
    if not missing:
        return apply
    return lambda rows, name: apply(rows, name).withColumn(name, F.concat(F.col(name), F.array_repeat(F.lit(0.0), missing)))


def fit_centroid(rows: DataFrame, features: list[str], label: str) -> Applied:
    model = fit_centroids(rows, features, label)
    return lambda rows, name: rows.withColumn(name, centroid_probability(model))


def fit_first(rows: DataFrame, features: list[str], label: str, families: tuple[str, ...] = ("trees", "logistic", "centroid")) -> tuple[str, Applied]:
    """(family, model) of the first family that can be fitted; with one class only the centroids can."""
    both = rows.agg(F.count_distinct(label)).first()[0] == 2
    fits = {"trees": fit_trees, "logistic": fit_logistic, "centroid": fit_centroid}
    for family in families:
        if family not in fits:
            raise ValueError(f"unknown family {family}")
        if both or family == "centroid":
            return family, fits[family](rows, features, label)
    raise ValueError("no family can be fitted to one class")


def fit_stacked(rows: DataFrame, features: list[str], order: str, direction: str, profitability: str, base: Callable[..., Applied] = fit_trees) -> Applied:
    """A logistic over two base models (direction, profitability) of the first rows in order of time; it is fitted to the rows after them.

    The cuts are exact places in the order (a number column); the last fifth is kept for validation.
    """
    from quartzbar.operators.asof import percentiles

    n = rows.count()
    if n < LEAST_ROWS:
        raise ValueError(f"stacking needs {LEAST_ROWS} rows")
    cuts = percentiles(rows.select(F.lit(0).alias("k"), order), "k", {"a": (order, (int(n * BASE_SHARE) - 1) / (n - 1)), "b": (order, (int(n * META_SHARE) - 1) / (n - 1))}).first()
    first = rows.where(F.col(order) <= cuts.a + 1e-6)
    later = rows.where((F.col(order) > cuts.a + 1e-6) & (F.col(order) <= cuts.b + 1e-6))
    d, p = base(first, features, direction), base(first, features, profitability)
    both = lambda r: p(d(r, "_pd"), "_pp")
    meta = fit_logistic(both(later), ["_pd", "_pp"], profitability)
    return lambda r, name: meta(both(r), name).drop("_pd", "_pp")


def accuracy_edges(scored: DataFrame, horizons: dict[int, tuple[str, str]]) -> dict[int, float]:
    """horizon -> weight of its model: how far its hit rate is above a half, at least nothing; all alike if none is above.

    horizons gives the columns (probability, label) of each.
    """
    aggs = [F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y).cast("int")).cast("double")).alias(f"a{h}") for h, (p, y) in horizons.items()]
    row = scored.agg(*aggs).first()
    edges = {h: max(0.0, (row[f"a{h}"] or 0.0) - 0.5) for h in horizons}
    return edges if sum(edges.values()) > 0 else dict.fromkeys(horizons, 1.0)


def blended(models: dict[int, Applied], weights: dict[int, float]) -> Applied:
    """The weighted mean of the probabilities of models of several horizons, within 0 and 1."""
    if set(models) != set(weights) or not models:
        raise ValueError("each horizon needs a model and a weight")
    total = sum(weights.values())
    if not all(w >= 0 and w == w and w != float("inf") for w in weights.values()) or total <= 0:
        raise ValueError("weights must be finite, not negative and have a positive sum")

    def apply(rows: DataFrame, name: str) -> DataFrame:
        out, mean = rows, F.lit(0.0)
        for h, model in models.items():
            out = model(out, f"_h{h}")
            mean = mean + F.col(f"_h{h}") * (weights[h] / total)
        return out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).drop(*(f"_h{h}" for h in models))

    return apply
