"""Probability models on Spark ML: prevalence, logistic regressions, boosted trees, out-of-fold calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import rate
from tidemark.functions.pin import pin
from tidemark.operators.isotonic import isotonic_blocks, isotonic_scores
from tidemark.operators.scoring import CATEGORICAL, LABEL, NUMERIC, STATIC_NUMERIC, feature_scaling_stats, temporal_folds

STATIC = [*CATEGORICAL, *STATIC_NUMERIC]
BEHAVIOURAL = [*CATEGORICAL, *NUMERIC]


class Preprocessor:
    """Imputation, missing flags, standardisation and one-hot encoding learnt from training rows only.

    The driver receives one statistics row per numeric feature (a fixed, small number).
    """

    def __init__(self, train: DataFrame, features: Sequence[str]):
        self.categorical = [f for f in features if f in CATEGORICAL]
        numeric = [f for f in features if f not in CATEGORICAL]
        self.stats = {r.feature: r for r in feature_scaling_stats(train, numeric).toLocalIterator()}
        self.numeric = numeric
        inputs = [f"{c}_oh" for c in self.categorical] + [f"{c}_z" for c in numeric] + [f"{c}_na" for c in numeric if self.stats[c].missing]
        stages = [
            StringIndexer(inputCols=self.categorical, outputCols=[f"{c}_ix" for c in self.categorical], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_ix" for c in self.categorical], outputCols=[f"{c}_oh" for c in self.categorical]),
            VectorAssembler(inputCols=inputs, outputCol="features"),
        ]
        self.pipeline = Pipeline(stages=stages).fit(self._scaled(train))

    def _scaled(self, df: DataFrame) -> DataFrame:
        def z(value: Column, mean: float, sd: float) -> Column:
            return (value - mean) / (sd or 1.0)

        cols = {}
        for c, s in self.stats.items():
            cols[f"{c}_z"] = z(F.coalesce(F.col(c).cast("double"), F.lit(s.median)), s.mean, s.stddev_pop)
            if s.missing:
                share = s.missing / (s.present + s.missing)
                cols[f"{c}_na"] = z(F.col(c).isNull().cast("double"), share, (share * (1 - share)) ** 0.5)
        return df.withColumns(cols)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self._scaled(df)).withColumn("label", F.col(LABEL).cast("double"))


def _probability(model, prepared: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    return model.transform(prepared).select(*keep, F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
                                            vector_to_array("probability")[1].alias("p"))


def fit_logistic(train: DataFrame, features: Sequence[str], c: float = 1.0):
    """L2 logistic regression with penalty weight 1 / (C n) on standardised inputs."""
    prep = Preprocessor(train, features)
    prepared = prep.apply(train)
    model = LogisticRegression(regParam=1.0 / (c * train.count()), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-8).fit(prepared)
    return prep, model


KEEP = ["subscription_id", "split"]


def penalised_gradient(prep: Preprocessor, model, train: DataFrame, c: float = 1.0) -> DataFrame:
    """(coefficient, value, gradient): the derivative of mean log loss plus penalty in each coefficient of a fit, the intercept at -1.

    One aggregate per coefficient over the training rows; all are near zero at the optimum.
    """
    n = train.count()
    scored = model.transform(prep.apply(train)).select("label", vector_to_array("probability")[1].alias("p"), vector_to_array("features").alias("x"))
    error = scored.select((F.col("p") - F.col("label")).alias("e"), "x")
    each = error.select(F.explode(F.array_append(F.transform("x", lambda v, i: F.struct(i.cast("int").alias("coefficient"), v.alias("v"))),
                                                 F.struct(F.lit(-1).alias("coefficient"), F.lit(1.0).alias("v")))).alias("t"), "e")
    sums = each.groupBy(F.col("t.coefficient").alias("coefficient")).agg((F.sum(F.col("e") * F.col("t.v")) / n).alias("loss"))
    weights = F.create_map(*[F.lit(x) for i, v in enumerate(model.coefficients.toArray().tolist()) for x in (i, v)], F.lit(-1), F.lit(float(model.intercept)))
    value = F.element_at(weights, F.col("coefficient"))
    penalty = F.when(F.col("coefficient") >= 0, value / (c * n)).otherwise(0.0)
    return sums.select("coefficient", value.alias("value"), (F.col("loss") + penalty).alias("gradient"))


def fit_invariants(split: DataFrame, folds: int = 5) -> DataFrame:
    """What must hold of any right fit, per model and the rows it was fitted on: the mean score equals the observed rate, scores lie in
    [0, 1], and no coefficient has a gradient left.

    The free intercept makes the first true of both logistic fits and of sigmoid calibration, pooling makes it true of isotonic calibration.
    """
    split = pin(split)
    tests = []
    for name, features, fitted_on in (("static_logistic", STATIC, ["train"]), ("behavioural_logistic", BEHAVIOURAL, ["train"]), ("behavioural_logistic_refit", BEHAVIOURAL, ["train", "validation"])):
        rows = split.where(F.col("split").isin(fitted_on))
        prep, model = fit_logistic(rows, features)
        steepest = penalised_gradient(prep, model, rows).agg(F.max(F.abs("gradient"))).scalar()
        tests.append((_probability(model, prep.apply(rows), KEEP, name).select("model", "label", "p"), steepest))
    oof = pin(out_of_fold_scores(temporal_folds(split.where(F.col("split") == "train"), folds), folds))
    for method in ("sigmoid", "isotonic"):
        own = calibrate(oof, oof).where(F.col("method") == method)
        tests.append((own.select(F.lit(f"{method}_calibration").alias("model"), "label", "p"), F.lit(0.0)))
    parts = [df.withColumn("steepest", g).groupBy("model").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("label").alias("observed_rate"), F.avg("p").alias("mean_score"),
        F.bool_and(F.col("p").between(0, 1)).alias("scores_in_range"), (F.max("steepest") < 1e-4).alias("gradient_vanishes")) for df, g in tests]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def logistic_scores(split: DataFrame, fit_on: Sequence[str] = ("train",), score: Sequence[str] = ("validation",)) -> DataFrame:
    """Static (8 features) and behavioural (16 features) logistic scores in long form."""
    split = pin(split)
    train = split.where(F.col("split").isin(*fit_on))
    target = split.where(F.col("split").isin(*score))
    out = []
    for name, features in (("static_logistic", STATIC), ("behavioural_logistic", BEHAVIOURAL)):
        prep, model = fit_logistic(train, features)
        out.append(_probability(model, prep.apply(target), KEEP, name))
    return out[0].unionByName(out[1])


def gbt_scores(split: DataFrame, score: Sequence[str] = ("validation",), iterations: int = 200) -> DataFrame:
    """Boosted trees in the role of the non-linear challenger (depth 4 stands in for 15 leaves)."""
    split = pin(split)
    train = split.where(F.col("split") == "train")
    prep = Preprocessor(train, BEHAVIOURAL)
    model = GBTClassifier(maxIter=iterations, stepSize=0.05, maxDepth=4, minInstancesPerNode=30, seed=42).fit(pin(prep.apply(train).select("features", "label")))
    return _probability(model, prep.apply(split.where(F.col("split").isin(*score))), KEEP, "gradient_boosting")


def prevalence_baseline(split: DataFrame) -> DataFrame:
    """Training conversion rate as a constant score, evaluated on every split."""
    prevalence = split.where(F.col("split") == "train").agg(rate(F.sum(LABEL), F.count(F.lit(1)))).scalar()
    y = F.col(LABEL)
    scored = split.withColumn("p", prevalence)
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("p").alias("prevalence"), rate(F.sum(y), F.count(F.lit(1))).alias("observed_rate"),
        F.avg(F.pow(F.col("p") - y, F.lit(2))).alias("brier_score"),
        (-F.avg(F.when(y == 1, F.ln("p")).otherwise(F.ln(1.0 - F.col("p"))))).alias("log_loss"))


def out_of_fold_scores(folded: DataFrame, folds: int = 5) -> DataFrame:
    """Behavioural logistic scores for each fold from a model fitted on everything before it."""
    folded = pin(folded)
    parts = []
    for k in range(1, folds + 1):
        prep, model = fit_logistic(folded.where(F.col("fold") < k), BEHAVIOURAL)
        parts.append(_probability(model, prep.apply(folded.where(F.col("fold") == k)), ["subscription_id", "fold"], "behavioural_logistic"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibrate(oof: DataFrame, scored: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Uncalibrated, sigmoid and isotonic versions of ``scored``, both learnt from out-of-fold scores."""
    clipped = F.least(F.greatest(F.col("p"), F.lit(epsilon)), F.lit(1.0 - epsilon))
    logit = VectorAssembler(inputCols=["logit"], outputCol="features")
    prepare = lambda df: logit.transform(df.withColumn("logit", F.ln(clipped / (1.0 - clipped))).withColumn("label", F.col("label").cast("double")))
    oof = pin(oof)
    sigmoid = LogisticRegression(regParam=0.0, maxIter=2000, tol=1e-8).fit(prepare(oof))
    base = scored.select("subscription_id", "label", "p")
    with_sigmoid = sigmoid.transform(prepare(base)).select(
        "subscription_id", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("p"), F.lit("sigmoid").alias("method"))
    with_isotonic = isotonic_scores(base, isotonic_blocks(oof)).select(
        "subscription_id", "label", F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(1.0)).alias("p"), F.lit("isotonic").alias("method"))
    return base.withColumn("method", F.lit("none")).unionByName(with_sigmoid).unionByName(with_isotonic)
