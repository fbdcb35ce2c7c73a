"""Training, tuning and finalising tree models with pyspark.ml."""

from __future__ import annotations

import json
import random
from functools import reduce
from operator import add

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glint.operators import metrics
from glint.operators.stats import scale_fit, scaled, standard_scale
from glint.sources import written

#: Up to this many rates are broadcast.
FEW = 1 << 16


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def pca(df: DataFrame, cols: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Centred components pc1.. and the shares of variance they explain."""
    data = assembled(standard_scale(df, cols), cols)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    out = model.transform(data).withColumn("pc", vector_to_array("pc"))
    return out.select("*", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)]).drop("features", "pc"), model.explainedVariance.toArray().tolist()


def forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", seed=42, **params)


def boosted(early_stop: bool = False, **params) -> GBTClassifier:
    est = GBTClassifier(labelCol="y", seed=42, **params)
    return est.setValidationIndicatorCol("validation") if early_stop else est


def scored(model, df: DataFrame) -> DataFrame:
    """Class and probability of 1."""
    return model.transform(df).withColumn("p1", vector_to_array("probability")[1]).withColumn("yhat", F.col("prediction").cast("int"))


def random_params(est: Estimator, space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n draws: ("int", lo, hi) excludes hi, ("uniform", lo, width), ("log", lo, hi), ("choice", values...); subsampling is capped at 1."""
    rng = random.Random(seed)
    draw = {"int": lambda a, b: rng.randrange(a, b), "uniform": lambda a, w: min(1.0, rng.uniform(a, a + w)), "log": lambda a, b: a * (b / a) ** rng.random(), "choice": lambda *v: rng.choice(v)}
    return [{getattr(est, name): draw[kind](*args) for name, (kind, *args) in space.items()} for _ in range(n)]


def search(df: DataFrame, est: Estimator, candidates: list[dict], fold: str = "fold", parallelism: int = 2):
    """Cross-validated search over candidates on given folds by area under ROC."""
    evaluator = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction", numBins=0)
    folds = df.agg(F.max(fold)).first()[0] + 1
    return CrossValidator(estimator=est, estimatorParamMaps=candidates, evaluator=evaluator, numFolds=folds, foldCol=fold, parallelism=parallelism, seed=42).fit(df)


def grid(est: Estimator, values: dict[str, list]) -> list[dict]:
    out = ParamGridBuilder()
    for name, v in values.items():
        out = out.addGrid(getattr(est, name), v)
    return out.build()


def importances(model, cols: list[str]) -> DataFrame:
    spark = SparkSession.active()
    return spark.createDataFrame(list(zip(cols, model.featureImportances.toArray().tolist(), strict=True)), "feature string, importance double")


def finalise(est: Estimator, params: dict, full: DataFrame):
    """The same parameters fitted on the larger set."""
    return est.copy(params).fit(full)


def tree_stats(model) -> list[tuple[int, int, int]]:
    """(tree, depth, leaves)."""
    return [(i, t.depth, (t.numNodes + 1) // 2) for i, t in enumerate(model.trees)]


def cumulative_variance(df: DataFrame, cols: list[str], k: int = 50) -> DataFrame:
    """component, share and cumulative share of the variance of the scaled columns, for the first k components (all, if fewer)."""
    _, shares = pca(df, cols, min(k, len(cols)))
    rows, total = [], 0.0
    for i, v in enumerate(shares, 1):
        total += v
        rows.append((i, float(v), total))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")  # k rows


def selected(df: DataFrame, cols: list[str], share: float = 0.4) -> list[str]:
    """The ``share`` of the columns that tell the label best (F test), in their order."""
    est = UnivariateFeatureSelector(featuresCol="features", labelCol="y", outputCol="chosen", selectionMode="percentile").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(share)
    return [cols[i] for i in sorted(est.fit(assembled(df, cols)).selectedFeatures)]


def params_of(model) -> dict[str, object]:
    """The parameters that were set, by name."""
    return {p.name: v for p, v in model.extractParamMap().items() if model.isSet(p) and isinstance(v, (bool, int, float, str))}


def save(model, path: str, scale: DataFrame | None = None) -> None:
    """Model, parameters (JSON) and, if given, the row of ``stats.scale_fit``, below ``path``; what was there is replaced."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(params_of(model), sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/params")
    if scale is not None:
        scale.write.mode("overwrite").parquet(f"{path}/scale")


def load(path: str) -> tuple:
    """(model, parameters) as ``save`` wrote them; ``load_scale`` reads the scaler."""
    spark = SparkSession.active()
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), json.loads(spark.read.text(f"{path}/params").first()[0])


def load_scale(path: str) -> DataFrame:
    return SparkSession.active().read.parquet(f"{path}/scale")


def finalise_saved(path: str, est: Estimator, full: DataFrame, cols: list[str], rescale: bool = True):
    """The saved parameters fitted on the larger set, scaled by its own fit or by the saved one. (model, importances before and after)."""
    old, params = load(path)
    fit = scale_fit(full, cols) if rescale else load_scale(path)
    data = assembled(scaled(full, fit, cols), cols)
    new = finalise(est, {getattr(est, k): v for k, v in params.items() if est.hasParam(k)}, data)
    both = importances(old, cols).withColumnRenamed("importance", "base").join(importances(new, cols).withColumnRenamed("importance", "final"), "feature")
    return new, both.withColumn("change", F.col("final") - F.col("base"))


# ---- comparing and blending models -----------------------------------------------------------------------------------


def out_of_fold(df: DataFrame, keys: list[str], models: dict[str, Estimator], fold: str = "fold") -> DataFrame:
    """keys, y, fold, model and p1 of each row and model, said by the fit that didn't see the row's fold; written once for all readers."""
    data = written.write(df, "folds")
    parts = []
    for k in range((data.agg(F.max(fold)).first()[0] or 0) + 1):
        for name, est in models.items():
            said = scored(est.fit(data.where(F.col(fold) != k)), data.where(F.col(fold) == k))
            parts.append(said.select(*keys, "y", fold, F.lit(name).alias("model"), "p1"))
    out = written.write(reduce(DataFrame.unionByName, parts), "out-of-fold")
    written.delete(data)
    return out


def _cases(df: DataFrame, keys: list[str], y: str, cols: list[str], fold: str) -> DataFrame:
    """keys, y, fold, model (the column's name) and _v (its value, as a string)."""
    cases = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("string").alias("_v")) for c in cols])
    return df.select(*keys, F.col(y).alias("y"), fold, F.explode(cases).alias("_c")).select(*keys, "y", fold, "_c.*")


def rates(df: DataFrame, y: str, cols: list[str], fold: str = "fold") -> DataFrame:
    """_m (a column), _w (a value of it), _f and p1: how often y was 1 among the rows of other folds than _f with the value (0.5 without any)."""
    own = _cases(df, [], y, cols, fold).groupBy("model", "_v", fold).agg(F.sum("y").alias("_s"), F.count("*").alias("_n"))
    value = Window.partitionBy("model", "_v")  # a row for each fold
    rate = F.coalesce(F.try_divide((F.sum("_s").over(value) - F.col("_s")).cast("double"), F.sum("_n").over(value) - F.col("_n")), F.lit(0.5))
    return own.select(F.col("model").alias("_m"), F.col("_v").alias("_w"), F.col(fold).alias("_f"), rate.alias("p1"))


def bucket_rates(df: DataFrame, keys: list[str], y: str, cols: list[str], fold: str = "fold", known: DataFrame | None = None) -> DataFrame:
    """The same table for the models that say, for each column, how often y was 1 among the rows of the other folds with the row's value (0.5 without any).

    ``known``: what ``rates`` gives, if the caller has it; it may be marked for broadcast.
    """
    long = _cases(df, keys, y, cols, fold)
    known = rates(df, y, cols, fold) if known is None else known
    near = long.join(known, (F.col("model") == F.col("_m")) & F.col("_v").eqNullSafe(F.col("_w")) & (F.col(fold) == F.col("_f")))
    return near.select(*keys, "y", fold, "model", "p1")


def blended_rates(df: DataFrame, y: str, cols: list[str], known: DataFrame, fold: str = "fold") -> DataFrame:
    """fold, n, and sums ``p`` and ``square`` of the mean rate of ``cols`` and of its squared distance from y, over the rows of ``sampling.narrow_folds``, twins being one."""
    few = known.count() <= FEW
    for i, c in enumerate(cols):
        one = known.where(F.col("_m") == c).select(F.col("_w").alias(f"_w{i}"), F.col("_f").alias(f"_f{i}"), F.col("p1").alias(f"_p{i}"))
        df = df.join(F.broadcast(one) if few else one, F.col(c).cast("string").eqNullSafe(F.col(f"_w{i}")) & (F.col(fold) == F.col(f"_f{i}")))
    said = df.select(fold, y, "twin", (reduce(add, [F.col(f"_p{i}") for i in range(len(cols))]) / len(cols)).alias("p"))
    rows = said.where("twin is null").select(fold, y, "p").unionByName(said.where("twin is not null").groupBy("twin", y, fold).agg(F.avg("p").alias("p")).select(fold, y, "p"))
    off = F.col("p") - F.col(y)
    return rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(off * off).alias("square"))


def ranking(oof: DataFrame, by: str = "accuracy", fold: str = "fold", at: float = 0.5) -> DataFrame:
    """model, accuracy and roc_auc (means over the folds), accuracy_spread and place (1: the largest ``by``, ties by name)."""
    hit = ((F.col("p1") >= at).cast("int") == F.col("y").cast("int")).cast("double")
    each = oof.groupBy("model", fold).agg(F.avg(hit).alias("accuracy")).join(metrics.roc_auc(oof, "y", "p1", ["model", fold]), ["model", fold])
    mean = each.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_spread"), F.avg("roc_auc").alias("roc_auc"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(by, 9)), "model")))  # a row for each model


def blended(oof: DataFrame, keys: list[str], best: DataFrame, n: int = 3, fold: str = "fold") -> DataFrame:
    """keys, y, fold, model 'blend' and p1, the mean of the scores of the ``n`` first models of ``ranking``."""
    chosen = best.where(F.col("place") <= n).select("model")  # n rows
    return oof.join(F.broadcast(chosen), "model").groupBy(*keys, "y", fold).agg(F.avg("p1").alias("p1")).select(*keys, "y", fold, F.lit("blend").alias("model"), "p1")


def soft_vote(models: list[tuple[object, DataFrame | None]], df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys, p1, model (which one, from 0) and yhat: for each row the largest probability of 1 that any model gives, ties to the first.

    Each model comes with the row of its own scaler (``stats.scale_fit``), or None. ValueError without models.
    """
    if not models:
        raise ValueError("no models to vote")
    rows = df.select(*keys, *cols)
    for i, (model, fit) in enumerate(models):
        own = rows if fit is None else scaled(rows, fit, cols)
        said = scored(model, assembled(own, cols)).select(*keys, F.struct(F.col("p1").alias("p1"), F.lit(-i).alias("m")).alias(f"_{i}"))
        out = said if i == 0 else out.join(said, keys)
    best = F.greatest(*[F.col(f"_{i}") for i in range(len(models))]) if len(models) > 1 else F.col("_0")
    return out.select(*keys, best.alias("b")).select(*keys, "b.p1", (-F.col("b.m")).alias("model"), (F.col("b.p1") >= 0.5).cast("int").alias("yhat"))
