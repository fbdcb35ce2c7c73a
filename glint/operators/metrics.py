"""Metrics of binary scores. Scores are first counted by value; curves then run within ranges of the score (``stats.prefixed``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.operators.stats import prefixed

BETAS = {"f1": 1.0, "f0_5": 0.5, "f2": 2.0, "f0_1": 0.1, "f0_3": 0.3, "f0_7": 0.7, "f1_5": 1.5, "f3": 3.0, "f5": 5.0}
STRATEGIES = {"max_f1": "f1", "max_balanced_accuracy": "balanced_accuracy", "max_mcc": "mcc", "max_f2": "f2", "max_f0_5": "f0_5"}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn in one pass."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(yhat) == b))
    return df.groupBy(*(by or [])).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Every metric of tp, tn, fp, fn columns."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    out = counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "balanced_accuracy": ratio(recall + spec, present), "precision": ratio(tp, tp + fp), "recall": recall, "specificity": spec, "npv": ratio(tn, tn + fn)})
    for name, b in BETAS.items():
        out = out.withColumn(name, ratio((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return out.withColumn("mcc", ratio(tp * tn - fp * fn, root))


def sweep(scores: DataFrame, y: str, p: str, thresholds: list[int]) -> DataFrame:
    """Metrics at each threshold (score >= threshold is 1), without a product of thresholds and scores.

    A score counts in the bucket of the largest threshold that it reaches; suffix sums over the buckets are the
    counts at each threshold.
    """
    edges = F.array(*[F.lit(t) for t in thresholds])
    bucket = F.size(F.filter(edges, lambda t: t <= F.col(p)))
    distinct = scores.groupBy(p).agg(F.sum(F.col(y)).alias("pos"), F.count("*").alias("n"))
    counted = distinct.select(bucket.alias("b"), "pos", "n").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    spark = scores.sparkSession
    grid = spark.createDataFrame([(0, None), *((i + 1, t) for i, t in enumerate(thresholds))], "b int, threshold int")
    full = grid.join(counted, "b", "left").fillna(0, ["pos", "n"])
    after = Window.orderBy(F.desc("b"))
    everyone = Window.partitionBy()
    full = full.withColumns({"tp": F.sum("pos").over(after), "said": F.sum("n").over(after), "all_pos": F.sum("pos").over(everyone), "all_n": F.sum("n").over(everyone)})
    counts = full.where("b > 0").select("threshold", F.col("tp"), (F.col("said") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("said") - F.col("all_pos") + F.col("tp")).alias("tn"))
    return threshold_metrics(counts)


def optimum(metrics: DataFrame, metric: str, last: bool = False) -> DataFrame:
    """The row of the largest value; of equals the lowest threshold, or the highest if ``last``."""
    if metric not in metrics.columns:
        raise ValueError(f"unknown metric {metric!r}")
    return metrics.orderBy(F.desc(F.round(metric, 9)), F.desc("threshold") if last else F.asc("threshold")).limit(1)


def custom_metric(weights: dict[str, float], cost_fp: float = 0.0, cost_fn: float = 0.0) -> Column:
    """Weighted precision, recall and specificity less the mean cost of errors."""
    total = sum(weights.values()) or 1.0
    gain = sum((F.col(m) * F.lit(w / total) for m, w in weights.items()), F.lit(0.0))
    return gain - (F.col("fp") * cost_fp + F.col("fn") * cost_fn) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def business_cost(tp: float, tn: float, fp: float, fn: float) -> Column:
    return F.col("tp") * tp + F.col("tn") * tn + F.col("fp") * fp + F.col("fn") * fn


def by_score(scores: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or []), F.col(p).alias("p")).agg(F.sum(y).alias("pos"), (F.count("*") - F.sum(y)).alias("neg"))


def roc_points(scores: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, tpr, fpr, precision at each distinct score, and what they were one score higher (0, 0, 1 at the highest)."""
    d = prefixed(by_score(scores, y, p), "p", ["pos", "neg"])
    tp, fp, np, nn = F.col("all_pos") - F.col("below_pos"), F.col("all_neg") - F.col("below_neg"), F.col("all_pos"), F.col("all_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    first = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(ratio(tp0, tp0 + fp0))
    return d.select(F.col("p").alias("threshold"), "pos", "neg", np.alias("np"), nn.alias("nn"), ratio(tp, np).alias("tpr"), ratio(fp, nn).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ratio(tp0, np).alias("tpr_before"), first.alias("precision_before"))


def roc_auc(scores: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; NULL with one class only."""
    d = prefixed(by_score(scores, y, p, by), "p", ["neg"], by)
    return d.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(scores: DataFrame, y: str, p: str) -> DataFrame:
    d = roc_points(scores, y, p)
    return d.agg(F.sum(ratio(F.col("pos"), F.col("np")) * F.col("precision")).alias("average_precision"))


def pr_area(scores: DataFrame, y: str, p: str) -> DataFrame:
    """Trapezoid area under the precision-recall curve, from recall 0 at precision 1."""
    d = roc_points(scores, y, p)
    return d.agg(F.sum((F.col("tpr") - F.col("tpr_before")) * (F.col("precision") + F.col("precision_before")) / 2).alias("pr_area"))


def pr_curve(scores: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, recall, precision and ``baseline``, the precision of a guess (the share of positives)."""
    return roc_points(scores, y, p).select("threshold", F.col("tpr").alias("recall"), "precision", ratio(F.col("np"), F.col("np") + F.col("nn")).alias("baseline"))


def one_vs_rest(scores: DataFrame, y: str, columns: dict[str, str]) -> DataFrame:
    """label, roc_auc and support of each class (by its own column of scores), then rows 'macro avg' and 'weighted avg'."""
    cases = F.array(*[F.struct(F.lit(c).alias("label"), F.col(p).alias("p"), (F.col(y) == c).cast("int").alias("is")) for c, p in columns.items()])
    long = scores.select(F.explode(cases).alias("c")).select("c.*")
    auc = roc_auc(long, "is", "p", ["label"]).join(long.groupBy("label").agg(F.sum("is").alias("support")), "label")
    mean = auc.agg(F.avg("roc_auc").alias("roc_auc"), F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "roc_auc", "support")
    weighted = auc.agg((F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc"), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "roc_auc", "support")
    return auc.select("label", "roc_auc", "support").unionByName(mean).unionByName(weighted)


def nearest_threshold(points: DataFrame, t: float) -> DataFrame:
    """The row whose threshold is nearest to t, of equals the lower."""
    return points.orderBy(F.abs(F.col("threshold") - t), "threshold").limit(1)


def voting_optimum(swept: DataFrame, metric: str, conservative: bool = False) -> DataFrame:
    """The threshold of the best recall, precision or f1: of equals the first if ``conservative``, else the last."""
    if metric not in ("recall", "precision", "f1"):
        raise ValueError(f"metric {metric!r} is not supported")
    return optimum(swept, metric, last=not conservative)


def harmonic() -> Column:
    """F1 recomputed from precision and recall, 0 where both are."""
    return ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))


def model_grid(scores: DataFrame, y: str, models: list[str], at: int, by: str) -> DataFrame:
    """For each model (a column of scores) and ``by``: its confusion and accuracy, in one pass over the rows."""
    cases = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) >= at).cast("int").alias("_h")) for m in models])
    c = confusion(scores.select(by, y, F.explode(cases).alias("c")).select(by, y, "c.*"), y, "_h", ["model", by])
    return c.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def overfit_gap(aucs: DataFrame) -> DataFrame:
    """``train`` and ``val`` areas with their gap: over 0.05 overfit, under 0.01 balanced, else moderate."""
    gap = F.col("train") - F.col("val")
    return aucs.withColumn("gap", gap).withColumn("verdict", F.when(gap > 0.05, "overfit").when(gap < 0.01, "balanced").otherwise("moderate"))


def youden(scores: DataFrame, y: str, p: str) -> DataFrame:
    d = roc_points(scores, y, p).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 9))
    return d.orderBy(F.desc("j"), F.desc("threshold")).limit(1).select("threshold", "j")


def calibration(scores: DataFrame, y: str, p: str, top: int = 1000, bins: int = 10) -> DataFrame:
    """Mean score and share of positives of uniform, right-closed bins; empty ones are left out."""
    edges = F.array(*[F.lit(top * i // bins) for i in range(1, bins)])
    return scores.groupBy(F.size(F.filter(edges, lambda e: e < F.col(p))).alias("bin")).agg((F.avg(p) / top).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"), F.count("*").alias("n"))


def voting(scores: DataFrame, first: str, second: str) -> DataFrame:
    """The larger of two scores, ties to the first model."""
    return scores.withColumn("p_vote", F.greatest(first, second)).withColumn("model", F.when(F.col(first) >= F.col(second), first).otherwise(second))


def class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, f1, support of each class, with accuracy (in the column f1), macro and weighted averages; label is a string."""
    cells = df.groupBy(F.col(y).alias("t"), F.col(yhat).alias("h")).agg(F.count("*").alias("n"))
    actual = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("h"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("h").alias("c")).agg(F.sum("n").alias("said"))
    each = actual.join(said, "c", "full").fillna(0, ["support", "hit", "said"])
    pr, rc = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    each = each.select(F.col("c").cast("string").alias("label"), pr.alias("precision"), rc.alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = each.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    right = each.withColumn("hit", F.col("recall") * F.col("support"))
    accuracy = right.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), (F.sum("hit") / F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    return each.unionByName(accuracy).unionByName(macro).unionByName(weighted)
