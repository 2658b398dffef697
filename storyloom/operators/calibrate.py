"""Thresholds from labelled confidences: sweeps, bins, calibration error, choice of a threshold, one per motif."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import CalibrationConfig
from storyloom.functions import numbers as N


def labelled(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """confidence and y (1 accepted, 0 rejected) of findings with such a decision and a confidence."""
    rows = latest.where("decision in ('accept', 'reject')").join(findings, "finding_id").where("confidence is not null")
    return rows.select("finding_id", "motif_id", "confidence", (F.col("decision") == "accept").cast("int").alias("y"))


def thresholds(step: float = 0.01, summed: bool = True) -> list[float]:
    """0 to 1; `summed` adds the step up, as a loop would (so most are a little off k * step)."""
    if not summed:
        n = round(1 / step)
        return [k / n for k in range(n + 1)]
    out, t = [], 0.0
    while t <= 1.0 + 1e-9:
        out.append(t)
        t += step
    return out


def sweep(points: DataFrame, at: list[float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall, f1, accuracy, positive_rate for each threshold (and group).

    Each point is counted once, at the last threshold that it reaches; a running sum over the thresholds then
    gives the counts, so the work is points + thresholds, not their product."""
    at = at or thresholds()
    spark = points.sparkSession
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t double")
    reach = F.array(*map(F.lit, at))
    last = F.size(F.filter(reach, lambda t: F.col("confidence") >= t)) - 1
    counted = points.withColumn("i", last).groupBy(*by, "i").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    total = counted.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    cells = total.crossJoin(F.broadcast(grid)).join(counted, [*by, "i"], "left").na.fill(0, ["p", "n"])  # groups times the fixed thresholds
    above = Window.partitionBy(*by).orderBy(F.desc("i"))
    rows = cells.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above))
    rows = rows.withColumn("fn", F.col("all_p") - F.col("tp")).withColumn("tn", F.col("all_n") - F.col("fp"))
    n = F.col("all_p") + F.col("all_n")
    precision, recall = N.ratio(F.col("tp"), F.col("tp") + F.col("fp")), N.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select(*by, "i", "t", F.round("t", 4).alias("threshold"), "tp", "fp", "tn", "fn", precision.alias("precision"), recall.alias("recall"), N.f1(precision, recall).alias("f1"), N.ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), N.ratio(F.col("tp") + F.col("fp"), n).alias("positive_rate"))


def choose(swept: DataFrame, objective: str = "f1@precision", min_precision: float = 0.7, min_recall: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """The row that the objective likes best; among equals the lowest threshold.

    f1: by f1, then precision. f1@precision: of rows precise enough by f1, then recall, else by precision, then f1.
    precision@recall: of rows with enough recall by precision, then f1, else by recall, then precision."""
    p, r, f = F.col("precision"), F.col("recall"), F.col("f1")
    match objective:
        case "f1":
            key = [f, p]
        case "f1@precision":
            ok = p >= min_precision
            key = [ok.cast("int"), F.when(ok, f).otherwise(p), F.when(ok, r).otherwise(f)]
        case "precision@recall":
            ok = r >= min_recall
            key = [ok.cast("int"), F.when(ok, p).otherwise(r), F.when(ok, f).otherwise(p)]
        case _:
            raise ValueError(f"unknown objective {objective}")
    w = Window.partitionBy(*by).orderBy(*(F.desc(k) for k in key), "t")
    return swept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def edges(bins: int) -> list[float]:
    """Lower edges of equal-width bins as multiples of the width; most are a little off k / bins."""
    return [i * (1.0 / bins) for i in range(bins)]


def reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """bin, low, high, n, mean_confidence, accept_rate of equal-width bins (the last one closed); empty bins are 0,
    confidences outside 0..1 are left out. A confidence is compared with the edges as they are, so that 0.3, which
    is less than 3 * 0.1, lies in bin 2."""
    low = edges(bins)
    grid = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    reached = F.size(F.filter(F.array(*map(F.lit, low)), lambda e: F.col("confidence") >= e)) - 1
    inside = points.where("confidence between 0 and 1").withColumn("bin", reached)
    some = inside.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("y").alias("accept_rate"))
    rows = grid.join(some, "bin", "left").na.fill(0, ["n"]).na.fill(0.0, ["mean_confidence", "accept_rate"])
    at = lambda i: F.get(F.array(*map(F.lit, [*low, 1.0])), i)
    return rows.select("bin", at(F.col("bin")).alias("low"), at(F.col("bin") + 1).alias("high"), "n", "mean_confidence", "accept_rate")


def reliability_present(points: DataFrame, bins: int = 10) -> DataFrame:
    """middle, n, accept_rate of the bins that hold anything; confidences are clamped."""
    b = F.least(F.lit(bins - 1), F.floor(N.clamped(F.col("confidence")) * bins)).cast("int")
    return points.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("accept_rate")).select("bin", ((F.col("bin") + 0.5) / bins).alias("middle"), "n", "accept_rate")


def calibration_error(binned: DataFrame) -> DataFrame:
    total = F.sum("n")
    return binned.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accept_rate") - F.col("mean_confidence"))) / total, F.lit(0.0)).alias("ece"), total.alias("n"))


def _swept_by_motif(points: DataFrame, marks: DataFrame) -> DataFrame:
    """motif_id, t, tp, fp of the points (motif_id, confidence, y) at or above each mark (motif_id, t): one running sum
    a motif over the marks and the points as they are, not their product."""
    events = marks.select("motif_id", "t", F.lit(1).alias("mark"), F.lit(0).alias("p"), F.lit(0).alias("n"))
    events = events.unionByName(points.select("motif_id", F.col("confidence").alias("t"), F.lit(0).alias("mark"), F.col("y").alias("p"), (1 - F.col("y")).alias("n")))
    events = events.groupBy("motif_id", "t").agg(F.max("mark").alias("mark"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = Window.partitionBy("motif_id").orderBy(F.desc("t"))
    return events.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above)).where("mark = 1")


def _sampled(points: DataFrame, least: int) -> DataFrame:
    groups = points.groupBy("motif_id").agg(F.count("*").alias("samples"), F.sum("y").alias("positives"))
    return groups.withColumn("negatives", F.col("samples") - F.col("positives")).where(F.col("samples") >= least)


def _scored(swept: DataFrame, groups: DataFrame) -> DataFrame:
    precision, recall = N.ratio(F.col("tp"), F.col("tp") + F.col("fp")), N.ratio(F.col("tp"), F.col("positives"))
    swept = swept.join(groups, "motif_id").withColumn("precision", precision).withColumn("recall", recall)
    return swept.withColumn("f1", F.round(N.f1(F.col("precision"), F.col("recall")), 9))


def motif_thresholds(points: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """motif_id, threshold, samples, positives, negatives: for motifs with enough samples, the threshold of best f1
    among those precise enough (0.5 if none is); equal f1: the lowest.

    points: motif_id, confidence, y. Thresholds are the confidences that occur, rounded to three places, and the
    multiples of the step; the confidences that are compared with them are not rounded."""
    groups = _sampled(points, config.min_samples)
    grid = F.explode(F.array(*(F.lit(k * config.step) for k in range(int(1 / config.step) + 1))))
    marks = points.select("motif_id", F.round("confidence", 3).alias("t")).join(groups.select("motif_id"), "motif_id", "left_semi")
    marks = marks.unionByName(groups.select("motif_id", grid.alias("t"))).distinct()
    swept = _scored(_swept_by_motif(points, marks), groups)
    best = Window.partitionBy("motif_id").orderBy(F.desc("f1"), "t")
    ok = swept.where((F.col("precision") >= config.min_precision) & (F.col("f1") > 0)).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return groups.join(ok.select("motif_id", F.col("t").alias("threshold")), "motif_id", "left").select("motif_id", F.coalesce("threshold", F.lit(0.5)).alias("threshold"), "samples", "positives", "negatives")


def reviewed_points(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """motif_id (the corrected one, if any), confidence (0 if null) and y of the findings that were accepted or
    rejected. latest: finding_id, decision, corrected_motif_id."""
    rows = latest.where("decision in ('accept', 'reject')").join(findings.select("finding_id", "motif_id", "confidence"), "finding_id")
    return rows.select(F.coalesce("corrected_motif_id", "motif_id").alias("motif_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (F.col("decision") == "accept").cast("int").alias("y"))


def review_thresholds(points: DataFrame, least: int = 6) -> DataFrame:
    """motif_id, threshold, tp, fp, fn, precision, recall, f1, n: for motifs with `least` points, the score that occurs
    and has the best f1 as a threshold; equal f1: the lowest. No precision is asked for."""
    groups = _sampled(points, least)
    marks = points.select("motif_id", F.col("confidence").alias("t")).join(groups.select("motif_id"), "motif_id", "left_semi").distinct()
    best = Window.partitionBy("motif_id").orderBy(F.desc("f1"), "t")
    rows = _scored(_swept_by_motif(points, marks), groups).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return rows.select("motif_id", F.col("t").alias("threshold"), "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), "precision", "recall", "f1", F.col("samples").alias("n"))


def stamped(findings: DataFrame, version: str, threshold: float, work: str | None = None, since: str | None = None, only_unstamped: bool = True) -> DataFrame:
    """findings with calibration_version and threshold_used set where the filters hold (times compare as ISO text)."""
    hit = F.lit(True)
    if work is not None:
        hit = hit & (F.col("work_id") == work)
    if since is not None:
        hit = hit & (F.col("created_at") >= since)
    if only_unstamped:
        hit = hit & F.col("calibration_version").isNull()
    hit = F.coalesce(hit, F.lit(False))
    return findings.withColumn("threshold_used", F.when(hit, F.lit(threshold)).otherwise(F.col("threshold_used"))).withColumn("calibration_version", F.when(hit, F.lit(version)).otherwise(F.col("calibration_version")))


def fit_logistic(points: DataFrame, features: list[str], by: str, l2: float = 1e-3, rate: float = 0.1, steps: int = 400, most: int = 100_000) -> DataFrame:
    """by and weights (bias first) of a logistic regression of y for each group, by batch gradient steps.

    A group is one fit in one task; groups of more than `most` rows are fitted on that many of least hash (a bound
    on the sample of a fit, not on what the fit is used for)."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(by, *features, "y"))
    rows = points.select(by, *(F.col(c).cast("double").alias(c) for c in features), F.col("y").cast("double").alias("y")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")

    def fit(group):
        import numpy as np
        import pandas as pd

        x = np.column_stack([np.ones(len(group)), group[features].to_numpy()])
        y, v = group["y"].to_numpy(), np.zeros(len(features) + 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -60, 60)))
            v -= rate * (x.T @ (p - y) / len(y) + l2 * v)
        return pd.DataFrame({by: [group[by].iloc[0]], "weights": [v.tolist()]})

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.groupBy(by).applyInPandas(fit, StructType([rows.schema[by], StructField("weights", ArrayType(DoubleType()))]))
