"""Human review: an append-only log of decisions, the latest of each finding, queues and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import numbers as N

from .tables import insert_or_ignore


def latest_decisions(log: DataFrame, ties: bool = False) -> DataFrame:
    """The decision of greatest created_at of each finding. With ties, all of several at the same time; else the
    one of greatest id."""
    if ties:
        return log.withColumn("_n", F.rank().over(Window.partitionBy("finding_id").orderBy(F.desc("created_at")))).where("_n = 1").drop("_n")
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("created_at"), F.desc("id")))).where("_n = 1").drop("_n")


def append_decision(log: DataFrame, decisions: DataFrame) -> DataFrame:
    ok = decisions.where("decision in ('accept', 'reject', 'edit')")
    return log.unionByName(ok.select(log.columns))


def current_findings(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings as the latest edits left them, with the latest decision."""
    edits = latest_decisions(log.where("decision = 'edit' and corrected_end > corrected_start"))
    edits = edits.select("finding_id", F.greatest(F.lit(0), "corrected_start").alias("_s"), F.col("corrected_end").alias("_e"), F.col("corrected_motif_id").alias("_m"))
    said = latest_decisions(log).select("finding_id", "decision")
    out = findings.join(edits, "finding_id", "left").join(said, "finding_id", "left")
    return out.withColumn("start", F.coalesce("_s", "start")).withColumn("end", F.coalesce("_e", "end")).withColumn("motif_id", F.coalesce("_m", "motif_id")).drop("_s", "_e", "_m")


def add_findings(findings: DataFrame, new: DataFrame) -> DataFrame:
    """Findings that people mark: a span that the motif already has is left as it is."""
    rows = new.where(F.col("end") > F.col("start")).withColumn("level", F.lit("span")).withColumn("model", F.lit("human"))
    return insert_or_ignore(findings, rows, ["work_id", "motif_id", "start", "end"], ["finding_id"])


ORDERS = {
    "uncertain": lambda: [F.abs(F.coalesce("confidence", F.lit(0.5)) - 0.5), F.desc("created_at"), F.col("finding_id")],
    "newest": lambda: [F.desc("created_at"), F.col("finding_id")],
    "highest": lambda: [F.desc("confidence"), F.desc("created_at"), F.col("finding_id")],
}


def queue(findings: DataFrame, log: DataFrame, order: str = "uncertain", limit: int | None = None, motif: str | None = None, low: float | None = None, high: float | None = None, after: str | None = None, seed: int = 0) -> DataFrame:
    """Findings without a decision, filtered and in the asked order (random: by a seeded hash)."""
    rows = findings.join(log.select("finding_id").distinct(), "finding_id", "left_anti")
    c = F.coalesce("confidence", F.lit(0.0))
    for condition in ((F.col("motif_id") == motif) if motif is not None else None, (c >= low) if low is not None else None, (c <= high) if high is not None else None, (F.col("finding_id") != after) if after is not None else None):
        rows = rows.where(condition) if condition is not None else rows
    by = [F.xxhash64(F.lit(seed), "finding_id"), F.col("finding_id")] if order == "random" else ORDERS[order]()
    rows = rows.orderBy(*by)
    return rows.limit(limit) if limit else rows


def scene_counts(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """scene_id, findings, accepted, rejected, reviewed, reviewed_share (0 where there are none)."""
    rows = findings.join(latest.select("finding_id", "decision"), "finding_id", "left")
    said = lambda d: F.sum(F.when(F.col("decision") == d, 1).otherwise(0))
    out = rows.groupBy("scene_id").agg(F.count("*").alias("findings"), said("accept").alias("accepted"), said("reject").alias("rejected"), F.count("decision").alias("reviewed"))
    return out.withColumn("reviewed_share", N.ratio(F.col("reviewed"), F.col("findings")))


def work_counts(works: DataFrame, scenes: DataFrame, findings: DataFrame) -> DataFrame:
    """work_id, scenes, findings of every work, 0 where there are none; each side is counted before it is joined."""
    s = scenes.groupBy("work_id").agg(F.count("*").alias("scenes"))
    f = findings.groupBy("work_id").agg(F.count("*").alias("findings"))
    return works.select("work_id").join(s, "work_id", "left").join(f, "work_id", "left").na.fill(0)


def motif_bias(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """motif_id, accepted, rejected, bias = 0.8 + 0.4 (accepted + 1) / (accepted + rejected + 2)."""
    rows = latest.where("decision in ('accept', 'reject')").join(findings.select("finding_id", "motif_id"), "finding_id")
    out = rows.groupBy("motif_id").agg(F.count_if(F.col("decision") == "accept").alias("accepted"), F.count_if(F.col("decision") == "reject").alias("rejected"))
    return out.withColumn("bias", 0.8 + 0.4 * (F.col("accepted") + 1) / (F.col("accepted") + F.col("rejected") + 2))
