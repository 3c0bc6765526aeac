"""Verdicts and roll-ups over targets (round, seq, verifier_id, locator, root_cause_key, status, severity, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def rollup(targets: DataFrame, *by: str, empty: str = "unverifiable") -> DataFrame:
    """Status of each group: failed before unverifiable before verified; P0 unless all are verified."""
    s = F.col("status")
    counts = targets.groupBy(*by).agg(F.count("*").alias("n_targets"), _n(s == "failed").alias("n_failed"), _n(s == "unverifiable").alias("n_unverifiable"), _n(s == "verified").alias("n_verified"))
    status = F.when(F.col("n_failed") > 0, "failed").when(F.col("n_unverifiable") > 0, "unverifiable").when(F.col("n_verified") > 0, "verified").otherwise(empty)
    return counts.withColumn("status", status).withColumn("severity", F.when(F.col("status") == "verified", "minor").otherwise("P0"))


def defect_rollup(targets: DataFrame, *by: str) -> DataFrame:
    """Roll-up where verified means a defect confirmed: P0 defects fail as P0, major ones as major, then unverifiable, else verified."""
    defect = F.col("status") == "verified"
    counts = targets.groupBy(*by).agg(
        _n(defect & (F.col("severity") == "P0")).alias("n_p0"), _n(defect & (F.col("severity") == "major")).alias("n_major"), _n(F.col("status") == "unverifiable").alias("n_unverifiable"))
    bad = (F.col("n_p0") > 0) | (F.col("n_major") > 0)
    status = F.when(bad, "failed").when(F.col("n_unverifiable") > 0, "unverifiable").otherwise("verified")
    severity = F.when(F.col("n_p0") > 0, "P0").when(F.col("n_major") > 0, "major").when(F.col("n_unverifiable") > 0, "P0").otherwise("minor")
    return counts.select("*", status.alias("status"), severity.alias("severity"))


def round_summary(targets: DataFrame) -> DataFrame:
    """Counts by verifier and status, with a row of totals (verifier_id 'total')."""
    s = F.col("status")
    return targets.rollup("verifier_id").agg(
        _n(s == "failed").alias("failed"), _n(s == "unverifiable").alias("unverifiable"), _n(s == "verified").alias("verified"), F.count("*").alias("total"),
    ).withColumn("verifier_id", F.coalesce("verifier_id", F.lit("total")))


def consolidate(targets: DataFrame) -> DataFrame:
    """Disposition and lane of each finding; verified findings of minor severity are dropped."""
    kind = F.coalesce("kind", F.lit("evidence"))
    disposition = (
        F.when(F.col("status") == "failed", "gate_blocker").when((F.col("status") == "unverifiable") & (kind == "env"), "setup_needed")
        .when((F.col("status") == "unverifiable") & (kind == "tool"), "human_review_recommended").when(F.col("status") == "unverifiable", "gate_blocker").otherwise("report")
    )
    lane = F.when(F.col("verifier_id") == "math", "math_identity/methodology").when(F.col("verifier_id") == "regression", "regression_safety/round_safety").otherwise(F.col("verifier_id"))
    kept = targets.where(~((F.col("status") == "verified") & (F.col("severity") == "minor")))
    return kept.select("round", "seq", "verifier_id", disposition.alias("disposition"), lane.alias("lane"), F.when(F.col("severity") == "P0", "major").otherwise(F.col("severity")).alias("severity"))


def release_gate(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """By round: whether nothing failed, no P0 is open, and an override covers whatever is unverifiable."""
    marked = targets.join(overrides.select(F.col("finding_key").alias("root_cause_key"), F.lit(True).alias("covered")).distinct(), "root_cause_key", "left")
    open_ = (F.col("status") == "unverifiable") & F.col("covered").isNull()
    p0 = (F.col("severity") == "P0") & (F.col("status") != "verified")
    out = marked.groupBy("round").agg(_n(F.col("status") == "failed").alias("n_failed"), _n(open_).alias("n_uncovered"), _n(p0).alias("n_p0"))
    return out.withColumn("released", (F.col("n_failed") == 0) & (F.col("n_uncovered") == 0) & (F.col("n_p0") == 0))


def last_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_k(df: DataFrame, k: int, by: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
