"""Comparison of two revision rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


def of_round(targets: DataFrame, n: int) -> DataFrame:
    return targets.where(F.col("round") == n)


def regressions(prev: DataFrame, curr: DataFrame, key: list[str]) -> DataFrame:
    """Targets verified before and failed or unverifiable now."""
    before = prev.where("status = 'verified'").select(*key).distinct()
    return curr.where("status in ('failed', 'unverifiable')").join(before, key, "left_semi")


def quote_pairs(prev: DataFrame, curr: DataFrame, by: list[str]) -> DataFrame:
    """(by, prev_quote, curr_quote) of claims (by, number, claim_quote) that both rounds have; by names the type of claim, so types don't mix. Of claims with one key the last counts."""
    last = lambda df, name: df.groupBy(*by).agg(F.max_by("claim_quote", "number").alias(name))
    return last(prev, "prev_quote").join(last(curr, "curr_quote"), by)


def claim_drift(pairs: DataFrame, strict: bool = False, same_from: float = 0.9) -> DataFrame:
    """Quotes under one locator that changed; P0 where numbers or quantifiers differ. strict compares these before the overlap."""
    a, b = t.normalize_quote(F.col("prev_quote")), t.normalize_quote(F.col("curr_quote"))
    rows = t.with_overlap(pairs, a, b).where("not same")
    rows = rows if strict else rows.where(F.col("overlap") < same_from)
    numbers = t.numbers_in(F.col("prev_quote")) != t.numbers_in(F.col("curr_quote"))
    words = t.quantifiers_in(F.col("prev_quote")) != t.quantifiers_in(F.col("curr_quote"))
    rows = t.once(rows, claims_differ=numbers | words).where(F.col("claims_differ") | (F.col("overlap") < same_from))
    return rows.select("locator", "overlap", F.when(F.col("claims_differ"), "P0").otherwise("major").alias("severity"))


def deletion_evasion(prev: DataFrame, curr: DataFrame, fix_log: DataFrame, exempt: tuple[str, ...] = ("fixed",)) -> DataFrame:
    """Findings that were P0 or failed, are gone, and aren't logged with an exempting disposition; the log row is kept as evidence."""
    log = fix_log.select(F.col("finding_key").alias("root_cause_key"), "disposition", "rationale")
    gone = prev.where("severity = 'P0' or status = 'failed'").join(curr.select("root_cause_key").distinct(), "root_cause_key", "left_anti")
    return gone.join(log, "root_cause_key", "left").where(F.col("disposition").isNull() | ~F.col("disposition").isin(*exempt)).select("root_cause_key", "locator", "severity", "disposition", "rationale")


def new_citations(prev: DataFrame, curr: DataFrame, targets: DataFrame) -> DataFrame:
    """(paper_id, locator) of citations that appear this round and that no verified target of the round covers."""
    covered = targets.where("status = 'verified' and locator like 'cite:%'").select("locator").distinct()
    fresh = curr.select("paper_id", "locator").distinct().join(prev.select("paper_id", "locator"), ["paper_id", "locator"], "left_anti")
    return fresh.join(covered, "locator", "left_anti").select("paper_id", "locator")


def new_scope(prev: DataFrame, curr: DataFrame, reports: DataFrame, verifier: str = "scope") -> DataFrame:
    """(paper_id, locator, quote) of scope quotes that no paper made before, unless a scope report of this round exists."""
    seen = prev.select(t.normalize_quote(F.col("claim_quote")).alias("quote")).distinct()
    gate = reports.where(F.col("verifier_id") == verifier).select("verifier_id").distinct()  # one row at most
    fresh = curr.select("paper_id", "locator", t.normalize_quote(F.col("claim_quote")).alias("quote"), F.lit(verifier).alias("verifier_id"))
    return fresh.join(F.broadcast(gate), "verifier_id", "left_anti").join(seen, "quote", "left_anti").select("paper_id", "locator", "quote")


#: Fixed: the checkers, in the order in which their targets are listed.
CHECKERS = ["regressions", "claim_drift", "deletion_evasion", "new_citations", "new_scope"]


def report(checkers: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(checker, locator, status, severity, kind, root_cause_key, notes): the targets of all checkers, the first of each cause.

    A checker gives (locator, status, severity, root_cause_key). One that can't be planned, for columns it misses or of the wrong kind,
    is a target itself, unverifiable for the environment; the others' stay.
    """
    out = None
    for place, name in enumerate(CHECKERS):
        try:
            rows = checkers[name]().select("locator", "status", "severity", F.when(F.col("status") == "unverifiable", "evidence").alias("kind"), "root_cause_key", F.lit("").alias("notes"))
        except Exception as e:  # noqa: BLE001  whatever a checker raises is reported, not hidden
            spark = SparkSession.getActiveSession()
            crash = (f"checker-crash:{name}", "unverifiable", "P0", "env", f"regression-checker-crash-{name}", f"{name} crashed: {type(e).__name__}")
            rows = spark.createDataFrame([crash], "locator string, status string, severity string, kind string, root_cause_key string, notes string")
        rows = rows.select(F.lit(place).alias("__place"), F.lit(name).alias("checker"), "*")
        out = rows if out is None else out.unionByName(rows)
    # A minimum is combined before the shuffle, so that a cause with many rows isn't gathered.
    first = out.groupBy("root_cause_key").agg(F.min(F.struct("__place", "locator", "checker", "status", "severity", "kind", "notes")).alias("x"))
    return first.select("x.checker", "x.locator", "x.status", "x.severity", "x.kind", "root_cause_key", "x.notes")
