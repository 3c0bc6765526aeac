"""What a paper's abstract claims against what its methods restrict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .extract import KEY, parse_sections, scan_markers

# The share of restrictions kept silent that makes an overclaim, how many make a leak, characters quoted.
SILENT, LEAK, QUOTED = 0.6, 3, 280


def findings(manuscript: DataFrame) -> DataFrame:
    """Sections with their markers, the leak ratio, and the finding: universality_asymmetry, restriction_leakage, methods_missing or null.

    Asymmetric is a paper whose abstract or introduction is universal and whose methods name restrictions, most of which the abstract
    doesn't. Otherwise a broad claim leaks restrictions if the abstract leaves out enough of them.
    """
    marked = scan_markers(parse_sections(manuscript), ("abstract_universal", "abstract_restriction", "introduction_universal", "methods_restriction"))
    marked = t.once(marked, missing=F.array_except("methods_restriction", "abstract_restriction"), broad=F.lower("abstract").rlike(t.any_of(t.BROAD_CLAIM)))
    named = F.size("methods_restriction")
    ratio = F.size("missing") / F.greatest(named, F.lit(1))
    upstream = (F.size("abstract_universal") > 0) | (F.size("introduction_universal") > 0)
    asymmetric = upstream & (named > 0) & (ratio >= SILENT)
    finding = F.when(asymmetric, "universality_asymmetry").when(F.col("broad") & (F.size("missing") >= LEAK), "restriction_leakage").when(F.col("methods") == "", "methods_missing")
    return t.once(marked, leak_ratio=F.round(ratio, 3), finding=finding)


def targets(found: DataFrame) -> DataFrame:
    """(paper_id, round, locator, status, severity, kind, confidence, finding, root_cause_key, quote, paired_quote): one target a paper.

    A finding that stands is verified; missing methods leave the scope unverifiable for lack of a tool.
    """
    f = F.col("finding")
    severity = F.when(f.isNull(), "minor").when(f == "restriction_leakage", "major").otherwise("P0")
    name = F.coalesce(f, F.lit("consistent"))
    lost = F.coalesce(f == "methods_missing", F.lit(False))
    return found.select(
        *KEY, F.lit("pair:abstract-methods").alias("locator"), F.when(lost, "unverifiable").otherwise("verified").alias("status"), severity.alias("severity"), F.when(lost, "tool").alias("kind"),
        F.when(f == "universality_asymmetry", "high").otherwise("medium").alias("confidence"), name.alias("finding"), F.concat(F.lit("internal-consistency-"), name).alias("root_cause_key"),
        t.truncate(F.col("abstract"), QUOTED).alias("quote"), t.truncate(F.col("methods"), QUOTED).alias("paired_quote"))


def report(found: DataFrame) -> DataFrame:
    """(paper_id, round, status, severity): a paper without methods is unverifiable, one with a finding fails."""
    f = F.col("finding")
    lost = F.col("methods") == ""
    status = F.when(lost, "unverifiable").when(f.isNotNull(), "failed").otherwise("verified")
    return found.select(*KEY, status.alias("status"), F.when(lost | (f == "universality_asymmetry"), "P0").when(f.isNotNull(), "major").otherwise("minor").alias("severity"))
