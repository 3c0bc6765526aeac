"""Displayed formulas of manuscripts (paper_id, round, tex): their rows, macros and equalities, checked in Arrow batches.

Brace depth, macros with arguments and algebra are beyond column functions, so each manuscript is read once by one Python
function a batch; nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra, latex
from ..functions import text as t
from .judging import math_severity

KEY = ["paper_id", "round"]

# Formulas checked a paper, sampled places, tolerance, characters quoted, names of the tools in reports.
MOST, SEEDS, TOLERANCE, QUOTED = 500, 3, 1e-8, 300
EXACT, EXACT_EXPANDED, JUDGE, NO_TOOL = "sympy", "sympy_with_macros", "llm_fallback", "none"
DEFINITIONS = [":=", r"\equiv", r"\coloneqq"]

TARGET = "eq int, pair int, locator string, quote string, lhs string, rhs string, status string, kind string, sign_flip boolean, tool string, note string"


def _each(manuscript: DataFrame, fields: str, make: Callable[[tuple, str], list[tuple]]) -> DataFrame:
    """The rows that ``make`` gives for the key and text of each manuscript; a null text counts as empty."""
    keys = ", ".join(f"`{k}` {manuscript.schema[k].dataType.simpleString()}" for k in KEY)
    names = [*KEY, *(f.split()[0] for f in fields.split(", "))]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field(k).type for k in range(len(KEY))] + [kinds[f.split()[1]] for f in fields.split(", ")]
            out: list[tuple] = []
            for *key, tex in zip(*(c.to_pylist() for c in b.columns)):
                out += [(*key, *row) for row in make(tuple(key), tex or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(names), types)], names)

    return manuscript.select(*KEY, "tex").mapInArrow(run, f"{keys}, {fields}")


def equations(manuscript: DataFrame) -> DataFrame:
    """(paper_id, round, eq, start, row, body): displayed formulas in all forms, a row of an alignment at a time, in the order of the text."""
    return _each(manuscript, "eq int, start int, row int, body string", lambda _, tex: [(n, start, row, body.strip()) for n, (start, row, _, body) in enumerate(latex.equations(tex))])


def equality_pairs(manuscript: DataFrame) -> DataFrame:
    """(paper_id, round, eq, pair, lhs, rhs): neighbours in chains of equalities, as written; definitions make none."""
    def make(_: tuple, tex: str) -> list[tuple]:
        bodies = [(n, body) for n, (*_, body) in enumerate(latex.equations(tex)) if not any(sign in body for sign in DEFINITIONS)]
        return [(n, pair, *sides) for n, body in bodies for pair, sides in enumerate(latex.equalities(body))]

    return _each(manuscript, "eq int, pair int, lhs string, rhs string", make)


def macros(manuscript: DataFrame) -> DataFrame:
    """(paper_id, round, name, arity, body): macros that a manuscript defines; the last definition wins."""
    return _each(manuscript, "name string, arity int, body string", lambda _, tex: [(name, n, body) for name, (n, body) in latex.macros(tex).items()])


def expanded(manuscript: DataFrame, all_calls: bool = True) -> DataFrame:
    """(paper_id, round, eq, body, expanded, note): formulas with the manuscript's macros expanded."""
    def make(_: tuple, tex: str) -> list[tuple]:
        known = latex.macros(tex)
        return [(n, body.strip(), *latex.expand(body.strip(), known, all_calls=all_calls)) for n, (*_, body) in enumerate(latex.equations(tex))]

    return _each(manuscript, "eq int, body string, expanded string, note string", make)


def check(key: tuple, tex: str, most: int = MOST, steps: int = algebra.STEPS) -> list[tuple]:
    """Targets of one manuscript: each equality of each formula, definitions and what can't be read included."""
    known, out = latex.macros(tex), []
    for eq, (_, _, source, body) in enumerate(latex.equations(tex)[:most]):
        quote = re.sub(r"\s+", " ", source).strip()[:QUOTED]
        if any(sign in body for sign in DEFINITIONS):
            out.append((eq, 0, f"eq:{eq}", quote, None, None, "unverifiable", "tool", False, NO_TOOL, "a definition"))
            continue
        for pair, sides in enumerate(latex.equalities(body)):
            locator = f"eq:{eq}.{pair}" if pair else f"eq:{eq}"
            (lhs, note_l), (rhs, note_r) = (latex.expand(side, known) for side in sides)
            notes = [x for x in (note_l, note_r) if x]
            seen = [x for x in t.UNPARSEABLE if x in lhs or x in rhs or x in body] + [x for x in (r"\begin{", r"\end{") if x in lhs or x in rhs]
            if seen:
                verdict, tool = algebra.Verdict("unverifiable", "tool", False, "can't read " + ", ".join(sorted(set(seen)))), NO_TOOL
            else:
                seed = zlib.crc32(f"{key}:{eq}:{pair}".encode())
                verdict, tool = algebra.equal(lhs, rhs, seed, SEEDS, TOLERANCE, steps), EXACT if (lhs, rhs) == sides else EXACT_EXPANDED
            out.append((eq, pair, locator, quote, lhs[:QUOTED], rhs[:QUOTED], verdict.status, verdict.kind, verdict.sign_flip, tool, " | ".join([verdict.note, *notes])))
    return out or [(None, None, "eq:none", "", None, None, "verified", None, False, NO_TOOL, "no displayed equalities")]


def math_targets(manuscript: DataFrame, most: int = MOST, steps: int = algebra.STEPS, available: bool = True) -> DataFrame:
    """(paper_id, round, TARGET, severity): verdicts on the equalities of the first ``most`` formulas of each manuscript.

    A manuscript without any has one verified target, eq:none. Where the algebra isn't available, each has one target
    that says so, eq:preflight, unverifiable for the environment.
    """
    absent = (None, None, "eq:preflight", "", None, None, "unverifiable", "env", False, NO_TOOL, "the algebra is not available")
    found = _each(manuscript, TARGET, (lambda key, tex: check(key, tex, most, steps)) if available else (lambda *_: [absent]))
    return found.withColumn("severity", F.when(F.col("locator") == "eq:preflight", "P0").otherwise(math_severity(F.col("status"), F.col("kind"))))


def truncated(eqs: DataFrame, most: int = MOST) -> DataFrame:
    """(paper_id, round, n_equations, error) of manuscripts with more formulas than are checked."""
    counts = eqs.groupBy(*KEY).agg(F.count("*").alias("n_equations")).where(F.col("n_equations") > most)
    return counts.withColumn("error", F.format_string(f"truncated: paper has %d equation(s); verifying only the first {most}", "n_equations"))


def capped(eqs: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` formulas of each manuscript."""
    w = Window.partitionBy(*KEY).orderBy("eq")
    return eqs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def tools_used(targets: DataFrame, *by: str) -> DataFrame:
    """How many targets each tool decided; one that a judge decided counts as the judge's (column judged, if there)."""
    tool = F.when(F.col("judged"), JUDGE).otherwise(F.col("tool")) if "judged" in targets.columns else F.col("tool")
    return targets.where("eq is not null").groupBy(*by, tool.alias("tool")).agg(F.count("*").alias("n"))
