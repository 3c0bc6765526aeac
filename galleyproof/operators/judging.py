"""Replies of language-model judges, the two-wave contradiction check, and what runs cost and lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Section pairs that are compared, kinds of contradiction, those that are P0, signs of a network fault, lengths kept.
SECTION_PAIRS = [("abstract", "conclusion"), ("abstract", "methods"), ("introduction", "results")]
KINDS = ["direct_opposite", "scope_mismatch", "promise_not_delivered", "number_mismatch"]
P0_KINDS = ["direct_opposite", "promise_not_delivered"]
NETWORK = ["timeout", "urlerror", "failed to", "connect", "network", "http 5", "http 429", "http 403"]
TRIPLE_LENGTHS = {"subject": 200, "predicate": 300, "scope": 200, "quote_span": 220}
MOST_TRIPLES = 8

def judge_array(body: Column, item: str) -> Column:
    """The outermost JSON list in free text as array<item>; null where there is none or it can't be parsed."""
    return F.from_json(F.regexp_extract(body, r"(?s)\[.*\]", 0), f"array<{item}>")


def triples(replies: DataFrame, most: int = MOST_TRIPLES) -> DataFrame:
    """(paper_id, section, pos, and the fields of TRIPLE_LENGTHS): the first triples of each reply, fields cut to their lengths; a missing field is empty."""
    item = "struct<" + ", ".join(f"{name}: string" for name in TRIPLE_LENGTHS) + ">"
    rows = replies.select("paper_id", "section", F.posexplode(F.slice(judge_array(F.col("body"), item), 1, most)).alias("pos", "item")).where("item is not null")
    return rows.select("paper_id", "section", "pos", *(F.substring(F.coalesce(f"item.{name}", F.lit("")), 1, n).alias(name) for name, n in TRIPLE_LENGTHS.items()))


def section_pairs(counts: DataFrame, fast: bool = False) -> DataFrame:
    """For each paper of (paper_id, section, n_triples) the pairs to compare; a side without triples makes its pair unverifiable.

    A paper has a handful of sections, so they are gathered in one row, and the pairs are generated from it without a join.
    """
    by = counts.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "n_triples"))).alias("n"))
    pairs = F.array(*(F.struct(F.lit(a).alias("section_a"), F.lit(b).alias("section_b")) for a, b in SECTION_PAIRS[: 1 if fast else None]))
    rows = by.select("paper_id", "n", F.explode(pairs).alias("p")).select("paper_id", "p.*", "n")
    side = lambda c: F.coalesce(F.element_at("n", F.col(c)), F.lit(0).cast("long"))
    rows = rows.select("paper_id", "section_a", "section_b", side("section_a").alias("n_a"), side("section_b").alias("n_b"))
    able = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return rows.select("*", F.when(able, "pending").otherwise("unverifiable").alias("status"), F.when(~able, "tool").alias("kind"))


def contradictions(replies: DataFrame) -> DataFrame:
    """(locator, paper_id, section_a, section_b, kind, confidence, severity): known kinds of at least medium confidence, numbered after the others are gone."""
    item = "struct<claim_a: string, claim_b: string, contradiction_kind: string, confidence: string, reason: string>"
    confidence = F.lower(F.trim("item.confidence"))
    rows = replies.select("paper_id", "section_a", "section_b", F.posexplode(judge_array(F.col("body"), item)).alias("pos", "item"))
    rows = rows.select("paper_id", "section_a", "section_b", "pos", F.trim("item.contradiction_kind").alias("kind"), F.when(confidence.isin("high", "medium"), confidence).otherwise("low").alias("confidence"))
    rows = rows.where(F.col("kind").isin(*KINDS) & (F.col("confidence") != "low"))
    index = F.row_number().over(Window.partitionBy("paper_id", "section_a", "section_b").orderBy("pos")) - 1
    locator = F.concat(F.lit("contradiction:"), "section_a", F.lit("-"), "section_b", F.lit("-"), index.cast("string"))
    return rows.select(locator.alias("locator"), "paper_id", "section_a", "section_b", "kind", "confidence", F.when(F.col("kind").isin(*P0_KINDS), "P0").otherwise("major").alias("severity"))


def wave_status(triple_replies: DataFrame, compare_replies: DataFrame, sections: int = 5, pairs: int = len(SECTION_PAIRS)) -> DataFrame:
    """(paper_id, n_triples, n_compares, phase): triples until every section has a reply, then compare until every pair has one, then done."""
    a = triple_replies.groupBy("paper_id").agg(F.count("*").alias("n_triples"))
    b = compare_replies.groupBy("paper_id").agg(F.count("*").alias("n_compares"))
    rows = a.join(b, "paper_id", "left").na.fill(0, ["n_compares"])
    phase = F.when(F.col("n_triples") < sections, "triples").when(F.col("n_compares") < pairs, "compare").otherwise("done")
    return rows.select("*", phase.alias("phase"))


def cost(usage: DataFrame, rates: DataFrame, warn_above: int = 100) -> DataFrame:
    """Cost of (model, tokens_in, tokens_out) by model, at rates (model, rate_in, rate_out) for a million tokens; null for a model without rates.

    A suffix in brackets doesn't count as part of a model's name. Usage is summed before it meets the rate card.
    """
    rows = usage.withColumn("model", F.regexp_replace("model", r"\[[^\]]*\]$", ""))
    sums = rows.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("n"))
    price = F.round((F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1e6, 4)
    return sums.join(rates, "model", "left").select("model", "tokens_in", "tokens_out", price.alias("cost"), (F.col("n") > warn_above).alias("warn"))


#: Fixed: lengths to which parts of a prompt are cut, and tokens that a reply may take, by kind of task.
CONTEXT, SIDE, SECTION = 1200, 300, 6000
REPLY = {"primary": 400, "devils_advocate": 400, "triples": 800, "compare": 900, "math": 300}


def _lines(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in parts))


def citation_prompt(claim: Column, context: Column) -> Column:
    return _lines(("Claim", F.substring(claim, 1, SIDE)), ("Context", F.substring(context, 1, CONTEXT)))


def adversarial_prompt(claim: Column, context: Column) -> Column:
    return F.concat(F.lit("Look for reasons why the source might not support this.\n"), citation_prompt(claim, context))


def triples_prompt(name: Column, body: Column) -> Column:
    return _lines(("Section", name), ("Text", F.substring(body, 1, SECTION)))


def compare_prompt(name_a: Column, claims_a: Column, name_b: Column, claims_b: Column) -> Column:
    return _lines(("First", name_a), ("Its claims", F.substring(claims_a, 1, SECTION)), ("Second", name_b), ("Its claims", F.substring(claims_b, 1, SECTION)))


def math_prompt(lhs: Column, rhs: Column, context: Column) -> Column:
    return _lines(("Left", F.substring(lhs, 1, SIDE)), ("Right", F.substring(rhs, 1, SIDE)), ("Context", F.substring(context, 1, CONTEXT)))


def citation_tasks(pending: DataFrame) -> DataFrame:
    """(claim_id, kind, task_id, max_tokens, prompt): one task for each pending claim (claim_id, claim, context, fast) in fast mode, else also one for the other side."""
    kinds = F.when(F.col("fast"), F.array(F.lit("primary"))).otherwise(F.array(F.lit("primary"), F.lit("devils_advocate")))
    rows = pending.withColumn("kind", F.explode(kinds))
    prompt = F.when(F.col("kind") == "primary", citation_prompt(F.col("claim"), F.col("context"))).otherwise(adversarial_prompt(F.col("claim"), F.col("context")))
    tokens = F.when(F.col("kind") == "primary", REPLY["primary"]).otherwise(REPLY["devils_advocate"])
    return rows.select("claim_id", "kind", F.concat_ws(":", "claim_id", "kind").alias("task_id"), tokens.alias("max_tokens"), prompt.alias("prompt"))


def emit(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (claim_id, claim, context, fast, status) split into the tasks of those that are open (status null) and the state: all claims, open ones pending."""
    state = claims.withColumn("phase", F.when(F.col("status").isNull(), "pending").otherwise("final"))
    return citation_tasks(claims.where("status is null")), state


MODES = ["sdk", "batch-emit", "batch-ingest"]


def backend_mode(chosen: str | None, key: bool, library: bool) -> str:
    """How judges are asked: as chosen, else directly where there are a key and a library for it, else by tasks for later."""
    if chosen is not None and chosen not in MODES:
        raise ValueError(f"{chosen!r} is none of {MODES}")
    return chosen or ("sdk" if key and library else "batch-emit")


def preflight(checks: DataFrame, effects: DataFrame, by: str) -> DataFrame:
    """Status of each run of (by, check, ok): ready, or degraded with the failed checks, the verifiers they affect and how.

    effects (check, verifier, effect) is a table of the deployment, a row for each verifier that a check bears on; a failed check
    without one degrades the run all the same. ``impact`` lists verifier:effect.
    """
    failed = checks.where("not ok").select(by, "check").distinct().join(effects, "check", "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    impact = F.when(F.col("verifier").isNotNull(), F.concat_ws(":", "verifier", "effect"))
    found = failed.groupBy(by).agg(listed("check").alias("missing"), listed("verifier").alias("affected"), listed(impact).alias("impact"))
    out = checks.select(by).distinct().join(found, by, "left").na.fill("", ["missing", "affected", "impact"])
    return out.select(by, F.when(F.col("missing") == "", "ready").otherwise("degraded").alias("status"), "missing", "affected", "impact")


def unverifiable_kind(errors: Column) -> Column:
    """env where an error's text shows a network fault, else evidence."""
    text = F.lower(F.coalesce(errors, F.lit("")))
    return F.when(F.array_contains(F.array(*(text.contains(m) for m in NETWORK)), True), "env").otherwise("evidence")


def math_severity(status: Column, kind: Column) -> Column:
    return F.when(status == "verified", "minor").when((status == "failed") | (F.coalesce(kind, F.lit("evidence")) == "evidence"), "P0").otherwise("major")


def judge_math(pending: DataFrame, judged: DataFrame) -> DataFrame:
    """Pending equations (task_id, ..) with their judge's verdict: plausible, sure enough, verifies; implausible fails as major; the rest stays open."""
    rows = pending.join(judged.select("task_id", F.col("verdict").alias("__v"), F.col("confidence").alias("__c")), "task_id", "left")
    yes = F.coalesce((F.col("__v") == "plausible") & F.col("__c").isin("high", "medium"), F.lit(False))
    no = F.coalesce(F.col("__v") == "implausible", F.lit(False))
    arrived = F.col("__v").isNotNull()
    out = rows.withColumns({"status": F.when(yes, "verified").when(no, "failed").otherwise("unverifiable"), "severity": F.when(yes, "minor").when(no, "major").otherwise("P0")})
    return out.withColumn("kind", F.when(~arrived, "env").when(~yes & ~no, "evidence")).drop("__v", "__c")
