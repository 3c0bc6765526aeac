"""References resolved against metadata tables, and the judges' answers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .judging import unverifiable_kind


def resolve_doi(bib: DataFrame, catalog: DataFrame) -> DataFrame:
    ref = catalog.select(t.normalize_doi(F.col("doi")).alias("url"), F.col("title").alias("resolved_title"), t.strip_tags(F.col("abstract")).alias("resolved_abstract"), F.col("year").alias("resolved_year"), "source")
    return bib.withColumn("url", t.normalize_doi(F.col("doi"))).join(ref, "url", "left")


def _rare_tokens(titles: DataFrame, uses: DataFrame, least: float) -> DataFrame:
    """(title, marks, word): titles, with digests of their tokens, by the tokens at which similar ones must meet.

    In one order of all tokens, rare ones first, titles of similarity t over the larger set share one of the first n - ceil(t n) + 1
    tokens of each. So common words bring nobody together.
    """
    rows = titles.select("title", "marks", F.size("tokens").alias("n"), F.explode("tokens").alias("word")).join(uses, "word")
    first = F.row_number().over(Window.partitionBy("title").orderBy("uses", "word"))
    return rows.withColumn("__place", first).where(F.col("__place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("title", "marks", "word")


def similar_titles(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """(title, hit) of the distinct titles of both sides that are as similar as ``least``; digests sift the candidates, texts decide."""
    sides = [t.once(df.select("title").where("title is not null").distinct(), tokens=t.tokens(F.col("title"))).withColumn("marks", F.transform("tokens", lambda w: F.xxhash64(w))) for df in (left, right)]
    uses = sides[0].unionByName(sides[1]).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    a, b = (_rare_tokens(df, uses, least) for df in sides)
    pairs = a.join(b.select(F.col("title").alias("hit"), F.col("marks").alias("hit_marks"), "word"), "word")
    able = F.size(F.array_intersect("marks", "hit_marks")) >= least * F.greatest(F.size("marks"), F.size("hit_marks")) - 1e-9
    return pairs.where(able).select("title", "hit").distinct().where(t.title_similarity(F.col("title"), F.col("hit")) >= least)


def resolve_title(bib: DataFrame, catalog: DataFrame, least: float = 0.7, hits: int = 5) -> DataFrame:
    """The best of the first ``hits`` hits, by rank, whose title is close, whose year is within one, and with whose authors one surname is shared.

    Titles under six characters aren't searched. A hit is a catalogue row whose title is as similar as ``least``; like a search, only the first few by
    rank are looked at for year and authors. Distinct titles are compared, and of equal catalogue titles only the first few rows can be hits.
    """
    left = bib.where(F.length("title") >= 6)
    right = catalog.select("hit_rank", "doi", F.col("title").alias("hit"), F.col("year").alias("hit_year"), t.surnames(t.split_authors(F.col("author"))).alias("hit_names"))
    order = ["hit_rank", "doi"]
    first = F.row_number().over(Window.partitionBy("hit").orderBy(*order))
    right = right.withColumn("n", first).where(F.col("n") <= hits).drop("n")
    listed = similar_titles(left, catalog, least).join(right, "hit")
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("title").orderBy(*order))).where(F.col("n") <= hits)
    wanted = left.select("cite_key", "title", F.col("year").alias("want_year"), t.surnames(t.split_authors(F.col("author"))).alias("want_names"))
    near = F.coalesce(F.abs(F.col("want_year") - F.col("hit_year")) <= 1, F.lit(True))
    known = (F.size("want_names") == 0) | F.arrays_overlap("want_names", "hit_names")
    ok = wanted.join(listed, "title").where(near & known)
    best = Window.partitionBy("cite_key").orderBy(*order)
    return ok.withColumn("n", F.row_number().over(best)).where("n = 1").select("cite_key", F.col("doi").alias("hit_doi"), F.col("hit").alias("hit_title"), "hit_year")


def read_atom(feed: DataFrame) -> DataFrame:
    """(arxiv_id, title, abstract, year, author) of Atom entries (arxiv_id, xml); an entry without a title is none."""
    at = lambda path: F.xpath_string("xml", F.lit(f"/feed/entry/{path}"))
    names = F.array_join(F.xpath("xml", F.lit("/feed/entry/author/name/text()")), " and ")
    rows = feed.select(t.normalize_arxiv(F.col("arxiv_id")).alias("arxiv_id"), t.collapse(at("title")).alias("title"), F.nullif(t.collapse(at("summary")), F.lit("")).alias("abstract"), F.expr("try_cast(substr(xpath_string(xml, '/feed/entry/published'), 1, 4) as int)").alias("year"), names.alias("author"))
    return rows.where("title <> ''")


def resolve_arxiv(bib: DataFrame, entries: DataFrame) -> DataFrame:
    """bib (with eprint) and what the preprint service has under that id."""
    found = entries.select("arxiv_id", F.col("title").alias("resolved_title"), F.col("abstract").alias("resolved_abstract"), F.col("year").alias("resolved_year"))
    return bib.withColumn("arxiv_id", t.normalize_arxiv(F.col("eprint"))).join(found, "arxiv_id", "left")


def resolve_reference(bib: DataFrame, catalog: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """By DOI, where that gives no abstract by preprint id (if there are entries), where that gives none by title; fields are filled, never overwritten."""
    now = resolve_doi(bib, catalog).select("cite_key", F.col("resolved_title").alias("title"), F.nullif("resolved_abstract", F.lit("")).alias("abstract"), F.col("resolved_year").alias("year"))

    def fill(now: DataFrame, step: DataFrame) -> DataFrame:
        """step: (cite_key, t, a, y) of references that are open."""
        return now.join(step, "cite_key", "left").select("cite_key", *(F.coalesce(c, s).alias(c) for c, s in (("title", "t"), ("abstract", "a"), ("year", "y"))))

    still = lambda df: bib.join(df.where("abstract is null").select("cite_key"), "cite_key", "left_semi")
    if entries is not None:
        step = resolve_arxiv(still(now), entries).where("resolved_title is not null")
        now = fill(now, step.select("cite_key", F.col("resolved_title").alias("t"), F.col("resolved_abstract").alias("a"), F.col("resolved_year").alias("y")))
    by_title = resolve_title(still(now), catalog).join(catalog.select(F.col("doi").alias("hit_doi"), F.nullif(t.strip_tags(F.col("abstract")), F.lit("")).alias("a")), "hit_doi")
    return fill(now, by_title.select("cite_key", F.col("hit_title").alias("t"), "a", F.col("hit_year").alias("y")))


def author_mismatch(bib: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved references that share no surname with the entry."""
    hit = catalog.select(t.normalize_doi(F.col("doi")).alias("url"), t.surnames(t.split_authors(F.col("author"))).alias("hit_names"))
    rows = bib.select("cite_key", t.normalize_doi(F.col("doi")).alias("url"), t.surnames(t.split_authors(F.col("author"))).alias("names")).join(hit, "url")
    apart = (F.size("names") > 0) & (F.size("hit_names") > 0) & ~F.arrays_overlap("names", "hit_names")
    return rows.where(apart).select("cite_key", F.array_join("names", "|").alias("names"), F.array_join("hit_names", "|").alias("hit_names"))


def cache_state(cache: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """cache (payload, stored) with its content key and whether each entry is fresh or expired ``days`` after it was stored."""
    fresh = F.col("stored") > F.lit(now - timedelta(days=days))
    return cache.withColumns({"cache_key": F.sha2("payload", 256), "state": F.when(fresh, "fresh").otherwise("expired")})


VERDICTS = ["supports", "contradicts", "not_addressed", "insufficient_context"]


def judgements(results: DataFrame) -> DataFrame:
    """(task_id, verdict, confidence, ok): the last answer to each task, its JSON object parsed and its enums sanitised."""
    w = Window.partitionBy("task_id").orderBy(F.desc("line_no"))
    last = results.where(F.length("task_id") > 0).withColumn("n", F.row_number().over(w)).where("n = 1")
    verdict, confidence = t.judge_object(F.col("body"), "verdict"), t.judge_object(F.col("body"), "confidence")
    return last.select("task_id", "ok", t.sanitize(verdict, VERDICTS, "insufficient_context").alias("verdict"), t.sanitize(confidence, ["high", "medium", "low"], "low").alias("confidence"), verdict.alias("raw_verdict"))


def ingest(pending: DataFrame, results: DataFrame) -> DataFrame:
    """(event_id, agreed, missing, verdict, status, severity, kind): two judges' answers joined to each pending claim; a missing one is a matter of set-up."""
    j = judgements(results)
    side = lambda k: j.select(F.col("task_id").alias(f"t_{k}"), F.col("ok").alias(f"ok_{k}"), F.col("verdict").alias(f"v_{k}"), F.col("confidence").alias(f"c_{k}"))
    rows = pending.select("event_id", *(F.concat(F.lit("t"), F.col("event_id").cast("string"), F.lit(f":{k}")).alias(f"t_{x}") for x, k in (("a", "primary"), ("b", "devils_advocate"))))
    rows = rows.join(side("a"), "t_a", "left").join(side("b"), "t_b", "left")
    missing = F.col("v_a").isNull() | F.col("v_b").isNull() | ~F.col("ok_a") | ~F.col("ok_b")
    sure = F.col("c_a").isin("high", "medium") & F.col("c_b").isin("high", "medium")
    agreed = (F.col("v_a") == F.col("v_b")) & ((F.col("v_a") != "supports") | sure)
    rows = rows.withColumns({"missing": F.coalesce(missing, F.lit(True)), "agreed": F.coalesce(agreed, F.lit(False))})
    undecided = ~F.col("agreed") | (F.col("v_a") == "insufficient_context")
    status = F.when(F.col("missing") | undecided, "unverifiable").when(F.col("v_a") == "supports", "verified").otherwise("failed")
    rows = rows.withColumn("status", status)
    kind = F.when(F.col("missing"), "env").when(F.col("status") == "unverifiable", "evidence")
    return rows.select("event_id", "agreed", "missing", F.col("v_a").alias("verdict"), "status", F.when(F.col("status") == "verified", "minor").otherwise("P0").alias("severity"), kind.alias("kind"))


#: Fixed: what the root-cause key of a citation says of its verdict.
CAUSES = {"supports": "match", "contradicts": "contradicts", "not_addressed": "not-addressed"}


def classify(claims: DataFrame) -> DataFrame:
    """claims (sufficient, error, author_mismatch, missing, agreed, verdict) with status, severity, kind and cause, by the first rule that holds.

    No abstract, or another author's paper, leaves a citation unverifiable whatever the judges say; so do judges that are missing, undecided or
    at odds. Then their verdict counts.
    """
    lost, other = ~F.col("sufficient"), F.col("author_mismatch")
    open_ = F.col("missing") | ~F.col("agreed") | (F.col("verdict") == "insufficient_context")
    status = F.when(lost | other | open_, "unverifiable").when(F.col("verdict") == "supports", "verified").otherwise("failed")
    kind = F.when(lost, unverifiable_kind(F.col("error"))).when(other, "evidence").when(F.col("missing"), "env").when(open_, "evidence")
    cause = F.when(lost, "unresolvable").when(other, "author-mismatch").when(open_, "judge-unresolved")
    for verdict, name in CAUSES.items():
        cause = cause.when(F.col("verdict") == verdict, name)
    return claims.withColumns({"status": status, "kind": kind, "cause": cause}).withColumn("severity", F.when(F.col("status") == "verified", "minor").otherwise("P0"))
