"""Claims, sections, markers and equations of manuscripts (paper_id, round, tex)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

KEY = ["paper_id", "round"]
ABSTRACT = r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"


def _headed(manuscript: DataFrame) -> DataFrame:
    """manuscript with its headings and the text before, between and after them."""
    return t.once(manuscript, names=t.found(F.col("tex"), t.HEADING, 1), heads=t.found(F.col("tex"), t.HEADING, 0), bodies=F.split("tex", t.HEADING, -1))


def section_index(manuscript: DataFrame) -> DataFrame:
    """(paper_id, round, seq, heading, hint, key, body): the abstract (seq 0) and the text under each heading."""
    first = F.element_at("bodies", 1)
    abstract = F.when(F.col("tex").rlike(ABSTRACT), F.regexp_extract("tex", ABSTRACT, 1)).otherwise(first)
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("seq"), F.lit(None).cast("string").alias("heading"), F.lit("abstract").alias("hint"), F.lit("abstract").alias("key"), abstract.alias("body"))),
        F.transform("names", lambda h, i: F.struct((i + 1).alias("seq"), h.alias("heading"), t.heading_hint(h).alias("hint"), t.heading_key(h).alias("key"), F.get("bodies", i + 1).alias("body"))),
    )
    return _headed(manuscript).select(*KEY, F.inline(parts))


def section_hints(positions: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """positions (by, pos) with the hint of the smallest span (by, start, stop, hint) around each, the earliest of equal ones; null outside of all.

    Rows meet by key, so a position is compared with the spans of its own text only, and each is then worth a minimum.
    """
    inside = positions.distinct().join(spans, by, "left").withColumn("hit", F.when((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("stop")), F.struct((F.col("stop") - F.col("start")).alias("size"), "start", "hint")))
    best = inside.groupBy(*by, "pos").agg(F.min("hit")["hint"].alias("hint"))
    return positions.join(best, [*by, "pos"], "left")


def sentences(manuscript: DataFrame) -> DataFrame:
    """(paper_id, round, seq, hint, n, sentence) of cleaned sections; none is dropped or shifted by line breaks."""
    return section_index(manuscript).select(*KEY, "seq", "hint", F.posexplode(t.sentences(t.soft_clean(F.col("body")))).alias("n", "sentence"))


TYPES = ("citation", "numerical", "scope")


def _made(kind: str) -> Column:
    """Claims of one type in a sentence, as structs."""
    one = lambda kind_, value: F.struct(F.lit(kind).alias("type"), kind_.alias("kind"), value.alias("value"))
    none = F.array().cast("array<struct<type:string,kind:string,value:string>>")
    sentence = F.col("sentence")
    if kind == "citation":
        keys = F.flatten(F.transform(t.found(sentence, t.CITE, 1), lambda k: F.split(k, ",")))
        rows = F.transform(F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: k != ""), lambda k: one(F.lit(None).cast("string"), k))
        return F.when(F.contains(sentence, F.lit("\\")), rows).otherwise(none)
    if kind == "numerical":
        of = lambda name, pattern: F.transform(t.found(sentence, pattern), lambda v: one(F.lit(name), F.trim(v)))
        rows = F.concat(*(of(name, pattern) for name, pattern in t.NUMERIC.items()))
        return F.when(sentence.rlike(r"(?U)\d"), rows).otherwise(none)
    phrase = F.coalesce(*(F.get(t.found(sentence, "(?i)" + p), F.lit(0)) for p in t.SCOPE))
    return F.when(sentence.rlike(t.any_of(t.SCOPE, "Ui")), F.array(one(F.lit(None).cast("string"), phrase))).otherwise(none)


def claims(manuscript: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(paper_id, round, type, number, occurrence, kind, value, hint, sentence): all claims of some types, from one pass over the sentences.

    A value with its sentence's start (60 characters) is claimed once, as is a sentence's start (160) with a scope phrase, capitals apart;
    each mention of a cited key is a claim, its occurrence. Claims are numbered by type in the order of the text. All steps
    work within a manuscript, so rows are dealt out once.
    """
    rows = sentences(manuscript).select("*", F.posexplode(F.concat(*(_made(x) for x in types))).alias("pos", "c")).select(*KEY, "seq", "n", "pos", "hint", "sentence", "c.*")
    same = F.when(F.col("type") == "citation", F.struct(F.col("value").alias("a"), F.lit("").alias("b"))).when(F.col("type") == "numerical", F.struct(F.lower("value").alias("a"), F.lower(F.substring("sentence", 1, 60)).alias("b"))).otherwise(F.struct(F.lit("").alias("a"), F.lower(F.substring("sentence", 1, 160)).alias("b")))
    rows = rows.withColumn("same", same).repartition(*KEY)
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*KEY, "type", "same").orderBy("seq", "n", "pos"))).where("type = 'citation' or occurrence = 1")
    number = F.row_number().over(Window.partitionBy(*KEY, "type").orderBy("seq", "n", "pos")) - 1
    return rows.select(*KEY, "type", number.alias("number"), "occurrence", "kind", "value", "hint", "sentence")


def citation_claims(manuscript: DataFrame, bib: DataFrame) -> DataFrame:
    """One row for each cited key, with its bibliography entry where there is one; occurrence numbers equal locators."""
    rows = claims(manuscript, ("citation",)).withColumnRenamed("value", "cite_key").join(bib, "cite_key", "left")
    return rows.select(*KEY, F.concat(F.lit("cite:"), "cite_key").alias("locator"), "occurrence", "hint", "cite_key", t.truncate(F.col("sentence"), 400).alias("claim_quote"), "doi", "title", "year")


def numerical_claims(manuscript: DataFrame) -> DataFrame:
    """Numbers claimed, by kind, numbered in each paper."""
    return claims(manuscript, ("numerical",)).select(*KEY, F.concat(F.lit("numclaim:"), "number").alias("locator"), "kind", "value", "hint", t.truncate(F.col("sentence"), 400).alias("claim_quote"))


def scope_claims(manuscript: DataFrame) -> DataFrame:
    """Sentences with a scope phrase, the first pattern that matches."""
    return claims(manuscript, ("scope",)).select(*KEY, F.concat(F.lit("scope:"), "number").alias("locator"), F.col("value").alias("quantifier_phrase"), "hint", t.truncate(F.col("sentence"), 400).alias("claim_quote"))


def parse_sections(manuscript: DataFrame) -> DataFrame:
    """(paper_id, round, abstract, introduction, methods, results, conclusion): first non-empty text under each key.

    Without an abstract, the text before the first heading and after the title stands in, 3,000 characters of it. Without a methods
    heading, the text between the abstract (or title) and the first results or conclusion heading does where it has over 200 characters.
    A manuscript is one row throughout: nothing is shuffled.
    """
    rows = t.once(_headed(manuscript), keys=F.transform("names", t.heading_key), cleaned=F.transform("bodies", t.section_clean))
    under = lambda k: F.filter(F.arrays_zip("keys", F.slice("cleaned", 2, F.size("names") + 1).alias("body")), lambda p: (p["keys"] == k) & (p["body"] != ""))
    first = lambda k: F.coalesce(F.get(under(k), F.lit(0))["body"], F.lit(""))
    untitled = F.regexp_replace(F.element_at("bodies", 1), r"(?s)^.*\\maketitle", "")
    given = t.section_clean(F.regexp_extract("tex", ABSTRACT, 1))
    stop = F.array_position(F.transform("keys", lambda k: F.coalesce(k.isin("results", "conclusion"), F.lit(False))), True)
    before = F.array_join(F.transform(F.sequence(F.lit(1), stop), lambda i: F.concat(F.element_at("bodies", i.cast("int")), F.when(i < stop, F.element_at("heads", i.cast("int"))).otherwise(""))), "")
    rows = t.once(rows, given=given, found_methods=first("methods"), before=F.when(stop > 0, before))
    span = F.when(F.contains("before", F.lit(r"\end{abstract}")), F.regexp_replace("before", r"(?s)^.*?\\end\{abstract\}", "")).otherwise(F.regexp_replace("before", r"(?s)^.*?\\maketitle", ""))
    abstract = F.when(F.col("given") != "", F.col("given")).when(F.size("names") > 0, F.substring(t.section_clean(untitled), 1, 3000)).otherwise("")
    methods = F.when(F.col("found_methods") != "", F.col("found_methods")).when(F.length(span) > 200, t.section_clean(span)).otherwise("")
    return t.once(rows, abstract=abstract, introduction=first("introduction"), methods=methods, results=first("results"), conclusion=first("conclusion")).select(*KEY, "abstract", "introduction", "methods", "results", "conclusion")


MARKS = tuple(f"{part}_{kind}" for part in ("abstract", "introduction", "methods") for kind in ("universal", "restriction"))


def scan_markers(sections: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """sections with universal and restriction markers of abstract, introduction and methods, or some of these."""
    kinds = {"universal": t.UNIVERSAL, "restriction": t.RESTRICTION}
    return t.once(sections, **{m: t.markers(F.col(m.split("_")[0]), kinds[m.split("_")[1]]) for m in marks})


def claims_by_section(manuscript: DataFrame, bib: DataFrame) -> DataFrame:
    """Counts of all claims by section hint, type and kind: of scope claims the phrase, of citations whether the bibliography has them."""
    kind = F.when(F.col("type") == "numerical", F.col("kind")).otherwise(F.lower("value"))
    counts = claims(manuscript).select("hint", F.col("type").alias("claim_type"), F.when(F.col("type") == "citation", F.col("value")).otherwise(kind).alias("kind")).groupBy("hint", "claim_type", "kind").agg(F.count("*").alias("n"))
    # What is joined is counted before, a row for each key and hint.
    known = counts.join(bib.select(F.col("cite_key").alias("kind"), F.lit("citation").alias("claim_type"), F.col("title").isNotNull().alias("known")), ["kind", "claim_type"], "left")
    named = F.when(F.col("claim_type") == "citation", F.when(F.col("known"), "known").otherwise("unknown")).otherwise(F.col("kind"))
    return known.groupBy("hint", "claim_type", named.alias("kind")).agg(F.sum("n").alias("n_claims"))


def extract_summary(manuscript: DataFrame, samples: int = 2) -> DataFrame:
    """(paper_id, round, n_citation, n_numerical, n_scope, sample): claims of each paper by type, and the first few locators of each."""
    rows = claims(manuscript)
    locator = F.when(F.col("type") == "citation", F.concat(F.lit("cite:"), "value")).when(F.col("type") == "numerical", F.concat(F.lit("numclaim:"), "number")).otherwise(F.concat(F.lit("scope:"), "number"))
    first = F.when(F.col("number") < samples, F.struct("type", "number", locator.alias("locator")))
    counts = [F.count_if(F.col("type") == x).alias(f"n_{x}") for x in TYPES]
    return rows.groupBy(*KEY).agg(*counts, F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["locator"]), "|").alias("sample"))


def extract(manuscript: DataFrame, bib: DataFrame) -> tuple[dict[str, DataFrame], list[str]]:
    """The claims of each type, and the faults of types that can't be planned, for columns they miss or of the wrong kind; the other types stay."""
    made, faults = {}, []
    for name, make in (("citation", lambda: citation_claims(manuscript, bib)), ("numerical", lambda: numerical_claims(manuscript)), ("scope", lambda: scope_claims(manuscript))):
        try:
            made[name] = make()
        except Exception as e:  # noqa: BLE001  whatever a stage raises is reported, not hidden
            faults.append(f"{name} claims: {type(e).__name__}")
    return made, faults
