"""Column functions on LaTeX, BibTeX and judge text. Patterns are Unicode-aware, as the checks expect."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that decide what counts as a claim, a marker or a heading. Restrictions match whatever their capitals
# (text is lowered first, and so are the patterns), and a percentage may have an escaped sign: both as documented, not as found.
CITE = r"\\(?:cite|citet|citep|citeauthor|citeyear|citealt|citealp|citenum|parencite|textcite)(?:\[[^\]]{0,200}\])?(?:\[[^\]]{0,200}\])?\{([^{}]{0,400})\}"
HEADING = r"\\(?:chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}]{1,400})\}"
NUMERIC = {
    "speedup": r"(?i)\b(\d+(?:\.\d+)?)\s*[×xX]\s*(?:speedup|speed-?up|improvement|faster|better|larger|reduction|smaller|slower)\b",
    "percentage": r"(?i)\b(\d+(?:\.\d+)?)\s*\\?%\s*(?:accuracy|improvement|increase|decrease|error|reduction|gain|drop|boost|loss)\b",
    "p_value": r"(?i)\bp\s*[<=]\s*0?\.\d+\b",
    "metric": r"(?i)\b(?:accuracy|precision|recall|f1|auc|auroc|bleu|rouge|mse|rmse|mae)\s+(?:of|=)\s*\d+(?:\.\d+)?\s*\\?%?",
    "errorbar": r"\b\d+(?:\.\d+)?\s*(?:±|\+\-|\+/\-)\s*\d+(?:\.\d+)?\b",
}
SCOPE = [
    r"\bfor all\b", r"\bfor any\b", r"\bfor every\b", r"\buniversal(?:ly)?\b", r"\bwithout (?:any )?assumption(?:s)?\b", r"\bin general\b", r"\barbitrary\b",
    r"\bholds? (?:for|in) (?:all|any|every)\b", r"\bfirst to\b", r"\balways\b",
    r"\bany\s+(?:continuous|smooth|bounded|finite|arbitrary|general|system|dynamics|process|distribution|function|network|model)\b",
    r"\bunconditional(?:ly)?\b", r"\bmodel-?free\b", r"\bassumption-?free\b", r"\bnon-?parametric\b", r"\bregardless of\b",
]
QUANTIFIER = "|".join([
    r"\bfor all\b", r"\bfor any\b", r"\bfor every\b", r"\buniversal(?:ly)?\b", r"\bwithout (?:any )?assumption(?:s)?\b", r"\bin general\b", r"\barbitrary\b",
    r"\bholds? (?:for|in) (?:all|any|every)\b", r"\bfirst to\b", r"\balways\b", r"\bany\s+(?:continuous|smooth|bounded|finite|arbitrary|general)\b",
    r"\bunconditional(?:ly)?\b", r"\bmodel-?free\b", r"\bassumption-?free\b", r"\bnon-?parametric\b",
])
UNIVERSAL = [
    r"\buniversal(?:ly)?\b", r"\bin general\b", r"\bfully general\b", r"\bfor (?:all|any|every|arbitrary)\b", r"\barbitrary\b", r"\bunconditional(?:ly)?\b", r"\bregardless of\b",
    r"\bwithout (?:any )?assumption(?:s)?\b", r"\bholds? (?:for|in) all\b", r"\bfirst (?:principle|general|universal)\b", r"\bnon-perturbative\b", r"\bmodel-free\b",
    r"\bassumption-free\b", r"\bnonparametric\b", r"\bany (?:continuous|smooth|bounded|finite) (?:system|dynamics|process|distribution|function)\b",
]
RESTRICTION = [
    r"\bgaussian\b", r"\blog-normal\b", r"\bexponential family\b", r"\bsub-?gaussian\b", r"\bblock-?diagonal\b", r"\bdiagonal\b", r"\bsymmetric\b", r"\bcircular\b", r"\bsparse\b",
    r"\blinear(?:ized| regime)?\b", r"\bquadratic\b", r"\bweakly (?:coupled|non-?linear)\b", r"\bornstein-?uhlenbeck\b", r"\blangevin\b", r"\bmarkov(?:ian)?\b", r"\bsteady state\b",
    r"\bequilibrium\b", r"\bthermodynamic limit\b", r"\blow(?:-| )dimensional\b", r"\bhigh(?:-| )temperature\b", r"\bsmall noise\b", r"\bweak (?:coupling|interaction|noise)\b",
    r"\bdilute\b", r"\bmean-field\b", r"\bsynthetic (?:data|benchmark)\b", r"\btoy (?:model|problem|example)\b", r"\b1d\b|\bone[- ]dimensional\b", r"\b2d\b|\btwo[- ]dimensional\b",
    r"\basymptotically\b", r"\bto leading order\b", r"\bunder the assumption\b", r"\bassuming that\b", r"\bprovided that\b", r"\bif (?:we|one) assume(?:s)?\b",
    r"\bwhen .{0,40} is (?:small|large|positive|bounded)\b",
]
BROAD_CLAIM = [r"\bshow that\b", r"\bprove that\b", r"\bdemonstrate(?:s|d)?\b", r"\bestablish(?:es|ed)?\b", r"\bderive(?:s|d)?\b", r"\bobtain(?:s|ed)?\b", r"\bprovide(?:s|d)?\b"]
UNPARSEABLE = [
    r"\int", r"\oint", r"\iint", r"\iiint", r"\sum", r"\prod", r"\lim", r"\liminf", r"\limsup", r"\partial", r"\nabla", r"\Delta", r"\mathrm{d}", r"\,d", r"\mathbb", r"\mathcal",
    r"\mathbf", r"\mathscr", r"\langle", r"\rangle", r"\det", r"\tr", r"\Tr", r"\hat", r"\tilde", r"\overline", r"\underline", r"\bar", r"\text", r"\mbox",
]


def _replace(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, "(?U)" + r[0], r[1]), rules, c)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often they are read: the optimiser doesn't copy expressions across a generator, nor push filters below it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of the pattern."""
    return F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(group))


#: Runs of blanks become one; a single blank isn't matched, which most are.
_BLANKS = (r"[ \t]{2,}|\t", " ")


def soft_clean(tex: Column) -> Column:
    """Comments, references and style commands gone, inline formulas as MATH; citations stay."""
    return _replace(
        tex, (r"(?<!\\)%[^\n]*", ""), (r"\\(?:label|ref|eqref|hyperref|url|href)\{[^{}]{0,400}\}", " "),
        (r"\\(?:textit|textbf|texttt|textsf|textrm|textsc|emph|mathrm|mathbf|mathit)\{([^{}]{0,400})\}", "$1"), (r"\$[^$]+\$", " MATH "), (r"\\\\", " "), _BLANKS,
    )


def section_clean(body: Column) -> Column:
    """A section's text for marker search; citations go too. An escaped percent sign is no comment."""
    return F.trim(_replace(
        body, (r"(?<!\\)%[^\n]*", ""), (r"\\(?:cite|ref|eqref|label|citep|citet)\{[^}]*\}", " "),
        (r"\\(?:text(?:it|bf|tt|sf|rm|sc)|emph|mathrm|mathbf|mathit)\{([^}]*)\}", " $1 "), (r"\\\\", " "), _BLANKS,
    ))


def strip_comments(tex: Column) -> Column:
    return _replace(tex, (r"(?<!\\)%[^\n]*", ""))


def collapse(c: Column) -> Column:
    return F.trim(_replace(F.coalesce(c, F.lit("")), (r"\s{2,}|[^\S ]", " ")))


def sentences(text: Column) -> Column:
    """Array of sentences: breaks after . ! ? before a capital or a command."""
    parts = F.split(collapse(text), r" (?<=[.!?] )(?=[A-Z\\])")  # blanks are single by now
    return F.filter(parts, lambda s: s != "")


def truncate(c: Column, n: int) -> Column:
    clean = collapse(c)
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.substring(clean, 1, n - 1), F.lit("…")))


def normalize_quote(c: Column) -> Column:
    return F.translate(F.lower(collapse(c)), "“”‘’", "''''")


def strip_braces(c: Column) -> Column:
    out = F.trim(c)
    for _ in range(3):
        out = F.when(out.rlike(r"(?s)^(\{.*\}|\".*\")$") & (F.length(out) >= 2), F.trim(F.substring(out, F.lit(2), F.length(out) - 2))).otherwise(out)
    return collapse(F.translate(out, "{}", ""))


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def normalize_doi(c: Column) -> Column:
    """The DOI as a URL; null and blank stay null."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    return F.when(bare != "", F.concat(F.lit("https://doi.org/"), bare))


def normalize_arxiv(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^arxiv:", ""), r"v\d+$", "")


def root_cause_slug(tag: str, doi: Column, arxiv: Column, title: Column) -> Column:
    some = lambda x: F.when(x != "", x)
    slug = F.regexp_replace(F.lower(F.coalesce(some(doi), some(arxiv), title, F.lit("unknown"))), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.concat(F.lit(f"citation-{tag}-"), F.substring(F.when(slug == "", "unknown").otherwise(slug), 1, 60))


def surnames(authors: Column) -> Column:
    """Sorted distinct surnames of an array of authors: letters before the comma, else of the last word."""
    def one(a: Column) -> Column:
        name = F.when(F.contains(a, F.lit(",")), F.substring_index(a, ",", 1)).otherwise(F.element_at(F.split(F.trim(a), r"\s+"), -1))
        return F.regexp_replace(F.lower(name), "[^a-z]", "")

    return F.array_sort(F.array_distinct(F.filter(F.transform(authors, one), lambda s: F.length(s) >= 2)))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")


def numbers_in(c: Column) -> Column:
    return F.array_sort(F.array_distinct(found(c, r"\d+(?:\.\d+)?")))


def quantifiers_in(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found(c, f"(?i)(?:{QUANTIFIER})"), F.lower)))


# The words of headings, in the order in which they are tried.
def heading_hint(h: Column) -> Column:
    low = F.lower(h)
    return (
        F.when(low.rlike(r"\bintroduction\b|\bintro\b|\bbackground\b"), "intro").when(low.rlike(r"\bmethod|approach|model|framework|theory|formulation|derivation"), "methods")
        .when(low.rlike(r"\bresult|experiment|evaluation|analysis|finding"), "results").when(low.rlike(r"\babstract\b"), "abstract").otherwise("unknown")
    )


def heading_key(h: Column) -> Column:
    low = F.lower(h)
    return (
        F.when(low.rlike(r"\bintroduction\b|\bintro\b|\bbackground\b"), "introduction").when(low.rlike(r"\bmethod|approach|model|framework|theory|formulation|derivation"), "methods")
        .when(low.rlike(r"\bresult|experiment|evaluation|analysis|finding"), "results").when(low.rlike(r"\bconclusion|discussion|summary|outlook"), "conclusion")
    )


def any_of(patterns: list[str], flags: str = "U") -> str:
    """One pattern that matches where any does; the word boundary that all begin with is looked for once a place."""
    return rf"(?{flags})\b(?:" + "|".join(p.removeprefix(r"\b") for p in patterns) + ")"


def markers(text: Column, patterns: list[str]) -> Column:
    """Sorted distinct matches in the lowered text; one scan tells texts without any."""
    low = F.lower(text)
    hits = F.array_sort(F.array_distinct(F.flatten(F.array(*(found(low, p) for p in patterns)))))
    return F.when(low.rlike(any_of(patterns)), hits).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    return F.array_distinct(found(F.lower(c), "[a-z0-9]+"))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 where a side has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def ngrams(c: Column, n: int = 4) -> Column:
    whole = F.array(c)
    grams = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))  # linear in the length, unlike a substring for each place
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < n, whole).otherwise(F.array_distinct(grams))


def with_overlap(df: DataFrame, a: Column, b: Column, n: int = 4) -> DataFrame:
    """df with the Jaccard similarity of two texts' n-grams, rounded to three places, 0 where a side is empty, and whether the texts are the same."""
    df = once(df, __a=a, __b=b)
    df = once(df, same=F.col("__a") == F.col("__b"), __x=ngrams(F.col("__a"), n), __y=ngrams(F.col("__b"), n))
    df = once(df, __common=F.size(F.array_intersect("__x", "__y")))
    total = F.size("__x") + F.size("__y") - F.col("__common")
    return df.withColumn("overlap", F.when(total > 0, F.round(F.col("__common") / total, 3)).otherwise(F.lit(0.0))).drop("__a", "__b", "__x", "__y", "__common")


def unparseable_hits(body: Column) -> Column:
    return F.filter(F.array(*map(F.lit, UNPARSEABLE)), lambda t: F.contains(body, t))


def is_definition(body: Column) -> Column:
    return F.contains(body, F.lit(":=")) | F.contains(body, F.lit(r"\equiv")) | F.contains(body, F.lit(r"\coloneqq"))


def places(text: Column, mark: str) -> Column:
    """Places (from 0) at which a fixed mark begins."""
    before = F.split(text, re.escape(mark), -1)
    steps = F.transform(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda x: F.length(x) + len(mark))
    return F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, 1, i + 1), F.lit(-len(mark)), lambda n, x: n + x))


def judge_object(body: Column, field: str) -> Column:
    """A field of the first JSON object in free text; null where there is none."""
    return F.get_json_object(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), f"$.{field}")


def sanitize(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(default)
