"""Queries on the driver tables, and SQL that states each result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extract as x
from ..operators import formulas as fm
from ..operators import regression as g
from ..operators import resolve as r
from ..operators import scope as sc
from ..operators import verdicts as v
from ..sources import files
from ..sources.rendered import view, with_views

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a query under its function's name; its arguments are views."""
    def add(f):
        Q[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in views.split()))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


DOC = "doc_id"
HEAD = r"\\(?:chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}]{1,400})\}"
UNCOMMENT = r"replace(regexp_replace(replace({0}, '\%', chr(2)), '%[^\n]*', '', 'g'), chr(2), '\%')"
SOFT = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + UNCOMMENT + r", '\\(?:label|ref|eqref|hyperref|url|href)\{{[^{{}}]{{0,400}}\}}', ' ', 'g'), "
        r"'\\(?:textit|textbf|texttt|textsf|textrm|textsc|emph|mathrm|mathbf|mathit)\{{([^{{}}]{{0,400}})\}}', '\1', 'g'), '\$[^$]+\$', ' MATH ', 'g'), '\\\\', ' ', 'g'), '[ \t]+', ' ', 'g')")
SECTION = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + UNCOMMENT + r", '\\(?:cite|ref|eqref|label|citep|citet)\{{[^}}]*\}}', ' ', 'g'), "
           r"'\\(?:text(?:it|bf|tt|sf|rm|sc)|emph|mathrm|mathbf|mathit)\{{([^}}]*)\}}', ' \1 ', 'g'), '\\\\', ' ', 'g'), '[ \t]+', ' ', 'g'))")
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
HINT = (r"case when regexp_matches(lower({0}), '\bintroduction\b|\bintro\b|\bbackground\b') then 'intro' when regexp_matches(lower({0}), '\bmethod|approach|model|framework|theory|formulation|derivation') then 'methods' "
        r"when regexp_matches(lower({0}), '\bresult|experiment|evaluation|analysis|finding') then 'results' when regexp_matches(lower({0}), '\babstract\b') then 'abstract' else 'unknown' end")
KEYED = (r"case when regexp_matches(lower({0}), '\bintroduction\b|\bintro\b|\bbackground\b') then 'introduction' when regexp_matches(lower({0}), '\bmethod|approach|model|framework|theory|formulation|derivation') then 'methods' "
         r"when regexp_matches(lower({0}), '\bresult|experiment|evaluation|analysis|finding') then 'results' when regexp_matches(lower({0}), '\bconclusion|discussion|summary|outlook') then 'conclusion' end")
PARTS = rf"""heads as (select paper_id, round, regexp_extract_all(tex, '{HEAD}', 1) as h, regexp_split_to_array(tex, '{HEAD}') as b from manuscript),
parts as (select paper_id, round, 0 as seq, null as heading, 'abstract' as hint, 'abstract' as key, regexp_extract(tex, '(?s)\\begin\{{abstract\}}(.*?)\\end\{{abstract\}}', 1) as body from manuscript
 union all select paper_id, round, i as seq, h[i], {HINT.format('h[i]')}, {KEYED.format('h[i]')}, b[i + 1] from (select *, unnest(range(1, len(h) + 1)) as i from heads))"""
SENT = rf"""{PARTS}, cut as (select paper_id, round, seq, hint, string_split(regexp_replace({COLLAPSE.format(SOFT.format('body'))}, '([.!?])\s+([A-Z\\])', '\1' || chr(1) || '\2', 'g'), chr(1)) as s from parts),
sent as (select paper_id, round, seq, hint, n, sentence from (select paper_id, round, seq, hint, unnest(range(0, len(s))) as n, trim(unnest(s)) as sentence from cut) where sentence <> '')"""
QUOTE = f"case when length({COLLAPSE.format('sentence')}) <= 400 then {COLLAPSE.format('sentence')} else substr({COLLAPSE.format('sentence')}, 1, 399) || '…' end"


@query(r"select paper_id, round, length(tex) as n_chars, md5(tex) as digest from manuscript", "manuscript")
def scan_manuscripts(m):
    return m.select("paper_id", "round", F.length("tex").cast("long").alias("n_chars"), F.md5("tex").alias("digest"))


@query(f"select paper_id, round, {SOFT.format('tex')} as cleaned from manuscript", "manuscript")
def soft_clean(m):
    return m.select("paper_id", "round", t.soft_clean(F.col("tex")).alias("cleaned"))


@query(f"select paper_id, round, {SECTION.format('tex')} as cleaned from manuscript", "manuscript")
def section_clean(m):
    return m.select("paper_id", "round", t.section_clean(F.col("tex")).alias("cleaned"))


@query(f"select paper_id, round, {UNCOMMENT.format('tex')} as cleaned from manuscript", "manuscript")
def strip_comments(m):
    return m.select("paper_id", "round", t.strip_comments(F.col("tex")).alias("cleaned"))


@query(f"with {SENT} select * from sent", "manuscript")
def sentences(m):
    return x.sentences(m)


@query(f"select doc_id, case when length({COLLAPSE.format('text')}) <= 280 then {COLLAPSE.format('text')} else substr({COLLAPSE.format('text')}, 1, 279) || '…' end as quote from documents", "documents")
def truncate_quote(d):
    return d.select(DOC, t.truncate(F.col("text"), 280).alias("quote"))


@query(f"select doc_id, translate(lower({COLLAPSE.format('text')}), '“”‘’', '''''''''') as quote from documents", "documents")
def normalize_quote(d):
    return d.select(DOC, t.normalize_quote(F.col("text")).alias("quote"))


@query(rf"select cite_key, {COLLAPSE.format('''replace(replace(regexp_extract(bibtex, 'title = (.*),', 1), '{', ''), '}', '')''')} as title from bib", "bib")
def strip_braces(b):
    return b.select("cite_key", t.strip_braces(F.regexp_extract("bibtex", r"title = (.*),", 1)).alias("title"))


@query(f"select page_id, {COLLAPSE.format('''regexp_replace(html, '<[^>]+>', ' ', 'g')''')} as plain from pages", "pages")
def strip_tags(p):
    return p.select("page_id", t.strip_tags(F.col("html")).alias("plain"))


@query("select cite_key, 'https://doi.org/' || replace(doi, 'https://doi.org/', '') as url from bib", "bib")
def doi_normalize(b):
    return b.select("cite_key", t.normalize_doi(F.col("doi")).alias("url"))


@query("select c_custkey, cast(1000 + c_custkey % 9000 as string) || '.' || cast(c_custkey as string) as arxiv_id from customer", "customer")
def arxiv_normalize(c):
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "arXiv:").otherwise(""), (1000 + F.col("c_custkey") % 9000).cast("string"), F.lit("."), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "v2").otherwise(""))
    return c.select("c_custkey", t.normalize_arxiv(raw).alias("arxiv_id"))


@query("select cite_key, 'citation-match-' || substr(trim(regexp_replace(lower(coalesce(doi, title)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) as root_cause_key from bib", "bib")
def root_cause_slug(b):
    return b.select("cite_key", t.root_cause_slug("match", F.col("doi"), F.lit(None).cast("string"), F.col("title")).alias("root_cause_key"))


@query(r"with a as (select cite_key, unnest(string_split(author, ' and ')) as a from bib) select cite_key, string_agg(distinct regexp_replace(lower(split_part(a, ',', 1)), '[^a-z]', '', 'g'), '|' order by regexp_replace(lower(split_part(a, ',', 1)), '[^a-z]', '', 'g')) as names from a group by cite_key", "bib")
def surnames(b):
    return b.select("cite_key", F.array_join(t.surnames(t.split_authors(F.col("author"))), "|").alias("names"))


@query(r"select locator, array_to_string(list_sort(list_distinct(regexp_extract_all(curr_quote, '\d+(?:\.\d+)?'))), '|') as numbers from drift_pair", "drift_pair")
def numbers_in(d):
    return d.select("locator", F.array_join(t.numbers_in(F.col("curr_quote")), "|").alias("numbers"))


@query(rf"select paper_id, round, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(tex, '(?i)(?:{t.QUANTIFIER})'), lambda q: lower(q)))), '|') as quantifiers from manuscript", "manuscript")
def quantifiers_in(m):
    return m.select("paper_id", "round", F.array_join(t.quantifiers_in(F.col("tex")), "|").alias("quantifiers"))


@query(f"with {PARTS} select paper_id, round, seq, heading, hint, key, length(body) as n_chars from parts", "manuscript")
def section_index(m):
    return x.section_index(m).select("paper_id", "round", "seq", "heading", "hint", "key", F.length("body").cast("long").alias("n_chars"))


@query(f"with {PARTS} select hint, count(*) as n from parts group by hint", "manuscript")
def heading_hint(m):
    return x.section_index(m).groupBy("hint").agg(F.count("*").alias("n"))


@query(f"with {PARTS} select coalesce(key, 'none') as key, count(*) as n from parts group by 1", "manuscript")
def heading_key(m):
    return x.section_index(m).groupBy(F.coalesce("key", F.lit("none")).alias("key")).agg(F.count("*").alias("n"))


CITES = rf"""{SENT}, groups as (select *, regexp_extract_all(sentence, '{t.CITE}', 1) as g from sent), cites as (select * exclude (g), string_split(unnest(g), ',') as keys, generate_subscripts(g, 1) as p1 from groups),
one as (select * exclude (keys), trim(unnest(keys)) as cite_key, generate_subscripts(keys, 1) as p2 from cites),
claims as (select o.*, b.doi, b.title, b.year, row_number() over (partition by paper_id, round, o.cite_key order by seq, n, p1, p2) as occurrence, row_number() over (partition by paper_id, round order by seq, n, p1, p2) - 1 as number from one o left join bib b using (cite_key) where o.cite_key <> '')"""


@query(f"with {CITES} select paper_id, round, hint, cite_key, 'cite:' || cite_key as locator, occurrence, {QUOTE} as claim_quote, doi, title, year from claims", "manuscript bib")
def citation_claims(m, b):
    return x.citation_claims(m, b)


NUMS = SENT + ", found as (" + " union all ".join(f"select paper_id, round, hint, seq, n, sentence, '{k}' as kind, {i} as kind_no, regexp_extract_all(sentence, '{p}') as vs from sent" for i, (k, p) in enumerate(t.NUMERIC.items())) + """),
nums as (select * exclude (vs), trim(unnest(vs)) as value, generate_subscripts(vs, 1) as p from found), firsts as (select distinct on (paper_id, round, lower(value), lower(substr(sentence, 1, 60))) * from nums order by seq, n, kind_no, p),
kept as (select *, row_number() over (partition by paper_id, round order by seq, n, kind_no, p) - 1 as number from firsts)"""


@query(f"with {NUMS} select paper_id, round, 'numclaim:' || number as locator, kind, value, hint, {QUOTE} as claim_quote from kept", "manuscript")
def numerical_claims(m):
    return x.numerical_claims(m)


FIRST = "coalesce(" + ", ".join(f"nullif(regexp_extract(sentence, '(?i){p}'), '')" for p in t.SCOPE) + ")"
SCOPES = f"{SENT}, scopes as (select distinct on (paper_id, round, lower(substr(sentence, 1, 160))) *, {FIRST} as phrase from sent where {FIRST} is not null order by seq, n)"


@query(f"with {SCOPES} select paper_id, round, 'scope:' || cast(row_number() over (partition by paper_id, round order by seq, n) - 1 as varchar) as locator, phrase as quantifier_phrase, hint, {QUOTE} as claim_quote from scopes", "manuscript")
def scope_claims(m):
    return x.scope_claims(m)


ALL = f"""with {CITES}, {NUMS[len(SENT) + 2:]}, {SCOPES[len(SENT) + 2:]} select hint, claim_type, kind, count(*) as n_claims from (
select hint, 'citation' as claim_type, case when title is not null then 'known' else 'unknown' end as kind from claims union all select hint, 'numerical', kind from kept union all select hint, 'scope', lower(phrase) from scopes) group by all"""


@query(ALL, "manuscript bib")
def claims_by_section(m, b):
    return x.claims_by_section(m, b)


def _marks(part: str, patterns: list[str]) -> str:
    return "array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(lower({part}), '{p}')" for p in patterns) + "]))), '|')"


FIVE = f"""{PARTS}, clean as (select paper_id, round, seq, key, {SECTION.format('body')} as c from parts),
five as (select paper_id, round, {', '.join(f"coalesce(arg_min(c, seq) filter (key = '{k}' and c <> ''), '') as {k}" for k in ('abstract', 'introduction', 'results', 'conclusion'))}, coalesce(arg_min(c, seq) filter (key = 'methods' and c <> ''), '') as m from clean group by paper_id, round),
sections as (select five.* exclude (m), case when m <> '' then m when length(span) > 200 then {SECTION.format('span')} else '' end as methods from five join (select paper_id, round, regexp_extract(tex, '(?s)\\\\end\\{{abstract\\}}(.*?)\\\\section\\{{Results\\}}', 1) as span from manuscript) using (paper_id, round))"""


@query(f"with {FIVE} select * from sections", "manuscript")
def parse_sections(m):
    return x.parse_sections(m)


MARKED = f"""{FIVE}, marked as (select paper_id, round, methods, {_marks('abstract', t.UNIVERSAL)} as au, {_marks('abstract', t.RESTRICTION)} as ar, {_marks('introduction', t.UNIVERSAL)} as iu, {_marks('methods', t.RESTRICTION)} as mr from sections),
leak as (select *, case when mr = '' then cast([] as varchar[]) else string_split(mr, '|') end as ms, list_filter(case when mr = '' then cast([] as varchar[]) else string_split(mr, '|') end, lambda e: not list_contains(string_split(ar, '|'), e)) as missing from marked),
found as (select *, (au <> '' or iu <> '') and mr <> '' and len(missing) / greatest(1, len(ms)) >= 0.6 as lopsided, round(len(missing) / greatest(1, len(ms)), 3) as leak_ratio from leak)"""


@query(f"with {MARKED} select paper_id, round, au as abstract_universal, ar as abstract_restriction, iu as introduction_universal, mr as methods_restriction from marked", "manuscript")
def scan_markers(m):
    out = x.scan_markers(x.parse_sections(m))
    return out.select("paper_id", "round", *(F.array_join(c, "|").alias(c) for c in ("abstract_universal", "abstract_restriction", "introduction_universal", "methods_restriction")))


@query(f"with {MARKED} select paper_id, round, leak_ratio from found where lopsided", "manuscript")
def scope_asymmetry(m):
    return sc.findings(m).where("finding = 'universality_asymmetry'").select("paper_id", "round", "leak_ratio")


#: Every other pair of abstracts with a broad claim, so that restrictions leak where it isn't universal; the rest of the text is as rendered.
BROAD = "broad as (select paper_id, round, case when paper_id % 4 < 2 then replace(tex, 'We prove the bound', 'We prove that the bound holds') else tex end as tex from manuscript), "
LEAKS = BROAD + MARKED.replace("from manuscript", "from broad") + """, named as (select f.*, case when lopsided then 'universality_asymmetry' when regexp_matches(lower(s.abstract), 'prove that') and len(missing) >= 3 then 'restriction_leakage' when f.methods = '' then 'methods_missing' end as finding,
s.abstract from found f join sections s using (paper_id, round))"""


def _broad(m: DataFrame) -> DataFrame:
    return m.withColumn("tex", F.when(F.col("paper_id") % 4 < 2, F.replace("tex", F.lit("We prove the bound"), F.lit("We prove that the bound holds"))).otherwise(F.col("tex")))


@query(f"with {LEAKS} select paper_id, round, len(missing) as n_missing from named where finding = 'restriction_leakage'", "manuscript")
def scope_leakage(m):
    return sc.findings(_broad(m)).where("finding = 'restriction_leakage'").select("paper_id", "round", F.size("missing").cast("long").alias("n_missing"))


CUT = "case when length(C) <= 280 then C else substr(C, 1, 279) || '…' end"


@query(f"""with {LEAKS} select paper_id, round, case when finding = 'methods_missing' then 'unverifiable' else 'verified' end as status, case when finding is null then 'minor' when finding = 'restriction_leakage' then 'major' else 'P0' end as severity,
case when finding = 'methods_missing' then 'tool' end as kind, case when finding = 'universality_asymmetry' then 'high' else 'medium' end as confidence, 'internal-consistency-' || coalesce(finding, 'consistent') as root_cause_key,
{CUT.replace('C', COLLAPSE.format('abstract'))} as quote, {CUT.replace('C', COLLAPSE.format('methods'))} as paired_quote from named""", "manuscript")
def scope_targets(m):
    return sc.targets(sc.findings(_broad(m))).drop("locator", "finding")


@query(f"with {LEAKS} select round, case when methods = '' then 'unverifiable' when finding is not null then 'failed' else 'verified' end as status, case when methods = '' or finding = 'universality_asymmetry' then 'P0' when finding is not null then 'major' else 'minor' end as severity, count(*) as n from named group by all", "manuscript")
def scope_rollup(m):
    return sc.report(sc.findings(_broad(m))).groupBy("round", "status", "severity").agg(F.count("*").alias("n"))


EQS = rf"""eqs as (select paper_id, round, unnest(range(0, len(e))) as eq, trim(regexp_replace(unnest(e), '^(?:\$\$|\\begin\{{equation\*?\}})|(?:\$\$|\\end\{{equation\*?\}})$', '', 'g')) as body
 from (select paper_id, round, regexp_extract_all({UNCOMMENT.format('tex')}, '(?s)\$\$.*?\$\$|\\begin\{{equation\*?\}}.*?\\end\{{equation\*?\}}') as e from manuscript))"""


@query(f"with {EQS} select * from eqs", "manuscript")
def equations(m):
    return fm.equations(m).select("paper_id", "round", "eq", "body")


@query(rf"with {EQS} select paper_id, round, eq, 0 as pair, trim(split_part(body, '=', 1)) as lhs, trim(split_part(body, '=', 2)) as rhs from eqs where contains(body, '=') and not contains(body, ':=')", "manuscript")
def equality_pairs(m):
    return fm.equality_pairs(m)


def _tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@query(f"select b.cite_key, c.doi, round(len(list_intersect({_tokens('b.title')}, {_tokens('c.title')})) / greatest(len({_tokens('b.title')}), len({_tokens('c.title')})), 3) as similarity from bib b join catalog c on substr(b.cite_key, 2) = replace(c.doi, '10.1234/part.', '')", "bib catalog")
def title_similarity(b, c):
    """Each entry's title and its catalogue row's, which differs for every fourth."""
    pairs = b.select("cite_key", F.substring("cite_key", 2, 20).alias("part"), F.col("title").alias("a")).join(c.select(F.replace("doi", F.lit("10.1234/part."), F.lit("")).alias("part"), "doi", F.col("title").alias("b")), "part")
    return pairs.select("cite_key", "doi", F.round(t.title_similarity(F.col("a"), F.col("b")), 3).alias("similarity"))


GRAMS = """p as (select locator, translate(lower(trim(regexp_replace(prev_quote, '\\s+', ' ', 'g'))), '“”‘’', '''''''''') as a, translate(lower(trim(regexp_replace(curr_quote, '\\s+', ' ', 'g'))), '“”‘’', '''''''''') as b, prev_quote, curr_quote from drift_pair),
g as (select *, list_distinct(list_transform(range(1, greatest(length(a) - 3, 1) + 1), lambda i: substr(a, i, 4))) as x, list_distinct(list_transform(range(1, greatest(length(b) - 3, 1) + 1), lambda i: substr(b, i, 4))) as y from p),
j as (select locator, a = b as same, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 3) as overlap,
 list_sort(list_distinct(regexp_extract_all(prev_quote, '\\d+(?:\\.\\d+)?'))) <> list_sort(list_distinct(regexp_extract_all(curr_quote, '\\d+(?:\\.\\d+)?'))) or list_sort(list_distinct(list_transform(regexp_extract_all(prev_quote, '(?i)(?:QQ)'), lambda q: lower(q)))) <> list_sort(list_distinct(list_transform(regexp_extract_all(curr_quote, '(?i)(?:QQ)'), lambda q: lower(q)))) as differ from g)""".replace("QQ", t.QUANTIFIER)


@query(f"with {GRAMS} select locator, overlap from j", "drift_pair")
def ngram_jaccard(d):
    return t.with_overlap(d, t.normalize_quote(F.col("prev_quote")), t.normalize_quote(F.col("curr_quote"))).select("locator", "overlap")


@query(f"with {GRAMS} select locator, overlap, case when differ then 'P0' else 'major' end as severity from j where not same and overlap < 0.9", "drift_pair")
def claim_drift(d):
    return g.claim_drift(d)


@query(f"with {GRAMS} select locator, overlap, case when differ then 'P0' else 'major' end as severity from j where not same and (differ or overlap < 0.9)", "drift_pair")
def claim_drift_strict(d):
    return g.claim_drift(d, strict=True)


@query("select c.root_cause_key, c.status, c.severity from target c join target p on p.root_cause_key = c.root_cause_key and p.round = 1 where c.round = 2 and p.status = 'verified' and c.status <> 'verified'", "target")
def regressions(tg):
    return g.regressions(g.of_round(tg, 1), g.of_round(tg, 2), ["root_cause_key"]).select("root_cause_key", "status", "severity")


@query("select distinct c.seq, c.verifier_id, c.locator, c.status from target c join target p on p.verifier_id = c.verifier_id and p.locator = c.locator and p.round = 1 where c.round = 2 and p.status = 'verified' and c.status <> 'verified'", "target")
def regressions_stable(tg):
    return g.regressions(g.of_round(tg, 1), g.of_round(tg, 2), ["verifier_id", "locator"]).select("seq", "verifier_id", "locator", "status")


@query("""select p.root_cause_key, p.locator, p.severity, f.disposition, f.rationale from target p left join fix_log f on f.finding_key = p.root_cause_key
where p.round = 1 and (p.severity = 'P0' or p.status = 'failed') and not exists (select 1 from target c where c.round = 2 and c.root_cause_key = p.root_cause_key) and (f.disposition is null or f.disposition <> 'fixed')""", "target fix_log")
def deletion_evasion(tg, f):
    return g.deletion_evasion(g.of_round(tg, 1), g.of_round(tg, 2), f)


COVERED = "covered as (select distinct 'cite:p' || (seq % 40) as locator from target where round = 2 and verifier_id = 'citations' and status = 'verified')"
NEW_CITES = f"""{CITES}, {COVERED}, fresh as (select distinct paper_id, 'cite:' || cite_key as locator from claims c where round = 2 and not exists (select 1 from claims p where p.round = 1 and p.paper_id = c.paper_id and p.cite_key = c.cite_key)
 and 'cite:' || cite_key not in (select locator from covered))"""


def _new_citations(m: DataFrame, b: DataFrame, tg: DataFrame) -> DataFrame:
    """Verified targets cover the keys p0 to p39."""
    c = x.citation_claims(m, b)
    cited = g.of_round(tg, 2).where("verifier_id = 'citations'").withColumn("locator", F.concat(F.lit("cite:p"), (F.col("seq") % 40).cast("string")))
    return g.new_citations(c.where("round = 1"), c.where("round = 2"), cited)


@query(f"with {NEW_CITES} select * from fresh", "manuscript bib target")
def new_citations(m, b, tg):
    return _new_citations(m, b, tg)


NORM = "translate(lower({0}), '“”‘’', '''''''''')".format(QUOTE)
NEW_SCOPE = f"""{SCOPES}, made as (select paper_id, round, 'scope:' || (row_number() over (partition by paper_id, round order by seq, n) - 1) as locator, {NORM} as quote from scopes),
added as (select paper_id, locator, quote from made where round = 2 and quote not in (select quote from made where round = 1) and not exists (select 1 from target where round = 3 and verifier_id = 'scope'))"""


def _new_scope(m: DataFrame, tg: DataFrame) -> DataFrame:
    """The reports of a third round, of which there are none, leave the gate open."""
    c = x.scope_claims(m)
    return g.new_scope(c.where("round = 1"), c.where("round = 2"), g.of_round(tg, 3))


@query(f"with {NEW_SCOPE} select * from added", "manuscript target")
def new_scope(m, tg):
    return _new_scope(m, tg)


@query("select locator, arg_min(seq, seq) as seq from target where round = 2 group by locator", "target")
def dedupe_first(tg):
    return v.first_by(g.of_round(tg, 2), "locator", "seq").select("locator", "seq")


@query("select locator, max(seq) as seq, arg_max(status, seq) as status from target where round = 1 group by locator", "target")
def index_last(tg):
    return v.last_by(g.of_round(tg, 1), "locator", "seq").select("locator", "seq", "status")


@query("select locator from target where round = 1 intersect select locator from target where round = 2", "target")
def locator_intersect(tg):
    return g.of_round(tg, 1).select("locator").intersect(g.of_round(tg, 2).select("locator"))


@query("select root_cause_key from target where round = 2 except select root_cause_key from target where round = 1", "target")
def locator_except(tg):
    return g.of_round(tg, 2).select("root_cause_key").subtract(g.of_round(tg, 1).select("root_cause_key"))


LATTICE = """select round, verifier_id, seq % 500 as paper, count(*) as n_targets, count(*) filter (status = 'failed') as n_failed, count(*) filter (status = 'unverifiable') as n_unverifiable, count(*) filter (status = 'verified') as n_verified,
case when count(*) filter (status = 'failed') > 0 then 'failed' when count(*) filter (status = 'unverifiable') > 0 then 'unverifiable' else 'verified' end as status,
case when count(*) filter (status <> 'verified') > 0 then 'P0' else 'minor' end as severity from target where verifier_id = '{0}' group by all"""


def _lattice(tg: DataFrame, verifier: str) -> DataFrame:
    return v.rollup(tg.where(F.col("verifier_id") == verifier).withColumn("paper", F.col("seq") % 500), "round", "verifier_id", "paper")


@query(LATTICE.format("citations"), "target")
def citation_rollup(tg):
    return _lattice(tg, "citations")


@query(LATTICE.format("math"), "target")
def math_rollup(tg):
    return _lattice(tg, "math")


@query(LATTICE.format("regression"), "target")
def regression_rollup(tg):
    return _lattice(tg, "regression")


@query("""select round, seq % 500 as paper, n_p0, n_major, n_unverifiable, case when n_p0 + n_major > 0 then 'failed' when n_unverifiable > 0 then 'unverifiable' else 'verified' end as status,
case when n_p0 > 0 then 'P0' when n_major > 0 then 'major' when n_unverifiable > 0 then 'P0' else 'minor' end as severity from (select round, seq % 500 as seq, count(*) filter (status = 'verified' and severity = 'P0') as n_p0,
count(*) filter (status = 'verified' and severity = 'major') as n_major, count(*) filter (status = 'unverifiable') as n_unverifiable from target where verifier_id = 'contradiction' group by 1, 2)""", "target")
def contradiction_rollup(tg):
    return v.defect_rollup(tg.where("verifier_id = 'contradiction'").withColumn("paper", F.col("seq") % 500), "round", "paper")


@query("""select coalesce(verifier_id, 'total') as verifier_id, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'unverifiable') as unverifiable, count(*) filter (status = 'verified') as verified, count(*) as total from target group by rollup (verifier_id)""", "target")
def round_summary(tg):
    return v.round_summary(tg)


@query("""select round, seq, verifier_id, case when status = 'failed' then 'gate_blocker' when status = 'verified' then 'report' when kind = 'env' then 'setup_needed' when kind = 'tool' then 'human_review_recommended' else 'gate_blocker' end as disposition,
case verifier_id when 'math' then 'math_identity/methodology' when 'regression' then 'regression_safety/round_safety' else verifier_id end as lane, case severity when 'P0' then 'major' else severity end as severity from target where not (status = 'verified' and severity = 'minor')""", "target")
def consolidate(tg):
    return v.consolidate(tg)


@query("""select round, n_failed, n_uncovered, n_p0, n_failed + n_uncovered + n_p0 = 0 as released from (select round, count(*) filter (status = 'failed') as n_failed,
count(*) filter (status = 'unverifiable' and root_cause_key not in (select finding_key from fix_log)) as n_uncovered, count(*) filter (severity = 'P0' and status <> 'verified') as n_p0 from target group by round)""", "target fix_log")
def release_gate(tg, f):
    return v.release_gate(tg, f)


@query("select round, verifier_id, seq from (select *, row_number() over (partition by round, verifier_id order by seq) as n from target) where n <= 2", "target")
def topk_samples(tg):
    return v.top_k(tg, 2, ["round", "verifier_id"], "seq").select("round", "verifier_id", "seq")


@query("select task_id, line_no, body from (select *, row_number() over (partition by task_id order by line_no desc) as n from judge_result) where n = 1", "judge_result")
def results_last_wins(j):
    return v.last_by(j, "task_id", "line_no").select("task_id", "line_no", "body")


JUDGED = r"""last as (select *, regexp_extract(body, '"verdict":"([^"]*)"', 1) as vd, regexp_extract(body, '"confidence":"([^"]*)"', 1) as cf from judge_result qualify row_number() over (partition by task_id order by line_no desc) = 1),
judged as (select task_id, ok, case when vd in ('supports', 'contradicts', 'not_addressed', 'insufficient_context') then vd else 'insufficient_context' end as verdict, case when cf in ('high', 'medium', 'low') then cf else 'low' end as confidence, nullif(vd, '') as raw_verdict from last)"""


@query(f"with {JUDGED} select task_id, verdict, confidence, raw_verdict from judged", "judge_result")
def parse_judge_object(j):
    return r.judgements(j).select("task_id", "verdict", "confidence", "raw_verdict")


@query(f"with {JUDGED} select verdict, confidence, count(*) as n from judged group by all", "judge_result")
def enum_sanitize(j):
    return r.judgements(j).groupBy("verdict", "confidence").agg(F.count("*").alias("n"))


INGEST = f"""{JUDGED}, both_ as (select e.event_id, coalesce(a.task_id is null or b.task_id is null or not a.ok or not b.ok, true) as missing, coalesce(a.verdict = b.verdict and (a.verdict <> 'supports' or (a.confidence <> 'low' and b.confidence <> 'low')), false) as agreed, a.verdict as vd
 from events e left join judged a on a.task_id = 't' || cast(e.event_id as varchar) || ':primary' left join judged b on b.task_id = 't' || cast(e.event_id as varchar) || ':devils_advocate'),
done as (select event_id, agreed, missing, case when missing or not agreed or vd = 'insufficient_context' then 'unverifiable' when vd = 'supports' then 'verified' else 'failed' end as status from both_)"""


@query(f"with {INGEST} select event_id, agreed, status, case status when 'verified' then 'minor' else 'P0' end as severity, case when missing then 'env' when status = 'unverifiable' then 'evidence' end as kind from done", "events judge_result")
def ingest_citations(e, j):
    return r.ingest(e, j).drop("missing", "verdict")


@query(f"with {INGEST} select agreed, count(*) as n from done group by agreed", "events judge_result")
def judge_agreement(e, j):
    return r.ingest(e, j).groupBy("agreed").agg(F.count("*").alias("n"))


@query("select verifier_id, count(*) as n_tasks, least(10, greatest(1, count(*))) as batch from target where status = 'unverifiable' group by verifier_id", "target")
def task_manifest(tg):
    n = F.count("*")
    return tg.where("status = 'unverifiable'").groupBy("verifier_id").agg(n.alias("n_tasks"), F.least(F.lit(10), F.greatest(F.lit(1), n)).cast("long").alias("batch"))


@query("select cite_key, 'https://doi.org/' || c.doi as url, c.title as resolved_title, c.year as resolved_year, c.source from bib b join catalog c on b.doi = 'https://doi.org/' || c.doi", "bib catalog")
def resolve_doi(b, c):
    return r.resolve_doi(b, c).where("source is not null").select("cite_key", "url", "resolved_title", "resolved_year", "source")


TITLED = f"""names as (select cite_key, title, year, list_transform(string_split(author, ' and '), lambda a: regexp_replace(lower(split_part(a, ',', 1)), '[^a-z]', '', 'g')) as ns from bib),
alike as (select n.*, c.doi as hit_doi, c.title as hit_title, c.year as hit_year, c.abstract as hit_abstract, c.author, c.hit_rank from names n join catalog c on len(list_intersect({_tokens('n.title')}, {_tokens('c.title')})) / greatest(len({_tokens('n.title')}), len({_tokens('c.title')})) >= 0.7
 where length(n.title) >= 6 qualify row_number() over (partition by n.cite_key order by c.hit_rank, c.doi) <= 5),
hits as (select * from alike where abs(year - hit_year) <= 1 and list_contains(ns, regexp_replace(lower(string_split(author, ' ')[-1]), '[^a-z]', '', 'g')) qualify row_number() over (partition by cite_key order by hit_rank, hit_doi) = 1)"""


@query(f"with {TITLED} select cite_key, hit_doi, hit_title, hit_year from hits", "bib catalog")
def resolve_title(b, c):
    return r.resolve_title(b, c)


@query(f"""with {TITLED}, d as (select b.cite_key, c.title, nullif(trim(regexp_replace(regexp_replace(c.abstract, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') as abstract, c.year from bib b left join catalog c on b.doi = 'https://doi.org/' || c.doi)
select d.cite_key, coalesce(d.title, h.hit_title) as title, coalesce(d.abstract, nullif(trim(regexp_replace(regexp_replace(h.hit_abstract, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')) as abstract, coalesce(d.year, h.hit_year) as year from d left join hits h on h.cite_key = d.cite_key and d.abstract is null""", "bib catalog")
def resolve_reference(b, c):
    return r.resolve_reference(b, c)


@query("select b.cite_key, regexp_replace(lower(split_part(string_split(b.author, ' and ')[2], ',', 1)), '[^a-z]', '', 'g') || '|' || regexp_replace(lower(split_part(b.author, ',', 1)), '[^a-z]', '', 'g') as names, regexp_replace(lower(string_split(c.author, ' ')[-1]), '[^a-z]', '', 'g') as hit_names from bib b join catalog c on b.doi = 'https://doi.org/' || c.doi where not contains(b.author, upper(substr(string_split(c.author, ' ')[-1], 1, 1)) || substr(string_split(c.author, ' ')[-1], 2) || ',')", "bib catalog")
def author_mismatch(b, c):
    return r.author_mismatch(b, c)


@query("select event_id, case when cast(ts as timestamp) > (select max(cast(ts as timestamp)) from events) - interval 15 day then 'fresh' else 'expired' end as state, sha256(props) as cache_key from events", "events")
def cache_ttl(e):
    """Entries of the cache at the time of the last one, kept for 15 days."""
    now = e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return r.cache_state(e.select("event_id", F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("stored")), now, 15).select("event_id", "state", "cache_key")


@query("""select event_id, user_id, json_extract_string(props, '$.k') as k from events where event_id % 10 <> 0""", "events")
def jsonl_lenient(e):
    """Lines of JSON, every tenth broken."""
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return files.parse_lenient(e.select("event_id", "user_id", line.alias("line")), "k string")


@query("select locator, length(curr_quote) as n_chars, cast(replace(locator, 'scope:', '') as bigint) % 3 = 0 as warn from drift_pair", "drift_pair")
def claims_strict(d):
    """Claims as lines of JSON among comments and blank lines, every third without a reference."""
    number = F.replace("locator", F.lit("scope:"), F.lit("")).cast("long")
    reference = F.when(number % 3 != 0, F.struct(F.col("locator").alias("doi")))
    rows = d.select(F.explode(F.array(F.to_json(F.struct("locator", F.col("curr_quote").alias("claim_quote"), reference.alias("reference"))), F.lit("  # a comment"), F.lit(" "))).alias("line"))
    return files.parse_strict(rows).select("locator", F.length("claim_quote").cast("long").alias("n_chars"), "warn")


@query("select finding_key, disposition, rationale from fix_log", "fix_log")
def fix_log_load(f):
    """A log for each rationale and last digits, as a list or under entries; every other record has its key under the other name."""
    name = F.when(F.col("disposition") == "dropped", "root_cause_key").otherwise("finding_key")
    record = F.struct(F.when(name == "finding_key", F.col("finding_key")).alias("finding_key"), F.when(name == "root_cause_key", F.col("finding_key")).alias("root_cause_key"), "disposition", "rationale")
    logs = f.groupBy("rationale", F.substring("finding_key", -4, 4).alias("digits")).agg(F.to_json(F.collect_list(record)).alias("j"))
    line = F.when(F.col("digits") < "5", F.col("j")).otherwise(F.concat(F.lit('{"entries":'), "j", F.lit("}"))).alias("line")
    return files.parse_fix_log(logs.select(line))


PREPRINTS = """entry as (select regexp_replace(arxiv_id, 'v[0-9]+$', '') as arxiv_id, trim(regexp_replace(regexp_extract(xml, '<title>(.*)</title>', 1, 's'), '\\s+', ' ', 'g')) as title, nullif(trim(replace(regexp_extract(xml, '<summary>(.*)</summary>', 1), '&amp;', '&')), '') as abstract,
cast(regexp_extract(xml, '<published>(\\d{4})', 1) as int) as year from preprint), asked as (select *, cast(1000 + cast(substr(cite_key, 2) as bigint) % 9000 as varchar) || '.' || substr(cite_key, 2) as eprint from bib)"""


def _with_eprint(b: DataFrame) -> DataFrame:
    number = F.substring("cite_key", 2, 20).cast("long")
    prefix = F.when(number % 2 == 0, "arXiv:").otherwise("")
    return b.withColumn("eprint", F.concat(prefix, (1000 + number % 9000).cast("string"), F.lit("."), number.cast("string"), F.when(number % 4 == 0, "v7").otherwise("")))


@query(f"with {PREPRINTS} select a.cite_key, a.eprint as arxiv_id, e.title, e.abstract, e.year from asked a join entry e on e.arxiv_id = a.eprint", "bib preprint")
def resolve_arxiv(b, p):
    found = r.resolve_arxiv(_with_eprint(b), r.read_atom(p)).where("resolved_title is not null")
    return found.select("cite_key", "arxiv_id", F.col("resolved_title").alias("title"), F.col("resolved_abstract").alias("abstract"), F.col("resolved_year").alias("year"))


PLAIN = "nullif(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')"


@query(f"""with {PREPRINTS}, {TITLED}, d as (select b.cite_key, b.eprint, c.title, {PLAIN.format('c.abstract')} as abstract, c.year from asked b left join catalog c on b.doi = 'https://doi.org/' || c.doi),
p as (select d.cite_key, coalesce(d.title, e.title) as title, coalesce(d.abstract, e.abstract) as abstract, coalesce(d.year, e.year) as year from d left join entry e on e.arxiv_id = d.eprint and d.abstract is null)
select p.cite_key, coalesce(p.title, h.hit_title) as title, coalesce(p.abstract, {PLAIN.format('h.hit_abstract')}) as abstract, coalesce(p.year, h.hit_year) as year from p left join hits h on h.cite_key = p.cite_key and p.abstract is null""", "bib catalog preprint")
def resolve_chain(b, c, p):
    """By DOI, preprint id and title in turn."""
    return r.resolve_reference(_with_eprint(b), c, r.read_atom(p))


@query("""with h as (select paper_id, round, instr(tex, chr(92) || 'section{Introduction}') - 1 as i, instr(tex, chr(92) || 'section{Results}') - 1 as r, instr(tex, chr(92) || 'section{Conclusion}') - 1 as c, instr(tex, chr(92) || 'section{Methods}') - 1 as m,
instr(tex, chr(92) || 'begin{abstract}') - 1 as a, instr(tex, chr(92) || 'end{abstract}') - 1 as z, tex from manuscript),
p as (select paper_id, round, unnest([a + 20, i + 5, r + 5, c + 5]) as pos, unnest(['abstract', 'Introduction', 'Results', 'Conclusion']) as hint from h union all select paper_id, round, 0, null from h union all select paper_id, round, z + 1, 'paper' from h union all select paper_id, round, m + 3, 'Methods' from h where m >= 0)
select * from p""", "manuscript")
def section_hint(m):
    """The hint around some places of each manuscript: sections end where the next begins, the abstract lies within the paper's body."""
    named = ["Introduction", "Methods", "Results", "Conclusion"]
    start = lambda name: F.get(t.places(F.col("tex"), chr(92) + "section{" + name + "}"), F.lit(0))
    key = ["paper_id", "round"]
    rows = t.once(m, starts=F.array(*(F.struct(start(n).alias("start"), F.lit(n).alias("hint")) for n in named)), a=F.get(t.places(F.col("tex"), chr(92) + "begin{abstract}"), F.lit(0)), z=F.get(t.places(F.col("tex"), chr(92) + "end{abstract}"), F.lit(0)))
    there = F.array_sort(F.filter("starts", lambda s: s["start"].isNotNull()))
    sections = F.transform(there, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(there, i + 1)["start"], F.length("tex")).alias("stop"), s["hint"].alias("hint")))
    around = F.array(F.struct(F.col("a").alias("start"), F.col("z").alias("stop"), F.lit("abstract").alias("hint")), F.struct(F.col("a").alias("start"), F.length("tex").alias("stop"), F.lit("paper").alias("hint")))
    spans = rows.select(*key, F.inline(F.concat(sections, around)))
    at = F.concat(F.array(F.col("a") + 20, F.lit(0), F.col("z") + 1), F.transform(F.filter("starts", lambda s: s["start"].isNotNull()), lambda s: s["start"] + F.when(s["hint"] == "Methods", 3).otherwise(5)))
    return x.section_hints(rows.select(*key, F.explode(at).alias("pos")), spans, key)
