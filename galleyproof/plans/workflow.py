"""Queries on judges' replies, waves of tasks, costs and set-up, and SQL that states each result independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extract as x
from ..operators import judging as jd
from ..operators import regression as g
from ..operators import resolve as r
from ..sources import files
from . import catalogue
from .catalogue import INGEST, JUDGED, query

_before = set(catalogue.Q)

TRIPLES = """raw as (select paper_id, section, regexp_extract(body, '\\[.*\\]', 0, 's') as j from triple_reply ),
ok as (select paper_id, section, from_json(j, '[{"subject":"VARCHAR","predicate":"VARCHAR","scope":"VARCHAR","quote_span":"VARCHAR"}]') as items from raw where j <> '' and json_valid(j)),
tr as (select paper_id, section, unnest(items[1:8]) as i, generate_subscripts(items[1:8], 1) - 1 as pos from ok)"""


@query(f"with {TRIPLES} select paper_id, section, pos, i.subject as subject, substr(i.predicate, 1, 300) as predicate, i.scope as scope, coalesce(i.quote_span, '') as quote_span from tr", "triple_reply")
def triples(replies):
    return jd.triples(replies)


@query(f"with {TRIPLES} select w.paper_id, w.section, coalesce(len(ok.items), -1) as n_items from raw w left join ok using (paper_id, section)", "triple_reply")
def parse_judge_array(replies):
    items = jd.judge_array(F.col("body"), "string")
    return replies.select("paper_id", "section", F.when(items.isNotNull(), F.size(items)).otherwise(-1).cast("long").alias("n_items"))


@query(f"with {TRIPLES} select paper_id, count(distinct section) as n_sections, count(*) as n_triples from tr group by paper_id", "triple_reply")
def section_stats(replies):
    return jd.triples(replies).groupBy("paper_id").agg(F.count_distinct("section").alias("n_sections"), F.count("*").alias("n_triples"))


@query(f"""with {TRIPLES}, c as (select w.paper_id, w.section, count(tr.pos) as n from raw w left join tr using (paper_id, section) group by all),
p as (select * from (values ('abstract', 'conclusion'), ('abstract', 'methods'), ('introduction', 'results')) as p(section_a, section_b)),
n as (select q.paper_id, section_a, section_b, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from (select distinct paper_id from raw) q cross join p left join c a on a.paper_id = q.paper_id and a.section = section_a left join c b on b.paper_id = q.paper_id and b.section = section_b)
select *, case when n_a > 0 and n_b > 0 then 'pending' else 'unverifiable' end as status, case when n_a = 0 or n_b = 0 then 'tool' end as kind from n""", "triple_reply")
def section_pairs(replies):
    items = jd.judge_array(F.col("body"), "struct<subject: string>")
    counts = replies.select("paper_id", "section", F.least(F.coalesce(F.size(F.filter(items, lambda i: i.isNotNull())), F.lit(0)), F.lit(jd.MOST_TRIPLES)).cast("long").alias("n_triples"))
    return jd.section_pairs(counts.withColumn("n_triples", F.greatest("n_triples", F.lit(0).cast("long"))))


@query("""with items as (select paper_id, section_a, section_b, unnest(from_json(body, '[{"contradiction_kind":"VARCHAR","confidence":"VARCHAR"}]')) as i, generate_subscripts(from_json(body, '["JSON"]'), 1) as pos from compare_reply ),
kept as (select *, i.contradiction_kind as kind, lower(i.confidence) as confidence from items where i.contradiction_kind <> 'bogus' and lower(i.confidence) in ('high', 'medium'))
select 'contradiction:' || section_a || '-' || section_b || '-' || cast(row_number() over (partition by paper_id, section_a, section_b order by pos) - 1 as varchar) as locator, paper_id, section_a, section_b, kind, confidence,
case when kind in ('direct_opposite', 'promise_not_delivered') then 'P0' else 'major' end as severity from kept""", "compare_reply")
def contradictions(replies):
    return jd.contradictions(replies)


@query("""select a.paper_id, a.n as n_triples, coalesce(b.n, 0) as n_compares, case when a.n < 5 then 'triples' when coalesce(b.n, 0) < 3 then 'compare' else 'done' end as phase
from (select paper_id, count(*) as n from triple_reply group by 1) a left join (select paper_id, count(*) as n from compare_reply group by 1) b using (paper_id)""", "triple_reply compare_reply")
def wave_status(first, second):
    return jd.wave_status(first, second)


@query("""select event_type as model, cast(sum(event_id % 1000) as bigint) as tokens_in, cast(sum(user_id % 500) as bigint) as tokens_out,
round(case event_type when 'view' then sum(event_id % 1000) * 3.0 + sum(user_id % 500) * 15.0 when 'click' then sum(event_id % 1000) * 1.0 + sum(user_id % 500) * 5.0 end / 1e6, 4) as cost, count(*) > 100 as warn from events group by event_type""", "events")
def cost_estimate(e):
    named = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("[long]"))).otherwise(F.col("event_type"))
    return jd.cost(e.select(named.alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("user_id") % 500).alias("tokens_out")), e.sparkSession.createDataFrame([("view", 3.0, 15.0), ("click", 1.0, 5.0)], "model string, rate_in double, rate_out double"))


#: Checks of the fixture and what each bears on, from the parts table: every brand is a verifier that some checks affect.
EFFECT = "select concat('check ', cast(p_size as string)) as chk, p_brand as verifier, min(case when p_partkey % 2 = 0 then 'stops' else 'falls back' end) as effect from part where p_size % 10 < 4 group by p_size, p_brand"


@query(f"""with e as ({EFFECT}), c as (select distinct o_custkey % 1000 as run, 'check ' || cast(o_orderkey % 50 as varchar) as chk, o_orderstatus as s from orders),
f as (select distinct run, c.chk, verifier, effect from c left join e on e.chk = c.chk where s = 'F'),
g as (select run, string_agg(distinct chk, ',' order by chk) as missing, coalesce(string_agg(distinct verifier, ',' order by verifier), '') as affected, coalesce(string_agg(distinct verifier || ':' || effect, ',' order by verifier || ':' || effect), '') as impact from f group by run)
select r.run, case when g.run is null then 'ready' else 'degraded' end as status, coalesce(missing, '') as missing, coalesce(affected, '') as affected, coalesce(impact, '') as impact from (select distinct run from c) r left join g using (run)""", "orders part")
def preflight_rollup(o, p):
    check = F.concat(F.lit("check "), (F.col("o_orderkey") % 50).cast("string"))
    checks = o.select((F.col("o_custkey") % 1000).alias("run"), check.alias("check"), (F.col("o_orderstatus") != "F").alias("ok"))
    effect = F.min(F.when(F.col("p_partkey") % 2 == 0, "stops").otherwise("falls back"))
    effects = p.where("p_size % 10 < 4").groupBy(F.concat(F.lit("check "), F.col("p_size").cast("string")).alias("check"), F.col("p_brand").alias("verifier")).agg(effect.alias("effect"))
    return jd.preflight(checks, effects, "run")


ERROR = "case event_id % 6 when 0 then 'URLError: timed out' when 1 then 'HTTP 503' when 2 then 'HTTP 404 not found' when 3 then 'Failed to connect' when 4 then 'no hit' end"


@query(f"select event_id, case event_id % 6 when 0 then 'env' when 1 then 'env' when 3 then 'env' else 'evidence' end as kind from events", "events")
def unverifiable_kind(e):
    return e.select("event_id", jd.unverifiable_kind(F.expr(ERROR)).alias("kind"))


@query(f"""with {INGEST}, v as (select d.event_id, d.status, d.missing, b.vd, event_id % 8 = 0 as lost, event_id % 9 = 0 as other from done d join both_ b using (event_id))
select event_id, case when lost or other then 'unverifiable' else status end as status, case when not lost and not other and status = 'verified' then 'minor' else 'P0' end as severity,
case when lost then case when event_id % 6 in (0, 1, 3) then 'env' else 'evidence' end when other then 'evidence' when missing then 'env' when status = 'unverifiable' then 'evidence' end as kind,
case when lost then 'unresolvable' when other then 'author-mismatch' when status = 'unverifiable' then 'judge-unresolved' when vd = 'supports' then 'match' when vd = 'contradicts' then 'contradicts' else 'not-addressed' end as cause from v""", "events judge_result")
def classify_citations(e, j):
    known = e.select("event_id", (F.col("event_id") % 8 != 0).alias("sufficient"), (F.col("event_id") % 9 == 0).alias("author_mismatch"), F.expr(ERROR).alias("error"))
    rows = r.ingest(e, j).select("event_id", "missing", "agreed", "verdict").join(known, "event_id")
    return r.classify(rows).select("event_id", "status", "severity", "kind", "cause")


@query("""select 'd' || cast(doc_id as varchar) as claim_id, k.kind, 'd' || cast(doc_id as varchar) || ':' || k.kind as task_id, 400 as max_tokens, case k.kind when 'primary' then '' else 'Look for reasons why the source might not support this.' || chr(10) end
 || 'Claim: ' || substr(coalesce(text, ''), 1, 300) || chr(10) || 'Context: ' || substr(coalesce(text, ''), 301, 1200) as prompt
from documents join (values ('primary'), ('devils_advocate')) as k(kind) on k.kind = 'primary' or doc_id % 4 <> 0 where doc_id % 5 <> 0""", "documents")
def judge_tasks(d):
    """Tasks of claims that are open: every fourth in fast mode, every fifth settled before."""
    text = F.coalesce("text", F.lit(""))
    claims = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("claim_id"), text.alias("claim"), F.substring(text, 301, 1200).alias("context"), (F.col("doc_id") % 4 == 0).alias("fast"), F.when(F.col("doc_id") % 5 == 0, "verified").alias("status"))
    return jd.emit(claims)[0]


@query("select case when doc_id % 5 = 0 then 'final' else 'pending' end as phase, count(*) as n from documents group by 1", "documents")
def emit_state(d):
    claims = d.select(F.col("doc_id").cast("string").alias("claim_id"), F.col("text").alias("claim"), F.col("text").alias("context"), F.lit(False).alias("fast"), F.when(F.col("doc_id") % 5 == 0, "verified").alias("status"))
    return jd.emit(claims)[1].groupBy("phase").agg(F.count("*").alias("n"))


@query(f"""with {JUDGED}, m as (select t.round, t.seq, case j.verdict when 'supports' then 'plausible' when 'contradicts' then 'implausible' when 'not_addressed' then 'uncertain' when 'insufficient_context' then 'uncertain' end as vd, j.confidence as cf
 from target t left join judged j on j.task_id = 't' || cast(t.seq as varchar) || ':primary' where t.verifier_id = 'math' and t.status = 'unverifiable')
select round, seq, case when vd = 'plausible' and cf <> 'low' then 'verified' when vd = 'implausible' then 'failed' else 'unverifiable' end as status,
case when vd = 'plausible' and cf <> 'low' then 'minor' when vd = 'implausible' then 'major' else 'P0' end as severity,
case when vd is null then 'env' when vd = 'uncertain' or (vd = 'plausible' and cf = 'low') then 'evidence' end as kind from m""", "target judge_result")
def ingest_math(tg, j):
    verdict = F.when(F.col("verdict") == "supports", "plausible").when(F.col("verdict") == "contradicts", "implausible").otherwise("uncertain")
    pending = tg.where("verifier_id = 'math' and status = 'unverifiable'").select("round", "seq", F.concat(F.lit("t"), F.col("seq").cast("string"), F.lit(":primary")).alias("task_id"))
    return jd.judge_math(pending, r.judgements(j).withColumn("verdict", verdict)).drop("task_id")


@query("select round, seq, case when status = 'verified' then 'minor' when status = 'failed' then 'P0' when coalesce(kind, 'evidence') = 'evidence' then 'P0' else 'major' end as severity from target where verifier_id = 'math'", "target")
def math_severity(tg):
    return tg.where("verifier_id = 'math'").select("round", "seq", jd.math_severity(F.col("status"), F.col("kind")).alias("severity"))


@query("""with want as (select event_type, 't' || cast(event_id as varchar) || ':' || k.kind as task_id from events cross join (values ('primary'), ('devils_advocate')) as k(kind)),
have as (select distinct task_id from judge_result )
select event_type, count(*) as n_expected, count(h.task_id) as n_arrived, case when count(h.task_id) < count(*) then 'pending' else 'done' end as phase from want w left join have h using (task_id) group by event_type""", "events judge_result")
def round_pending(e, j):
    """Whether each group of tasks has all its results."""
    kinds = F.array(F.lit("primary"), F.lit("devils_advocate"))
    want = e.select("event_type", "event_id", F.explode(kinds).alias("kind")).select("event_type", F.concat(F.lit("t"), F.col("event_id").cast("string"), F.lit(":"), "kind").alias("task_id"))
    have = j.select("task_id", F.lit(1).alias("have")).distinct()
    out = want.join(have, "task_id", "left").groupBy("event_type").agg(F.count("*").alias("n_expected"), F.count("have").alias("n_arrived"))
    return out.withColumn("phase", F.when(F.col("n_arrived") < F.col("n_expected"), "pending").otherwise("done"))


@query("""select 'r' || cast(round as varchar) || '-' || verifier_id || '-' || cast(seq // 64 as varchar) as report, verifier_id, locator, status, severity, root_cause_key, kind from target where seq % 64 <> 63""", "target")
def explode_targets(tg):
    """Targets of JSON reports; a report holds 64 order numbers of a verifier, and the last of them without targets at all."""
    evidence = F.struct(F.col("kind").alias("unverifiable_kind"))
    target = F.when(F.col("seq") % 64 != 63, F.struct("locator", F.initcap("status").alias("status"), F.col("severity").alias("severity_suggestion"), "root_cause_key", evidence.alias("evidence")))
    name = F.concat(F.lit("r"), F.col("round").cast("string"), F.lit("-"), "verifier_id", F.lit("-"), F.floor(F.col("seq") / 64).cast("string"))
    reports = tg.groupBy("round", name.alias("report"), "verifier_id").agg(F.collect_list(target).alias("targets"))
    text = reports.select("report", F.to_json(F.struct("verifier_id", "targets")).alias("line")).union(reports.select("report", F.lit("{not json").alias("line")))
    return files.targets_of(files.parse_lenient(text, files.REPORT))


@query(f"""with {catalogue.NUMS}, {catalogue.SCOPES[len(catalogue.SENT) + 2:]}, said as (select paper_id, round, 'numerical' as type, number, {catalogue.QUOTE} as quote from kept
union all select paper_id, round, 'scope', row_number() over (partition by paper_id, round order by seq, n) - 1, {catalogue.QUOTE} from scopes)
select a.paper_id, a.type, a.number, a.quote as prev_quote, b.quote as curr_quote from said a join said b using (paper_id, type, number) where a.round = 1 and b.round = 2 and a.quote <> b.quote""", "manuscript")
def quote_pairs(m):
    """Claims of both rounds under one locator whose quotes differ."""
    c = x.claims(m, ("numerical", "scope")).withColumn("claim_quote", t.truncate(F.col("sentence"), 400))
    pairs = g.quote_pairs(c.where("round = 1"), c.where("round = 2"), ["paper_id", "type", "number"])
    return pairs.where("prev_quote <> curr_quote")


@query(f"""with {catalogue.GRAMS}, {catalogue.NEW_CITES}, {catalogue.NEW_SCOPE[len(catalogue.SENT) + 2:]}, prev as (select * from target where round = 1), curr as (select * from target where round = 2),
gone as (select p.root_cause_key from prev p where (p.severity = 'P0' or p.status = 'failed') and p.root_cause_key not in (select root_cause_key from curr) and p.root_cause_key not in (select finding_key from fix_log where disposition = 'fixed')),
back as (select c.root_cause_key from curr c where c.status in ('failed', 'unverifiable') and c.root_cause_key in (select root_cause_key from prev where status = 'verified')),
listed as (select 'regressions' as checker, 'regression:' || root_cause_key as locator, 'failed' as status, 'P0' as severity, null as kind, 'regression-' || root_cause_key as root_cause_key from back
 union all select 'claim_drift', 'claim-drift:' || locator, 'failed', case when differ then 'P0' else 'major' end, null, 'claim-drift-' || locator from j where not same and overlap < 0.9
 union all select 'deletion_evasion', 'deletion-evasion:' || root_cause_key, 'failed', 'P0', null, 'deletion-evasion-' || root_cause_key from gone
 union all select distinct 'new_citations', 'new-citation:' || locator, 'unverifiable', 'P0', 'evidence', 'new-citation-uncovered-' || locator from fresh
 union all select distinct 'new_scope', 'new-scope:' || locator, 'unverifiable', 'P0', 'evidence', 'new-scope-uncovered-' || locator from added)
select * from listed""", "manuscript bib target fix_log drift_pair")
def regression_report(m, b, tg, f, d):
    """All checkers' targets, one for each cause."""
    prev, curr = g.of_round(tg, 1), g.of_round(tg, 2)

    def named(rows, of, prefix, cause, status="failed"):
        severity = F.col("severity") if prefix == "claim-drift:" else F.lit("P0")
        return rows.select(F.concat(F.lit(prefix), of).alias("locator"), F.lit(status).alias("status"), severity.alias("severity"), F.concat(F.lit(cause), of).alias("root_cause_key"))

    found = g.report({
        "regressions": lambda: named(g.regressions(prev, curr, ["root_cause_key"]), "root_cause_key", "regression:", "regression-"),
        "claim_drift": lambda: named(g.claim_drift(d), "locator", "claim-drift:", "claim-drift-"),
        "deletion_evasion": lambda: named(g.deletion_evasion(prev, curr, f), "root_cause_key", "deletion-evasion:", "deletion-evasion-"),
        "new_citations": lambda: named(catalogue._new_citations(m, b, tg), "locator", "new-citation:", "new-citation-uncovered-", "unverifiable"),
        "new_scope": lambda: named(catalogue._new_scope(m, tg), "locator", "new-scope:", "new-scope-uncovered-", "unverifiable"),
    })
    return found.drop("notes")


@query(r"""select cite_key, 'article' as entry_type, trim(regexp_replace(replace(replace(regexp_extract(bibtex, 'title = (.*),', 1), '{', ''), '}', ''), '\s+', ' ', 'g')) as title, regexp_extract(bibtex, 'author = \{(.*)\},', 1) as author, cast(regexp_extract(bibtex, 'year = \{(\d+)\}', 1) as int) as year from bib""", "bib")
def bib_parse(b):
    """Entries of BibTeX text: every fourth record has its key twice, of which the last counts."""
    twice = F.when(F.substring("cite_key", 2, 20).cast("long") % 4 == 0, F.concat(F.lit("@book{"), "cite_key", F.lit(', title = "Before", year = 1900}\n'), "bibtex")).otherwise(F.col("bibtex"))
    return files.parse_bib(b.select(F.col("cite_key").alias("record"), twice.alias("bibtex"))).select("cite_key", "entry_type", "title", "author", "year")


@query(f"""with {catalogue.CITES}, {catalogue.NUMS[len(catalogue.SENT) + 2:]}, {catalogue.SCOPES[len(catalogue.SENT) + 2:]}, said as (select paper_id, round, 'citation' as type, number, 'cite:' || cite_key as locator from claims
union all select paper_id, round, 'numerical', number, 'numclaim:' || number from kept union all select paper_id, round, 'scope', k, 'scope:' || k from (select *, row_number() over (partition by paper_id, round order by seq, n) - 1 as k from scopes))
select paper_id, round, count(*) filter (type = 'citation') as n_citation, count(*) filter (type = 'numerical') as n_numerical, count(*) filter (type = 'scope') as n_scope, string_agg(locator, '|' order by type, number) filter (number < 2) as sample from said group by all""", "manuscript bib")
def extract_summary(m, b):
    return x.extract_summary(m)


Q = {k: f for k, f in catalogue.Q.items() if k not in _before}
SQL = {k: s for k, s in catalogue.SQL.items() if k in Q}
