"""Queries on formulas; SQL states what the rendered manuscripts hold by construction, without reading LaTeX."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import formulas as m
from ..operators import judging as jd
from ..operators import resolve as r
from . import catalogue
from .catalogue import JUDGED, query

_before = set(catalogue.Q)

#: The two formulas of a manuscript by the number of its paper.
MADE = r"""made as (select distinct paper_id, round, paper_id % 30 as a, paper_id % 13 as b, paper_id % 30 + paper_id % 13 + case when paper_id % 7 = 0 then 1 else 0 end as c,
case when paper_id % 13 = 0 then 'definition' when paper_id % 11 = 0 then 'sign' when paper_id % 12 = 1 then 'integral' else 'macro' end as form from manuscript),
verdict as (select paper_id, round, 0 as eq, 'eq:0' as locator, case when a + b = c then 'verified' else 'failed' end as status, null as kind, false as sign_flip, 'sympy' as tool from made
 union all select paper_id, round, 1, 'eq:1', case form when 'sign' then 'failed' when 'macro' then 'verified' else 'unverifiable' end, case when form in ('definition', 'integral') then 'tool' end, form = 'sign',
 case form when 'sign' then 'sympy' when 'macro' then 'sympy_with_macros' else 'none' end from made)"""


@query(f"with {MADE} select *, case status when 'verified' then 'minor' when 'failed' then 'P0' else 'major' end as severity from verdict", "manuscript")
def math_verify(tex):
    return m.math_targets(tex).select("paper_id", "round", "eq", "locator", "status", "kind", "sign_flip", "tool", "severity")


@query(f"with {MADE} select round, tool, count(*) as n from verdict group by all", "manuscript")
def tools_used(tex):
    return m.tools_used(m.math_targets(tex), "round")


@query(f"""with {MADE}, {JUDGED}, answered as (select v.*, j.verdict, j.confidence from verdict v left join judged j on j.task_id = 't' || cast(v.paper_id * 2 + v.eq as varchar) || ':primary')
select paper_id, round, locator, case when status <> 'unverifiable' then status when verdict = 'supports' and confidence <> 'low' then 'verified' when verdict = 'contradicts' then 'failed' else 'unverifiable' end as status,
case when status = 'unverifiable' and verdict is not null then 'llm_fallback' else tool end as tool from answered""", "manuscript judge_result")
def math_fallback(tex, replies):
    """Formulas that the algebra leaves open go to a judge, whose verdict counts."""
    task = F.concat(F.lit("t"), (F.col("paper_id") * 2 + F.col("eq")).cast("string"), F.lit(":primary"))
    verdict = F.when(F.col("verdict") == "supports", "plausible").when(F.col("verdict") == "contradicts", "implausible").otherwise("uncertain")
    judged = r.judgements(replies).withColumn("verdict", verdict)
    targets = m.math_targets(tex)
    open_ = targets.where("status = 'unverifiable' and eq is not null").withColumn("task_id", task)
    answered = jd.judge_math(open_, judged).join(judged.select("task_id", F.lit(True).alias("judged")), "task_id", "left")
    settled = targets.where("status <> 'unverifiable' or eq is null")
    tool = F.when(F.col("judged"), m.JUDGE).otherwise(F.col("tool")).alias("tool")
    return settled.select("paper_id", "round", "locator", "status", "tool").union(answered.select("paper_id", "round", "locator", "status", tool))


def _pieces(d):
    """Formulas rendered from documents: rows in a wrapper, a break inside braces, chains, equals signs at every depth."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    cat = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    inner = cat(r"\begin{aligned} x_{i=", n(9), "} &= ", n(7), r" Y = {a \\ b} \\[2pt] & Z(", n(5), r"=u) = W \\ ", n(3), r" := k \end{aligned}")
    body = F.when(F.col("doc_id") % 4 == 0, cat(r"$$ ", inner, " $$")).when(F.col("doc_id") % 4 == 1, cat(r"\begin{equation*} ", inner, r" \end{equation*}")).when(F.col("doc_id") % 4 == 2, cat(r"\[ ", inner, r" \]"))
    body = body.otherwise(cat(r"\begin{align} ", F.regexp_replace(inner, r"\\(begin|end)\{aligned\}", ""), r" \end{align}"))
    return d.select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("round"), body.alias("tex"))


ROWS = r"""rows as (select doc_id as paper_id, 0 as eq, 'x_{i=' || (doc_id % 9) || '} &= ' || (doc_id % 7) || ' Y = {a \\ b}' as body from documents
union all select doc_id, 1, 'Z(' || (doc_id % 5) || '=u) = W' from documents union all select doc_id, 2, (doc_id % 3) || ' := k' from documents)"""


@query(f"with {ROWS} select * from rows", "documents")
def alignment_rows(d):
    return m.equations(_pieces(d)).select("paper_id", "eq", "body")


@query(r"""select doc_id as paper_id, 0 as eq, 0 as pair, 'x_{i=' || (doc_id % 9) || '}' as lhs, (doc_id % 7) || ' Y' as rhs from documents union all select doc_id, 0, 1, (doc_id % 7) || ' Y', '{a \\ b}' from documents
union all select doc_id, 1, 0, 'Z(' || (doc_id % 5) || '=u)', 'W' from documents""", "documents")
def equality_chains(d):
    """Equalities at the top level only; the definition makes none."""
    return m.equality_pairs(_pieces(d)).drop("round")


def _defined(d):
    """Macros rendered from documents: with arguments, nested, defined twice, one without an end."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    cat = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    heads = cat(r"\newcommand{\pair}[2]{\frac{#1}{#2}} \newcommand*{\set}{\mathbb{R}_{", n(6), r"}} \renewcommand\set{\mathbf{S}_{", n(4), r"}} \def\twice#1{#1#1} \newcommand{\far}{\near^{2}} \newcommand{\near}{N} \newcommand{\loop}{\loop+1} ")
    body = F.when(F.col("doc_id") % 3 == 0, cat(r"\pair{a}{", n(8), r"} + \twice{x}\set")).when(F.col("doc_id") % 3 == 1, cat(r"\far \sets ", n(8))).otherwise(cat(r"\loop - ", n(8)))
    return d.select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("round"), cat(heads, "$$ ", body, " $$").alias("tex"))


@query(r"""select doc_id as paper_id, case doc_id % 3 when 0 then '\frac{a}{' || (doc_id % 8) || '} + xx\mathbf{S}_{' || (doc_id % 4) || '}' when 1 then 'N^{2} \sets ' || (doc_id % 8) else '\loop - ' || (doc_id % 8) end as expanded,
case doc_id % 3 when 2 then 'macro expansion did not converge after 5 passes' end as note from documents""", "documents")
def macro_expand(d):
    return m.expanded(_defined(d)).select("paper_id", "expanded", "note")


@query(r"""select doc_id as paper_id, name, arity, body from documents cross join (values ('pair', 2, '\frac{#1}{#2}'), ('twice', 1, '#1#1'), ('far', 0, '\near^{2}'), ('near', 0, 'N'), ('loop', 0, '\loop+1')) as k(name, arity, body)
union all select doc_id, 'set', 0, '\mathbf{S}_{' || (doc_id % 4) || '}' from documents""", "documents")
def macros(d):
    return m.macros(_defined(d)).drop("round")


@query("""select n.s_nationkey as paper_id, least(n.k, 500) as n_checked, case when n.k > 500 then 'truncated: paper has ' || n.k || ' equation(s); verifying only the first 500' end as error
from (select s_nationkey, 400 + 10 * s_nationkey as k from supplier group by all) n""", "supplier")
def equation_cap(s):
    """Papers of 400 and more formulas, the first 500 checked."""
    papers = s.select("s_nationkey").distinct()
    tex = F.repeat(F.lit("$$ a = a $$ "), (400 + 10 * F.col("s_nationkey")).cast("int"))
    eqs = m.equations(papers.select(F.col("s_nationkey").alias("paper_id"), F.lit(1).alias("round"), tex.alias("tex")))
    kept = m.capped(eqs).groupBy("paper_id").agg(F.count("*").alias("n_checked"))
    return kept.join(m.truncated(eqs).select("paper_id", "error"), "paper_id", "left")


@query("select p_partkey, p_partkey % 4 <> 3 as is_definition from part", "part")
def is_definition(p):
    signs = F.array(F.lit(":="), F.lit(r"\equiv"), F.lit(r"\coloneqq"), F.lit("="))
    body = F.concat(F.lit("a "), F.element_at(signs, (F.col("p_partkey") % 4 + 1).cast("int")), F.lit(" "), F.col("p_name"))
    return p.select("p_partkey", t.is_definition(body).alias("is_definition"))


TOKENS = "[" + ", ".join(f"'{x}'" for x in t.UNPARSEABLE) + "]"


@query(f"""with b as (select p_partkey, 'a ' || {TOKENS}[1 + p_partkey % 30] || ' x = ' || case when p_size % 2 = 0 then {TOKENS}[1 + p_size % 30] else 'y' end as body from part)
select p_partkey, array_to_string(list_filter({TOKENS}, lambda e: contains(body, e)), '|') as hits from b""", "part")
def unparseable_hits(p):
    token = lambda c: F.element_at(F.array(*map(F.lit, t.UNPARSEABLE)), (F.col(c) % 30 + 1).cast("int"))
    body = F.concat(F.lit("a "), token("p_partkey"), F.lit(" x = "), F.when(F.col("p_size") % 2 == 0, token("p_size")).otherwise("y"))
    return p.select("p_partkey", F.array_join(t.unparseable_hits(body), "|").alias("hits"))


Q = {k: f for k, f in catalogue.Q.items() if k not in _before}
SQL = {k: s for k, s in catalogue.SQL.items() if k in Q}
