"""Views over the driver tables that render manuscripts and verdicts: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

#: In the order of registration; see FIXTURES.md.
VIEWS = {
    "manuscript": """
select d.doc_id as paper_id, r.round as round, concat(
  chr(92),'newcommand{',chr(92),'calA}{A}',chr(10),
  chr(92),'begin{abstract} We prove the bound ',
  case when r.round = 2 and d.doc_id % 9 = 0 then 'for any finite system'
       when d.doc_id % 6 = 0 then 'for all systems' when d.doc_id % 6 = 1 then 'in general'
       when d.doc_id % 6 = 2 then 'on our data'     when d.doc_id % 6 = 3 then 'without any assumption'
       when d.doc_id % 6 = 4 then 'for the small set' else 'regardless of the seed' end,
  '. We get ',
  case when d.doc_id % 5 = 0 then concat(cast(2 + d.doc_id % 40 + case when r.round = 2 and d.doc_id % 4 = 0 then 1 else 0 end as string),'x speedup')
       when d.doc_id % 5 = 1 then concat(cast(d.doc_id % 90 as string),chr(92),'% improvement')
       when d.doc_id % 5 = 2 then concat('p < 0.0',cast(1 + d.doc_id % 9 as string))
       when d.doc_id % 5 = 3 then concat('accuracy of 0.',cast(10 + d.doc_id % 80 as string))
       else concat(cast(d.doc_id % 70 as string),' +/- 0.',cast(1 + d.doc_id % 9 as string)) end,
  ' here. ',chr(92),'end{abstract}',chr(10),
  case when d.doc_id % 8 = 0 then concat('% todo: holds for all inputs',chr(10)) else '' end,
  chr(92),'section{Introduction} Prior work ',chr(92),'cite{p',cast(d.doc_id % 7 as string),',p',cast(d.doc_id % 11 as string),
  '} is close. We extend ',chr(92),'citep[see][]{p',cast((d.doc_id + r.round) % 60 as string),'} today. ',
  translate(d.text,'$%','  '),chr(10),
  case when d.doc_id % 10 = 9 then '' else concat(chr(92),'section{Methods} We work in the ',
    case when d.doc_id % 2 = 0 then 'steady state with sparse and diagonal noise, assuming that drift is linear' else 'usual regime' end,'.',chr(10)) end,
  chr(92),'section{Results} We compute $$ ',cast(d.doc_id % 30 as string),' + ',cast(d.doc_id % 13 as string),' = ',
  cast(d.doc_id % 30 + d.doc_id % 13 + case when d.doc_id % 7 = 0 then 1 else 0 end as string),' $$ and',chr(10),
  chr(92),'begin{equation} ',
  case when d.doc_id % 13 = 0 then 'q := r' when d.doc_id % 11 = 0 then 'a + b = -(a+b)'
       when d.doc_id % 12 = 1 then concat(chr(92),'int x = y') else concat(chr(92),'calA = A') end,
  ' ',chr(92),'end{equation}',chr(10),
  chr(92),'section{Conclusion} We always stop here.',chr(10)) as tex
from documents d cross join (select 1 as round union all select 2 as round) r
""",
    "bib": """
select concat('p',cast(p_partkey as string)) as cite_key,
  case when p_partkey % 3 = 0 then concat('https://doi.org/10.1234/part.',cast(p_partkey as string)) end as doi,
  concat(p_name,' ',p_type,' ',p_brand) as title,
  concat('Smith',chr(97 + cast(p_partkey % 20 as int)),', J. and Jones',chr(97 + cast(p_partkey % 7 as int)),', K.') as author,
  cast(1990 + p_size % 35 as int) as year,
  concat('@article{p',cast(p_partkey as string),',',chr(10),'  author = {Smith',chr(97 + cast(p_partkey % 20 as int)),', J.},',chr(10),
    '  title = {{',p_name,'} ',p_type,'},',chr(10),'  year = {',cast(1990 + p_size % 35 as string),'}',chr(10),'}') as bibtex
from part
""",
    "catalog": """
select concat('10.1234/part.',cast(p_partkey as string)) as doi,
  case when p_partkey % 4 = 0 then concat('other ',p_type) else concat(p_name,' ',p_type,' ',p_brand) end as title,
  case when p_partkey % 7 = 0 then null else concat('<p>On ',p_name,' in ',p_type,'.</p>') end as abstract,
  cast(1990 + p_size % 35 + case when p_partkey % 6 = 0 then 2 when p_partkey % 6 = 1 then 1 else 0 end as int) as year,
  case when p_partkey % 5 = 0 then 'Alice Different' else concat('J. Smith',chr(97 + cast(p_partkey % 20 as int))) end as author,
  case when p_partkey % 2 = 0 then 'crossref' else 'semanticscholar' end as source,
  cast(p_partkey % 5 as int) as hit_rank
from part
""",
    "target": """
select r.round as round, o.o_orderkey as seq,
  case o.o_custkey % 5 when 0 then 'citations' when 1 then 'scope' when 2 then 'math' when 3 then 'contradiction' else 'regression' end as verifier_id,
  concat(case when o.o_custkey % 5 = 0 then 'cite:' else 'eq:' end, cast(o.o_orderkey % 4000 as string)) as locator,
  concat('rck-',cast(o.o_orderkey as string)) as root_cause_key,
  case when r.round = 2 and o.o_orderkey % 4 = 0 then 'failed'
       when r.round = 2 and o.o_orderkey % 8 = 1 then 'unverifiable'
       when o.o_orderstatus = 'F' then 'failed' when o.o_orderstatus = 'O' then 'verified' else 'unverifiable' end as status,
  case substr(o.o_orderpriority,1,1) when '1' then 'P0' when '2' then 'major' when '3' then 'moderate' else 'minor' end as severity,
  case o.o_orderkey % 4 when 0 then 'env' when 1 then 'tool' when 2 then 'evidence' end as kind
from orders o cross join (select 1 as round union all select 2 as round) r
where (r.round = 1 and o.o_orderkey % 10 <> 9) or (r.round = 2 and o.o_orderkey % 10 <> 3)
""",
    "fix_log": """
select concat('rck-',cast(o_orderkey as string)) as finding_key,
  case o_orderkey % 30 when 3 then 'fixed' when 13 then 'rejected' else 'dropped' end as disposition,
  concat('note ',o_orderpriority) as rationale
from orders where o_orderkey % 10 = 3 and o_orderkey % 50 <> 3
""",
    "judge_result": """
select concat('t',cast(e.event_id as string),':',k.kind) as task_id, e.event_id * 3 + k.n as line_no,
  e.event_type <> 'error' as ok,
  case when e.event_id % 23 = 0 then 'no json here'
       else concat('Sure: {"verdict":"',
         case when k.n = 2 then 'supports' when k.n = 1 and e.event_id % 5 = 0 then 'contradicts'
              when e.event_type in ('purchase','view') then 'supports' when e.event_type = 'click' then 'contradicts'
              when e.event_type = 'signup' then 'not_addressed' else 'MAYBE' end,
         '","confidence":"',case when e.value > 100 then 'high' when e.value > 30 then 'medium' else 'low' end,
         '","reason":"r',cast(e.user_id as string),'"}') end as body, e.ts as ts
from events e cross join (select 'primary' as kind, 0 as n union all select 'devils_advocate' as kind, 1 as n union all select 'primary' as kind, 2 as n) k
where e.event_id % 17 <> 0 and (k.n < 2 or e.event_id % 19 = 0)
""",
    "triple_reply": """
select cast(floor(event_id / 5) as bigint) as paper_id,
  case event_id % 5 when 0 then 'abstract' when 1 then 'introduction' when 2 then 'methods' when 3 then 'results' else 'conclusion' end as section,
  case when event_id % 13 = 0 then 'no list here'
       else concat('```json',chr(10),'[',substr(repeat(concat(',{"subject":"s',cast(event_id as string),'","predicate":"',repeat('p',cast(event_id % 400 as int)),'","scope":"all"}'),cast(event_id % 11 as int)),2),']',chr(10),'```') end as body
from events where event_id % 17 <> 3
""",
    "compare_reply": """
select cast(floor(event_id / 3) as bigint) as paper_id,
  case event_id % 3 when 0 then 'abstract' when 1 then 'abstract' else 'introduction' end as section_a,
  case event_id % 3 when 0 then 'conclusion' when 1 then 'methods' else 'results' end as section_b,
  concat('[{"claim_a":"a","claim_b":"b","contradiction_kind":"',
    case event_id % 5 when 0 then 'direct_opposite' when 1 then 'scope_mismatch' when 2 then 'promise_not_delivered' when 3 then 'number_mismatch' else 'bogus' end,
    '","confidence":"',case event_id % 4 when 0 then 'HIGH' when 1 then 'medium' when 2 then 'low' else 'LOUD' end,
    '"},{"claim_a":"c","claim_b":"d","contradiction_kind":"scope_mismatch","confidence":"',case when event_id % 6 < 3 then 'high' else 'low' end,'"}]') as body
from events where event_id % 7 <> 0
""",
    "drift_pair": """
select concat('scope:',cast(doc_id as string)) as locator, text as prev_quote,
  case when doc_id % 3 = 0 then replace(text,'e','for all 7')
       when doc_id % 3 = 1 then concat(substr(text,1,length(text) - 4),' 9') else text end as curr_quote
from documents where length(text) > 20
""",
    "preprint": """
select concat(cast(1000 + p_partkey % 9000 as string), '.', cast(p_partkey as string), 'v', cast(1 + p_size % 3 as string)) as arxiv_id,
  concat('<feed><entry><title>', p_name, chr(10), '  ', p_type, '</title>', case when p_partkey % 5 = 0 then '<summary> </summary>' else concat('<summary>Of ', p_name, ' &amp; ', p_brand, '.</summary>') end,
    '<published>', cast(1990 + p_size % 35 as string), '-03-01T00:00:00Z</published><author><name>J. Smith', chr(97 + cast(p_partkey % 20 as int)), '</name></author><author><name>K. Lee</name></author></entry></feed>') as xml
from part where p_partkey % 3 <> 1
""",
}


#: Tables of texts, whose rows are work enough to be dealt out.
TEXTS = ["documents", "pages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a small one of texts, which lies in fewer files than there are cores, is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() <= cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rendered view, or a driver table, of the folder."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    for x in TABLES:
        if f" {x}" in VIEWS[name]:
            table(spark, sf_dir, x).createOrReplaceTempView(x)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """The SQL preceded by the rendered views that it names, for an engine that has the driver tables only."""
    used = [f"{n} as ({v})" for n, v in VIEWS.items() if f" {n} " in f" {sql.replace(chr(10), ' ').replace(')', ' ').replace(',', ' ')} "]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join([*used, body[5:]])
    return ("with " + ", ".join(used) + " " if used else "") + body
