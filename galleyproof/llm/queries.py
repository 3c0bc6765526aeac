"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import context_totals, decode, default_files, encode, length_histogram
from .fm_index import find_contamination
from .line_runs import remove_repeated_lines
from .multi_index import nearest
from .resampling import fit, resample
from .sharding import assign_shards
from .simhash import near_duplicates
from .suffixes import remove_repeats
from .url_trees import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return out.select("doc_id", F.round("log_weight", 9).alias("log_weight"), F.round("gumbel_key", 9).alias("gumbel_key"), "selected")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = default_files()
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *files).drop("text"), *files)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(table(spark, sf_dir, "documents"), *default_files()))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("block_score", 9).alias("block_score"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest(table(spark, sf_dir, "embeddings"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}



#: Windows of one to ten lines that aren't blank and hold ten words; the lines of all but the first copy go.
LINE_SQL = r"""
with raw as (select doc_id, text, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where text is not null),
l as (select *, len(regexp_extract_all(content, '[^\x09-\x0d ]+')) as words, row_number() over (partition by doc_id order by line) as k from raw where regexp_matches(content, '[^\x09-\x0d ]')),
w as (select a.doc_id, a.k, b.k as last, list(c.content order by c.k) as run, sum(c.words) as words
  from l a join l b on b.doc_id = a.doc_id and b.k between a.k and a.k + 9 join l c on c.doc_id = a.doc_id and c.k between a.k and b.k group by all),
f as (select *, row_number() over (partition by run order by doc_id, k) as copy from w where words >= 10),
gone as (select distinct l.doc_id, l.line from f join l on l.doc_id = f.doc_id and l.k between f.k and f.last where f.copy > 1),
kept as (select r.doc_id, count(*) as n_lines, count(*) filter (g.line is not null) as n_removed, coalesce(string_agg(r.content, chr(10) order by r.line) filter (g.line is null), '') as kept
  from raw r left join gone g on g.doc_id = r.doc_id and g.line = r.line group by r.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join kept using (doc_id)
"""

CONTAMINATION_SQL = r"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as phrase from (select *, unnest(range(1, greatest(2, len(w) - 8))) as s from i where len(w) > 0)),
sizes as (select distinct n from p),
x as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) as s from d, sizes)),
m as (select x.doc_id, x.s, x.n, p.item_id from x join p using (n, phrase)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(s, s + n)) as k from m) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": LINE_SQL, "op10_decontamination": CONTAMINATION_SQL}
