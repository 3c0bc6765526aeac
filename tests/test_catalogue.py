"""Queries against their SQL on the smallest tables, and row-level cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from galleyproof.functions import text as t
from galleyproof.plans import catalogue, math, workflow
from galleyproof.sources.rendered import TABLES, view

DATA = "/root/testdata/sf0.001"
CHECKED = ["citation_claims", "numerical_claims", "scope_claims", "scope_asymmetry", "claim_drift", "regressions", "deletion_evasion", "citation_rollup", "ingest_citations", "resolve_reference", "equality_pairs"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", [*CHECKED, *workflow.Q, *math.Q])
def test_same_rows_as_sql(spark, db, name):
    got, want = catalogue.Q[name](spark, DATA), db.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: "" if v is None else str(round(v, 6) if isinstance(v, float) else v)
    rows = [tuple(map(plain, r)) for r in got.select(*names).collect()]
    assert rows and sorted(rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("raw", ["https://doi.org/10.1/x", "doi.org/10.1/x", "http://dx.doi.org/10.1/x"])
def test_doi_prefixes(spark, raw):
    assert spark.range(1).select(t.normalize_doi(F.lit(raw))).first()[0] == "https://doi.org/10.1/x"


def test_sentences_keep_digits(spark):
    text = "0 is first. 1 is not. See \\cite{a}. Then 2."
    assert spark.range(1).select(t.sentences(F.lit(text))).first()[0] == ["0 is first. 1 is not.", "See \\cite{a}.", "Then 2."]


def test_views_render_whole_tables(spark):
    docs, parts = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "part"))
    tex = view(spark, DATA, "manuscript").join(docs, F.expr("paper_id = doc_id"))
    assert tex.where(F.expr("not contains(tex, translate(text, '$%', '  '))")).count() == 0
    quotes = view(spark, DATA, "drift_pair").join(docs, F.expr("locator = concat('scope:', cast(doc_id as string))"))
    assert quotes.where("prev_quote <> text or length(curr_quote) < length(text) - 4").count() == 0
    assert [view(spark, DATA, x).count() for x in ("bib", "catalog")] == [parts.count()] * 2


def test_ngrams_of_long_texts(spark):
    text = "aéb\n😀cd" * 3
    got = spark.range(1).select(t.ngrams(F.lit(text))).first()[0]
    assert got == list(dict.fromkeys(text[i : i + 4] for i in range(len(text) - 3)))
