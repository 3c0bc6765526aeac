"""Cases of the checks: scope, sections, regression, resolving, set-up."""

import pytest
from pyspark.sql import functions as F

from galleyproof.functions import text as t
from galleyproof.operators import extract, judging, regression, resolve, scope
from galleyproof.sources import probes

SCHEMA = "paper_id long, round int, tex string"


def paper(spark, *texts):
    return spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], SCHEMA)


def test_scope(spark):
    over = r"\begin{abstract}We treat arbitrary continuous dynamics universally and in general.\end{abstract}\section{Methods}Block-diagonal noise, linearized around a steady state with small noise."
    fair = r"\begin{abstract}For block-diagonal Gaussian models with small noise, in general.\end{abstract}\section{Methods}Block-diagonal Gaussian with small noise."
    leak = r"\begin{abstract}We show that it holds.\end{abstract}\section{Methods}Sparse, diagonal and symmetric systems."
    none = r"\begin{abstract}We show that it holds.\end{abstract}\section{Results}Good."
    rows = sorted(scope.targets(scope.findings(paper(spark, over, fair, leak, none))).collect())
    assert [(r.finding, r.status, r.severity, r.kind, r.confidence) for r in rows] == [
        ("universality_asymmetry", "verified", "P0", None, "high"), ("consistent", "verified", "minor", None, "medium"),
        ("restriction_leakage", "verified", "major", None, "medium"), ("methods_missing", "unverifiable", "P0", "tool", "medium")]
    status = {r.paper_id: (r.status, r.severity) for r in scope.report(scope.findings(paper(spark, over, fair, leak, none))).collect()}
    assert status == {0: ("failed", "P0"), 1: ("verified", "minor"), 2: ("failed", "major"), 3: ("unverifiable", "P0")}


def test_sections(spark):
    body = "We consider a letter. " * 15
    texts = [
        r"\paragraph{Introduction.} Intro text. \paragraph{Methods.} Method text.",
        r"\begin{abstract}A\end{abstract}\maketitle " + body + r"\section{Results} R",
        r"\title{T}\maketitle " + "x" * 4000 + r" \section{Introduction} I \section{Result of the method} M \section{Discussion} D",
        r"\begin{abstract}A\end{abstract} short \section{Results} R",
        "no heading at all",
    ]
    rows = sorted(extract.parse_sections(paper(spark, *texts)).collect())
    assert (rows[0].introduction, rows[0].methods) == ("Intro text.", "Method text.")
    assert rows[1].abstract == "A" and rows[1].methods.startswith("\\maketitle We consider") and rows[1].results == "R"
    assert rows[2].abstract == "x" * 3000 and (rows[2].methods, rows[2].results, rows[2].conclusion) == ("M", "", "D")
    assert rows[3].methods == "" and tuple(rows[4])[2:] == ("",) * 5


def test_claims_once(spark):
    text = r"\section{Results} We achieve 5x speedup over A. We achieve 5X Speedup over A. It gives p < 0.05 and 3x faster runs. It holds for all continuous dynamics. IT HOLDS FOR ALL continuous dynamics."
    got = {(r.type, r.number): (r.kind, r.value) for r in extract.claims(paper(spark, text)).collect()}
    assert got == {("numerical", 0): ("speedup", "5x speedup"), ("numerical", 1): ("speedup", "3x faster"), ("numerical", 2): ("p_value", "p < 0.05"), ("scope", 0): (None, "for all")}
    made, faults = extract.extract(paper(spark, text), spark.range(1))
    assert set(made) == {"numerical", "scope"} and faults == ["citation claims: AnalysisException"]


def test_regression(spark):
    schema = "root_cause_key string, locator string, verifier_id string, status string, severity string"
    prev = spark.createDataFrame([("a", "eq:0", "math", "verified", "minor"), ("b", "eq:1", "math", "failed", "P0"), ("c", "eq:2", "math", "verified", "P0")], schema)
    curr = spark.createDataFrame([("a", "eq:0", "math", "failed", "P0")], schema)
    log = spark.createDataFrame([("c", "dropped", "why"), ("b", "fixed", "done")], "finding_key string, disposition string, rationale string")
    assert [r.root_cause_key for r in regression.regressions(prev, curr, ["root_cause_key"]).collect()] == ["a"]
    assert [(r.root_cause_key, r.disposition) for r in regression.deletion_evasion(prev, curr, log).collect()] == [("c", "dropped")]
    cites = lambda *keys: spark.createDataFrame([(1, f"cite:{k}") for k in keys], "paper_id long, locator string")
    covered = spark.createDataFrame([("x", "cite:n", "citations", "verified", "minor"), ("y", "cite:m", "citations", "failed", "P0")], schema)
    assert [r.locator for r in regression.new_citations(cites("o"), cites("o", "n", "m"), covered).collect()] == ["cite:m"]
    quotes = lambda *q: spark.createDataFrame([(1, f"scope:{i}", x) for i, x in enumerate(q)], "paper_id long, locator string, claim_quote string")
    for reports, want in ((covered, ["new one"]), (covered.withColumn("verifier_id", F.lit("scope")), [])):
        assert [r.quote for r in regression.new_scope(quotes("Old  one"), quotes("old one", "New one"), reports).collect()] == want
    good = lambda: prev.select("locator", "status", "severity", "root_cause_key")
    rows = {r.checker: r for r in regression.report(dict.fromkeys(regression.CHECKERS, good) | {"claim_drift": lambda: prev.select("nothing")}).collect()}
    assert set(rows) == {"regressions", "claim_drift"} and (rows["claim_drift"].status, rows["claim_drift"].kind, rows["claim_drift"].locator) == ("unverifiable", "env", "checker-crash:claim_drift")


def test_resolving(spark):
    bib = spark.createDataFrame([("k", "A quick study of things", "Smith, J.", 2023)], "cite_key string, title string, author string, year int")
    hit = lambda rank, year, author, title="A quick study of things": (f"10.1/{rank}", title, "abs", year, author, rank)
    schema = "doi string, title string, abstract string, year int, author string, hit_rank int"
    find = lambda *rows: [r.hit_doi for r in resolve.resolve_title(bib, spark.createDataFrame(list(rows), schema)).collect()]
    assert find(hit(0, 2019, "J. Smith")) == [] and find(hit(0, 2023, "Other")) == [] and find(hit(0, 2019, "J. Smith"), hit(1, 2024, "J. Smith")) == ["10.1/1"]
    assert find(*(hit(k, 2010, "J. Smith") for k in range(5)), hit(5, 2023, "J. Smith")) == []  # beyond the first five
    assert find(hit(0, 2023, "J. Smith", "Another matter of things")) == []
    xml = "<feed><entry><title>T\n  U</title><summary> S </summary><published>2021-05-06T00:00:00Z</published><author><name>A B</name></author><author><name>C D</name></author></entry></feed>"
    entries = resolve.read_atom(spark.createDataFrame([("arXiv:2105.1v2", xml), ("x", "<feed></feed>")], "arxiv_id string, xml string")).collect()
    assert [tuple(r) for r in entries] == [("2105.1", "T U", "S", 2021, "A B and C D")]


def test_set_up(spark, monkeypatch):
    assert [judging.backend_mode(None, True, True), judging.backend_mode(None, True, False), judging.backend_mode("batch-ingest", True, True)] == ["sdk", "batch-emit", "batch-ingest"]
    with pytest.raises(ValueError, match="none of"):
        judging.backend_mode("other", True, True)
    monkeypatch.setenv("SOME_KEY", "x")

    def get(url, seconds):
        if "down" in url:
            raise TimeoutError("timed out")
        return (404, "") if "gone" in url else (503, "") if "busy" in url else (200, "body of " + url)

    checks = probes.probe(spark, ["SOME_KEY", "NO_KEY"], ["numpy", "no_such_library"], ["http://up", "http://down"], get)
    assert [r.ok for r in checks.collect()] == [True, False, True, False, True, False]
    effects = spark.createDataFrame([("key NO_KEY", "citations", "stops"), ("key SOME_KEY", "math", "stops")], "check string, verifier string, effect string")
    row = judging.preflight(checks.withColumn("run", F.lit(1)), effects, "run").first()
    assert (row.status, row.affected, row.impact) == ("degraded", "citations", "citations:stops") and "library no_such_library" in row.missing
    urls = spark.createDataFrame([("http://a",), ("http://gone",), ("http://busy",), ("http://down",), (None,)], "url string")
    got = {r.url: (r["status"], r.body, r.error) for r in probes.fetch(urls, get=get, pause=0).collect()}
    assert got == {"http://a": (200, "body of http://a", None), "http://gone": (404, None, None), "http://busy": (None, None, "http 503"), "http://down": (None, None, "TimeoutError: timed out"), None: (None, None, "no url")}


def test_places(spark):
    row = spark.range(1).select(t.places(F.lit("ab(c(ab("), "(").alias("a"), t.places(F.lit("xx"), "(").alias("b"), t.places(F.lit(""), "(").alias("c")).first()
    assert (row.a, row.b, row.c) == ([2, 4, 7], [], [])
