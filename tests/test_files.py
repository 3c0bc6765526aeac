"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from galleyproof.functions import latex
from galleyproof.sources import files, sinks
from galleyproof.streaming import rounds


def test_manuscripts_and_bib(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"good \xff bytes \xc3\xa9")
    (tmp_path / "b.tex").write_text("")
    got = {r.paper: r.tex for r in files.read_manuscripts(spark, f"{tmp_path}/*.tex").collect()}
    assert got == {"a": "good � bytes é"}
    (tmp_path / "refs.bib").write_text('@article{smith2024, title = {A {Nested} {Ti{tl}e}}, author = "Smith, J. and Lee, K.", year = {in 2024/5}, doi={doi.org/10.1/X}}\n@misc{smith2024, title={Later}, eprint = {arXiv:2101.00001v3}, year = 1999}\n@book{open, title = {never closed\n@comment{x, y={z}}')
    rows = files.read_bib(spark, f"{tmp_path}/refs.bib").collect()
    assert [(r.cite_key, r.entry_type, r.title, r.year, r.eprint) for r in rows] == [("smith2024", "misc", "Later", 1999, "2101.00001")]
    first = latex.bib_entries((tmp_path / "refs.bib").read_text())[0]
    assert first[2] == {"title": "A {Nested} {Ti{tl}e}", "author": "Smith, J. and Lee, K.", "year": "in 2024/5", "doi": "doi.org/10.1/X"}


def test_claims(spark, tmp_path):
    good = [{"locator": "cite:a", "claim_quote": "q", "reference": {"doi": "10.1/x"}}, {"locator": "cite:b", "claim_quote": "r", "reference": {}}]
    path = tmp_path / "claims.jsonl"
    path.write_text("# a comment\n\n" + "\n".join(map(json.dumps, good)) + "\n")
    assert [(r.locator, r.warn) for r in files.read_claims(spark, str(path)).orderBy("locator").collect()] == [("cite:a", False), ("cite:b", True)]
    for bad in ("{broken", '{"locator": "cite:c"}', '{"claim_quote": "q"}'):
        path.write_text(json.dumps(good[0]) + "\n" + bad)
        with pytest.raises(Exception, match="bad JSON|a claim without"):
            files.read_claims(spark, str(path)).collect()
        assert files.read_jsonl(spark, str(path), files.CLAIM).where("locator = 'cite:a'").count() == 1


def test_results_reports_logs(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in [{"task_id": "t1", "ok": False, "body": "old"}, {"task_id": "", "body": "x"}, {"task_id": "t1", "ok": True, "body": "new"}, {"body": "y"}]) + "\nnot json")
    assert [tuple(r) for r in files.read_results(spark, f"{tmp_path}/r.jsonl").collect()] == [("t1", True, "new")]
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "math.json").write_text(json.dumps({"verifier_id": "math", "status": "failed", "targets": [{"locator": "eq:0", "status": "Failed", "root_cause_key": "k"}]}, indent=1))
    (tmp_path / "reports" / "bad.json").write_text("{")
    reports = files.read_reports(spark, f"{tmp_path}/reports/*.json")
    assert [r.report for r in reports.collect()] == ["math"] and [(r.locator, r.status) for r in files.targets_of(reports).collect()] == [("eq:0", "failed")]
    for name, log in (("list", [{"finding_key": "a", "disposition": "fixed"}, {"root_cause_key": "b"}]), ("entries", {"entries": [{"finding_key": "a", "root_cause_key": "z"}, {"root_cause_key": "b"}, {"disposition": "fixed"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(log, indent=1))
        assert sorted(r.finding_key for r in files.read_fix_log(spark, f"{tmp_path}/{name}.json").collect()) == ["a", "b"]
    (tmp_path / "s.json").write_text('{"abstract": "A", "methods": null}')
    assert files.read_sections(spark, f"{tmp_path}/s.json").first().asDict() == {"paper": "s", "abstract": "A", "introduction": "", "methods": "", "results": "", "conclusion": ""}
    (tmp_path / "scope_claims.jsonl").write_text('{"locator": "scope:0", "claim_quote": "for all"}')
    assert [(r.type, r.round, r.locator) for r in files.read_bundle(spark, str(tmp_path), 2).collect()] == [("scope", 2, "scope:0")]


def test_sinks(spark, tmp_path):
    rows = spark.range(10).select(F.col("id"), F.lit("é").alias("text"), F.lit(None).cast("string").alias("none"))
    assert sinks.write_jsonl(rows, f"{tmp_path}/rows") == 10 and sinks.write_jsonl(rows.limit(3), f"{tmp_path}/rows") == 3
    line = spark.read.text(f"{tmp_path}/rows").first()[0]
    assert "é" in line and '"none":null' in line
    task = spark.range(2).select(*(F.col("id").cast("string").alias(c) for c in sinks.TASK))
    assert sinks.write_tasks(task, f"{tmp_path}/tasks") == 2
    sinks.append_tasks(task, f"{tmp_path}/tasks")
    assert spark.read.json(f"{tmp_path}/tasks").count() == 4
    assert sinks.read_state(spark, f"{tmp_path}/state") is None
    sinks.write_state(rows, f"{tmp_path}/state")
    assert sinks.read_state(spark, f"{tmp_path}/state").count() == 10
    folder = sinks.open_round(spark, str(tmp_path), 1)
    sinks.snapshot(rows, folder)
    with pytest.raises(sinks.RoundExists):
        sinks.open_round(spark, str(tmp_path), 1)
    assert sinks.open_round(spark, str(tmp_path), 1, force=True) == folder and sinks.write_preflight(rows, folder) == 10
    rollup = spark.createDataFrame([(1, "failed", "P0"), (2, "verified", "minor")], "paper_id long, status string, severity string")
    targets = spark.createDataFrame([(1, "eq:1", "failed", "P0", "k1"), (1, "eq:0", "verified", "minor", "k0")], "paper_id long, locator string, status string, severity string, root_cause_key string")
    reports = {r.paper_id: json.loads(r.report) for r in sinks.report_json(rollup, targets, ["paper_id"], "math").collect()}
    assert [x["locator"] for x in reports[1]["targets"]] == ["eq:0", "eq:1"] and reports[2]["targets"] == []
    assert [r.status for r in sinks.skipped(spark, ["math"], "fast").collect()] == ["skipped"]
    assert spark.range(1).select(sinks.notes(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))).first()[0] == "a | b"


def _drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    at = lambda late: F.timestamp_seconds(F.col("id") * 3600 + 10**9 + late)
    spark.range(50).select(F.concat(F.lit("t"), "id").alias("task_id"), at(0).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/tasks")
    spark.range(50).where("id % 3 <> 0").select(F.concat(F.lit("t"), "id").alias("task_id"), at(F.when(F.col("id") == 7, 9000).otherwise(60)).alias("ts"), F.lit("{}").alias("body"), (F.col("id") % 2 == 0).alias("ok")).coalesce(1).write.parquet(f"{tmp_path}/results")
    read = lambda x: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}")
    got = {r.task_id: r.body for r in _drain(rounds.settle(read("tasks"), read("results")), "settled").collect()}
    assert all((got[f"t{i}"] is None) == (i % 3 == 0 or i == 7) for i in range(45))
    counts = _drain(rounds.arrivals(read("results")), "arrived", "complete").agg(F.sum("n"), F.sum("n_failed")).first()
    assert tuple(counts) == (33, 17)


def test_waves(spark, tmp_path):
    replies = [(1, "triples", s) for s in "abcde"] + [(1, "compare", s) for s in "xyz"] + [(2, "triples", s) for s in "abcde"] + [(2, "compare", "x")] * 3 + [(3, "triples", "a")]
    spark.createDataFrame(replies, "paper_id long, wave string, part string").coalesce(1).write.parquet(f"{tmp_path}/replies")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("paper_id long, wave string, part string").parquet(f"{tmp_path}/replies")
        got = {r.paper_id: (r.n_triples, r.n_compares, r.phase) for r in _drain(rounds.waves(stream), "waves", "update").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == {1: (5, 3, "done"), 2: (5, 1, "compare"), 3: (1, 0, "triples")}
