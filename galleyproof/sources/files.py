"""Readers of what a paper's round consists of: manuscripts, bibliographies, JSON lines, reports. All read folders or globs, many papers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import latex
from ..functions import text as t

#: A claim as its file has it.
CLAIM = "locator string, claim_quote string, reference struct<doi: string, arxiv: string, title: string, authors: array<string>, year: int>, section_hint string, value string, kind string, quantifier_phrase string"
#: A verifier's report.
REPORT = "verifier_id string, status string, severity_suggestion string, summary string, targets array<struct<locator: string, status: string, severity_suggestion: string, root_cause_key: string, evidence: struct<unverifiable_kind: string, quote: string, judge_notes: string>>>"
FIX = "finding_key string, root_cause_key string, disposition string, rationale string"
SECTIONS = ["abstract", "introduction", "methods", "results", "conclusion"]


def _name(path: Column) -> Column:
    """A file's name without its folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """(paper, path, tex): one row a file that isn't empty, whatever its bytes: what isn't UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(_name(F.col("path")).alias("paper"), "path", F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("tex"))


def parse_bib(bib: DataFrame) -> DataFrame:
    """(the columns of bib, cite_key, entry_type, title, author, year, doi, eprint) of BibTeX text: values in quotes or nested braces, the last of equal keys."""
    fields = ["title", "author", "year", "doi", "eprint"]
    schema = "cite_key string, entry_type string, place int, " + ", ".join(f"{f} string" for f in fields)

    @F.udtf(returnType=schema)
    class Entries:
        """BibTeX values nest braces, which no regular expression follows."""

        def eval(self, text: str):
            for n, (key, kind, values) in enumerate(latex.bib_entries(text or "")):
                yield (key, kind, n, *(values.get(f) for f in fields))

    spark = bib.sparkSession
    spark.udtf.register("bib_entries", Entries)
    bib.createOrReplaceTempView("__bib")
    others = [c for c in bib.columns if c != "bibtex"]
    rows = spark.sql(f"select {', '.join([f'b.`{c}`' for c in others] + ['e.*'])} from __bib b, lateral bib_entries(b.bibtex) e")
    last = Window.partitionBy(*others, "cite_key").orderBy(F.desc("place"))
    rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "place")
    year = F.regexp_extract(F.coalesce("year", F.lit("")), r"\d{4}", 0).try_cast("int")
    return rows.withColumns({"title": t.strip_braces(F.col("title")), "year": year, "doi": t.normalize_doi(F.col("doi")), "eprint": t.normalize_arxiv(F.col("eprint"))})


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """The entries of BibTeX files, with each file's name as paper."""
    raw = read_manuscripts(spark, path)
    return parse_bib(raw.select("paper", F.col("tex").alias("bibtex")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files, blank lines left out."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line")).where("trim(line) <> ''")


def parse_lenient(rows: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """The columns of rows and what each line holds as a JSON object; lines that aren't one are skipped."""
    parsed = rows.where(F.try_parse_json(line).isNotNull() & F.trim(line).startswith("{")).withColumn("__j", F.from_json(line, schema))
    return parsed.where("__j is not null").select(*[c for c in rows.columns if c != line], "__j.*")


def parse_strict(rows: DataFrame, schema: str = CLAIM, needed: tuple[str, ...] = ("locator", "claim_quote"), line: str = "line") -> DataFrame:
    """What each line holds; blank lines and comments (#) are skipped, a line that isn't JSON or lacks what is needed stops the job. warn marks claims without a reference."""
    kept = rows.where((F.trim(line) != "") & ~F.ltrim(line).startswith("#"))
    checked = F.when(F.try_parse_json(line).isNull(), F.raise_error(F.concat(F.lit("bad JSON: "), F.substring(line, 1, 80)))).otherwise(F.from_json(line, schema))
    parsed = t.once(kept, __j=checked)
    for name in needed:
        value = F.col(f"__j.{name}")
        parsed = t.once(parsed.drop(f"__ok_{name}"), **{f"__ok_{name}": F.when(value.isNull() | (value == ""), F.raise_error(F.concat(F.lit(f"a claim without {name}: "), F.substring(line, 1, 80)))).otherwise(True)}).where(f"__ok_{name}")
    reference = F.col("__j.reference")
    empty = reference.isNull() | (F.coalesce(reference["doi"], reference["arxiv"], reference["title"], F.lit("")) == "")
    return parsed.select(*[c for c in rows.columns if c != line], "__j.*", empty.alias("warn"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return parse_strict(lines(spark, path)).drop("path")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_lenient(lines(spark, path), schema)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, ok, body): of the lines of a task the last counts; lines without a task are dropped. Files are ordered by name, lines by place."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    rows = parse_lenient(raw, "task_id string, ok boolean, body string").where(F.length("task_id") > 0)
    last = Window.partitionBy("task_id").orderBy(F.desc("file"), F.desc("line_no"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("task_id", "ok", "body")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, the columns of REPORT) of a folder of JSON documents, ordered by name; unreadable ones are skipped."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("line"))
    return parse_lenient(raw, REPORT).withColumn("report", _name(F.col("path"))).drop("path").orderBy("report")


def targets_of(reports: DataFrame) -> DataFrame:
    """(report, verifier_id, locator, status, severity, root_cause_key, kind): the targets of all reports."""
    rows = reports.select("report", "verifier_id", F.explode("targets").alias("x"))
    return rows.select("report", "verifier_id", "x.locator", F.lower("x.status").alias("status"), F.col("x.severity_suggestion").alias("severity"), "x.root_cause_key", F.col("x.evidence.unverifiable_kind").alias("kind"))


def parse_fix_log(rows: DataFrame, column: str = "line") -> DataFrame:
    """(finding_key, disposition, rationale) of JSON that is a list or has one under entries; the key is finding_key, else root_cause_key."""
    listed = F.from_json(column, f"array<struct<{FIX.replace(' string', ': string')}>>")
    held = F.from_json(column, f"struct<entries: array<struct<{FIX.replace(' string', ': string')}>>>")["entries"]
    rows = rows.select(F.inline(F.when(F.ltrim(column).startswith("["), listed).otherwise(held)))
    return rows.select(F.coalesce("finding_key", "root_cause_key").alias("finding_key"), "disposition", "rationale").where("finding_key is not null")


def read_fix_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_fix_log(spark.read.text(path, wholetext=True).select(F.col("value").alias("line")))


def parse_sections_json(rows: DataFrame, column: str = "line") -> DataFrame:
    """The five sections of pre-split papers; a missing one is empty."""
    parsed = rows.withColumn("__j", F.from_json(column, ", ".join(f"{s} string" for s in SECTIONS)))
    return parsed.select(*[c for c in rows.columns if c != column], *(F.coalesce(f"__j.{s}", F.lit("")).alias(s) for s in SECTIONS))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(_name(F.input_file_name()).alias("paper"), F.col("value").alias("line"))
    return parse_sections_json(raw)


def read_bundle(spark: SparkSession, folder: str, round_: int) -> DataFrame:
    """(type, round, locator, claim_quote, ...): the three claim files of a round; a file that isn't there holds no claims."""
    out = None
    for kind in ("citation", "numerical", "scope"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}_claims.jsonl")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = read_jsonl(spark, f"{folder}/{kind}_claims.jsonl", CLAIM).drop("path") if there else spark.createDataFrame([], CLAIM)
        rows = rows.select(F.lit(kind).alias("type"), F.lit(round_).alias("round"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
