"""Writers of claims, tasks, reports, state and rounds. A round is a folder, written once unless it is forced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed: the fields of a task for a judge, as the judge's side reads them.
TASK = ["task_id", "verifier", "target_locator", "kind", "system", "user", "max_tokens", "temperature", "expected_format"]


class RoundExists(Exception):
    """The folder of a round is there already."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_jsonl(df: DataFrame, path: str) -> int:
    """df as JSON lines, over what was there; gives the number of rows, counted while they are written."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    fields = df.schema
    df.mapInArrow(count, fields).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.value


def write_tasks(tasks: DataFrame, path: str) -> int:
    return write_jsonl(tasks.select(*TASK), path)


def append_tasks(tasks: DataFrame, path: str) -> None:
    """Further tasks beside those that are there."""
    tasks.select(*TASK).write.mode("append").json(path)


def stream_tasks(tasks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Tasks as they come; the checkpoint makes each be written once."""
    return tasks.select(*TASK).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_json(rollup: DataFrame, targets: DataFrame, by: list[str], verifier: str) -> DataFrame:
    """(by, report): a JSON report for each group, status and severity from the roll-up, its targets in order of their locators.

    A group is a paper's round, which bounds what is gathered in a row.
    """
    listed = targets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("locator", "status", F.col("severity").alias("severity_suggestion"), "root_cause_key"))).alias("targets"))
    fields = F.struct(F.lit(verifier).alias("verifier_id"), "status", F.col("severity").alias("severity_suggestion"), F.coalesce("targets", F.array().cast(listed.schema["targets"].dataType)).alias("targets"))
    return rollup.join(listed, by, "left").select(*by, F.to_json(fields, {"pretty": "true"}).alias("report"))


def write_reports(reports: DataFrame, path: str, by: list[str]) -> None:
    """Reports (by, report) in a folder for each group, dealt out by group."""
    reports.repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)


def write_state(state: DataFrame, path: str) -> None:
    """State of an open round, over the last one."""
    state.write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state, or None where there is none."""
    where, fs = _files(spark, path)
    return spark.read.parquet(path) if fs.exists(where) else None


def open_round(spark: SparkSession, base: str, round_: int, force: bool = False) -> str:
    """The folder of a round. One that holds something is refused unless forced, and is then emptied."""
    path = f"{base}/round={round_}"
    where, fs = _files(spark, path)
    if fs.exists(where) and len(fs.listStatus(where)):
        if not force:
            raise RoundExists(path)
        fs.delete(where, True)
    fs.mkdirs(where)
    return path


def snapshot(manuscripts: DataFrame, folder: str) -> None:
    """The manuscripts of a round as they were checked."""
    manuscripts.write.mode("errorifexists").parquet(f"{folder}/snapshot")


def write_preflight(checks: DataFrame, folder: str) -> int:
    return write_jsonl(checks, f"{folder}/preflight")


def skipped(spark: SparkSession, verifiers: list[str], reason: str) -> DataFrame:
    """(verifier_id, status, reason): a marker for each verifier that isn't run."""
    return spark.createDataFrame([(v, "skipped", reason) for v in verifiers], "verifier_id string, status string, reason string")


def notes(*parts: Column) -> Column:
    """Notes joined by a bar; null and empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " | ")
