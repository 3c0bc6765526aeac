"""Rounds as streams: results that arrive for tasks, papers that pass through two waves of judging."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.judging import SECTION_PAIRS

#: Fixed: sections a paper is read in, before its pairs are compared.
WAVE_SECTIONS = 5
STATUS = "paper_id long, n_triples int, n_compares int, phase string"


def settle(tasks: DataFrame, results: DataFrame, wait: str = "1 hour") -> DataFrame:
    """(task_id, ts, body): tasks (task_id, ts) with the result (task_id, ts, body) that comes within ``wait``, or null once none can.

    Both are streams. Watermarks let the state of a task go when its time is over; a late result is one that is missing.
    """
    a = tasks.select("task_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", wait)
    b = results.select(F.col("task_id").alias("for_task"), F.col("ts").cast("timestamp").alias("came"), "body").withWatermark("came", wait)
    return a.join(b, F.expr(f"task_id = for_task and came >= ts and came <= ts + interval {wait}"), "leftOuter").select("task_id", "ts", "body")


def arrivals(results: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n, n_failed): results by window of their time; those that come after the watermark has passed are dropped."""
    rows = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed")).select("w.start", "n", "n_failed")


class Waves(StatefulProcessor):
    """A paper's progress: triples until every section has a reply, then compare until every pair has one, then done.

    The state holds the sections and pairs that have replied, a handful a paper, so that a reply that comes twice counts once. Each is
    forgotten after ``days``, if given.
    """

    def __init__(self, days: int | None = None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.days * 24 * 3600 * 1000 if self.days else None
        self.seen = handle.getMapState("seen", "wave string, part string", "n int", ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for wave, part in zip(batch["wave"], batch["part"]):
                self.seen.updateValue((wave, part), (1,))
        waves = [wave for wave, _ in self.seen.keys()]
        n, m = waves.count("triples"), waves.count("compare")
        phase = "triples" if n < WAVE_SECTIONS else "compare" if m < len(SECTION_PAIRS) else "done"
        yield pd.DataFrame({"paper_id": [key[0]], "n_triples": [n], "n_compares": [m], "phase": [phase]})

    def close(self) -> None:
        pass


def waves(replies: DataFrame, days: int | None = None) -> DataFrame:
    """(paper_id, n_triples, n_compares, phase) whenever replies (paper_id, wave, part) of a paper come in.

    With ``days`` the state expires by the clock, and batches run on without data: such a query doesn't end by itself.
    """
    return replies.groupBy("paper_id").transformWithStateInPandas(Waves(days), STATUS, "Update", "ProcessingTime" if days else "None")
