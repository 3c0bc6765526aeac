"""What a run depends on outside of Spark: keys, libraries, services; and a client for the latter."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Seconds a probe and a request may take, requests after the first, statuses that are answers and not faults.
PROBE_SECONDS, SECONDS, RETRIES, GONE = 5, 15, 2, (404, 410)

Get = Callable[[str, float], tuple[int, str]]


def http_get(url: str, seconds: float) -> tuple[int, str]:
    """Status and body; a status that isn't a success is returned, other faults are raised."""
    try:
        with urllib.request.urlopen(url, timeout=seconds) as reply:
            return reply.status, reply.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def probe(spark: SparkSession, keys: list[str] = (), libraries: list[str] = (), services: list[str] = (), get: Get = http_get) -> DataFrame:
    """(check, ok, note): whether environment variables are set, libraries can be imported and services answer, as seen from the driver."""
    rows = [(f"key {k}", bool(os.environ.get(k)), None) for k in keys]
    rows += [(f"library {x}", find_spec(x) is not None, None) for x in libraries]
    for url in services:
        try:
            status, _ = get(url, PROBE_SECONDS)
            rows.append((f"service {url}", status < 500, f"http {status}"))
        except (OSError, ValueError) as e:
            rows.append((f"service {url}", False, f"{type(e).__name__}: {e}"[:200]))
    return spark.createDataFrame(rows, "check string, ok boolean, note string")


def fetch(requests: DataFrame, url_col: str = "url", get: Get = http_get, retries: int = RETRIES, pause: float = 1.0) -> DataFrame:
    """The columns of requests and: status, body, error. A service that isn't there (404, 410) is an answer without a body.

    Other faults are tried again after a pause that grows with each, then told in error. Each distinct URL should come once: a task asks
    one at a time, and a task that is run again asks again. The catalogues that resolvers join are such results, stored.
    """
    def ask(url: str | None) -> tuple[int | None, str | None, str | None]:
        if not url:
            return None, None, "no url"
        error = ""
        for n in range(retries + 1):
            if n:
                time.sleep(pause * n)
            try:
                status, body = get(url, SECONDS)
                if status in GONE:
                    return status, None, None
                if status < 400:
                    return status, body, None
                error = f"http {status}"
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"[:200]
        return None, None, error

    at = requests.columns.index(url_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(u) for u in b.column(at).to_pylist()]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "status", "body", "error"])

    return requests.mapInArrow(run, f"{fields}, status int, body string, error string")
