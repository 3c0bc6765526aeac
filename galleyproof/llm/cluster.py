"""Helpers for jobs of several rounds: cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder named in spark.checkpoint.dir, so that a lost executor costs no recomputation.

    Where a session on one machine names no folder (tests), a temporary one is set; on a cluster that is an error.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The shared folder."""
    context = spark.sparkContext
    if not (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): a hub's neighbours are never gathered into
    one row, each round being a minimum with map-side combining and a join that can be split when skewed.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
        joined = both.join(low, both.a == low.hub)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select(F.col("hub").alias("a"), F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.select("a", "b").where("a <> b").distinct())
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = cut(star(star(now, True), False))
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def cut_to_table(df: DataFrame) -> DataFrame:
    """Like cut, for wide rows: written as Parquet to a table of its own in the shared folder, and read again.

    The tables of an application lie together and stay, as results may still read them, until discard() or drop_tables().
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _tables(spark: SparkSession) -> str:
    return f"{folder(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut_to_table that nothing reads any more: what came of them has been written itself."""
    for t in tables:
        _delete(t.sparkSession, t._table)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have written. Results that still read them must have been stored before."""
    _delete(spark, _tables(spark))


def join_skewed(left: DataFrame, right: DataFrame, key: str, uses: DataFrame, rows: int) -> DataFrame:
    """left joined with right, whose keys are unique, by key; rows of a hot key are dealt to several tasks.

    uses has (key, uses), the rows of left by key, for at least the hot keys; rows is the number of rows of left. A key is hot
    from the larger of 1,000 and a 50,000th of the rows on, so at most 50,000 keys are broadcast.
    """
    limit = max(1_000, rows // 50_000)
    hot = F.broadcast(uses.where(F.col("uses") > limit).select(F.col(key).alias("__hot"), F.ceil(F.col("uses") / limit).cast("int").alias("__salts")))
    salt = F.pmod(F.xxhash64(*(left[c] for c in left.columns)), F.col("__salts")).cast("int")  # of the row, so that it is the same when a task is run again
    salted = left.join(hot, left[key] == F.col("__hot"), "left").withColumn("__salt", F.coalesce(salt, F.lit(0))).drop("__hot", "__salts")
    copies = right.join(hot, right[key] == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0))))).drop("__hot", "__salts")
    return salted.join(copies, [key, "__salt"]).drop("__salt")


def columns_without(docs: DataFrame, needed: list[str], new: list[str]) -> DataFrame:
    """docs without the columns that an operator makes itself, and without the names it uses inside (they begin with two underscores)."""
    taken = {n.lower() for n in new}
    if clash := [n for n in needed if n.lower() in taken]:
        raise ValueError(f"columns that are read can't be named like results: {clash}")
    return docs.select(*(f"`{n}`" for n in docs.columns if n in needed or n.lower() not in taken and not n.startswith("__")))


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "2m") -> None:
    """Smaller Arrow batches in this session from here on, as plans read the setting when they run: a batch is held by the JVM and by Python, in several copies, for each running task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only finished steps refer to; Spark deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
