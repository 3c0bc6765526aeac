"""Removal of repeated runs of lines: a suffix array over line-ID sequences by prefix doubling, with DataFrame operations only.

Every line that isn't blank and occurs more than once is given its ID, its rank among such lines. Round j ranks the sequences of
2 ** (j + 1) lines: a position's pair of ranks, its own and that of the position 2 ** j further on, is grouped, and
the groups are ranked in order of their pairs, so ranks keep the order of the sequences. A sequence that occurs once, or runs past its
document's end, is told apart from all others for good and leaves; rounds go on until none is left, when the order of all
suffixes is known as far as they have anything in common. Positions of one rank are neighbours in the suffix array, an
interval with a common prefix of at least 2 ** j lines; of 2 ** j <= n < 2 ** (j + 1) lines if they also have one rank n - 2 ** j lines on.

A run counts as repeated where it holds at least ``min_words`` words and also occurs earlier: where its position
is not the first of such an interval. A run is the union of its smallest windows of that many words, those smallest from a
start and those smallest to an end; as no line is without a word, such a window has at most ``min_words`` lines. So maximal
repeated runs come out whole, whatever their length; the longer intervals say how long they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import columns_without, cut_to_table, discard, join_skewed

MIN_WORDS = 10

_DOC = ["__id", "__d1", "__d2"]
_WORD = r"[^\x09-\x0d ]"


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__d1"), F.xxhash64(F.lit(1), text_col).alias("__d2")]


def _filled(text_col: str) -> Column:
    """(line, content) of the lines that aren't blank."""
    return F.filter(F.transform(F.split(text_col, "\n"), lambda c, i: F.struct(i.alias("line"), c.alias("content"))), lambda x: x["content"].rlike(_WORD))


def _ranked(rows: DataFrame, *names: str) -> DataFrame:
    """The combinations of names that occur more than once, ranked in their order."""
    groups = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return groups.orderBy(*names).withColumn("next", F.monotonically_increasing_id())


def line_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> list[DataFrame]:
    """For j = 0, 1, ... (__id, __d1, __d2, k, least, most, rank) of the positions whose 2 ** j lines occur elsewhere too, until there are none.

    k counts a document's lines that aren't blank; least and most are the lines of windows from there that are looked at: the
    smallest of ``min_words`` words, and up to that of the next line (or the end), which are smallest to their ends. Ranks are in the
    order of the sequences, in which IDs are ordered by digests of their lines. Rows equal in id and text count as one document.
    """
    parts = docs.where(F.col(text_col).isNotNull()).select(*_keys(id_col, text_col), F.posexplode(_filled(text_col)).alias("k", "x"))
    content = F.col("x.content")
    lines = parts.select(*_DOC, "k", F.least(F.regexp_count(content, F.lit(_WORD + "+")), F.lit(min_words)).alias("words"), F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"))
    lines = cut_to_table(lines)
    live = lines.join(_ranked(lines, "a", "b"), ["a", "b"]).drop("a", "b").withColumnRenamed("next", "rank")
    # Of rows equal in id and text, one stays.
    order = Window.partitionBy(*_DOC).orderBy("k")
    live = live.withColumn("again", F.lag("k").over(order).eqNullSafe(F.col("k"))).where("not again").drop("again")
    # Where a line between occurs once, so does a window across it, whatever these sums say.
    sums = [F.sum("words").over(order.rangeBetween(0, n - 1)) for n in range(1, min_words + 1)]
    live = live.withColumn("least", F.coalesce(*(F.when(x >= min_words, F.lit(n)) for n, x in enumerate(sums, 1))))
    following = F.first("least").over(order.rangeBetween(1, 1))
    live = live.withColumn("most", F.greatest("least", F.coalesce(following, F.lit(min_words)))).drop("words")
    levels = [cut_to_table(live)]
    discard(lines)
    while not levels[-1].isEmpty():
        half = 1 << (len(levels) - 1)
        pairs = levels[-1].withColumn("on", F.first("rank").over(order.rangeBetween(half, half))).where("on is not null")
        levels.append(cut_to_table(pairs.join(_ranked(pairs, "rank", "on"), ["rank", "on"]).select(*_DOC, "k", "least", "most", F.col("next").alias("rank"))))
    return levels[:-1]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __d1, __d2, ks, longest): lines (counted without blank ones) that lie in later copies of repeated runs, by id and text digests.

    Earlier means a smaller id (nulls first), then a smaller digest, then a smaller line number. longest is the number of lines, a power
    of two or the lines of a window, of the longest interval in which the document has a later copy.
    """
    levels = line_ranks(docs, id_col, text_col, min_words)
    order = Window.partitionBy(*_DOC).orderBy("k")
    at = F.struct(*_DOC, "k").alias("at")
    runs = None
    for j, live in enumerate(levels):
        half = 1 << j
        if half > min_words:
            found = live.select(at, F.lit(half).alias("n"), F.col("rank").alias("r1"), F.col("rank").alias("r2"))
        else:
            widths = range(half, min(2 * half - 1, min_words) + 1)
            ends = {f"r{n}": F.first("rank").over(order.rangeBetween(n - half, n - half)) for n in widths}
            due = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.col("rank").alias("r1"), F.col(f"r{n}").alias("r2")) for n in widths)), lambda w: w["r2"].isNotNull() & w["n"].between(F.col("least"), F.col("most")))
            found = live.withColumns(ends).select(at, F.inline(due))
        runs = found if runs is None else runs.unionByName(found)
    if runs is None:
        return docs.select(*_keys(id_col, text_col), F.array().cast("array<int>").alias("ks"), F.lit(0).alias("longest")).limit(0)
    runs = cut_to_table(runs.select("at", F.struct("n", "r1", "r2").alias("run")))
    first = runs.groupBy("run").agg(F.min("at").alias("first"), F.count("*").alias("uses")).where("uses > 1")
    later = join_skewed(runs, first.drop("uses"), "run", first.drop("first"), runs.count()).where(~F.col("at").eqNullSafe(F.col("first"))).withColumn("n", F.col("run.n"))
    covered = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("n") <= min_words, F.sequence(F.col("at.k"), F.col("at.k") + F.col("n") - 1)))))
    return later.groupBy("at.__id", "at.__d1", "at.__d2").agg(covered.alias("ks"), F.max("n").alias("longest"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs and: n_lines, removed (line numbers from 0, ordered), kept (the other lines, joined), longest (as in repeated_lines, 0 where nothing goes).

    One row for each row of docs. Lines part at line feeds; blank lines are never removed and don't break a run.
    Null text: n_lines 0, nothing removed, kept null. An empty text is one blank line. Where all is removed, kept is empty.
    Rows equal in id and text lose the same lines. Columns of docs named like the new ones are replaced.
    """
    docs = columns_without(docs, [id_col, text_col], ["n_lines", "removed", "kept", "longest"])
    found = repeated_lines(docs, id_col, text_col, min_words).select(F.col("__id").alias("__i"), F.col("__d1").alias("__1"), F.col("__d2").alias("__2"), "ks", F.col("longest").alias("__longest"))
    named = docs.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(_keys(id_col, text_col))))
    same = named["__k0"].eqNullSafe(found["__i"]) & (named["__k1"] == found["__1"]) & (named["__k2"] == found["__2"])
    some = F.size("ks") > 0
    filled = F.transform(_filled(text_col), lambda x: x["line"])
    gone = F.array_sort(F.transform("ks", lambda k: F.get(F.col("__filled"), k)))
    out = named.join(found, same, "left").withColumn("__filled", F.when(some, filled)).withColumn("__lines", F.when(some, gone))
    content = F.split(text_col, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(content) - 1), F.col("__lines"))
    kept = F.when(some, F.array_join(F.transform(stay, lambda i: F.get(content, i)), "\n")).otherwise(F.col(text_col))
    return out.select(
        *docs.columns,
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(content)).cast("long").alias("n_lines"),
        F.when(some, F.col("__lines")).otherwise(F.array().cast("array<int>")).alias("removed"),
        kept.alias("kept"),
        F.when(some, F.col("__longest")).otherwise(0).alias("longest"),
    )
