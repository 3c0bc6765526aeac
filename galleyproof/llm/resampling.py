"""Quality classifier by importance resampling (Xie et al., 2023).

Two generative models of hashed n-grams, of target text (documents labelled good) and of raw text (all documents), give
each document a log weight: the sum over its n-grams of the log ratio of their probabilities. Documents are then
resampled without replacement by Gumbel top-k. N-grams are words, the first five and seven bytes of longer words, the shapes of tokens
(letters and digits as classes, runs as one), and a word five times in a row. What a document has said once it says
again, so repeats are worth less: the models count the documents that hold an n-gram, the sum takes one that
occurs n times 1 + log(n) times.

Both models are smoothed by ``PRIOR`` documents a bucket and normalised by the documents counted. Most n-grams are rare, and sums of their chance
deviations would grow with a text's length until they drown what tells texts apart. So the target model departs from the raw
one, to either side, as far as the evidence goes: a log ratio is multiplied by the probability that it isn't chance, from the
log likelihood ratio of the target count (Poisson) and prior odds of ``ODDS`` to one for chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .cluster import columns_without, cut_to_table
from .sharding import number_rows

BUCKET_BITS = 18
PRIOR = 1.0
ODDS = 1_000
BEGINNINGS = (5, 7)
#: Bytes of text whose n-grams are held at a time; a longer text alone.
CHUNK = 1 << 18
#: One in so many labelled rows is held out; documents as good as KEEP of the good ones among them are as many as are selected by default.
HELD_OUT, KEEP = 4, 0.985

_REPEAT = 7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def ngrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all n-grams of some texts, repeats included."""
    shift = np.uint64(64 - BUCKET_BITS)
    low = _LOWER[data]
    starts, ends, row = arrays.word_bounds(low, bounds, _WORD)
    h = arrays.span_hashes(low, starts, ends)
    rows, buckets = [row], [(h >> shift).astype(np.int64)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        rows.append(row[longer])
        buckets.append((arrays.mix(arrays.span_hashes(low, starts[longer], starts[longer] + size) + np.uint64(size)) >> shift).astype(np.int64))
    if len(h) > 4:
        again = row[4:] == row[:-4]
        for k in range(1, 5):
            again &= h[k : len(h) - 4 + k] == h[:-4]
        rows.append(row[4:][again])
        buckets.append(np.full(int(again.sum()), _REPEAT))
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] < 48) | _SPACE[shape[1:]]
    keep[bounds[:-1][bounds[:-1] < len(data)]] = True
    shape_bounds = np.r_[0, np.cumsum(keep)][bounds]
    shape = shape[keep]
    starts, ends, shape_row = arrays.word_bounds(shape, shape_bounds, ~_SPACE)
    rows.append(shape_row)
    buckets.append((arrays.mix(arrays.span_hashes(shape, starts, ends) + np.uint64(9)) >> shift).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


class Model(NamedTuple):
    """The log ratio of each bucket, and the log weight that all but 1 - KEEP of the held-out good documents reach."""

    weights: np.ndarray
    floor: float


def log_ratios(target: np.ndarray, raw: np.ndarray, target_docs: int, raw_docs: int) -> np.ndarray:
    """Of the probability of each bucket under the two models, from the documents that hold it."""
    if not target_docs:
        return np.zeros(len(target))
    expected = raw * (target_docs / raw_docs)
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    evidence = target * np.log(np.maximum(target, 1) / np.where(target > 0, expected, 1)) - target + expected
    return ratio / (1 + ODDS * np.exp(-np.minimum(evidence, 600)))


def log_weights(column, weights: np.ndarray) -> np.ndarray:
    """The log weight of each text: the sum of the weights of its n-grams, repeats damped."""
    data, offsets = arrays.buffers(column)
    out = np.zeros(len(offsets) - 1)
    for at, to, part, bounds in arrays.chunks(data, offsets, CHUNK):
        row, bucket = ngrams(part, bounds)
        heavy = np.flatnonzero(weights[bucket])
        pairs, times = np.unique(row[heavy] << BUCKET_BITS | bucket[heavy], return_counts=True)
        out[at:to] = np.bincount(pairs >> BUCKET_BITS, weights[pairs & ((1 << BUCKET_BITS) - 1)] * (1 + np.log(times)), to - at)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> Model:
    """The target model is of all good labelled documents but the held-out ones, the raw model of all documents.

    Labels are (id, quality, toxic); a document is good with quality 1 and toxic 0, and rows with a null are passed over; an id
    labelled twice is good if all its labels say so. Every text counts in the raw model, but equal ones (null and empty are
    equal) count once, by the labelled one of smallest id if there is any, or copies would pass for evidence. One in
    HELD_OUT labelled documents, by id hash, is left out of the target model; the good ones of these give the floor. Without
    documents, usable labels or good ones the ratios are 0 and the floor is minus infinity. Labels meet ids and hashes of texts
    only, in a shuffle; n-grams are shuffled once, by the text's hash.
    """
    marked = labels.select(F.col(id_col).alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    held = F.pmod(F.xxhash64(F.lit(HELD_OUT), "id"), F.lit(HELD_OUT)) == 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(1), text).alias("kb"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.buffers(b.column(2))
            for at, to, part, bounds in arrays.chunks(data, offsets, CHUNK):
                row, bucket = ngrams(part, bounds)
                pairs = np.unique(row << BUCKET_BITS | bucket)
                ends = np.searchsorted(pairs >> BUCKET_BITS, np.arange(to - at + 1))
                own = (pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
                lists = pa.array([own[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), lists], ["ka", "kb", "buckets"])
        arrays.trim()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a task: at most one row for each bucket, and the numbers of documents at bucket -1."""
        sums, size = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            lists = b.column(1).filter(b.column(0).fill_null(False)), b.column(1)
            size += len(lists[0]), len(lists[1])
            for k in range(2):
                sums[k] += np.bincount(np.frombuffer(b"".join(lists[k].to_pylist()), np.int32), minlength=1 << BUCKET_BITS)
        found = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[size[0], sums[0, found]]), pa.array(np.r_[size[1], sums[1, found]])], ["bucket", "target", "raw"])
        arrays.trim()

    texts = named.select("ka", "kb", "text").mapInArrow(read, "ka long, kb long, buckets binary").groupBy("ka", "kb").agg(F.min("buckets").alias("buckets"))
    labelled = named.select("id", "ka", "kb").join(marked, "id").groupBy("ka", "kb").agg(F.min(F.struct("id", (F.col("good") & ~held).alias("good"))).alias("x"))
    kept = texts.join(labelled.select("ka", "kb", "x.good"), ["ka", "kb"], "left").select("good", "buckets")
    counts = kept.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros((2, 1 << BUCKET_BITS))
    size = [int(x) for x in counts[counts["bucket"] < 0][["target", "raw"]].sum()]
    counts = counts[counts["bucket"] >= 0]
    target[counts["bucket"]], raw[counts["bucket"]] = counts["target"], counts["raw"]
    weights = log_ratios(target, raw, *size)
    del counts
    arrays.trim()
    if not target.any():
        return Model(weights, -np.inf)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(log_weights(b.column(1), weights))], ["id", "log_weight"])
        arrays.trim()

    kind = docs.schema[id_col].dataType.simpleString()
    judged = named.where(held).select("id", "text").mapInArrow(judge, f"id {kind}, log_weight double")
    known, total = number_rows(judged.join(marked.where("good").select("id"), "id").select("log_weight"), "log_weight")
    if not total:
        return Model(weights, -np.inf)
    place = (total - 1) * (1 - keep)
    near = [r[0] for r in known.where(F.col("row").isin(int(np.floor(place)), int(np.ceil(place)))).orderBy("row").select("log_weight").collect()]
    return Model(weights, float(np.quantile(near, place % 1)))


def resample(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 0, carry: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those to ``carry``) and: log_weight, gumbel_key, selected.

    The k largest keys, log weight plus Gumbel noise, are selected, with all that tie with the k-th; by default k is the number
    of documents whose log weight reaches the model's floor. The noise is a function of the seed, the id and the text,
    so equal rows have equal keys. Null and empty texts have no n-grams and the weight 0. Texts are scored once; scored rows
    are written to the shared folder, and only keys are sorted. An empty table gives no rows; columns of docs named
    like the new ones are replaced.
    """
    docs = columns_without(docs, [id_col, text_col], ["log_weight", "gumbel_key", "selected"])
    carry = docs.columns if carry is None else carry
    at, stay = docs.columns.index(text_col), [docs.columns.index(c) for c in carry]
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 11).cast("double") + 0.5) / float(1 << 53)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(len(b.schema) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in stay), key, pa.array(log_weights(b.column(at), model.weights))], [*carry, "__noise", "log_weight"])
        arrays.trim()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    scored = docs.withColumn("__noise", -F.log(-F.log(uniform))).mapInArrow(score, f"{fields}, __noise double, log_weight double")
    scored = cut_to_table(scored.withColumn("gumbel_key", F.col("log_weight") + F.col("__noise")).drop("__noise"))
    if k is None:
        k = scored.where(F.col("log_weight") >= model.floor).count()
    ranked, total = number_rows(scored.select("gumbel_key"), F.desc("gumbel_key"))
    last = ranked.where(F.col("row") == min(k, total) - 1).select("gumbel_key").first() if k > 0 else None
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(last[0] if last else float("inf")))
