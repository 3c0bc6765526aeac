"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012).

Vectors are cut in two halves, each half quantised by a codebook of its own; a pair of centroids is a cell. A
query visits cells by the sum of its squared distances to both centroids, from a heap, until they hold
enough entries, which are then ranked by their exact distances. How many are enough is learnt with the codebooks: the share
of the entries that rows of the sample must read to find the wanted part of their nearest ones, which is small where vectors cluster.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut

CENTROIDS = 128
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 400
LLOYD_ROUNDS = 12
RECALL = 0.95
BLOCK = 4_096


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Lloyd's centroids of x, begun with rows spread over it; deterministic."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(7).permutation(len(x))[:size]].copy()
    for _ in range(LLOYD_ROUNDS):
        near = _squares(x, c).argmin(1)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return c


def share_for(x: np.ndarray, books: list[np.ndarray], k: int, recall: float) -> float:
    """The share of the entries x, in the order of their cells, that a query must read to find ``recall`` of its k nearest ones."""
    if recall >= 1 or len(x) <= k + 1:
        return 1.0
    half = len(books[0][0])
    cells = [_squares(part, book).argmin(1) for part, book in zip((x[:, :half], x[:, half:]), books)]
    places = []
    for i in np.random.default_rng(11).permutation(len(x))[:SAMPLE_QUERIES]:
        d = _squares(x[i : i + 1], x)[0]
        d[i] = np.inf
        cell = sum(_squares(part[None], book)[0][c] for part, book, c in zip((x[i, :half], x[i, half:]), books, cells))
        places.append(np.searchsorted(np.sort(cell), cell[np.argpartition(d, k)[:k]], "right") / len(x))
    return float(np.quantile(np.concatenate(places), recall, method="higher"))


def visit(near: list[np.ndarray], counts: np.ndarray, wanted: int) -> np.ndarray:
    """The cells (first, second) that a query visits: by growing sum of distances, until they hold ``wanted`` entries."""
    a, b = (np.argsort(d, kind="stable") for d in near)
    da, db = near[0][a].tolist(), near[1][b].tolist()
    table = counts[np.ix_(a, b)].tolist()
    heap, held, out = [(da[0] + db[0], 0, 0)], 0, []
    reached = [0] * len(da)  # of each row of pairs, how many have been taken
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        if table[i][j]:
            out.append((a[i], b[j]))
            held += table[i][j]
        if i + 1 < len(da) and reached[i + 1] == j:
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < len(db) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
    return np.array(out, np.int64).reshape(-1, 2)


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def valid(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null or zero and has finite components only."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & ~bad & F.exists(vec_col, lambda x: x != 0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` its k nearest found among all other rows.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. The codebooks, and the
    share of entries that a query reads for ``recall`` (1: all, so results are exact), are fitted on at most ``sample_rows`` rows,
    those of smallest id hash; every row is indexed. In a larger table neighbours are nearer, so the share errs on the safe side.

    Null, zero, or not wholly finite vectors, rows with a null id, and vectors of another length than the sample's most common
    one (between which there is no distance) take no part. Rows that are equal in id and vector, or in one of them, are entries of their own, and
    only its own row is kept from a query; queries with one id give a list each. Of equal vectors only k + 1 rows, those of smallest ids, can
    be among the k nearest, so others are left out of the index, which changes no result. Vectors can be arrays of floats
    or doubles. An empty table gives no rows; other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    named = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    named = valid(named, "vec")
    sample = [r[0] for r in named.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").collect()]
    array = vectors.schema[vec_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, id {kind}, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.array([v for v in sample if len(v) == dim], np.float64)
    half = dim // 2
    books = [codebook(x[:, :half], centroids), codebook(x[:, half:], centroids)]
    named = named.where(F.size("vec") == dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _vectors(b.column(1))
            cells = [_squares(part, book).argmin(1).astype(np.int32) for part, book in zip((v[:, :half], v[:, half:]), books)] if len(v) else [np.zeros(0, np.int32)] * 2
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cells)], ["id", "vec", "key", "c1", "c2"])

    copies = Window.partitionBy("__a", "__b").orderBy("id")
    same = Window.partitionBy("__a", "__b", "id").orderBy("id")
    digested = named.withColumns({"__a": F.xxhash64("vec"), "__b": F.xxhash64(F.lit(1), "vec")})
    # The n-th of the rows that are equal in id and vector has one key as an entry and as a query.
    key = F.xxhash64("id", "__a", "__b", "__n").alias("key")
    entries = digested.withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k + 1)
    entries = entries.withColumn("__n", F.row_number().over(same)).select("id", "vec", key)
    entries = cut(entries.mapInArrow(assign, f"id {kind}, vec {array}, key long, c1 int, c2 int"))
    queries = digested.where(F.col("id") % every == 0).withColumn("__n", F.row_number().over(same)).select("id", "vec", key)
    n_queries = queries.count()
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for c1, c2, n in entries.groupBy("c1", "c2").count().collect():  # at most centroids ** 2 rows
        counts[c1, c2] = n
    wanted = int(np.ceil(share_for(x, books, k, recall) * counts.sum()))
    blocks = np.maximum(1, -(-counts.sum(1) // BLOCK))
    lanes = max(1, -(-n_queries // BLOCK))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each first centroid and block of entries that a query visits, with a mask of the second centroids."""
        for b in batches:
            v = _vectors(b.column(1))
            for lo in range(0, len(v), 64):
                take, c1s, bs, masks = [], [], [], []
                for i in range(lo, min(lo + 64, len(v))):
                    near = [_squares(part[None], book)[0] for part, book in zip((v[i, :half], v[i, half:]), books)]
                    cells = visit(near, counts, wanted)
                    for c1 in np.unique(cells[:, 0]).tolist():
                        mask = np.zeros(len(books[1]), bool)
                        mask[cells[cells[:, 0] == c1, 1]] = True
                        for block in range(int(blocks[c1])):
                            take.append(i)
                            c1s.append(c1)
                            bs.append(block)
                            masks.append(np.packbits(mask).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), b.column(1).take(pa.array(take, pa.int64())), pa.array(c1s, pa.int32()), pa.array(bs, pa.int32()), pa.array(masks, pa.binary()), b.column(2).take(pa.array(take, pa.int64()))], ["query_id", "query", "c1", "block", "mask", "key"])

    block_of = F.element_at(F.array(*(F.lit(int(n)) for n in blocks)), F.col("c1") + 1)
    cells = entries.withColumn("block", F.pmod(F.col("key"), block_of).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    asked = queries.mapInArrow(probe, f"query_id {kind}, query {array}, c1 int, block int, mask binary, key long").withColumn("lane", F.pmod(F.shiftright("key", 20), F.lit(lanes)).cast("int"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        q, found = left.combine_chunks(), []
        empty = {"query_id": [], "key": [], "id": [], "score": []}
        if q.num_rows and right.num_rows:
            right = right.combine_chunks()
            e, ids, own = _vectors(right["vec"].combine_chunks()), right["id"].to_numpy(), right["key"].to_numpy()
            c2, norms = right["c2"].to_numpy(), (e * e).sum(1)
            qv, qid, masks = _vectors(q["query"].combine_chunks()), q["query_id"].to_numpy(), q["mask"].to_pylist()
            keys = q["key"].to_numpy()
            for lo in range(0, len(qv), 128):
                rough = norms[None] - 2 * qv[lo : lo + 128] @ e.T
                for i in range(lo, min(lo + 128, len(qv))):
                    mask = np.unpackbits(np.frombuffer(masks[i], np.uint8)).astype(bool)
                    may = np.flatnonzero(mask[c2] & (own != keys[i]))
                    if len(may) > k:
                        r = rough[i - lo, may]
                        may = may[r <= np.partition(r, k - 1)[k - 1] + 1e-6 * (1 + np.abs(r).max())]
                    d = np.sqrt(((e[may] - qv[i]) ** 2).sum(1))
                    best = np.lexsort((ids[may], d))[:k]
                    found += [(qid[i], keys[i], ids[may[t]], d[t]) for t in best]
        return pa.table(dict(zip(empty, map(list, zip(*found)))) if found else empty, schema=pa.schema([("query_id", left.schema.field("query_id").type), ("key", pa.int64()), ("id", left.schema.field("query_id").type), ("score", pa.float64())]))

    near = asked.groupBy("c1", "block", "lane").cogroup(cells.groupBy("c1", "block", "lane")).applyInArrow(rerank, f"query_id {kind}, key long, id {kind}, score double")
    top = Window.partitionBy("query_id", "key").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
