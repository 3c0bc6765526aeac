"""Byte-level BPE through a sentencepiece model that is serialised here from a table of ranks.

Every byte stands as one printable character, every token as the piece of its bytes' characters, scored by
its negative rank; the normaliser changes nothing. Sentencepiece then joins, again and again, the leftmost
of the adjacent pairs with the best score, which is the merge order of the ranks. Each match of the pattern
is encoded by itself, a match that is a token as a whole is that token, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .cluster import columns_without, cut

REMEMBERED = 1 << 18
EMIT_BYTES = 1 << 20


def characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and no space, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def bytes_by_rank(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The token of each rank; None for a rank that no token has."""
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: a varint, a 32-bit float or a string of bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model of the ranks; piece k has rank k, and a piece for the unknown follows the last.

    Field numbers and values are those of the public sentencepiece_model.proto (fixed values).
    """
    normal, unknown, unused, bpe = 1, 2, 5, 2
    char, size = characters(), max(ranks.values(), default=-1) + 1
    tokens = {rank: token for token, rank in ranks.items()}
    pieces = []
    for rank in range(size):
        token = tokens.get(rank)
        name = "".join(char[b] for b in token) if token is not None else f"▁unused{rank}"
        pieces.append(_field(1, name.encode()) + _field(2, float(-rank)) + _field(3, normal if token is not None else unused))
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, size + 1) + _field(40, size) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Texts to token ids and back. Space in the pattern is Unicode's White_Space, as tiktoken has it."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(white_space(pattern)).findall
        self.table = {b: c for b, c in enumerate(characters())}
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, matches: set[str]) -> None:
        """Put the ids of matches that aren't known into the memory; sentencepiece gets them in one call."""
        rest, names = [], []
        for match in matches:
            raw = match.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[match] = (rank,)
            else:
                rest.append(match)
                names.append(raw.decode("latin-1").translate(self.table))
        if names:
            self.known.update(zip(rest, map(tuple, self.model.encode(names, num_threads=1))))

    def pieces(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of each match of the pattern. A memory of bounded size keeps what short matches give."""
        found = [self.find(text) for text in texts]
        out = [list(map(self.known.get, matches)) for matches in found]
        open_ = [i for i, ids in enumerate(out) if None in ids]
        missing = {match for i in open_ for match, ids in zip(found[i], out[i]) if ids is None}
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = {match for i in open_ for match in found[i]}
            self.learn(missing)
            for i in open_:
                out[i] = list(map(self.known.__getitem__, found[i]))
            for match in missing:
                if len(match) > 64:
                    del self.known[match]
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(ids)) for ids in self.pieces(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def count(self, texts: list[str]) -> list[int]:
        return [sum(map(len, ids)) for ids in self.pieces(texts)]


def white_space(pattern: str) -> str:
    r"""The pattern with \s and \S as White_Space; this engine's own class has four control characters more."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _with(batch: pa.RecordBatch, lo: int, hi: int, name: str, values: pa.Array) -> pa.RecordBatch:
    part = batch.slice(lo, hi - lo)
    return pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])


def _cuts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """The columns of docs and ``out``: the token ids of the whole text (array of int). Null counts as the empty text: no ids.

    Rows stay where they are. path must be readable on the executors. A column of docs named like ``out`` is replaced.
    """
    docs = columns_without(docs, [text_col], [out])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for b in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at)]
            for lo, hi in _cuts(sizes, EMIT_BYTES):
                ids = encoder.encode_all([text or "" for text in b.column(at).slice(lo, hi - lo).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield _with(b, lo, hi, out, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        del encoder
        arrays.trim()

    return docs.mapInArrow(run, _schema(docs, out, T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The columns of tokens and ``out``: the bytes that the ids stand for (binary). Null ids give null; an unknown id is an error. A column of tokens named like ``out`` is replaced."""
    tokens = columns_without(tokens, [ids_col], [out])
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(bytes_by_rank(load_ranks(path)), pa.large_binary())
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _cuts((4 * sizes).tolist(), EMIT_BYTES):
                rows = b.column(at).slice(lo, hi - lo)
                yield _with(b, lo, hi, out, _joined(table.take(rows.flatten()), sizes[lo:hi], rows.is_valid()))

    return tokens.mapInArrow(run, _schema(tokens, out, T.BinaryType()))


def _joined(tokens: pa.Array, sizes: np.ndarray, valid: pa.Array) -> pa.Array:
    """Runs of so many tokens each, joined; the tokens lie one after the other already, so only the bounds are new."""
    if tokens.null_count:
        raise ValueError("an id that no token has")
    ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1) if len(tokens) else np.zeros(1, np.int64)
    bounds = ends[np.cumsum(np.r_[0, sizes])].astype(np.int64)
    data = tokens.buffers()[2] if len(tokens) else pa.py_buffer(b"")
    joined = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.tobytes()), data])
    return pc.if_else(valid, joined, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """The columns of docs but the text, and ``out``: the number of token ids of the whole text (null: 0). A column of docs named like ``out`` is replaced."""
    docs = columns_without(docs, [text_col], [out])
    at = docs.columns.index(text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for b in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at)]
            counts = [n for lo, hi in _cuts(sizes, EMIT_BYTES) for n in encoder.count([x or "" for x in b.column(at).slice(lo, hi - lo).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), pa.array(counts, pa.int64())], [*(f.name for f in rest), out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))


def default_files() -> tuple[str, str]:
    """Path of the ranks and the pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def length_histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): the exact histogram of encoded lengths. Null and empty texts have length 0; an empty table has no rows."""
    return count_tokens(docs.select(text_col), path, pattern, text_col).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame, width: int = 1024) -> DataFrame:
    """For every length that occurs, taken as a context limit, exact sums from a histogram (length, n_docs).

    context_limit, n_docs (of that length), docs_within and tokens_within (of at most that length), docs_beyond,
    tokens_truncated (what is left where each document is cut at the limit) and quantile (share of documents
    within). Suffix sums are taken in two levels, within runs of ``width`` lengths and over the runs, so no
    task sees the whole histogram. The histogram, one row for each length, is written once, as both levels read it.
    """
    from pyspark.sql import Window

    h = cut(histogram).withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("run", F.floor(F.col("length") / width))
    runs = h.groupBy("run").agg(F.sum("n_docs").alias("run_docs"), F.sum("tokens").alias("run_tokens"))
    over = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    runs = runs.select("run", F.coalesce(F.sum("run_docs").over(over), zero).alias("docs_over"), F.sum("run_docs").over(every).alias("all_docs"), F.sum("run_tokens").over(every).alias("all_tokens"), F.coalesce(F.sum("run_tokens").over(over), zero).alias("tokens_over"))
    above = Window.partitionBy("run").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(runs, "run").withColumn("docs_beyond", F.col("docs_over") + F.coalesce(F.sum("n_docs").over(above), zero)).withColumn("tokens_beyond", F.col("tokens_over") + F.coalesce(F.sum("tokens").over(above), zero))
    within = F.col("all_docs") - F.col("docs_beyond")
    kept = F.col("all_tokens") - F.col("tokens_beyond")
    return h.select(F.col("length").alias("context_limit"), "n_docs", within.alias("docs_within"), kept.alias("tokens_within"), "docs_beyond", (kept + F.col("docs_beyond") * F.col("length")).alias("tokens_truncated"), (within / F.col("all_docs")).alias("quantile"))


def totals_at(totals: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, tokens_within, docs_beyond, tokens_truncated) for any limits, from context_totals: those of the longest length within, cut at the limit.

    A limit under all lengths truncates every document; without documents all are 0.
    """
    asked = totals.sparkSession.createDataFrame([(n,) for n in sorted(set(limits))], "asked long")
    zero = F.lit(0).cast("long")
    everything = totals.agg(F.max(F.col("docs_within") + F.col("docs_beyond")).alias("all_docs"))
    below = totals.select("context_limit", "docs_within", "tokens_within", "docs_beyond")
    last = F.max(F.when(F.col("context_limit") <= F.col("asked"), F.struct("context_limit", "docs_within", "tokens_within", "docs_beyond"))).alias("x")
    # The limits asked for are a short list; each row of the histogram meets all of them before a maximum that is combined at once.
    rows = below.withColumn("asked", F.explode(F.array(*(F.lit(n).cast("long") for n in sorted(set(limits)))))).groupBy("asked").agg(last)
    rows = asked.join(F.broadcast(rows), "asked", "left").withColumn("all_docs", F.lit(everything.first()[0] or 0).cast("long"))
    beyond = F.coalesce("x.docs_beyond", "all_docs")
    within = F.coalesce("x.tokens_within", zero)
    return rows.select(F.col("asked").alias("context_limit"), F.coalesce("x.docs_within", zero).alias("docs_within"), within.alias("tokens_within"), beyond.alias("docs_beyond"), (within + beyond * F.col("asked")).alias("tokens_truncated"))


def length_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length within which at least that share of the documents lies, from context_totals. No documents: no rows."""
    rows = totals.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares)))).where(F.col("quantile") >= F.col("share") - 1e-12)
    return rows.groupBy("share").agg(F.min("context_limit").alias("length"))
